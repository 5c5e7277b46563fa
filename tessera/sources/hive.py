"""Tables of a Hive metastore: sessions with Hive support, tables of Hive's formats, and Hive's functions.

Whether a session has a Hive catalog is settled when it is made (``session`` makes one on one machine, with a metastore of its
own in a folder); on a cluster the session that is given has it or not (``available``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import CONF


def available(spark: SparkSession) -> bool:
    """Whether the session's catalog is a Hive metastore."""
    return spark.conf.get("spark.sql.catalogImplementation") == "hive"


def session(folder: str, cores: int = 2) -> SparkSession:
    """A local session with a metastore and a warehouse in ``folder``. No other session may run in the process."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tessera-hive").enableHiveSupport()
    b = b.config(map=CONF | {"spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    b = b.config("spark.hadoop.javax.jdo.option.ConnectionURL", f"jdbc:derby:;databaseName={folder}/metastore;create=true").config("spark.driver.extraJavaOptions", f"-Dderby.system.home={folder}")
    b = b.config("spark.hadoop.hive.exec.dynamic.partition.mode", "nonstrict")
    return b.getOrCreate()


def create(spark: SparkSession, name: str, df: DataFrame, stored_as: str = "PARQUET", partition_by: Sequence[str] = ()) -> None:
    """CREATE TABLE in one of Hive's formats (PARQUET, ORC, TEXTFILE ...), with the columns of ``df``."""
    plain = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in partition_by)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}` {t}' for c, t in df.dtypes if c in partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({plain}){parts} STORED AS {stored_as}")


def insert(spark: SparkSession, name: str, df: DataFrame, overwrite: bool = False) -> None:
    """INSERT INTO (or OVERWRITE) a table, columns by name; partitions of the rows' values are made or overwritten."""
    df.select(*spark.table(name).columns).write.insertInto(name, overwrite=overwrite)


def function(spark: SparkSession, name: str, java_class: str) -> None:
    """Make a Hive function (UDF, UDAF or UDTF) known to the session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} AS '{java_class}'")
