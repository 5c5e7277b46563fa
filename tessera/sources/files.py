"""Reading and writing files: Parquet, ORC, CSV, JSON lines, text and XML, plus what a scan knows about its files.

Schemas are passed on where they are known, so no format is read twice to infer one. Empty tables keep their schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Options under which the text formats give back what was written (nulls apart from empty strings).
_ROUND_TRIP = {
    "csv": {"header": "true", "nullValue": "\\N", "quote": '"', "escape": '"', "multiLine": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "json": {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "xml": {"rowTag": "row", "rootTag": "rows"},
}
#: Formats that need a jar; they are passed on to Spark if it is there.
LAKEHOUSE = ("delta", "iceberg", "hudi", "avro")


def has_format(spark: SparkSession, name: str) -> bool:
    """Whether the session can read the format."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
        return True
    except Exception:  # noqa: BLE001
        return False


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write ``df``. With ``partition_by`` rows are first brought together by those columns as a rebalancing that adaptive
    execution sizes: small partitions share a task, a hot one is split into tasks of the advisory size, so there are few files
    per partition and none is one task's. ``sort_by`` orders rows within files, which lets readers skip row groups by their
    statistics."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.format(fmt).mode(mode).options(**(_ROUND_TRIP.get(fmt, {}) | options))
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def bucketed(df: DataFrame, path: str, by: Sequence[str], buckets: int) -> DataFrame:
    """``df`` as a bucketed and sorted table at ``path``, under a name of its own in the catalog: joins and aggregates by those columns
    need no shuffle, and an aggregate's partial and final step run in one stage."""
    name = f"tessera_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Read what ``save`` wrote, or any path of the format."""
    r = spark.read.format(fmt).options(**(_ROUND_TRIP.get(fmt, {}) | options))
    return (r.schema(schema) if schema is not None else r).load(path)


def with_file_facts(df: DataFrame) -> DataFrame:
    """A file scan's rows with the file's name, size, block and row index."""
    m = F.col("_metadata")
    return df.select("*", m["file_name"].alias("file_name"), m["file_size"].alias("file_size"), m["file_block_start"].alias("block_start"), m["row_index"].alias("row_index"), F.input_file_name().alias("file_path"), F.input_file_block_length().alias("block_length"))


def cache_data(df: DataFrame, columns: Sequence[str] = (), where: str | None = None, eager: bool = True) -> DataFrame:
    """Keep the columns and rows that later queries read in memory, spilling to disk; ``eager`` fills the cache at once."""
    df = df.where(where) if where else df
    df = (df.select(*columns) if columns else df).persist()
    if eager:
        df.count()
    return df
