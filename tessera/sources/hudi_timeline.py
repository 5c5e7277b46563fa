"""Copy-on-write tables in the open Hudi format, read by their timeline, without its jar.

Base files are named ``fileId_token_instant.parquet``; of each file group the latest one counts whose instant is completed, or lies
before the active timeline (what was archived was completed), unless a later commit replaced the group. Files are listed by tasks;
only the names of live ones reach the driver. Timelines of table versions up to 6 are covered; merge-on-read tables and newer
timelines are refused, never misread.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import listing

_INSTANT = re.compile(r"(\d{14,17})\.(commit|replacecommit|deltacommit)")


class Unsupported(ValueError):
    """The table uses a feature of the format that isn't covered."""


def _text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
    finally:
        s.close()


def instants(spark: SparkSession, path: str) -> dict[str, str]:
    """Completed instants of the active timeline, and what each is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/.hoodie")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return dict(sorted(m.groups() for s in found if (m := _INSTANT.fullmatch(s.getPath().getName()))))


def read(spark: SparkSession, path: str, instant: str | None = None, hidden: bool = False) -> DataFrame:
    """The rows as of an instant (the latest by default); ``hidden``: with the format's own columns."""
    path = path.rstrip("/")
    facts = dict(line.split("=", 1) for line in _text(spark, f"{path}/.hoodie/hoodie.properties").splitlines() if "=" in line and not line.startswith("#"))
    if facts.get("hoodie.table.type", "COPY_ON_WRITE") != "COPY_ON_WRITE" or int(facts.get("hoodie.table.version", "6")) > 6:
        raise Unsupported(f"{path}: {facts.get('hoodie.table.type')} of version {facts.get('hoodie.table.version')}")
    done = instants(spark, path)
    if "deltacommit" in done.values():
        raise Unsupported(f"{path}: log files")
    upto = instant or max(done, default="")
    if instant and instant not in done:
        raise FileNotFoundError(f"{path}: instant {instant}")
    seen = [t for t in done if t <= upto]
    gone = [(p, i) for t in seen if done[t] == "replacecommit" for p, ids in (json.loads(_text(spark, f"{path}/.hoodie/{t}.replacecommit")).get("partitionToReplaceFileIds") or {}).items() for i in ids]
    name = r"^(.+)_([^_]+)_(\d{14,17})\.parquet$"
    f = listing(spark, path).select("partition", "name", F.regexp_extract("name", name, 1).alias("group"), F.regexp_extract("name", name, 3).alias("at")).where("`group` <> ''")
    f = f.where(F.col("at").isin(seen) | (F.col("at") < min(done, default="")))
    if gone:
        f = f.join(spark.createDataFrame(gone, "partition string, `group` string"), ["partition", "group"], "left_anti")
    live = f.groupBy("partition", "group").agg(F.max_by("name", "at").alias("name")).collect()  # names of files
    if not live:
        raise FileNotFoundError(f"{path}: no file at {upto or 'any instant'}")
    df = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{r['partition']}/{r['name']}" for r in live])
    return df if hidden else df.select(*[c for c in df.columns if not c.startswith("_hoodie_")])
