"""Listing folders as a job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from .paths import filesystem


def listing(spark: SparkSession, src: str) -> DataFrame:
    """The Parquet files below a folder: partition (the folder, seen from ``src``), name and length. Folders are listed by tasks,
    level by level, so neither names nor folders pass through the driver. Hidden names (as Spark takes them) are left out."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = filesystem(src)
        for b in batches:
            for folder in b["partition"]:
                rows = []
                for i in where.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    n = i.base_name
                    if n.startswith(".") or n.startswith("_") and "=" not in n:
                        continue
                    if i.type == fs.FileType.Directory:
                        rows.append((folder, n, -1))
                    elif n.endswith(".parquet"):
                        rows.append((folder, n, i.size))
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=["partition", "name", "length"])

    tasks = spark.sparkContext.defaultParallelism
    level, out = spark.createDataFrame([("",)], "partition string"), None
    while True:
        found = written(level.repartition(tasks).mapInPandas(go, "partition string, name string, length long"), "listing")
        out = found if out is None else out.unionByName(found)
        level = found.where("length < 0").select(F.ltrim(F.concat_ws("/", "partition", "name"), F.lit("/")).alias("partition"))
        if level.isEmpty():
            return out.where("length >= 0")
