"""Structured Streaming over files: windows with watermarks, duplicates, sessions and state of one's own.

Every function takes a streaming (or batch) frame with an event time and gives the transformed frame; ``run_to_table`` runs a
stream over all that is there and gives its result as a table. State and results lie in the shared folder, so a query that is
started again goes on where it stopped. Rows with a null event time, or later than the watermark, are dropped by a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import new_path


def read(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or a single file, with the schema of ``like``."""
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that Spark doesn't take it for the folder above partitions
    r = spark.readStream.schema(like.schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates per window of equal width and keys."""
    w = df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in w.columns if c != "window"])


def sliding(df: DataFrame, time: str, width: str, step: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates per overlapping window and keys."""
    w = df.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(*aggregates)
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in w.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column, late: str = "1 hour") -> DataFrame:
    """Aggregates per session: events of equal keys with no gap of the given length between them."""
    w = df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return w.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in w.columns if c != "session_window"])


def without_duplicates(df: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of every key; state is kept for as long as a repeat may come."""
    df = df.withWatermark(time, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the number of rows and their summed value so far, by state of one's own (one row per key and batch)."""

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n += len(b)
            total += float(b[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(df.dtypes)[key]
    return df.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str, name: str = "stream") -> DataFrame:
    """Run a stream over everything there is, then give its result: for mode ``complete`` the last state, else all rows that came
    out (for ``update`` the versions of a row, with their ``batch``)."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")

    def sink(df: DataFrame, batch: int) -> None:
        x = df if mode == "append" else df.withColumn("batch", F.lit(batch).cast("long"))
        # A batch that is run again overwrites its own folder: each row stands once.
        x.write.mode("overwrite").parquet(f"{out}/b={0 if mode == 'complete' else batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(out).drop("b")


def run_to_files(stream: DataFrame, fmt: str = "parquet", name: str = "stream-files", partition_by: Sequence[str] = ()) -> str:
    """Run a stream over everything there is into files of a format, by Spark's own file sink: every row once, even if a batch is
    run again. Gives the folder; a plain read of it sees only files of finished batches."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    w = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
    q = (w.partitionBy(*partition_by) if partition_by else w).start(out)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out
