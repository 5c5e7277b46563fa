"""Giving small inputs enough tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan (with filters and projections at most) that yields fewer partitions than the cluster has cores, dealt out over
    all of them before costly work per row. Larger inputs are left alone: they are never shuffled for this."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)
