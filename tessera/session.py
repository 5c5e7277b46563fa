"""Session defaults the engine is designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Semantics (ANSI off, UTC) and scale settings (AQE, skew joins, run-time filters).
CONF = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.orc.aggregatePushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_or_create(cores: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is given and ``configure`` it."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    for k, v in CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    b = b.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    b = b.config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the run-time part of CONF on a session made elsewhere; sizes and partitions are left as the cluster set them."""
    for k, v in CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark
