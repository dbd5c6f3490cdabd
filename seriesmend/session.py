"""Spark session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def require_utc(spark: SparkSession) -> None:
    """Times without a zone are read as UTC; another session zone would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}")


def local_session(threads: str = "8", **conf) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use your own.

    The session time zone must be UTC: times are stored without a zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("seriesmend")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # small local tables still use all threads after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        # a session that repeats many different queries keeps their compiled stages
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
