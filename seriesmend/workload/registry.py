"""Queries over the given tables, each next to the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmend.model import SeriesSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


# one series per event type
READINGS = SeriesSpec(("event_type",), ("ts",), ("event_id",))
BY_USER = SeriesSpec(("user_id",), ("ts",), ("event_id",))
# readings with repeated times
PRICES = SeriesSpec(("o_orderpriority",), ("o_orderdate",), ("o_orderkey",), "o_totalprice")
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")

# readings of one device setting are missing
GAP_SETTING = '{"k": 7}'
GAPPED_SQL = f"CASE WHEN props <> '{GAP_SETTING}' THEN value END"


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def gapped(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("props") != GAP_SETTING, F.col("value"))
    return table(spark, folder, "events").withColumn("value", value)
