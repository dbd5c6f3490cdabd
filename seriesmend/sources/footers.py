"""Row counts and value ranges of parquet tables from their footers.

The version 2 parquet reader answers counts, minima and maxima from the statistics in the
files' footers, so that no column is read.  It is used for one aggregate at a time: the
session's settings are put back afterwards.  Where footers cannot tell (a column without
statistics, as with NaN, or one of another kind), the table is read as usual.
"""

from __future__ import annotations

import contextlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from seriesmend.functions import ieee
from seriesmend.model import named
from seriesmend.sources.tables import find_time_column, variable_names

# what the reader keeps statistics of that it answers from
KINDS = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
SETTINGS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}


@contextlib.contextmanager
def footer_reader(spark: SparkSession):
    """Plan reads of parquet with the reader that answers from footers."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pushed(df: DataFrame) -> bool:
    """Whether an aggregate is answered from footers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PushedAggregation: [" in plan and "PushedAggregation: []" not in plan


def _answered(spark: SparkSession, path: str, aggregates) -> Row | None:
    with footer_reader(spark):
        df = spark.read.parquet(path).agg(*aggregates)
        if not pushed(df):
            return None
        try:
            return df.first()
        except (PySparkException, Py4JJavaError):   # statistics are missing in some file
            return None


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a parquet table."""
    row = _answered(spark, path, [F.count(F.lit(1)).alias("n")])
    # a table without rows gives no count
    return spark.read.parquet(path).count() if row is None else row["n"] or 0


def summary_from_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row, as ``table_summary``: number of rows and of variables."""
    table = spark.read.parquet(path)
    n = len(variable_names(table, find_time_column(table.schema)))
    return spark.createDataFrame([(count_rows(spark, path), n)], "rows long, variables int")


def ranges_from_footers(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Per variable the range of its finite values and the number of readings that are not null.

    Columns ``variable``, ``y_min``, ``y_max``, ``present``.  A variable whose footers say
    nothing, or whose range ends in an infinity, is read.
    """
    table = spark.read.parquet(path)
    known = [v for v in variables if isinstance(table.schema[v].dataType, KINDS)]
    aggregates = []
    for i, v in enumerate(known):
        aggregates += [F.min(named(v)).alias(f"a{i}"), F.max(named(v)).alias(f"b{i}"), F.count(named(v)).alias(f"n{i}")]
    told = _answered(spark, path, aggregates) if aggregates else None
    found = {}
    for i, v in enumerate(known if told is not None else []):
        # bool and date columns are no readings: they are read, as any other text would be
        if isinstance(table.schema[v].dataType, T.NumericType):
            ends = [None if told[k] is None else float(told[k]) for k in (f"a{i}", f"b{i}")]
            if all(e is None or abs(e) < float("inf") for e in ends):
                found[v] = (*ends, told[f"n{i}"] or 0)
    rest = [v for v in variables if v not in found]
    if rest:
        read = [named(v).try_cast("double") for v in rest]
        finite = [F.when(ieee.is_finite(y), y) for y in read]
        row = table.agg(*[f(c).alias(f"{n}{i}") for i, (c, v) in enumerate(zip(finite, rest))
                          for n, f in (("a", F.min), ("b", F.max))],
                        *[F.count(named(v)).alias(f"n{i}") for i, v in enumerate(rest)]).first()
        found |= {v: (row[f"a{i}"], row[f"b{i}"], row[f"n{i}"]) for i, v in enumerate(rest)}
    return spark.createDataFrame(
        [(v, *found[v]) for v in variables], "variable string, y_min double, y_max double, present long")
