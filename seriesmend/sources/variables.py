"""Open columns as variables: a double reading, missing where it is not a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seriesmend.functions.ieee import to_missing
from seriesmend.model import named
from seriesmend.sources.tables import TEMPORAL_TYPES
from seriesmend.sources.timeaxis import epoch_micros


def reading(column: Column, dtype: T.DataType) -> Column:
    """Lenient cast to double; NaN and anything unreadable become NULL."""
    if isinstance(dtype, TEMPORAL_TYPES):
        return epoch_micros(column.cast("timestamp_ntz")).cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return to_missing(column.cast("double"))
    if isinstance(dtype, T.StringType):
        return to_missing(column.try_cast("double"))
    return F.lit(None).cast("double")


def open_variable(df: DataFrame, name: str, row_key: tuple[str, ...]) -> DataFrame:
    """Row key, ``raw`` and ``corrected`` (equal until something is corrected)."""
    value = reading(named(name), df.schema[name].dataType)
    return df.select(*row_key, value.alias("raw")).withColumn("corrected", F.col("raw"))


def unpivot_variables(
    df: DataFrame, variables: list[str], row_key: tuple[str, ...]
) -> DataFrame:
    """Long form of several variables: row key, ``variable``, ``raw``, ``corrected``."""
    readable = df.select(
        *row_key,
        *[reading(named(v), df.schema[v].dataType).alias(f"_sm_var_{i}") for i, v in enumerate(variables)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(f"_sm_var_{i}").alias("raw"))
            for i, v in enumerate(variables)
        ]
    )
    return readable.select(*row_key, F.inline(pairs)).withColumn("corrected", F.col("raw"))
