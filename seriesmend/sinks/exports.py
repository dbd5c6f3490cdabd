"""What a save contains: changed cells only, the touched series, or the full table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.functions import ieee
from seriesmend.model import join_on_key, named

# Fixed values of the change test.
ABSOLUTE_TOLERANCE = 1e-9
RELATIVE_TOLERANCE = 1e-6


def changed(raw: Column, corrected: Column) -> Column:
    """True where the corrected value really differs from the raw one.

    The tolerance is relative to the corrected value.  Two missing values, and
    two equal infinities, are the same.
    """
    r, c = ieee.to_nan(raw), ieee.to_nan(corrected)
    # "=" holds for two NaN and for equal infinities; NaN is not below infinity
    close = (F.abs(c) < ieee.INF) & (
        F.abs(r - c) <= ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * F.abs(c)
    )
    return ~((r == c) | close)


def changed_cells(df: DataFrame, raw: str = "raw", corrected: str = "corrected") -> DataFrame:
    return df.filter(changed(F.col(raw), F.col(corrected)))


def diff_output(
    df: DataFrame, columns: tuple[str, ...], touched: dict[str, tuple[str, str]]
) -> DataFrame:
    """Rows where any touched variable changed; unchanged cells are missing.

    ``touched`` maps a variable to its (raw, corrected) columns in ``df``;
    ``columns`` (the time, and keys if any) are carried along.
    """
    if not touched:
        raise ValueError("there is no corrected variable to write")
    flags = {v: changed(named(raw), named(new)) for v, (raw, new) in touched.items()}
    any_changed = reduce(lambda a, b: a | b, flags.values())
    return df.filter(any_changed).select(
        *columns, *[F.when(flags[v], named(new)).alias(v) for v, (_, new) in touched.items()]
    )


def diff_output_long(df: DataFrame, row_key: tuple[str, ...], variables: list[str]) -> DataFrame:
    """The same from long form (``variable``, ``raw``, ``corrected``)."""
    cell = lambda v: F.max(F.when(F.col("variable") == v, F.col("corrected"))).alias(v)
    return changed_cells(df).groupBy(*row_key).agg(*[cell(v) for v in variables])


def series_output(
    df: DataFrame, columns: tuple[str, ...], touched: dict[str, str]
) -> DataFrame:
    """All rows: ``columns`` and the corrected value of every touched variable."""
    if not touched:
        raise ValueError("there is no corrected variable to write")
    return df.select(*columns, *[named(new).alias(v) for v, new in touched.items()])


def full_output(df: DataFrame, columns: list[str], touched: dict[str, str]) -> DataFrame:
    """All rows and ``columns``, the touched ones replaced by their corrected column."""
    return df.select(
        *[named(touched[c]).cast("double").alias(c) if c in touched else named(c) for c in columns]
    )


def merged_output(
    table: DataFrame, corrected: DataFrame, row_key: tuple[str, ...], variables: list[str]
) -> DataFrame:
    """An earlier full output with more variables replaced (its other fixes stay).

    ``corrected`` holds the row key and the variables.  Column order is kept.  Call
    ``check_same_rows`` first: a row without a partner would lose its values.
    """
    fresh = {v: f"_sm_new_{i}" for i, v in enumerate(variables)}
    renamed = corrected.select(
        *[named(k) for k in row_key], *[named(v).cast("double").alias(n) for v, n in fresh.items()]
    )
    joined = join_on_key(table, renamed, row_key)
    return joined.select(
        *[named(fresh[c]).alias(c) if c in fresh else named(c) for c in table.columns],
        *[named(n).alias(v) for v, n in fresh.items() if v not in table.columns],
    )


def check_same_rows(table: DataFrame, corrected: DataFrame, row_key: tuple[str, ...]) -> None:
    """Refuse to merge unless every row key is exactly once in both tables."""
    missing = [k for k in row_key if k not in table.columns]
    if missing:
        raise ValueError(f"the earlier output has no columns {missing} to tell its rows by; nothing was saved")
    keys = {k: f"_sm_key_{i}" for i, k in enumerate(row_key)}
    side = lambda df, old: df.select(*[named(k).alias(n) for k, n in keys.items()], F.lit(old).alias("_sm_old"))
    sides = side(table, 1).unionByName(side(corrected, 0)).groupBy(*keys.values()).agg(
        F.sum("_sm_old").alias("_sm_there"), F.sum(1 - F.col("_sm_old")).alias("_sm_here"))
    odd = sides.filter("_sm_there <> 1 OR _sm_here <> 1").agg(
        F.count(F.lit(1)).alias("keys"), F.sum(F.greatest("_sm_there", "_sm_here")).alias("rows")).first()
    if odd["keys"]:
        raise ValueError(
            f"{odd['keys']} row keys are not exactly once in both the earlier output and the loaded "
            "table; nothing was saved"
        )
