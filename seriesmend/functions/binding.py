"""Bind an expression to a name inside one Column.

Catalyst substitutes a projected expression wherever a later filter mentions it,
and again inside lambda bodies.  An expensive expression that is used several
times (a sorted window, an intermediate formula result) is therefore bound once
as the element of a one-element array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later filters read instead of repeating it.

    Unfolding a one-element array keeps the expression in generated code, and no
    filter moves below it.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
