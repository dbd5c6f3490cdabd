"""How a table of readings is identified and ordered."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """Names the columns that identify, order and carry the readings.

    ``keys`` may be empty (the table is one series).  ``order_by`` + ``tiebreak``
    must give a total order inside a series; together with ``keys`` they are the
    row key.  Rows without a time are kept and come last.
    """

    keys: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ("ts",)
    tiebreak: tuple[str, ...] = ()
    value: str = "value"
    row_key: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = dict.fromkeys((*self.keys, *self.order_by, *self.tiebreak))
        object.__setattr__(self, "row_key", tuple(names))

    @property
    def ordering(self) -> list[Column]:
        return [F.col(c).asc_nulls_last() for c in (*self.order_by, *self.tiebreak)]


RESERVED = "_sm_"   # prefix of columns the library adds and drops again


def named(name: str) -> Column:
    """A column by its exact name, also with dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def refuse_reserved(columns) -> None:
    """Tables must leave the library's own column names alone."""
    clashing = [c for c in columns if c.lower().startswith(RESERVED)]
    if clashing:
        raise ValueError(f"columns may not begin with {RESERVED}: {clashing}")


def join_on_key(left: DataFrame, right: DataFrame, columns, how: str = "left") -> DataFrame:
    """Join on NULL-safe key equality, keeping the left copy of the key columns."""
    renamed = right.select(
        *[named(c).alias(f"_sm_r_{c}") for c in columns],
        *[named(c) for c in right.columns if c not in columns],
    )
    condition = F.lit(True)
    for c in columns:
        condition = condition & named(c).eqNullSafe(named(f"_sm_r_{c}"))
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_sm_r_{c}" for c in columns]) if how != "left_semi" else joined
