"""Corrections: what happens to the value of a selected row.

A correction maps the current value Column and its parameters to a new value, so
it costs no shuffle; only formulas that summarise the selection add one grouped
aggregate per nesting level.  New corrections are added with
``register_correction``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seriesmend.functions import ieee
from seriesmend.functions.formula import Formula, compile_formula
from seriesmend.model import SeriesSpec, join_on_key
from seriesmend.operators.medians import exact_median
from seriesmend.plans.blocks import profile
from seriesmend.plans.staging import stage


@dataclass(frozen=True)
class Param:
    """One parameter: its type, default and allowed values."""

    name: str
    type: str  # "float", "int", "optional_float", "enum" or "expr"
    default: object = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Correction:
    """``new_value(current, params)`` for the selected rows.

    ``rows(current, params)`` is set for a correction that picks its own rows and
    needs no selection.
    """

    id: str
    new_value: Callable[[Column, dict], Column | Formula]
    params: tuple[Param, ...] = ()
    rows: Callable[[Column, dict], Column] | None = None

    @property
    def needs_selection(self) -> bool:
        return self.rows is None

    def settings(self, given: dict | None) -> dict:
        return checked_settings(self.id, self.params, given)


def _checked(owner: str, param: Param, value):
    if param.type == "optional_float":
        return None if value is None else float(value)
    if param.type in ("float", "int"):
        return float(value) if param.type == "float" else int(value)
    if param.choices and value not in param.choices:
        raise ValueError(f"{owner}: unknown {param.name}: {value}")
    return value


def checked_settings(owner: str, params: tuple[Param, ...], given: dict | None) -> dict:
    """Defaults filled in, types converted, unknown names and choices refused."""
    given = dict(given or {})
    unknown = set(given) - {p.name for p in params}
    if unknown:
        raise ValueError(f"{owner}: unknown parameter {sorted(unknown)}")
    return {p.name: _checked(owner, p, given.get(p.name, p.default)) for p in params}


CORRECTIONS: dict[str, Correction] = {}


def register_correction(correction: Correction) -> Correction:
    CORRECTIONS[correction.id] = correction
    return correction


# --- built-in corrections ----------------------------------------------------


def _missing(current: Column) -> Column:
    return F.lit(None).cast("double")


def _constant(current: Column, value: float) -> Column:
    return ieee.to_missing(F.lit(float(value)))


def _shifted(current: Column, amount: float) -> Column:
    return ieee.to_missing(current + float(amount))


def _scaled(current: Column, factor: float) -> Column:
    return ieee.to_missing(current * float(factor))


# Ids, parameter names, choices and defaults of the built-in corrections.
register_correction(Correction("delete", lambda v, p: _missing(v)))
register_correction(
    Correction("replace", lambda v, p: _constant(v, p["value"]), (Param("value", "float", 0.0),))
)
register_correction(
    Correction("offset", lambda v, p: _shifted(v, p["amount"]), (Param("amount", "float", 0.0),))
)
register_correction(
    Correction("multiply", lambda v, p: _scaled(v, p["factor"]), (Param("factor", "float", 1.0),))
)
register_correction(
    Correction("expression", lambda v, p: compile_formula(p["expr"], v), (Param("expr", "expr", "x"),))
)

ACTIONS: dict[str, Callable[[Column, dict], Column | Formula]] = {
    "delete": lambda v, p: _missing(v),
    "replace": lambda v, p: _constant(v, p["replace_value"]),
    "offset": lambda v, p: _shifted(v, p["offset_amount"]),
    "multiply": lambda v, p: _scaled(v, p["factor"]),
    "expression": lambda v, p: compile_formula(p["expr"], v),
}


def _within(current: Column, params: dict) -> Column:
    inside = F.lit(True)
    if params["min"] is not None:
        inside = inside & (current >= params["min"])
    if params["max"] is not None:
        inside = inside & (current <= params["max"])
    return inside


def _threshold_rows(current: Column, params: dict) -> Column:
    present = current.isNotNull() & ~F.isnan(current)
    inside = _within(current, params)
    return present & (inside if params["mode"] == "inside" else ~inside)


register_correction(
    Correction(
        "threshold",
        lambda v, p: ACTIONS[p["action"]](v, p),
        (
            Param("min", "optional_float"),
            Param("max", "optional_float"),
            Param("mode", "enum", "outside", ("outside", "inside")),
            Param("action", "enum", "delete", tuple(ACTIONS)),
            Param("replace_value", "float", 0.0),
            Param("offset_amount", "float", 0.0),
            Param("factor", "float", 1.0),
            Param("expr", "expr", "x"),
        ),
        rows=_threshold_rows,
    )
)


# --- applying ----------------------------------------------------------------


def _summary_table(selected: DataFrame, keys: tuple[str, ...], summaries) -> DataFrame:
    """One row per series with every summary of one nesting level."""
    arguments = selected.select(*keys, *[s.argument.alias(s.name) for s in summaries])
    poisoned = [F.max(F.isnan(F.col(s.name))).alias(f"_nan{s.name}") for s in summaries]
    reducers = {"mean": F.avg, "std": F.stddev_pop}
    plain = [
        reducers[s.reducer](s.name).alias(s.name) for s in summaries if s.reducer in reducers
    ]
    table = arguments.groupBy(*keys).agg(*plain, *poisoned)
    medians = [s for s in summaries if s.reducer == "median"]
    sizes = profile(arguments, keys) if medians else None
    for s in medians:
        present = arguments.select(*keys, ieee.to_missing(F.col(s.name)).alias(s.name))
        table = join_on_key(table, exact_median(present, keys, s.name, sizes), keys)
        table = table.withColumn(
            s.name, F.when(F.col(f"_nan{s.name}"), F.lit(ieee.NAN)).otherwise(F.col(s.name))
        )
    return table.select(*keys, *[s.name for s in summaries])


def attach_summaries(
    df: DataFrame,
    keys: tuple[str, ...],
    formula: Formula,
    where: Column,
    column: str,
    costly: bool = False,
) -> DataFrame:
    """Add the summary columns of ``formula``, taken over the rows where ``where`` holds.

    A summary has one row per series.  Medians, and values that a further summary
    goes on from, are written once.  The join is broadcast if the summary turns out
    to be small; otherwise it relies on the adaptive split of skewed keys.
    ``costly``: ``df`` is worth writing the selected values once.
    """
    if not formula.summaries:
        return df
    selected = df.filter(where).select(*keys, column)
    if costly:
        selected = stage(selected)
    levels = sorted({s.level for s in formula.summaries})
    for level in levels:
        batch = [s for s in formula.summaries if s.level == level]
        table = _summary_table(selected, keys, batch)
        if level != levels[-1] or any(s.reducer == "median" for s in batch):
            table = stage(table)
        if not keys:
            table = F.broadcast(table)   # one row
        df = join_on_key(df, table, keys)
        if level != levels[-1]:
            selected = join_on_key(selected, table, keys)
    return df


def corrected_values(
    df: DataFrame,
    spec: SeriesSpec,
    op: str,
    params: dict | None = None,
    where: Column | None = None,
    column: str | None = None,
    costly: bool = False,
) -> tuple[DataFrame, Column, Column]:
    """``(df, selected, new value)``; ``df`` may have gained summary columns."""
    correction = CORRECTIONS.get(op)
    if correction is None:
        raise ValueError(f"Unknown correction: {op}")
    settings = correction.settings(params)
    current = F.col(column or spec.value)
    if correction.needs_selection:
        if where is None:
            raise ValueError(f"{op} needs a selection")
        selected = where
    else:
        selected = correction.rows(current, settings)
    selected = F.coalesce(selected, F.lit(False))
    new = correction.new_value(current, settings)
    if isinstance(new, Formula):
        df = attach_summaries(df, spec.keys, new, selected, column or spec.value, costly)
        new = ieee.to_missing(new.value)
    return df, selected, new


def correct(
    df: DataFrame,
    spec: SeriesSpec,
    op: str,
    params: dict | None = None,
    where: Column | None = None,
    column: str | None = None,
    costly: bool = False,
) -> DataFrame:
    """``df`` with ``column`` (default: the value column) corrected in place."""
    column = column or spec.value
    columns = df.columns
    df, selected, new = corrected_values(df, spec, op, params, where, column, costly)
    return df.withColumn(column, F.when(selected, new).otherwise(F.col(column))).select(*columns)


def correction_patch(
    df: DataFrame,
    spec: SeriesSpec,
    op: str,
    params: dict | None = None,
    where: Column | None = None,
    column: str | None = None,
    costly: bool = False,
) -> DataFrame:
    """The selected rows only: row key, ``old_value``, ``new_value``."""
    column = column or spec.value
    df, selected, new = corrected_values(df, spec, op, params, where, column, costly)
    return df.filter(selected).select(
        *spec.row_key, F.col(column).alias("old_value"), new.alias("new_value")
    )


def mark_rows(df: DataFrame, spec: SeriesSpec, rows: DataFrame, name: str = "_picked") -> DataFrame:
    """Flag the rows whose key is in ``rows`` (a frozen selection or candidates)."""
    picked = rows.select(*spec.row_key).distinct().withColumn(name, F.lit(True))
    return join_on_key(df, picked, spec.row_key).withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )
