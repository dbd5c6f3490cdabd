"""Corrections, thresholds and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmend.operators import select
from seriesmend.operators.correct import correct
from seriesmend.workload.registry import GAPPED_SQL, READINGS, gapped, query, readings
from seriesmend.workload.sources_and_selection import X0, X1, X_SQL


def _in_range(op, params=None):
    def build(spark, folder):
        where = select.x_range(F.col("ts"), X0, X1)
        return correct(gapped(spark, folder), READINGS, op, params, where).select(
            "event_id", F.col("value").alias("corrected")
        )

    return build


def _in_range_sql(new: str) -> str:
    return f"""SELECT event_id, CASE WHEN {X_SQL} THEN {new} ELSE value END AS corrected
               FROM (SELECT event_id, ts, {GAPPED_SQL} AS value FROM events)"""


query("correct_delete", _in_range_sql("NULL"))(_in_range("delete"))
query("correct_replace", _in_range_sql("12.5"))(_in_range("replace", {"value": 12.5}))
query("correct_offset", _in_range_sql("value + -3.25"))(_in_range("offset", {"amount": -3.25}))
query("correct_multiply", _in_range_sql("value * 1.8"))(_in_range("multiply", {"factor": 1.8}))
query(
    "correct_expression",
    _in_range_sql("CASE WHEN value > 50 THEN sqrt(value) ELSE value * 2 + 1 END"),
)(_in_range("expression", {"expr": "np.where(x > 50, np.sqrt(x), x * 2 + 1)"}))


def _threshold(**params):
    def build(spark, folder):
        return correct(gapped(spark, folder), READINGS, "threshold", params).select(
            "event_id", F.col("value").alias("corrected")
        )

    return build


def _threshold_sql(hit: str, new: str) -> str:
    return f"""SELECT event_id, CASE WHEN {hit} THEN {new} ELSE value END AS corrected
               FROM (SELECT event_id, {GAPPED_SQL} AS value FROM events)"""


query("threshold_outside_delete", _threshold_sql("value NOT BETWEEN 2 AND 120", "NULL"))(
    _threshold(min=2, max=120)
)
query("threshold_inside_replace", _threshold_sql("value BETWEEN 30 AND 40", "35.0"))(
    _threshold(min=30, max=40, mode="inside", action="replace", replace_value=35)
)
query("threshold_min_only", _threshold_sql("value < 2", "NULL"))(_threshold(min=2))
query("threshold_max_only", _threshold_sql("value > 120", "NULL"))(_threshold(max=120))
query("threshold_no_bounds", _threshold_sql("value IS NOT NULL", "value + 1"))(
    _threshold(mode="inside", action="offset", offset_amount=1)
)
query("threshold_offset", _threshold_sql("value > 120", "value + -100.0"))(
    _threshold(max=120, action="offset", offset_amount=-100)
)
query("threshold_multiply", _threshold_sql("value > 120", "value * 0.5"))(
    _threshold(max=120, action="multiply", factor=0.5)
)
query("threshold_expression", _threshold_sql("value > 120", "120 + (value - 120) / 4"))(
    _threshold(max=120, action="expression", expr="120 + (x - 120) / 4")
)


# --- formulas over every reading of a series -----------------------------------


def _formula(text: str, digits: int | None = None):
    def build(spark, folder):
        out = correct(gapped(spark, folder), READINGS, "expression", {"expr": text}, F.lit(True))
        value = F.col("value")
        if digits is not None:
            value = F.round(value, digits)
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # one zero, not two
        return out.select("event_id", value.alias("corrected"))

    return build


def _formula_sql(new: str, digits: int | None = None) -> str:
    """``x`` is NaN for a missing reading; a NaN result is missing."""
    value = "r" if digits is None else f"CASE WHEN round(r, {digits}) = 0 THEN 0 ELSE round(r, {digits}) END"
    return f"""SELECT event_id, CASE WHEN NOT isnan(r) THEN {value} END AS corrected
               FROM (SELECT event_id, event_type, CAST({new} AS DOUBLE) AS r FROM (
                 SELECT event_id, event_type, coalesce({GAPPED_SQL}, 'nan'::DOUBLE) AS x FROM events))"""


FORMULAS = {
    "expr_arith": ("-(x + 3) * 2 - x / 4", "-(x + 3) * 2 - x / 4", None),
    "expr_div_zero": (
        "(x - 35.5) / (np.floor(x) - 35)",
        """CASE WHEN isnan(x) THEN x WHEN floor(x) = 35 THEN
             CASE WHEN x > 35.5 THEN 'inf'::DOUBLE WHEN x < 35.5 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END
             ELSE (x - 35.5) / (floor(x) - 35) END""",
        None,
    ),
    "expr_mod_sign": (
        "(x - 50) % -7",
        """CASE WHEN isnan(x) THEN x WHEN (x - 50) % -7.0::DOUBLE > 0
             THEN (x - 50) % -7.0::DOUBLE - 7 ELSE (x - 50) % -7.0::DOUBLE END""",
        None,
    ),
    "expr_floor_div": (
        "(x - 50) // 7",
        """CASE WHEN isnan(x) THEN x ELSE floor((x - 50) / 7) END""",
        None,
    ),
    "expr_log_domain": (
        "np.log(x - 35) + np.log10(x) + np.log2(x)",
        """CASE WHEN isnan(x) OR x < 35 THEN 'nan'::DOUBLE WHEN x = 35 THEN '-inf'::DOUBLE
             ELSE ln(x - 35) + log10(x) + log2(x) END""",
        9,
    ),
    "expr_round_half_even": (
        "np.round(x * 10) + np.round(x, 1)",
        """(CASE WHEN x * 10 - trunc(x * 10) = 0.5 THEN 2 * round(x * 10 / 2) ELSE round(x * 10) END)
           + (CASE WHEN x * 10 - trunc(x * 10) = 0.5 THEN 2 * round(x * 10 / 2) ELSE round(x * 10) END) / 10""",
        9,
    ),
    "expr_clip_where": (
        "np.where(x > 100, np.clip(x, 120, 150), np.minimum(x, 40) + np.maximum(x, 20))",
        """CASE WHEN isnan(x) THEN x WHEN x > 100 THEN least(greatest(x, 120), 150)
             ELSE least(x, 40) + greatest(x, 20) END""",
        None,
    ),
    "expr_nan_compare": (
        "(x > 30) + (x != x)",
        "CASE WHEN isnan(x) OR x > 30 THEN 1 ELSE 0 END",
        None,
    ),
    "expr_compare_kinds": (
        "(x >= 20) * (x <= 80) + 2.0 * (x == 34.5) - (x < 10)",
        """CASE WHEN isnan(x) THEN 0 ELSE
             (CASE WHEN x >= 20 AND x <= 80 THEN 1 ELSE 0 END) + (CASE WHEN x = 34.5 THEN 2 ELSE 0 END)
             - (CASE WHEN x < 10 THEN 1 ELSE 0 END) END""",
        None,
    ),
    "expr_integer_kinds": (
        "(x > 30) // (x > 60) + np.where(x > 40, 7, 3) % 0 + (np.abs(x > 20) + (x > 50))",
        """CASE WHEN isnan(x) THEN 0 ELSE
             (CASE WHEN x > 60 THEN 1 ELSE 0 END) + (CASE WHEN x > 20 THEN 1 ELSE 0 END) END""",
        None,
    ),
    "expr_power": (
        "x ** 2 + x ** 0.5 + x ** 0",
        "CASE WHEN isnan(x) THEN x ELSE x * x + sqrt(x) + 1 END",
        6,
    ),
    "expr_trigonometry": (
        "np.sin(x) + np.cos(x) + np.tan(x / 400) + np.arcsin(x / 500) + np.arccos(x / 500) + np.arctan(x)",
        "sin(x) + cos(x) + tan(x / 400) + asin(x / 500) + acos(x / 500) + atan(x)",
        9,
    ),
    "expr_hyperbolic": (
        "np.sinh(x / 100) + np.cosh(x / 100) + np.tanh(x / 100) + np.exp(x / 100)",
        "sinh(x / 100) + cosh(x / 100) + tanh(x / 100) + exp(x / 100)",
        9,
    ),
    "expr_sign_floor_ceil": (
        "np.sign(x - 35) * np.floor(np.abs(x - 35)) + np.ceil(x)",
        "CASE WHEN isnan(x) THEN x ELSE sign(x - 35) * floor(abs(x - 35)) + ceil(x) END",
        None,
    ),
    "expr_nan_to_num": (
        "np.nan_to_num(x, 1, -1) + np.isnan(x) * 1000",
        "CASE WHEN isnan(x) THEN 999 ELSE x END",
        None,
    ),
    "expr_zscore": (
        "(np.nan_to_num(x) - np.mean(np.nan_to_num(x))) / np.std(np.nan_to_num(x))",
        """(CASE WHEN isnan(x) THEN 0 ELSE x END
            - avg(CASE WHEN isnan(x) THEN 0 ELSE x END) OVER (PARTITION BY event_type))
           / stddev_pop(CASE WHEN isnan(x) THEN 0 ELSE x END) OVER (PARTITION BY event_type)""",
        6,
    ),
    "expr_median_center": (
        "x - np.median(np.nan_to_num(x))",
        "x - median(CASE WHEN isnan(x) THEN 0 ELSE x END) OVER (PARTITION BY event_type)",
        9,
    ),
    "expr_nan_aggregates": (
        "np.nanmean(x) + np.nanmedian(x) + np.nanstd(x) + np.isnan(np.mean(x))",
        """avg(nullif(x, 'nan'::DOUBLE)) OVER w + median(nullif(x, 'nan'::DOUBLE)) OVER w
           + stddev_pop(nullif(x, 'nan'::DOUBLE)) OVER w
           + max(CASE WHEN isnan(x) THEN 1 ELSE 0 END) OVER w""".replace(
            "OVER w", "OVER (PARTITION BY event_type)"
        ),
        6,
    ),
}

for _name, (_text, _sql, _digits) in FORMULAS.items():
    query(_name, _formula_sql(_sql, _digits))(_formula(_text, _digits))

query(
    "expr_nested_aggregates",
    f"""WITH r AS (SELECT event_id, event_type, {GAPPED_SQL} AS v FROM events),
             m AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS d FROM r)
        SELECT event_id, round(avg(abs(d)) OVER (PARTITION BY event_type), 6) AS corrected FROM m""",
)(_formula("np.nanmean(np.abs(x - np.nanmean(x)))", 6))
