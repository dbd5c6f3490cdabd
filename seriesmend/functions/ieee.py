"""Floating-point arithmetic with IEEE / array-library semantics as Columns.

Spark stores a missing reading as NULL; formulas are evaluated in the *NaN
domain* (``to_nan`` on the way in, ``to_missing`` on the way out), because
Spark orders NaN above every number, calls ``NaN = NaN`` true, returns NULL for
logarithms outside their domain and raises on division by zero.  Every function
here takes non-null double Columns and returns one, and stays inside generated
JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")
INF = float("inf")
MAX_DOUBLE = 1.7976931348623157e308
EXACT_INTEGERS = float(2**53)


def to_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def to_missing(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_double(flag: Column) -> Column:
    return F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    return (
        F.when(either_nan(a, b), F.lit(NAN))
        .when(b == 0, by_zero)
        .otherwise(F.try_divide(a, b))
    )


def _wrong_side(remainder: Column, b: Column) -> Column:
    return (remainder != 0) & ((remainder < 0) != (b < 0))


def remainder(a: Column, b: Column) -> Column:
    """Remainder that takes the sign of the divisor; NaN for a zero divisor."""
    r = F.coalesce(F.try_mod(a, b), F.lit(NAN))
    return F.when(_wrong_side(r, b), r + b).otherwise(r)


def floor_divide(a: Column, b: Column) -> Column:
    r = F.coalesce(F.try_mod(a, b), F.lit(NAN))
    exact = F.try_divide(a - r, b)
    q = F.when(_wrong_side(r, b), exact - 1).otherwise(exact)
    low = floor(q)
    snapped = F.when(q - low > 0.5, low + 1).otherwise(low)
    return F.when(b == 0, divide(a, b)).when(F.isnan(r), F.lit(NAN)).otherwise(snapped)


def power(a: Column, b: Column) -> Column:
    always_one = (a == 1) | ((a == -1) & (F.abs(b) == INF))
    return F.when(always_one, F.lit(1.0)).otherwise(F.pow(a, b))


def floor(a: Column) -> Column:
    return F.when(F.abs(a) < EXACT_INTEGERS, F.floor(a).cast("double")).otherwise(a)


def ceil(a: Column) -> Column:
    return F.when(F.abs(a) < EXACT_INTEGERS, F.ceil(a).cast("double")).otherwise(a)


def round_half_even(a: Column, digits: int = 0) -> Column:
    if digits == 0:
        return F.rint(a)
    scale = F.lit(float(10 ** abs(digits)))
    if digits > 0:
        return F.rint(a * scale) / scale
    return F.rint(a / scale) * scale


def minimum(a: Column, b: Column) -> Column:
    return F.when(either_nan(a, b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(either_nan(a, b), F.lit(NAN)).otherwise(F.greatest(a, b))


def _log(fn, a: Column) -> Column:
    return (
        F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(fn(a))
    )


def log(a: Column) -> Column:
    return _log(F.ln, a)


def log2(a: Column) -> Column:
    return _log(F.log2, a)


def log10(a: Column) -> Column:
    return _log(F.log10, a)


def replace_non_finite(a: Column, nan: Column, high: Column, low: Column) -> Column:
    return F.when(F.isnan(a), nan).when(a == INF, high).when(a == -INF, low).otherwise(a)


def less(a: Column, b: Column) -> Column:
    return ~either_nan(a, b) & (a < b)


def less_equal(a: Column, b: Column) -> Column:
    return ~either_nan(a, b) & (a <= b)


def equal(a: Column, b: Column) -> Column:
    return ~either_nan(a, b) & (a == b)


def not_equal(a: Column, b: Column) -> Column:
    return either_nan(a, b) | (a != b)


def is_finite(c: Column) -> Column:
    """True for a present, finite reading (NULL, NaN and infinities are false)."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INF)
