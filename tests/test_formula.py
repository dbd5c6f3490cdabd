import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmend import SeriesSpec
from seriesmend.functions.formula import FormulaError, compile_formula
from seriesmend.operators.correct import correct

SPEC = SeriesSpec(("s",), ("i",), (), "x")
VALUES = [
    math.nan, math.inf, -math.inf, 0.0, 1.0, -1.0, 2.0, -2.0, 0.5, -0.5, 1.5, 2.5, -2.5,
    3.0, -7.0, 7.0, 1e300, 1e-9, 0.7, -0.3, 123456.789,
]

FORMULAS = [
    "x", "-x", "+x", "x + 1", "1 - x", "x * 3", "x / 4", "4 / x", "x / 0", "x % 3", "x % -3", "7 % x",
    "x % 0", "x // 3", "x // -3", "x // 0", "x ** 2", "2 ** x", "x ** 0.5", "x ** -1", "x ** 1", "x ** 3", "x ** -0.5", "x ** 0", "1 ** x", "x ** x",
    "x < 1", "x <= 1", "x > 1", "x >= 1", "x == 1", "x != 1", "(x > 0) + (x < 1)", "(x > 0) * (x < 1)",
    "(x > 0) * 5", "(x > 0) / 2", "np.abs(x)", "np.sqrt(x)", "np.exp(x)", "np.log(x)", "np.log2(x)",
    "np.log10(x)", "np.sin(x)", "np.cos(x)", "np.tan(x)", "np.arcsin(x)", "np.arccos(x)",
    "np.arctan(x)", "np.sinh(x)", "np.cosh(x)", "np.tanh(x)", "np.sign(x)", "np.floor(x)",
    "np.ceil(x)", "np.round(x)", "np.round(x, 2)", "np.round(x, -2)", "np.clip(x, -1, 2)",
    "np.clip(x, 2, -1)", "np.minimum(x, 1)", "np.maximum(x, 1)", "np.minimum(x, np.sqrt(x))",
    "np.where(x > 0, x, -1)", "np.where(x, 1, 2)", "np.where(np.isnan(x), -1, x)", "np.isnan(x)",
    "np.nan_to_num(x)", "np.nan_to_num(x, True, 7)", "np.nan_to_num(x, True, 7, 8, 9)",
    "np.mean(x)", "np.median(x)", "np.std(x)", "np.nanmean(x)", "np.nanmedian(x)", "np.nanstd(x)",
    "np.mean(np.nan_to_num(x, 1, 0, 5, -5), 0)", "np.median(np.clip(np.nan_to_num(x), -9, 9))",
    "np.std(np.clip(np.nan_to_num(x), -9, 9))", "np.sqrt(4) + 2", "5", "True", "np.mean(3)",
    "np.mean(x > 0)", "((x % 3) % 2 + x // 2) ** 2",
    "np.nanmean(np.abs(np.clip(x, -9, 9) - np.nanmean(np.clip(x, -9, 9))))",
    "np.floor(np.log(np.abs(x) + 1) * 10) / 10",
    "(x > 1) // (x > 2)", "(x > 1) % (x > 2)", "np.where(x > 1, 1, 0) // 0", "np.where(x > 1, 7, 3) % 0",
    "np.abs(x > 1) + (x > 2)", "(x > 0) // 2 + (x > 1) ** 2", "np.where(x > 1, -7, 3) // np.where(x > 0, 2, 0)",
    "np.where(x > 1, -7, 3) % -4", "np.maximum(x > 0, 3) // 0", "-np.where(x > 1, 2, 3) // 2", "x // (x > 0)",
    "np.round(np.where(x > 0, 5, 2)) % 3", "np.sign(np.where(x > 0, -5, 2)) // 0", "(x > 1) / (x > 2)",
]


@pytest.fixture(scope="module")
def xs(spark):
    rows = [("a", i, None if math.isnan(v) else v) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "s string, i int, x double").cache()


def same(a, b):
    if a is None or math.isnan(a):
        return b is None or math.isnan(b)
    return b is not None and (a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300))


def test_formulas_match_numpy(xs):
    """Every formula on every special value, against numpy's own evaluation."""
    frame, x = xs, np.array(VALUES)
    plain = [f for f in FORMULAS if not compile_formula(f, F.col("x")).summaries]
    columns = [compile_formula(f, F.col("x")).value.alias(f"f{i}") for i, f in enumerate(plain)]
    got = {r["i"]: r for r in frame.select("i", *columns).collect()}
    wrong = []
    for n, text in enumerate(plain):
        with np.errstate(all="ignore"):
            want = np.broadcast_to(np.asarray(eval(text, {"np": np, "x": x}), dtype=float), x.shape)
        wrong += [
            (text, VALUES[i], got[i][f"f{n}"], want[i])
            for i in range(len(VALUES))
            if not same(want[i], got[i][f"f{n}"])
        ]
    assert not wrong


@pytest.mark.parametrize(
    "text", [f for f in FORMULAS if any(w in f for w in ("mean", "median", "std"))]
)
def test_summaries_match_numpy(xs, text):
    x = np.array(VALUES)
    with np.errstate(all="ignore"):
        want = np.broadcast_to(np.asarray(eval(text, {"np": np, "x": x}), dtype=float), x.shape)
    fixed = correct(xs, SPEC, "expression", {"expr": text}, F.lit(True))
    got = {r["i"]: r["x"] for r in fixed.collect()}
    assert all(
        same(want[i], got[i]) or math.isclose(want[i], got[i], rel_tol=1e-9) for i in range(len(VALUES))
    ), (text, want, got)


def test_pairs_of_values(spark):
    values = [v for v in VALUES if not math.isnan(v)] + [math.nan]
    pairs = list(itertools.product(values, values))
    df = spark.createDataFrame(pairs, "a double, b double")
    from seriesmend.functions import ieee

    checks = {
        "divide": np.divide, "remainder": np.mod, "floor_divide": np.floor_divide,
        "power": np.power, "minimum": np.minimum, "maximum": np.maximum,
    }
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", *[getattr(ieee, n)(a, b).alias(n) for n in checks]).collect()
    left, right = np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])
    with np.errstate(all="ignore"):
        wrong = [
            (n, r["a"], r["b"], r[n], want)
            for n, fn in checks.items()
            for r, want in zip(rows, fn(left, right))
            if not same(want, r[n])
        ]
    assert not wrong


@pytest.mark.parametrize(
    "text",
    [
        "np.radians(x)", "1 if x > 0 else 0", "0 < x < 1", "exp(x)", "np.pi", "y", "x[0]",
        "np.round(x, decimals=1)", "'a'", "x &", "x and 1", "not x", "~x", "x & 1", "1j",
        "lambda: 1", "np.linalg.norm(x)", "x.sum()", "[x]", "x is 1", "",
    ],
)
def test_refused(text):
    with pytest.raises(FormulaError, match="Invalid expression"):
        compile_formula(text, F.col("x"))


@pytest.mark.parametrize("text", ["(x > 0) - (x < 1)", "-(x > 0)", "+(x > 0)", "np.sign(x > 0)", "np.clip(x)"])
def test_type_errors(text):
    with pytest.raises(TypeError):
        compile_formula(text, F.col("x"))


def test_constants_fail_on_the_driver():
    with pytest.raises(ZeroDivisionError):
        compile_formula("1 / 0", F.col("x"))


def test_deep_formula_stays_small(xs):
    """Nested remainders mention their operand several times, but are bound once."""
    text = "x" + "".join(f" % {k}" for k in (97, 89, 83, 79, 73, 71))
    column = compile_formula(text, F.col("x")).value
    assert xs.select(column.alias("r")).count() == len(VALUES)
    assert len(str(column._jc)) < 50_000
