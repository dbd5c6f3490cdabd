"""Formulas over ``x`` compiled to Spark Columns.

The text is read by Python's own ``ast`` module; every accepted node becomes a
Column, so a formula runs inside the same JVM stage as the rest of the query.
Constants are folded on the driver.  Functions that reduce the whole selection
(mean, median, std and their NaN-skipping forms) become *summaries*: one grouped
aggregate per nesting level, attached to the rows by ``attach_summaries``.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, functions as F

from seriesmend.functions import ieee
from seriesmend.functions.binding import let


class FormulaError(ValueError):
    def __init__(self, reason: str):
        super().__init__(f"Invalid expression: {reason}")


@dataclass(frozen=True)
class Term:
    """A compiled sub-formula.

    ``const`` holds a folded Python number; otherwise ``col`` is a Column.  ``kind``
    is "bool", "int" (whole numbers, held as doubles) or "num".  ``plain`` marks a bare column, which
    is cheap to mention more than once.  ``level`` counts the summaries beneath.
    """

    kind: str
    col: Column | None = None
    const: object = None
    plain: bool = False
    level: int = 0

    @property
    def folded(self) -> bool:
        return self.col is None

    def number(self) -> Column:
        if self.folded:
            return F.lit(float(self.const))
        return ieee.to_double(self.col) if self.kind == "bool" else self.col

    def flag(self) -> Column:
        if self.folded:
            return F.lit(bool(self.const))
        return self.col if self.kind == "bool" else self.col != 0


@dataclass(frozen=True)
class Summary:
    name: str
    reducer: str
    argument: Column
    level: int


@dataclass(frozen=True)
class Formula:
    """``value`` is in the NaN domain; it may mention the summary columns."""

    text: str
    value: Column
    summaries: tuple[Summary, ...] = field(default=())


def _constant(value) -> Term:
    if isinstance(value, (bool, np.bool_)):
        return Term("bool", const=value)
    return Term("int" if isinstance(value, int) else "num", const=value)


def _numbers(build: Callable[..., Column], *terms: Term, kind: str = "num") -> Term:
    """Apply ``build`` to numeric operands, binding each non-trivial one once."""

    def bind(rest: list[Term], done: list[Column]) -> Column:
        if not rest:
            return build(*done)
        head, tail = rest[0], rest[1:]
        if head.folded or (head.plain and head.kind != "bool"):
            return bind(tail, [*done, head.number()])
        return let(head.number(), lambda c: bind(tail, [*done, c]))

    return Term(kind, bind(list(terms), []), level=max(t.level for t in terms))


def _both_bool(a: Term, b: Term) -> bool:
    return a.kind == "bool" and b.kind == "bool"


def _common(*terms: Term) -> str:
    """The kind of a number computed from these: whole if all of them are."""
    return "num" if any(t.kind == "num" for t in terms) else "int"


def _add(a: Term, b: Term) -> Term:
    if _both_bool(a, b):
        return Term("bool", a.flag() | b.flag(), level=max(a.level, b.level))
    return _numbers(operator.add, a, b, kind=_common(a, b))


def _subtract(a: Term, b: Term) -> Term:
    if _both_bool(a, b):
        raise TypeError("boolean subtract is not supported")
    return _numbers(operator.sub, a, b, kind=_common(a, b))


def _multiply(a: Term, b: Term) -> Term:
    if _both_bool(a, b):
        return Term("bool", a.flag() & b.flag(), level=max(a.level, b.level))
    return _numbers(operator.mul, a, b, kind=_common(a, b))


# exponents that array libraries compute without the general power function
SIMPLE_POWERS = {
    1: lambda a: a,
    2: lambda a: a * a,
    0.5: F.sqrt,
    -1: lambda a: ieee.divide(F.lit(1.0), a),
}


def _power(a: Term, b: Term) -> Term:
    kind = _common(a, b)
    if kind == "int" and b.folded and b.const < 0:
        raise TypeError("whole numbers have no negative whole powers")
    if b.folded and b.kind != "bool" and b.const in SIMPLE_POWERS:
        return _numbers(SIMPLE_POWERS[b.const], a, kind=kind)
    return _numbers(ieee.power, a, b, kind=kind)


def _dividing(build) -> Callable[[Term, Term], Term]:
    """Floor division or remainder; of whole numbers, by zero it is 0."""

    def make(a: Term, b: Term) -> Term:
        if _common(a, b) == "num":
            return _numbers(build, a, b)
        whole = lambda p, q: F.when(q == 0, F.lit(0.0)).otherwise(build(p, q))
        return _numbers(whole, a, b, kind="int")

    return make


def _lifted(build) -> Callable[..., Term]:
    return lambda *terms: _numbers(build, *terms)


# The fixed grammar: operators and the names after ``np.``.
# python operator for constants, Term builder for everything else
BINARY = {
    ast.Add: (operator.add, _add),
    ast.Sub: (operator.sub, _subtract),
    ast.Mult: (operator.mul, _multiply),
    ast.Div: (operator.truediv, _lifted(ieee.divide)),
    ast.Mod: (operator.mod, _dividing(ieee.remainder)),
    ast.FloorDiv: (operator.floordiv, _dividing(ieee.floor_divide)),
    ast.Pow: (operator.pow, _power),
}

COMPARISON = {
    ast.Lt: (operator.lt, ieee.less),
    ast.LtE: (operator.le, ieee.less_equal),
    ast.Gt: (operator.gt, lambda a, b: ieee.less(b, a)),
    ast.GtE: (operator.ge, lambda a, b: ieee.less_equal(b, a)),
    ast.Eq: (operator.eq, ieee.equal),
    ast.NotEq: (operator.ne, ieee.not_equal),
}

# np.<name> with one argument
ELEMENTWISE = {
    "abs": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": ieee.log,
    "log2": ieee.log2,
    "log10": ieee.log10,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "floor": ieee.floor,
    "ceil": ieee.ceil,
}

# np.<name> over the whole selection: (aggregate, NaN readings skipped)
REDUCERS = {
    "mean": ("mean", False),
    "median": ("median", False),
    "std": ("std", False),
    "nanmean": ("mean", True),
    "nanmedian": ("median", True),
    "nanstd": ("std", True),
}


def _need(terms: list[Term], low: int, high: int, name: str) -> None:
    if not low <= len(terms) <= high:
        raise TypeError(f"np.{name} takes {low} to {high} arguments, got {len(terms)}")


def _whole(term: Term, name: str) -> int:
    if not term.folded:
        raise TypeError(f"np.{name}: this argument must be a constant")
    return operator.index(term.const)


def _sign(terms):
    _need(terms, 1, 1, "sign")
    if terms[0].kind == "bool":
        raise TypeError("np.sign is not defined for booleans")
    return _numbers(F.signum, terms[0], kind=terms[0].kind)


def _round(terms):
    _need(terms, 1, 2, "round")
    digits = _whole(terms[1], "round") if len(terms) == 2 else 0
    return _numbers(lambda a: ieee.round_half_even(a, digits), terms[0], kind=_common(terms[0]))


def _pairwise(name, build):
    def make(terms):
        _need(terms, 2, 2, name)
        out = _numbers(build, *terms)
        if _both_bool(*terms):
            return Term("bool", out.col != 0, level=out.level)
        return replace(out, kind=_common(*terms))

    return make


def _clip(terms):
    _need(terms, 3, 3, "clip")
    return _numbers(lambda a, lo, hi: ieee.minimum(ieee.maximum(a, lo), hi), *terms, kind=_common(*terms))


def _where(terms):
    _need(terms, 3, 3, "where")
    test, yes, no = terms
    level = max(t.level for t in terms)
    if _both_bool(yes, no):
        return Term("bool", F.when(test.flag(), yes.flag()).otherwise(no.flag()), level=level)
    chosen = F.when(test.flag(), yes.number()).otherwise(no.number())
    return Term(_common(yes, no), chosen, level=level)


def _isnan(terms):
    _need(terms, 1, 1, "isnan")
    return _numbers(F.isnan, terms[0], kind="bool")


def _nan_to_num(terms):
    _need(terms, 1, 5, "nan_to_num")
    fills = [0.0, ieee.MAX_DOUBLE, -ieee.MAX_DOUBLE]
    # positions 2.. are nan, posinf, neginf; position 1 (copy) has no effect here
    given = [t.number() for t in terms[2:]]
    nan, high, low = given + [F.lit(v) for v in fills[len(given):]]
    return _numbers(lambda a: ieee.replace_non_finite(a, nan, high, low), terms[0])


SPECIAL = {
    "sign": _sign,
    "round": _round,
    "minimum": _pairwise("minimum", ieee.minimum),
    "maximum": _pairwise("maximum", ieee.maximum),
    "clip": _clip,
    "where": _where,
    "isnan": _isnan,
    "nan_to_num": _nan_to_num,
}


class _Compiler(ast.NodeVisitor):
    def __init__(self, x: Column, prefix: str):
        self.x = Term("num", ieee.to_nan(x), plain=True)
        self.prefix = prefix
        self.summaries: list[Summary] = []

    def generic_visit(self, node):
        raise FormulaError(f"{type(node).__name__} is not allowed")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        if not isinstance(node.value, (int, float)):
            raise FormulaError("only numbers are allowed as literals")
        return _constant(node.value)

    def visit_Name(self, node):
        if node.id != "x":
            raise FormulaError(f"unknown name {node.id!r}")
        return self.x

    def visit_BinOp(self, node):
        if type(node.op) not in BINARY:
            raise FormulaError(f"operator {type(node.op).__name__} is not allowed")
        fold, build = BINARY[type(node.op)]
        a, b = self.visit(node.left), self.visit(node.right)
        return _constant(fold(a.const, b.const)) if a.folded and b.folded else build(a, b)

    def visit_UnaryOp(self, node):
        if not isinstance(node.op, (ast.UAdd, ast.USub)):
            raise FormulaError(f"operator {type(node.op).__name__} is not allowed")
        negative = isinstance(node.op, ast.USub)
        a = self.visit(node.operand)
        if a.folded:
            return _constant(-a.const if negative else +a.const)
        if a.kind == "bool":
            raise TypeError("a boolean has no sign")
        return Term(a.kind, -a.col, level=a.level) if negative else a

    def visit_Compare(self, node):
        if len(node.ops) != 1 or type(node.ops[0]) not in COMPARISON:
            raise FormulaError("only one of < <= > >= == != is allowed")
        fold, build = COMPARISON[type(node.ops[0])]
        a, b = self.visit(node.left), self.visit(node.comparators[0])
        if a.folded and b.folded:
            return _constant(fold(a.const, b.const))
        return _numbers(build, a, b, kind="bool")

    def visit_Call(self, node):
        target = node.func
        if not (isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name)
                and target.value.id == "np"):
            raise FormulaError("only np.<function>(...) can be called")
        name = target.attr
        if name not in ELEMENTWISE and name not in REDUCERS and name not in SPECIAL:
            raise FormulaError(f"np.{name} is not allowed")
        if node.keywords:
            raise FormulaError("keyword arguments are not allowed")
        terms = [self.visit(a) for a in node.args]
        if terms and all(t.folded for t in terms) and not (name == "where" and len(terms) == 1):
            with np.errstate(all="ignore"):
                return _constant(getattr(np, name)(*[t.const for t in terms]).item())
        if name in REDUCERS:
            return self._reduce(name, terms)
        if name in SPECIAL:
            return SPECIAL[name](terms)
        _need(terms, 1, 1, name)
        if name == "abs" and terms[0].kind == "bool":
            return terms[0]
        kind = terms[0].kind if name == "abs" else "num"
        return _numbers(ELEMENTWISE[name], terms[0], kind=kind)

    def _reduce(self, name, terms):
        _need(terms, 1, 2, name)
        if len(terms) == 2 and _whole(terms[1], name) not in (0, -1):
            raise FormulaError(f"np.{name}: a selection has one axis only")
        reducer, skip_nan = REDUCERS[name]
        argument = terms[0].number()
        summary = Summary(
            f"{self.prefix}{len(self.summaries)}",
            reducer,
            ieee.to_missing(argument) if skip_nan else argument,
            terms[0].level,
        )
        self.summaries.append(summary)
        return Term("num", ieee.to_nan(F.col(summary.name)), plain=True, level=summary.level + 1)


def compile_formula(text: str, x: Column, prefix: str = "_summary") -> Formula:
    """Compile ``text``; raises :class:`FormulaError` for anything not allowed."""
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as exc:
        raise FormulaError(str(exc)) from exc
    compiler = _Compiler(x, prefix)
    term = compiler.visit(tree)
    return Formula(text, term.number(), tuple(compiler.summaries))
