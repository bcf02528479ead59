"""Scalar expressions compiled to columns.

Numbers, names, _0 _1 ... (arguments by place), unary and infix + - * /, parentheses and calls.  Names that are no
arguments are variables, which must have a value when the expression is compiled.  All values are doubles.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
FLOAT_EPSILON = 1.1920928955078125e-07
_LEX = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|([A-Za-z_]\w*)|([-+*/(),]))")

FUNCTIONS: dict[tuple[str, int], Callable[..., Column]] = {}


def define(name: str, arity: int) -> Callable:
    """Registers a function of so many columns under a name that is not case-sensitive."""

    def put(fn):
        FUNCTIONS[name.lower(), arity] = fn
        return fn

    return put


def _ln(x: Column) -> Column:
    """Of 0 minus infinity and of less NaN, where Spark has null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.when(x.isNull(), None).otherwise(F.lit(math.nan)))


def _log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.when(x.isNull(), None).otherwise(F.lit(math.nan)))


def _bits(x: Column) -> Column:
    return F.floor(F.abs(x) + F.lit(FLOAT_EPSILON)).cast("bigint")


def _double(fn: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *a: fn(*a).cast("double")


for _name in ("exp", "sqrt", "sin", "cos", "tan", "sinh", "cosh", "tanh", "asin", "acos", "atan", "floor", "ceil"):
    define(_name, 1)(_double(getattr(F, _name)))
define("fabs", 1)(F.abs)
define("log", 1)(_log10)
define("log", 2)(lambda x, b: _ln(x) / _ln(b))
define("ln", 1)(_ln)
define("sqr", 1)(lambda x: x * x)
define("pow", 2)(F.pow)
define("mod", 2)(lambda a, b: F.when(b == 0, F.lit(math.nan)).otherwise(a % b))
define("xor", 2)(_double(lambda a, b: _bits(a).bitwiseXOR(_bits(b))))
define("and", 2)(_double(lambda a, b: _bits(a).bitwiseAND(_bits(b))))
define("or", 2)(_double(lambda a, b: _bits(a).bitwiseOR(_bits(b))))
define("bcnt", 1)(_double(lambda a: F.bit_count(_bits(a))))
for _name, _op in (("if_gt", operator.gt), ("if_ge", operator.ge), ("if_lt", operator.lt), ("if_le", operator.le)):
    define(_name, 4)(functools.partial(lambda op, a, b, t, f: F.when(op(a, b), t).otherwise(f), _op))
define("if_eq", 4)(lambda a, b, t, f: F.when((a - b) * (a - b) <= EPSILON, t).otherwise(f))


def divide(a: Column, b: Column) -> Column:
    """Nothing divided by anything is nothing; else a divisor of about nothing is an error."""
    return F.when(F.abs(a) < EPSILON, F.lit(0.0)).when(F.abs(b) < EPSILON, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a / b)


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple = ()

    def names(self) -> set[str]:
        own = {self.value} if self.kind == "name" else set()
        return own.union(*(a.names() for a in self.args))


def parse(text: str) -> Node:
    parts, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"unexpected character in {text!r} at {at}")
        parts.append(m.group(m.lastindex) if m.lastindex != 1 else float(m.group(1)))
        at = m.end()
    parts.append(None)
    pos = 0

    def take(what=None):
        nonlocal pos
        got = parts[pos]
        if what is not None and got != what:
            raise ValueError(f"{what!r} expected in {text!r}, not {got!r}")
        pos += 1
        return got

    def primary() -> Node:
        got = take()
        if isinstance(got, float):
            return Node("number", got)
        if got in ("+", "-"):
            inner = primary()
            return inner if got == "+" else Node("negative", None, (inner,))
        if got == "(":
            inner = total()
            take(")")
            return inner
        if not isinstance(got, str) or not re.match(r"[A-Za-z_]", got):
            raise ValueError(f"unexpected {got!r} in {text!r}")
        if parts[pos] == "(":
            take()
            args = []
            while parts[pos] != ")":
                args.append(total())
                if parts[pos] != ")":
                    take(",")
            take(")")
            if (got.lower(), len(args)) not in FUNCTIONS:
                raise ValueError(f"no function {got} of {len(args)} arguments")
            return Node("call", got.lower(), tuple(args))
        return Node("argument", int(got[1:])) if re.fullmatch(r"_\d+", got) else Node("name", got)

    def product() -> Node:
        left = primary()
        while parts[pos] in ("*", "/"):
            op = take()
            left = Node(op, None, (left, primary()))
        return left

    def total() -> Node:
        left = product()
        while parts[pos] in ("+", "-"):
            op = take()
            left = Node(op, None, (left, product()))
        return left

    out = total()
    if parts[pos] is not None:
        raise ValueError(f"unexpected {parts[pos]!r} in {text!r}")
    return out


def compile(text: str, args: list[Column] | None = None, names: dict[str, Column] | None = None, variables: dict[str, float] | None = None) -> Column:
    """A column of doubles.  With named arguments, arguments by place aren't allowed."""
    named = {k.lower(): v for k, v in (names or {}).items()}
    given = {k.lower(): v for k, v in (variables or {}).items()}

    def build(n: Node) -> Column:
        if n.kind == "number":
            return F.lit(n.value)
        if n.kind == "name":
            key = n.value.lower()
            if key in named:
                return named[key].cast("double")
            if key in given:
                return F.lit(float(given[key]))
            raise ValueError(f"variable {n.value!r} has no value")
        if n.kind == "argument":
            if named:
                raise ValueError("arguments are named here")
            if args is None or n.value >= len(args):
                raise ValueError(f"there is no argument _{n.value}")
            return args[n.value].cast("double")
        inner = [build(a) for a in n.args]
        if n.kind == "negative":
            return -inner[0]
        if n.kind == "call":
            return FUNCTIONS[n.value, len(inner)](*inner)
        if n.kind == "/":
            return divide(*inner)
        return {"+": operator.add, "-": operator.sub, "*": operator.mul}[n.kind](*inner)

    return build(parse(text))
