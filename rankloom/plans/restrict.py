"""Metadata restrictions: a conjunction of groups of alternatives, each a comparison with a constant."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of comparisons of 16-bit and 32-bit floats (fixed values).
EPSILON = {"float16": 0.0004887581, "float32": 1.1920928955078125e-07}
OPS = ("<", "<=", "=", "==", "!=", ">", ">=")


@dataclass(frozen=True)
class Compare:
    op: str
    name: str
    value: float
    #: True opens a group of alternatives.
    new_group: bool = True
    kind: str = "int"

    def column(self) -> Column:
        if self.op not in OPS:
            raise ValueError(f"unknown comparison {self.op!r}")
        a = F.coalesce(F.col(self.name), F.lit(0))
        if self.kind in EPSILON:
            e, b = EPSILON[self.kind], float(self.value)
            a = a.cast("double")
            return {"=": F.abs(a - b) <= e, "==": F.abs(a - b) <= e, "!=": F.abs(a - b) > e, "<": a + e < b, "<=": a <= b + e, ">": a > b + e, ">=": a + e >= b}[self.op]
        b = int(self.value)
        if self.kind == "uint" and b < 0:
            b = 0
        return {"<": operator.lt, "<=": operator.le, "=": operator.eq, "==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge}[self.op](a, F.lit(b))


def column(compares: list[Compare]) -> Column:
    groups: list[list[Column]] = []
    for c in compares:
        if c.new_group or not groups:
            groups.append([])
        groups[-1].append(c.column())
    return functools.reduce(operator.and_, [functools.reduce(operator.or_, g) for g in groups], F.lit(True))
