"""Query expressions: terms, joins of expressions and variables, compiled to posting sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from rankloom.operators import joins
from rankloom.sources.corpus import Corpus


@dataclass(frozen=True)
class Term:
    type: str
    value: str
    length: int = 1
    variable: str | None = None

    def terms(self) -> list["Term"]:
        return [self]

    def compile(self, corpus: Corpus) -> DataFrame:
        return corpus.term(self.type, self.value, self.length)

    def df(self, corpus: Corpus) -> int:
        key = (self.type.lower(), self.value)
        return corpus.dfs([key])[key]

    def view(self) -> dict:
        return {"term": [self.type, self.value], **({"variable": self.variable} if self.variable else {})}


@dataclass(frozen=True)
class Join:
    op: str
    args: tuple
    range: int = 0
    cardinality: int = 0
    variable: str | None = None
    options: dict = field(default_factory=dict, hash=False, compare=False)

    def terms(self) -> list[Term]:
        return [t for a in self.args for t in a.terms()]

    def compile(self, corpus: Corpus) -> DataFrame:
        name = self.op.lower()
        more = dict(self.options)
        if name.startswith(("within", "inrange")):
            corpus.dfs([(t.type.lower(), t.value) for t in self.terms()])
            more["dfs"] = [a.df(corpus) for a in self.args]
        if name.startswith("within"):
            # Different terms of one type never share a position where each position holds one token.
            inner = self.args[1:] if name.endswith("_struct") else self.args
            more.setdefault("disjoint", all(isinstance(a, Term) for a in inner) and len({(a.type, a.value) for a in inner}) == len(inner) == len([a for a in inner if a.type == inner[0].type]))
        return joins.get(name)([a.compile(corpus) for a in self.args], range=self.range, cardinality=self.cardinality, **more)

    def df(self, corpus: Corpus) -> int:
        return joins.df_estimate(self.op, [a.df(corpus) for a in self.args])

    def view(self) -> dict:
        return {"join": self.op, "range": self.range, "cardinality": self.cardinality, "args": [a.view() for a in self.args], **({"variable": self.variable} if self.variable else {})}


Expr = Term | Join
