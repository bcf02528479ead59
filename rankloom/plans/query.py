"""Query evaluation: selection, restriction, weighting, ranking, paging and summaries.

A scheme (QueryEval) names selection, restriction and exclusion sets, weighting functions, a formula and summarizers.  A
query gives the features of the sets and its own restrictions.  evaluate() declares the plans; nothing runs but counts of
earlier selection passes, where there is more than one, document frequencies of the query's terms, in one job, and where
there are summarizers the ranking.  Documents whose weight is not above DBL_EPSILON are no result, unless a formula or
fields decide.
"""

from __future__ import annotations

import dataclasses
import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scalar
from rankloom.operators import field_weighting, summarize, weighting  # noqa: F401  field_weighting registers its functions
from rankloom.plans import restrict
from rankloom.plans.expr import Expr, Term
from rankloom.sources.corpus import Corpus

DBL_EPSILON = 2.220446049250313e-16
#: Up to so many ranks are fixed before they are summarized.
FIXED_RANKS = 10_000
#: Up to so many name their documents in the summaries' scans.
NAMED_RANKS = 1_000


@dataclass
class Call:
    name: str
    #: role -> feature set
    roles: dict[str, str] = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    id: str | None = None


@dataclass
class QueryEval:
    """A scheme.  Sets are named; the features of a set come with each query, and predefined terms with the scheme."""

    selections: list[str] = field(default_factory=list)
    restrictions: list[str] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    weightings: list[Call] = field(default_factory=list)
    summarizers: list[Call] = field(default_factory=list)
    formula: str | None = None
    terms: list[tuple[str, Term]] = field(default_factory=list)

    def query(self, corpus: Corpus) -> "Query":
        q = Query(self, corpus)
        for name, t in self.terms:
            q.feature(name, t)
        return q

    def view(self) -> dict:
        return {"select": self.selections, "restrict": self.restrictions, "exclude": self.exclusions, "weight": [vars(c) for c in self.weightings], "summarize": [vars(c) for c in self.summarizers], "formula": self.formula, "terms": [[s, t.view()] for s, t in self.terms]}


@dataclass
class Result:
    #: rank, docno, fstart, fend, weight in order; pass number; documents ranked and visited; summaries.
    ranks: DataFrame
    evaluation_pass: int
    stats: DataFrame
    summary: DataFrame | None
    global_summary: DataFrame | None


@dataclass
class Query:
    scheme: QueryEval
    corpus: Corpus
    features: dict[str, list[tuple[Expr, float]]] = field(default_factory=dict)
    compares: list[restrict.Compare] = field(default_factory=list)
    docset: list[int] | None = None
    users: list[str] = field(default_factory=list)
    variables: dict[str, float] = field(default_factory=dict)
    min_rank: int = 0
    max_ranks: int = 20

    def __post_init__(self) -> None:
        # Statistics that a client gives hold for this query alone.
        self.corpus = dataclasses.replace(self.corpus, client_df=dict(self.corpus.client_df))

    def feature(self, name: str, expr: Expr, weight: float = 1.0) -> "Query":
        self.features.setdefault(name.lower(), []).append((expr, weight))
        return self

    def restrict(self, op: str, name: str, value: float, new_group: bool = True, kind: str = "int") -> "Query":
        self.compares.append(restrict.Compare(op, name, value, new_group, kind))
        return self

    def term_statistics(self, kind: str, value: str, df: int) -> "Query":
        self.corpus.client_df[kind.lower(), value] = df
        return self

    def global_statistics(self, n: int) -> "Query":
        self.corpus.client_n = n
        return self

    def _set(self, name: str) -> list[tuple[Expr, float]]:
        return self.features.get(name.lower(), [])

    def _docs_of(self, exprs: list[Expr]) -> DataFrame:
        """Distinct documents that match any of the expressions."""
        terms = [e for e in exprs if isinstance(e, Term)]
        parts = [e.compile(self.corpus).select("docno") for e in exprs if not isinstance(e, Term)]
        if terms:
            keys = [f"{t.type.lower()}\x1f{t.value}" for t in terms]
            p = self.corpus.postings
            parts.append(p.filter(F.col("type").isin(sorted({t.type.lower() for t in terms})) & F.col("value").isin(sorted({t.value for t in terms})) & F.concat_ws("\x1f", "type", "value").isin(keys)).select("docno"))
        return functools.reduce(DataFrame.unionByName, parts).distinct()

    def _allowed(self, docs: DataFrame) -> DataFrame:
        if self.docset is not None:
            chosen = self.corpus.spark.createDataFrame([(int(d),) for d in self.docset], "docno long").distinct()
            # A list that came with the query.
            docs = docs.join(F.broadcast(chosen), "docno", "left_semi")
        if self.users and self.corpus.acl is not None:
            docs = docs.join(self.corpus.acl.filter(F.col("username").isin(self.users)).select("docno"), "docno", "left_semi")
        return docs

    def visited(self) -> DataFrame:
        """(docno, pass) of all selected documents that a user may see, each with its first selection set."""
        if not self.scheme.weightings:
            raise ValueError("a query needs a weighting function")
        sets = [s for s in self.scheme.selections if self._set(s)]
        if not sets:
            raise ValueError("a query needs a selection set with features")
        parts = [self._docs_of([e for e, _ in self._set(s)]).select("docno", F.lit(i).alias("pass")) for i, s in enumerate(sets)]
        docs = parts[0] if len(parts) == 1 else functools.reduce(DataFrame.unionByName, parts).groupBy("docno").agg(F.min("pass").alias("pass"))
        return self._allowed(docs)

    def filtered(self, docs: DataFrame) -> DataFrame:
        if self.compares:
            docs = docs.join(self.corpus.metadata.filter(restrict.column(self.compares)).select("docno"), "docno", "left_semi")
        for s in self.scheme.restrictions:
            for e, _ in self._set(s):
                docs = docs.join(self._docs_of([e]), "docno", "left_semi")
        gone = [e for s in self.scheme.exclusions for e, _ in self._set(s)]
        return docs.join(self._docs_of(gone), "docno", "left_anti") if gone else docs

    def _call(self, c: Call) -> tuple[dict, dict]:
        params = dict(c.params)
        if self.variables and c.name.lower() in ("smart", "scalar"):
            params["__variables__"] = self.variables
        return {role: self._set(s) for role, s in c.roles.items()}, params

    def weighted(self, docs: DataFrame) -> DataFrame:
        """docno, fstart, fend, weight of every candidate, functions combined."""
        candidates = docs.select("docno")
        results = []
        for c in self.scheme.weightings:
            features, params = self._call(c)
            results.append((c.name.lower() in ("bm25pff", "title"), weighting.call(c.name, self.corpus, candidates, features, params)))
        with_fields = [i for i, (f, _) in enumerate(results) if f]
        if len(with_fields) > 1:
            raise ValueError("only one weighting function may give fields")
        if self.scheme.formula is None and len(results) == 1 and not with_fields:
            return results[0][1].filter(F.col("weight") > DBL_EPSILON)
        rows = results[with_fields[0]][1].withColumnRenamed("weight", f"_{with_fields[0]}") if with_fields else candidates.select("docno", F.lit(0).alias("fstart"), F.lit(0).alias("fend"))
        for i, (f, df) in enumerate(results):
            if not f:
                rows = rows.join(df.select("docno", F.col("weight").alias(f"_{i}")), "docno", "left")
        args = [F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i, _ in enumerate(results)]
        if self.scheme.formula is not None:
            return rows.select("docno", "fstart", "fend", scalar.compile(self.scheme.formula, args, variables=self.variables).alias("weight"))
        total = functools.reduce(lambda a, b: a + b, args)
        out = rows.select("docno", "fstart", "fend", total.alias("weight"))
        return out if with_fields else out.filter(F.col("weight") > DBL_EPSILON)

    def evaluate(self) -> Result:
        visited = self.visited()
        candidates = self.filtered(visited)
        passes = len([s for s in self.scheme.selections if self._set(s)])
        last = passes - 1
        if passes > 1:
            # One small aggregate: a pass is used while those before it ranked too few.
            counts = {r["pass"]: r["n"] for r in candidates.groupBy("pass").agg(F.count("*").alias("n")).collect()}
            have, last = 0, 0
            for i in range(passes):
                last = i
                have += counts.get(i, 0)
                if have >= self.min_rank + self.max_ranks:
                    break
            visited, candidates = visited.filter(F.col("pass") <= last), candidates.filter(F.col("pass") <= last)
        w = self.weighted(candidates)
        order = [F.round("weight", 9).desc(), F.col("docno").desc(), F.col("fend").desc(), F.col("fstart").desc()]
        top = w.orderBy(*order).limit(self.min_rank + self.max_ranks)
        # At most minRank + maxNofRanks rows, so numbering them in one place is no burden.
        from pyspark.sql import Window

        rank = F.row_number().over(Window.orderBy(*order))
        ranks = top.select(rank.alias("rank"), "docno", "fstart", "fend", "weight").filter(F.col("rank") > self.min_rank)
        if not self.max_ranks:
            ranks = ranks.limit(0)
        corpus = self.corpus
        stats = candidates.agg(F.count("*").alias("ranked")).crossJoin(visited.agg(F.count("*").alias("visited")))
        if self.scheme.summarizers and self.min_rank + self.max_ranks <= FIXED_RANKS:
            # Ranked once, not once for each summarizer and feature; a bounded number of rows.
            fixed = ranks.collect()
            ranks = F.broadcast(self.corpus.spark.createDataFrame(fixed, ranks.schema))
            if len(fixed) <= NAMED_RANKS:
                corpus = corpus.of_documents(sorted({r["docno"] for r in fixed}))
        parts, for_global = [], []
        for c in self.scheme.summarizers:
            features, params = self._call(c)
            rows = summarize.call(c.name, corpus, ranks, features, params, c.id)
            parts.append(rows)
            if c.name.lower() in summarize.GLOBAL:
                for_global.append(rows)
        summary = functools.reduce(DataFrame.unionByName, parts) if parts else None
        whole = summarize.global_summary(functools.reduce(DataFrame.unionByName, for_global)) if for_global else None
        return Result(ranks, last, stats, summary, whole)
