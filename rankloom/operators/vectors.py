"""Similarity of vectors: exact by cosine, or among the candidates of random projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def similar(vectors: DataFrame, query: list[float], most: int = 10, least: float = -1.0, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The `most` vectors nearest to a query vector by cosine, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(id, cosine(F.col(vec), q).alias("similarity")).filter(F.col("similarity") >= least)
    return s.orderBy(F.round("similarity", 9).desc(), id).limit(most)


def similar_by_projection(vectors: DataFrame, query: list[float], most: int = 10, bits: int = 12, tables: int = 8, id: str = "vec_id", vec: str = "embedding", seed: int = 11) -> DataFrame:
    """As similar(), among vectors that share the signs of a table's random projections with the query but for one."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, len(query)))
    signs = planes @ np.asarray(query, float) > 0
    tests = []
    for t in range(tables):
        same = [(dot(F.col(vec), F.array(*[F.lit(float(x)) for x in planes[t, b]])) > 0) == F.lit(bool(signs[t, b])) for b in range(bits)]
        tests.append(sum((F.when(c, 1).otherwise(0) for c in same), F.lit(0)) >= bits - 1)
    near = tests[0]
    for t in tests[1:]:
        near = near | t
    return similar(vectors.filter(near), query, most, -1.0, id, vec)
