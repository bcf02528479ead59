"""The registered queries of the retrieval engine, each with its SQL for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import scalar
from rankloom.operators import readers, storage, vectors
from rankloom.plans import program
from rankloom.plans.expr import Join, Term
from rankloom.plans.query import Call, QueryEval, Result
from rankloom.plans.restrict import Compare
from rankloom.sources.corpus import Corpus, from_tables
from rankloom.streaming import stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The collection in DuckDB's SQL.
BASE = r"""
WITH tok AS (SELECT doc_id + 1 AS docno, unnest(regexp_extract_all(coalesce(text,''), '[A-Za-z0-9]+|[.!?]')) AS t, unnest(range(1, len(regexp_extract_all(coalesce(text,''), '[A-Za-z0-9]+|[.!?]')) + 1))::INT AS pos FROM documents),
post AS (SELECT CASE WHEN regexp_matches(t, '[A-Za-z0-9]') THEN 'word' ELSE 'eos' END AS type, CASE WHEN regexp_matches(t, '[A-Za-z0-9]') THEN lower(t) ELSE '' END AS value, docno, pos FROM tok
  UNION ALL SELECT 'lang', lang, doc_id + 1, 1 FROM documents UNION ALL SELECT 'source', source, doc_id + 1, 1 FROM documents),
docs AS (SELECT doc_id + 1 AS docno, 'D' || doc_id AS docid, lang, source FROM documents),
meta AS (SELECT d.doc_id + 1 AS docno, len(regexp_extract_all(coalesce(d.text,''), '[A-Za-z0-9]+'))::BIGINT AS doclen, d.n_chars, coalesce(l.quality, 0)::INT AS quality, coalesce(l.toxic, 0)::INT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
nn AS (SELECT count(*) AS n FROM docs),
ends AS (SELECT docno, min(CASE WHEN t IN ('.','!','?') THEN pos END) AS e, max(pos) AS last FROM tok GROUP BY docno),
sent0 AS (SELECT docno, pos, t IN ('.','!','?') AS eos, coalesce(sum((t IN ('.','!','?'))::INT) OVER (PARTITION BY docno ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tok),
sent AS (SELECT docno, min(pos) AS a, max(pos) + 1 AS b, row_number() OVER (PARTITION BY docno ORDER BY min(pos))::INT AS i FROM sent0 WHERE NOT eos GROUP BY docno, s),
struc AS (SELECT docno, 'title' AS struct, 1 AS struct_index, 1 AS hstart, e AS hend, e AS cstart, last + 1 AS cend FROM ends WHERE e > 1
  UNION ALL SELECT docno, 'sentence', i, a, b, a, b FROM sent),
"""


def word(w: str, length: int = 1, variable: str | None = None) -> Term:
    return Term("word", w, length, variable)


EOS = Term("eos", "")
THE, OF, AND, TO = word("the"), word("of"), word("and"), word("to")


def P(name: str, w: str, kind: str = "word") -> str:
    return f"{name} AS (SELECT docno, pos FROM post WHERE type = '{kind}' AND value = '{w}')"


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Corpus], DataFrame]], Callable]:
    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(from_tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return put


# Posting joins ---------------------------------------------------------------------------------------------------------


def _join(name: str, expr: Join, sql: str | None) -> None:
    register(name, sql and BASE + sql)(lambda c: expr.compile(c).select("docno", "pos", "len"))


_TOA = ", ".join((P("a", "the"), P("b", "of"), P("c", "and"), P("q", "", "eos")))
_join("j01_union", Join("union", (THE, OF)), f"{_TOA} SELECT docno, pos, 1 AS len FROM (SELECT * FROM a UNION SELECT * FROM b)")
_join("j02_intersect", Join("intersect", (Join("succ", (OF,)), THE)), f"{_TOA} SELECT docno, pos, 1 AS len FROM (SELECT docno, pos FROM a INTERSECT SELECT docno, pos + 1 FROM b)")
_join("j02c_intersect_card", Join("intersect", (Join("succ", (OF,)), THE, Join("pred", (AND,))), cardinality=2), f"{_TOA} SELECT docno, pos, 1 AS len FROM (SELECT docno, pos FROM a UNION ALL SELECT docno, pos + 1 FROM b UNION ALL SELECT docno, pos - 1 FROM c WHERE pos > 1) GROUP BY docno, pos HAVING count(*) >= 2")
_join("j03_diff", Join("diff", (THE, Join("succ", (OF,)))), f"{_TOA} SELECT docno, pos, 1 AS len FROM (SELECT docno, pos FROM a EXCEPT SELECT docno, pos + 1 FROM b)")
_join("j04_contains", Join("contains", (THE, OF, AND)), f"{_TOA} SELECT docno, 1 AS pos, 1 AS len FROM (SELECT docno FROM a INTERSECT SELECT docno FROM b INTERSECT SELECT docno FROM c)")
_join("j04c_contains_card", Join("contains", (THE, OF, AND), cardinality=2), f"{_TOA} SELECT docno, 1 AS pos, 1 AS len FROM (SELECT DISTINCT docno, 1 k FROM a UNION ALL SELECT DISTINCT docno, 2 FROM b UNION ALL SELECT DISTINCT docno, 3 FROM c) GROUP BY docno HAVING count(*) >= 2")
_join("j05_pred", Join("pred", (THE,)), f"{_TOA} SELECT docno, pos - 1 AS pos, 1 AS len FROM a WHERE pos > 1")
_join("j06_succ", Join("succ", (THE,)), f"{_TOA} SELECT docno, pos + 1 AS pos, 1 AS len FROM a")
_join("j07_between", Join("between", (THE, OF, AND)), f"{_TOA}, iv AS (SELECT b.docno, b.pos AS s, min(c.pos) AS e FROM b JOIN c ON b.docno = c.docno AND c.pos > b.pos GROUP BY b.docno, b.pos) SELECT DISTINCT a.docno, a.pos, 1 AS len FROM a JOIN iv ON a.docno = iv.docno AND a.pos >= iv.s AND a.pos < iv.e")


def _near(r: int, names: str = "ab") -> str:
    """Windows: each start m, the nearest position of each argument within r."""
    m = " UNION ".join(f"SELECT docno, pos FROM {x}" for x in names)
    steps, now = [f"m0 AS ({m})"], "m0"
    for k, x in enumerate(names):
        keep = "".join(f", m.p{y}" for y in names[:k])
        group = "m.docno, m.pos" + keep
        steps.append(f"m{k + 1} AS (SELECT m.docno, m.pos{keep}, min(x.pos) AS p{x} FROM {now} m JOIN {x} x ON x.docno = m.docno AND x.pos BETWEEN m.pos AND m.pos + {r} GROUP BY {group})")
        now = f"m{k + 1}"
    steps.append(f"w AS (SELECT docno, pos, greatest({', '.join(f'p{x}' for x in names)}) AS e, p{names[-1]} AS rare FROM {now})")
    return ", ".join(steps)


_CUT = "NOT EXISTS (SELECT 1 FROM q WHERE q.docno = w.docno AND q.pos BETWEEN w.pos AND w.e)"
_join("j08_inrange", Join("inrange", (THE, OF), 5), f"{_TOA}, {_near(5)} SELECT docno, pos, rare - pos + 1 AS len FROM w")
_join("j08n_inrange_neg", Join("inrange", (THE, OF), -5), f"{_TOA}, {_near(5)} SELECT DISTINCT docno, e AS pos, 1 AS len FROM w")
_join("j09_within", Join("within", (THE, THE, OF), 9), f"{_TOA}, t AS (SELECT docno, pos AS s, pos AS x, lead(pos) OVER (PARTITION BY docno ORDER BY pos) AS y FROM a), m AS (SELECT docno, pos FROM a UNION SELECT docno, pos FROM b), g AS (SELECT m.docno, m.pos, min(t.y) AS y FROM m JOIN t ON t.docno = m.docno AND t.x BETWEEN m.pos AND m.pos + 9 AND t.y <= m.pos + 9 GROUP BY m.docno, m.pos), h AS (SELECT g.docno, g.pos, greatest(g.y, min(b.pos)) AS e FROM g JOIN b ON b.docno = g.docno AND b.pos BETWEEN g.pos AND g.pos + 9 GROUP BY g.docno, g.pos, g.y) SELECT docno, pos, e - pos + 1 AS len FROM h")
_join("j09d_within_disjoint", Join("within", (THE, OF), 5), f"{_TOA}, {_near(5)} SELECT docno, pos, rare - pos + 1 AS len FROM w")
_join("j10_inrange_struct", Join("inrange_struct", (EOS, THE, OF), 8), f"{_TOA}, {_near(8)} SELECT docno, pos, rare - pos + 1 AS len FROM w WHERE {_CUT}")
_join("j11_within_struct", Join("within_struct", (EOS, THE, OF), 8), f"{_TOA}, {_near(8)} SELECT docno, pos, rare - pos + 1 AS len FROM w WHERE {_CUT}")


def _ordered(r: int, ahead: int) -> str:
    """the, of, and in order within r."""
    return f"s1 AS (SELECT a.docno, a.pos, min(b.pos) AS pb FROM a JOIN b ON b.docno = a.docno AND b.pos BETWEEN a.pos + {ahead} AND a.pos + {r} GROUP BY a.docno, a.pos), w AS (SELECT s1.docno, s1.pos, min(c.pos) AS e FROM s1 JOIN c ON c.docno = s1.docno AND c.pos BETWEEN s1.pb + {ahead} AND s1.pos + {r} GROUP BY s1.docno, s1.pos)"


_THREE = (THE, OF, AND)
_join("j12_sequence", Join("sequence", _THREE, 20), f"{_TOA}, {_ordered(20, 1)} SELECT docno, pos, e - pos + 1 AS len FROM w")
_join("j12n_sequence_neg", Join("sequence", _THREE, -20), f"{_TOA}, {_ordered(20, 1)} SELECT DISTINCT docno, e AS pos, 1 AS len FROM w")
_join("j13_chain", Join("chain", _THREE, 20), f"{_TOA}, {_ordered(20, 0)} SELECT docno, pos, e - pos + 1 AS len FROM w")
_join("j14_sequence_struct", Join("sequence_struct", (EOS, *_THREE), 20), f"{_TOA}, {_ordered(20, 1)} SELECT docno, pos, e - pos + 1 AS len FROM w WHERE {_CUT}")
_join("j15_chain_struct", Join("chain_struct", (EOS, *_THREE), 20), f"{_TOA}, {_ordered(20, 0)} SELECT docno, pos, e - pos + 1 AS len FROM w WHERE {_CUT}")
_join("j16_sequence_imm", Join("sequence_imm", (OF, THE)), f"{_TOA} SELECT docno, pos, 2 AS len FROM (SELECT docno, pos FROM b INTERSECT SELECT docno, pos - 1 FROM a)")

# Ranked queries ----------------------------------------------------------------------------------------------------------

W1, W2, W3 = "licensed", "version", "idiot"
MATCH = [(word(W1), 1.0), (word(W2), 0.5), (word(W3), 2.0)]


def scheme(*weightings: Call, formula: str | None = None, summarizers=(), restrictions=(), exclusions=(), selections=("sel",)) -> QueryEval:
    return QueryEval(list(selections), list(restrictions), list(exclusions), list(weightings), list(summarizers), formula)


def ranked(c: Corpus, s: QueryEval, match=MATCH, select=None):
    q = s.query(c)
    for e, w in match:
        q.feature("match", e, w)
    for e in select if select is not None else [e for e, _ in match]:
        q.feature("sel", e)
    return q


def ranks_of(r: Result) -> DataFrame:
    return r.ranks.select(F.col("rank").cast("bigint").alias("rank"), "docno", F.round("weight", 6).alias("weight"))


FREQ = Call("frequency", {"match": "match"})
BM25 = Call("bm25", {"match": "match"}, {"avgdoclen": 400})

#: ff per matching feature, idf, and the selected documents.
_FF = f"""
feat AS (SELECT * FROM (VALUES (0,'{W1}',1.0),(1,'{W2}',0.5),(2,'{W3}',2.0)) f(f, value, w)),
ff AS (SELECT p.docno, f.f, f.w, count(*)::DOUBLE AS ff FROM post p JOIN feat f ON p.type='word' AND p.value=f.value GROUP BY p.docno, f.f, f.w),
dfs AS (SELECT f.f, count(ff.docno)::DOUBLE AS df FROM feat f LEFT JOIN ff ON ff.f=f.f GROUP BY f.f),
cand AS (SELECT DISTINCT docno FROM ff),
idf AS (SELECT f, df, greatest(0.00001, log10(((SELECT n FROM nn) - df + 0.5) / (df + 0.5))) AS idf FROM dfs)
"""


def top(weights: str, n: int = 20, offset: int = 0) -> str:
    """Ranks from a query of (docno, w)."""
    return f"SELECT rank, docno, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (ORDER BY round(w, 9) DESC, docno DESC) AS rank FROM ({weights})) WHERE rank > {offset} AND rank <= {offset + n}"


def _bm25(b: float) -> str:
    norm = f"1.5 * (1 - {b} + {b} * m.doclen / 400.0)"
    return f"SELECT ff.docno, sum(ff.w * idf * ff.ff * 2.5 / (ff.ff + {norm})) AS w FROM ff JOIN idf USING (f) JOIN meta m ON m.docno = ff.docno GROUP BY ff.docno"


register("g01_bm25", BASE + _FF + top(_bm25(0.75)))(lambda c: ranks_of(ranked(c, scheme(BM25)).evaluate()))
register("g01b_bm25_b0", BASE + _FF + top(_bm25(0)))(lambda c: ranks_of(ranked(c, scheme(Call("bm25", {"match": "match"}, {"b": 0}))).evaluate()))
_FREQ = "SELECT docno, sum(w * ff) AS w FROM ff GROUP BY docno"
register("g03_frequency", BASE + _FF + top(_FREQ))(lambda c: ranks_of(ranked(c, scheme(FREQ)).evaluate()))
register("g04_constant", BASE + _FF + top("SELECT docno, sum(w * 1.5) AS w FROM ff GROUP BY docno"))(lambda c: ranks_of(ranked(c, scheme(Call("constant", {"match": "match"}, {"weight": 1.5}))).evaluate()))
register("g05_metadata", BASE + _FF + top("SELECT c.docno, m.doclen * 0.25 AS w FROM cand c JOIN meta m USING (docno)"))(lambda c: ranks_of(ranked(c, scheme(Call("metadata", {}, {"name": "doclen", "weight": 0.25}))).evaluate()))
register("g06_scalar", BASE + _FF + top("SELECT c.docno, log10(m.doclen + 1) * 2.5 + (SELECT n FROM nn) / 1000.0 AS w FROM cand c JOIN meta m USING (docno)"))(
    lambda c: ranks_of(_variables(ranked(c, scheme(Call("scalar", {}, {"function": "log(doclen + 1) * x + N / 1000", "metadata": ["doclen"]}))), x=2.5).evaluate())
)
_SMART = "SELECT docno, sum(w * (ln(1 + ff) * log10(n / df) / (1 + ln(1 + doclen)) + qf * 0.01)) AS w FROM (SELECT c.docno, f.w, coalesce(x.ff, 0) AS ff, d.df, m.doclen, 3 AS qf, (SELECT n FROM nn)::DOUBLE AS n FROM cand c CROSS JOIN feat f LEFT JOIN ff x ON x.docno = c.docno AND x.f = f.f JOIN dfs d ON d.f = f.f JOIN meta m ON m.docno = c.docno) GROUP BY docno"
SMART = Call("smart", {"match": "match"}, {"function": "ln(1 + ff) * log(N / df) / (1 + ln(1 + doclen)) + qf * 0.01", "metadata": ["doclen"]})
register("g07_smart", BASE + _FF + top(_SMART))(lambda c: ranks_of(ranked(c, scheme(SMART)).evaluate()))
register("g09_formula", BASE + _FF + top(f"SELECT a.docno, a.w * 0.7 + sqrt(m.doclen * 0.25) AS w FROM ({_bm25(0.75)}) a JOIN meta m USING (docno)"))(
    lambda c: ranks_of(ranked(c, scheme(BM25, Call("metadata", {}, {"name": "doclen", "weight": 0.25}), formula="_0 * 0.7 + sqrt(_1)")).evaluate())
)
register("g10_sum_of_functions", BASE + _FF + top(f"SELECT a.docno, a.w + m.quality * 0.5 AS w FROM ({_FREQ}) a JOIN meta m USING (docno)"))(lambda c: ranks_of(ranked(c, scheme(FREQ, Call("metadata", {}, {"name": "quality", "weight": 0.5}))).evaluate()))


def _variables(q, **values):
    q.variables.update(values)
    return q


PFF = Call("bm25pff", {"match": "match", "punct": "punct"}, {"avgdoclen": 400, "maxdf": 1.0, "cluster": 0.4})


def _pff(c: Corpus) -> DataFrame:
    q = ranked(c, scheme(PFF), [(THE, 1.0), (OF, 1.0), (word("with"), 1.0)], [Join("contains", (THE, OF, word("with")))])
    q.feature("punct", EOS)
    return q.evaluate().ranks.select(F.col("rank").cast("bigint").alias("rank"), "docno", "fstart", "fend", F.round("weight", 6).alias("weight"))


register("g02_bm25pff")(_pff)


def _title(c: Corpus) -> DataFrame:
    q = ranked(c, scheme(Call("title", {"match": "match"})), [(THE, 1.0)], [THE])
    return q.evaluate().ranks.select(F.col("rank").cast("bigint").alias("rank"), "docno", "fstart", "fend", F.round("weight", 6).alias("weight"))


# Headings that start with the only feature: the first sentence, and the content that it is the title of.
_TITLE = """t AS (SELECT docno FROM post WHERE type = 'word' AND value = 'the' AND pos = 1), f AS (
  SELECT s.docno, s.a AS fstart, s.b AS fend FROM sent s JOIN t USING (docno) WHERE s.i = 1 AND s.b - s.a <= 64
  UNION ALL SELECT s.docno, e.e, e.last + 1 FROM sent s JOIN t USING (docno) JOIN ends e USING (docno) WHERE s.i = 1 AND s.b - s.a <= 64 AND e.e > 1),
r AS (SELECT *, row_number() OVER (ORDER BY docno DESC, fend DESC, fstart DESC) AS rank FROM f)
SELECT rank, docno, fstart, fend, 1.0::DOUBLE AS weight FROM r WHERE rank <= 20"""
register("g08_title", BASE + _TITLE)(_title)

# Filters -------------------------------------------------------------------------------------------------------------------


def _docs(q) -> DataFrame:
    return q.filtered(q.visited()).select("docno")


_SEL = f"{P('s', W1)}, sel AS (SELECT DISTINCT docno FROM s)"
register("f01_metadata_cnf", BASE + _SEL + " SELECT docno FROM sel JOIN meta USING (docno) WHERE doclen > 50 AND (quality = 1 OR toxic = 1 OR doclen >= 600)")(
    lambda c: _docs(ranked(c, scheme(FREQ), [(word(W1), 1.0)]).restrict(">", "doclen", 50).restrict("=", "quality", 1).restrict("=", "toxic", 1, False).restrict(">=", "doclen", 600, False))
)


def _passes(c: Corpus) -> DataFrame:
    q = scheme(FREQ, selections=("first", "second", "third")).query(c)
    for e, w in MATCH:
        q.feature("match", e, w)
    q.feature("first", Join("contains", (word(W1), word(W3)))).feature("second", word(W2)).feature("third", word(W3))
    return ranks_of(q.evaluate())


_PASS = "p AS (SELECT docno, min(p) AS p FROM (SELECT docno, 0 AS p FROM ff WHERE f IN (0, 2) GROUP BY docno HAVING count(DISTINCT f) = 2 UNION ALL SELECT docno, 1 FROM ff WHERE f = 1 UNION ALL SELECT docno, 2 FROM ff WHERE f = 2) GROUP BY docno), used AS (SELECT docno FROM p WHERE (SELECT count(*) FROM p q WHERE q.p < p.p) < 20)"
register("f02_selection_passes", BASE + _FF + ", " + _PASS + " " + top("SELECT docno, sum(w * ff) AS w FROM ff WHERE docno IN (SELECT docno FROM used) GROUP BY docno"))(_passes)


def _with(c: Corpus, **sets) -> DataFrame:
    q = ranked(c, scheme(FREQ, restrictions=["res"], exclusions=["exc"]), [(THE, 1.0)])
    for name, exprs in sets.items():
        for e in exprs:
            q.feature(name, e)
    return _docs(q)


_T = f"{P('a', 'the')}, {P('x', 'of')}, {P('y', W1)}, {P('z', 'en', 'lang')}"
register("f03_restriction", BASE + _T + " SELECT DISTINCT docno FROM a WHERE docno IN (SELECT docno FROM y) AND docno IN (SELECT docno FROM z)")(lambda c: _with(c, res=[word(W1), Term("lang", "en")]))
register("f04_exclusion", BASE + _T + " SELECT DISTINCT docno FROM a WHERE docno NOT IN (SELECT docno FROM y) AND docno NOT IN (SELECT docno FROM x)")(lambda c: _with(c, exc=[word(W1), OF]))


def _docset(c: Corpus) -> DataFrame:
    q = ranked(c, scheme(FREQ), [(THE, 1.0)])
    q.docset = [3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987]
    return _docs(q)


register("f05_evalset", BASE + _T + " SELECT DISTINCT docno FROM a WHERE docno IN (3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987)")(_docset)


def _users(c: Corpus) -> DataFrame:
    q = ranked(c, scheme(FREQ), [(THE, 1.0)])
    q.users = ["src1", "src7", "nobody"]
    return _docs(q)


register("f06_acl", BASE + _T + " SELECT DISTINCT a.docno FROM a JOIN docs USING (docno) WHERE source IN ('src1', 'src7', 'nobody')")(_users)


def _page(c: Corpus) -> DataFrame:
    q = ranked(c, scheme(BM25))
    q.min_rank, q.max_ranks = 5, 7
    return ranks_of(q.evaluate())


register("t02_paging", BASE + _FF + top(_bm25(0.75), 7, 5))(_page)
register("f08_counts", BASE + _T + " SELECT (SELECT count(DISTINCT docno) FROM a JOIN meta USING (docno) WHERE quality = 1) AS ranked, (SELECT count(DISTINCT docno) FROM a) AS visited")(lambda c: ranked(c, scheme(FREQ), [(THE, 1.0)]).restrict("=", "quality", 1).evaluate().stats)

# Summaries -------------------------------------------------------------------------------------------------------------------


def summary(c: Corpus, *calls: Call) -> DataFrame:
    r = ranked(c, scheme(FREQ, summarizers=calls)).evaluate()
    return r.summary.select("docno", "name", "value", F.round("weight", 6).alias("weight"), "idx")


_R = _FF + ", ranks AS (" + top(_FREQ) + ") "
_E = "1.0::DOUBLE AS weight, -1 AS idx"
register("z01_metadata", BASE + _R + f"SELECT docno, 'metadata' AS name, doclen::VARCHAR AS value, {_E} FROM ranks JOIN meta USING (docno)")(lambda c: summary(c, Call("metadata", {}, {"name": "doclen"})))
register("z02_attribute", BASE + _R + f"SELECT docno, 'attribute' AS name, docid AS value, {_E} FROM ranks JOIN docs USING (docno)")(lambda c: summary(c, Call("attribute", {}, {"name": "docid"})))
register("z03_content", BASE + _R + "SELECT docno, 'content' AS name, t AS value, 1.0::DOUBLE AS weight, pos AS idx FROM (SELECT docno, pos, t FROM tok WHERE pos <= 25) WHERE docno IN (SELECT docno FROM ranks)")(lambda c: summary(c, Call("content", {}, {"type": "orig", "results": 25})))
_M = ", m AS (SELECT r.docno, f.f, f.w, p.pos, k.t FROM ranks r JOIN post p ON p.docno = r.docno AND p.type = 'word' JOIN feat f ON f.value = p.value JOIN tok k ON k.docno = p.docno AND k.pos = p.pos) "
register("z04_listmatch", BASE + _R + _M + "SELECT docno, 'listmatch' AS name, pos || ':' || t || '/W' AS value, w::DOUBLE AS weight, pos AS idx FROM (SELECT *, row_number() OVER (PARTITION BY docno ORDER BY f, pos) AS k FROM m) WHERE k <= 10")(
    lambda c: summary(c, Call("listmatch", {"match": "match"}, {"text": "orig", "tag": "tag", "fmt": "{pos}:{text}/{tag}", "results": 10}))
)
_ACC = "acc AS (SELECT docno, t AS value, sum(w)::DOUBLE AS w FROM m GROUP BY docno, t), acck AS (SELECT *, row_number() OVER (PARTITION BY docno ORDER BY w DESC, value) AS k FROM acc)"
ACCUMATCH = Call("accumatch", {"match": "match"}, {"text": "orig", "results": 5})
register("z05_accumatch", BASE + _R + _M.rstrip() + ", " + _ACC + " SELECT docno, 'accumatch' AS name, value, round(w, 6) AS weight, -1 AS idx FROM acck WHERE k <= 5")(lambda c: summary(c, ACCUMATCH))
register("a04_global_summary", BASE + _R + _M.rstrip() + ", " + _ACC + ", g AS (SELECT value, sum(w) AS w FROM acck WHERE k <= 5 GROUP BY value) SELECT 'accumatch' AS name, value, round(w / (SELECT max(w) FROM g), 6) AS weight FROM g")(
    lambda c: ranked(c, scheme(FREQ, summarizers=[ACCUMATCH])).evaluate().global_summary.select("name", "value", F.round("weight", 6).alias("weight"))
)
register("z09_smart_summary", BASE + _R + f", sm AS ({_SMART}) SELECT docno, 'weight' AS name, printf('%.4f', w) AS value, {_E} FROM ranks JOIN sm USING (docno)")(lambda c: summary(c, SMART))
register("z10_scalar_summary", BASE + _R + f"SELECT docno, 'weight' AS name, printf('%.4f', sqrt(doclen) / 3 + 0.00001) AS value, {_E} FROM ranks JOIN meta USING (docno)")(lambda c: summary(c, Call("scalar", {}, {"function": "sqrt(doclen) / 3 + 0.00001", "metadata": ["doclen"]})))


def _near_query(c: Corpus, call: Call) -> DataFrame:
    q = ranked(c, scheme(FREQ, summarizers=[call]), [(word(W1), 1.0), (word("under"), 1.0), (word(W2), 1.0)], [Join("contains", (word(W1), word(W2)))])
    q.feature("punct", EOS)
    return q.evaluate().summary.select("docno", "name", "value", F.round("weight", 6).alias("weight"), "idx")


register("z06_accunear")(lambda c: _near_query(c, Call("accunear", {"match": "match", "punct": "punct"}, {"collect": "name=near;type=orig;tag=tag;tags=W", "cluster": 0.5, "maxdf": 1.0})))
register("z07_matchphrase")(lambda c: _near_query(c, Call("matchphrase", {"match": "match", "punct": "punct"}, {"text": "orig", "cluster": 0.5, "maxdf": 1.0})))


def _headers(c: Corpus) -> DataFrame:
    from rankloom.operators import summarize

    fields = c.structures.filter("struct = 'sentence' AND struct_index = 2").select("docno", F.col("cstart").alias("fstart"), F.col("cend").alias("fend"))
    return summarize.call("structheader", c, fields, {}, {"text": "orig", "struct": "title"}).select("docno", "fstart", "fend", "value", "idx")


register("z08_structheader", BASE + "h AS (SELECT s.docno, s.a AS fstart, s.b AS fend, t.hstart, t.hend FROM sent s JOIN struc t ON t.docno = s.docno AND t.struct = 'title' AND t.cstart <= s.a AND t.cend >= s.b WHERE s.i = 2) SELECT h.docno, fstart, fend, string_agg(k.t, ' ' ORDER BY k.pos) AS value, 0 AS idx FROM h JOIN tok k ON k.docno = h.docno AND k.pos >= h.hstart AND k.pos < h.hend GROUP BY h.docno, fstart, fend")(_headers)

# Readers -------------------------------------------------------------------------------------------------------------------

register("s01_term", BASE + P("a", "the") + " SELECT docno, pos, 1 AS len FROM a")(lambda c: c.term("word", "the"))
register("s02_frequencies", BASE + P("a", "the") + " SELECT docno, count(*) AS ff FROM a GROUP BY docno")(lambda c: readers.frequency_postings(c, "word", "the"))
register("s03_null", BASE + P("a", "the") + " SELECT docno, pos, 1 AS len FROM a WHERE false")(readers.null_postings)
register("s04_browse", BASE + "x AS (SELECT 1) SELECT docno, unnest([1, 2, 3])::INT AS pos, 1 AS len FROM meta WHERE quality = 1 AND doclen < 100")(lambda c: readers.browse(c, [Compare("=", "quality", 1), Compare("<", "doclen", 100)], 3))
register("s06_forward", BASE + "x AS (SELECT 1) SELECT docno, pos, CASE WHEN NOT regexp_matches(t, '[A-Za-z0-9]') THEN 'P' WHEN regexp_matches(t, '^[0-9]+$') THEN 'N' ELSE 'W' END AS value FROM tok")(lambda c: readers.forward_values(c, "tag"))
register("s07_document_terms", BASE + "x AS (SELECT docno, value, count(*) AS ff, min(pos) AS firstpos FROM post WHERE type = 'word' GROUP BY docno, value) SELECT docno, value, ff, firstpos, count(*) OVER (PARTITION BY value) AS df FROM x")(lambda c: readers.document_terms(c, "word"))
register("s08_structure_at", BASE + "f AS (SELECT DISTINCT docno, hstart AS s, hend AS e FROM struc WHERE struct='title' UNION SELECT docno, cstart, cend FROM struc WHERE struct='title'), a AS (SELECT docno, pos FROM post WHERE type='word' AND value='the') SELECT a.docno, a.pos, arg_min(f.s, f.e) AS fstart, min(f.e) AS fend FROM a JOIN f ON f.docno=a.docno AND f.e > a.pos GROUP BY a.docno, a.pos")(
    lambda c: readers.structure_at(c, c.term("word", "the").select("docno", "pos"))
)
register("s09_metadata", BASE + "x AS (SELECT 1) SELECT docno, doclen, n_chars, quality, toxic FROM meta")(lambda c: c.metadata)
register("s10_attributes", BASE + "x AS (SELECT 1) SELECT docno, 'lang' AS name, lang AS value FROM docs")(lambda c: c.attributes.filter("name = 'lang'"))
register("s11_acl", BASE + "x AS (SELECT 1) SELECT DISTINCT docno FROM docs WHERE source IN ('src2', 'src3')")(lambda c: readers.acl_documents(c, ["src2", "src3"]))
register("s12_value_prefix", BASE + "x AS (SELECT DISTINCT value FROM post WHERE type='word' AND value >= 'li' AND starts_with(value, 'li')) SELECT value FROM x ORDER BY value LIMIT 50")(lambda c: readers.values(c, "term:word", "li", "li", 50))
register("s13_document_statistics", BASE + "x AS (SELECT 1) SELECT docno, count(DISTINCT value) AS terms, count(*) AS occurrences FROM post WHERE type='word' GROUP BY docno")(lambda c: readers.document_statistics(c, "word"))
register("s14_counters", BASE + "x AS (SELECT 1) SELECT count(*) AS n, max(docno) AS max_docno FROM docs")(readers.counters)
register("s15_check", BASE + "x AS (SELECT 1) SELECT unnest(['postings', 'forward', 'metadata', 'attributes']) AS \"table\", 0::BIGINT AS orphans, 0::BIGINT AS repeats")(readers.check)
register("s16_sizes", BASE + "x AS (SELECT 1) SELECT 'docs' AS \"table\", count(*) AS rows FROM docs UNION ALL SELECT 'postings', count(*) FROM post UNION ALL SELECT 'forward', 2 * count(*) FROM tok UNION ALL SELECT 'structures', count(*) FROM struc UNION ALL SELECT 'metadata', count(*) FROM meta UNION ALL SELECT 'attributes', 3 * count(*) FROM docs")(readers.sizes)
register("s17_structure_map", BASE + "x AS (SELECT 1) SELECT docno, struct, struct_index, hstart, hend, '[' || cstart || ',' || cend || ')' AS contents FROM struc")(
    lambda c: readers.structure_map(c).withColumn("contents", F.array_join(F.transform("contents", lambda x: F.concat(F.lit("["), x["start"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit(")"))), " "))
)
register("s18_field_trees", BASE + "f AS (SELECT DISTINCT docno, hstart AS s, hend AS e FROM struc UNION SELECT docno, cstart, cend FROM struc), p AS (SELECT f.docno, f.s, f.e, min({'n': o.e - o.s, 's': o.s, 'e': o.e}) AS b, count(*) AS depth FROM f JOIN f o ON o.docno=f.docno AND o.s <= f.s AND o.e >= f.e AND (o.s <> f.s OR o.e <> f.e) GROUP BY f.docno, f.s, f.e) SELECT f.docno, f.s AS start, f.e AS \"end\", p.b.s AS parent_start, p.b.e AS parent_end, 0 AS crossing, coalesce(p.depth, 0)::BIGINT AS depth FROM f LEFT JOIN p ON p.docno=f.docno AND p.s=f.s AND p.e=f.e")(
    lambda c: readers.field_trees(c.structures.select("docno", F.explode(F.array(F.struct(F.col("hstart").alias("s"), F.col("hend").alias("e")), F.struct(F.col("cstart").alias("s"), F.col("cend").alias("e")))).alias("f")).select("docno", F.col("f.s").alias("start"), F.col("f.e").alias("end")))
)

# Changes -------------------------------------------------------------------------------------------------------------------


def _part(c: Corpus, condition: str, renumber: int = 0) -> Corpus:
    """Some documents of a collection as one of their own, for changes."""
    keep = c.docs.filter(condition).select("docno")
    cut = {t: getattr(c, t).join(keep, "docno", "left_semi").select(*getattr(c, t).columns) for t in storage.TABLES}
    return Corpus(**cut)


def _term_counts(c: Corpus) -> DataFrame:
    return c.postings.groupBy("type").agg(F.count("*").alias("postings"), F.countDistinct("docno").alias("documents"))


def _replaced(c: Corpus) -> DataFrame:
    new = _part(c, "docno % 10 = 3")
    new.postings = new.postings.filter("type <> 'word' OR pos <= 5")
    return _term_counts(storage.replace(c, new))


_CHANGED = "SELECT type, count(*) AS postings, count(DISTINCT docno) AS documents FROM post WHERE {} GROUP BY type"
register("w01_replace", BASE + "x AS (SELECT 1) " + _CHANGED.format("docno % 10 <> 3 OR type <> 'word' OR pos <= 5"))(_replaced)


def _updated(c: Corpus) -> DataFrame:
    new = _part(c, "docno % 10 = 4")
    part = Corpus(None, new.postings.filter("type = 'word' AND pos <= 3"), None, None, None, None)
    # The words of these documents are replaced as a whole, also where none of the new ones are left.
    words = c.docs.filter("docno % 10 = 4").select("docno", F.lit("word").alias("type"))
    one = c.spark.createDataFrame([(2, "eos")], "docno long, type string")
    return _term_counts(storage.update(c, part, clear_terms=words.unionByName(one)))


register("w02_partial_update", BASE + "x AS (SELECT 1) " + _CHANGED.format("(docno % 10 <> 4 OR type <> 'word' OR pos <= 3) AND NOT (docno = 2 AND type = 'eos')"))(_updated)
register("w03_delete", BASE + "x AS (SELECT 1) " + _CHANGED.format("docno % 7 <> 0"))(lambda c: _term_counts(storage.delete(c, c.docs.filter("docno % 7 = 0"))))
register("w04_delete_user", BASE + "x AS (SELECT 1) SELECT source AS username, count(*) AS n FROM docs WHERE source <> 'src1' GROUP BY source")(lambda c: storage.delete_user(c, "src1").acl.groupBy("username").agg(F.count("*").alias("n")))
register("w05_set_metadata", BASE + "x AS (SELECT 1) SELECT docno, CASE WHEN docno % 2 = 0 THEN least(docno * 1000, 65535)::INT ELSE quality END AS quality FROM meta")(
    lambda c: storage.set_metadata(c, c.docs.filter("docno % 2 = 0").select("docno", (F.col("docno") * 1000).alias("value")), "quality", "uint16").metadata.select("docno", F.col("quality").cast("int").alias("quality"))
)


def _explicit(c: Corpus) -> DataFrame:
    extra = c.spark.createDataFrame([("word", W1, 10), ("word", "unseen", 3), ("word", W1, -4)], "type string, value string, increment long")
    return storage.term_statistics(c, extra).filter(f"type = 'word' AND value IN ('{W1}', '{W2}', 'unseen')")


register("w06_explicit_df", BASE + f"x AS (SELECT type, value, count(DISTINCT docno)::BIGINT AS df FROM post WHERE type='word' AND value IN ('{W1}','{W2}') GROUP BY type, value UNION ALL VALUES ('word','{W1}',10), ('word','unseen',3), ('word','{W1}',-4)) SELECT type, value, sum(df)::BIGINT AS df FROM x GROUP BY type, value")(_explicit)
register("w08_metadata_alter", BASE + "x AS (SELECT 1) SELECT docno, least(doclen, 255)::INT AS size, quality AS good, 0 AS extra FROM meta")(
    lambda c: storage.alter_metadata(c.metadata, {"extra": "int32"}, {"doclen": ("size", "uint8")}, {"quality": "good"}, ["toxic", "n_chars"]).select("docno", F.col("size").cast("int").alias("size"), "good", "extra")
)
register("w13_differences", BASE + "g AS (SELECT count(*) AS n FROM post WHERE docno % 7 = 0), x AS (SELECT 1) SELECT 'postings' AS \"table\", 'first' AS only_in, n AS rows FROM g UNION ALL SELECT 'postings', 'second', 0")(lambda c: storage.differences(c, storage.delete(c, c.docs.filter("docno % 7 = 0")), ("postings",)))

# Statistics ------------------------------------------------------------------------------------------------------------------

register("d01_changes", BASE + "x AS (SELECT 1) SELECT source AS node, type, value, count(DISTINCT docno) AS increment FROM post JOIN docs USING (docno) WHERE type IN ('word','eos','lang','source') GROUP BY source, type, value UNION ALL SELECT source, '#documents', '', count(*) FROM docs GROUP BY source")(stats.changes)
register("d02_statistics_map", BASE + "x AS (SELECT 1) SELECT type, value, count(DISTINCT docno)::BIGINT AS df FROM post GROUP BY type, value UNION ALL SELECT '#documents', '', count(*)::BIGINT FROM docs")(lambda c: stats.statistics(stats.changes(c)))


def _timed(c: Corpus) -> DataFrame:
    n = F.regexp_extract("node", r"(\d+)", 1).cast("int")
    return stats.changes(c).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + n * 60))


register("d03_changes_since", BASE + "x AS (SELECT source, type, value, count(DISTINCT docno) AS n FROM post JOIN docs USING (docno) WHERE regexp_extract(source, '(\\d+)', 1)::INT > 15 GROUP BY source, type, value) SELECT type, value, sum(n)::BIGINT AS df FROM x GROUP BY type, value UNION ALL SELECT '#documents', '', count(*)::BIGINT FROM docs WHERE regexp_extract(source, '(\\d+)', 1)::INT > 15")(
    lambda c: stats.statistics(stats.since(_timed(c), F.timestamp_seconds(F.lit(1_700_000_000 + 15 * 60))))
)


def _merged(c: Corpus) -> DataFrame:
    lists = []
    for condition in ("docno % 2 = 0", "docno % 2 = 1"):
        q = ranked(c, scheme(FREQ))
        docs = q.filtered(q.visited()).filter(condition)
        w = q.weighted(docs).select("docno", "weight")
        lists.append(w.orderBy(F.round("weight", 9).desc(), F.col("docno").desc()).limit(15))
    return stats.merge(lists, 2, 10).select("docno", F.round("weight", 6).alias("weight"))


register("d04_merge", BASE + _FF + ", z AS (" + top(_FREQ, 10, 2) + ") SELECT docno, weight FROM z")(_merged)


def _client(c: Corpus) -> DataFrame:
    q = ranked(c, scheme(BM25))
    q.term_statistics("word", W1, 7).global_statistics(50_000)
    return ranks_of(q.evaluate())


_CLIENT = f"SELECT ff.docno, sum(ff.w * log10((50000 - d + 0.5) / (d + 0.5)) * ff.ff * 2.5 / (ff.ff + 1.5 * (0.25 + 0.75 * m.doclen / 400.0))) AS w FROM (SELECT ff.*, CASE WHEN ff.f = 0 THEN 7 ELSE dfs.df END AS d FROM ff JOIN dfs USING (f)) ff JOIN meta m ON m.docno = ff.docno GROUP BY ff.docno"
register("d05_client_statistics", BASE + _FF + top(_CLIENT))(_client)

# Programs, vectors, scalar functions ------------------------------------------------------------------------------------------

PROGRAM = f"""
# terms that every query has
TERM match {W1} : word; TERM match "{W2}" : word;
SELECT match; WEIGHT match;
EVAL bm25( b = 0.75, k1 = 1.5, avgdoclen = 400);
EVAL metadata( name = quality);
FORMULA "_0 * 2 + _1";
SUMMARIZE id = attribute( name = docid);
"""
_PROG = "SELECT a.docno, a.w * 2 + m.quality AS w FROM (SELECT ff.docno, sum(idf * ff.ff * 2.5 / (ff.ff + 1.5 * (0.25 + 0.75 * m.doclen / 400.0))) AS w FROM ff JOIN idf USING (f) JOIN meta m ON m.docno = ff.docno WHERE ff.f < 2 GROUP BY ff.docno) a JOIN meta m USING (docno)"
register("x08_program", BASE + _FF + top(_PROG))(lambda c: ranks_of(program.parse(PROGRAM).query(c).evaluate()))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.filter("vec_id = 0").first()["embedding"]
    return vectors.similar(v, q, 10).select("vec_id", F.round("similarity", 5).alias("similarity"))


QUERIES["x05_similar_vectors"] = _similar
SQL["x05_similar_vectors"] = "WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q.e) AS c FROM embeddings, q) SELECT vec_id, round(c, 5) AS similarity FROM s ORDER BY round(c, 9) DESC, vec_id LIMIT 10"

#: An expression of each scalar function over l_quantity (x) and l_discount (y), in our language and in SQL.
SCALAR = {
    "fabs": ("fabs(y - x)", "abs(y - x)"),
    "floor": ("floor(x * y)", "floor(x * y)"),
    "ceil": ("ceil(x * y)", "ceil(x * y)"),
    "log": ("log(x + 1)", "log10(x + 1)"),
    "log2": ("log(x + 1, 2 + y)", "ln(x + 1) / ln(2 + y)"),
    "ln": ("ln(x + 1)", "ln(x + 1)"),
    "exp": ("exp(y)", "exp(y)"),
    "sqrt": ("sqrt(x)", "sqrt(x)"),
    "sqr": ("sqr(x - y)", "(x - y) * (x - y)"),
    "pow": ("pow(x, y)", "pow(x, y)"),
    "mod": ("mod(x, 7)", "x % 7"),
    "xor": ("xor(x, 13)", "xor(x::BIGINT, 13)::DOUBLE"),
    "and": ("and(x, 13)", "(x::BIGINT & 13)::DOUBLE"),
    "or": ("or(x, 13)", "(x::BIGINT | 13)::DOUBLE"),
    "bcnt": ("bcnt(x)", "bit_count(x::BIGINT)::DOUBLE"),
    "sin": ("sin(x)", "sin(x)"),
    "cos": ("cos(x)", "cos(x)"),
    "tan": ("tan(y)", "tan(y)"),
    "sinh": ("sinh(y)", "sinh(y)"),
    "cosh": ("cosh(y)", "cosh(y)"),
    "tanh": ("tanh(y)", "tanh(y)"),
    "asin": ("asin(y)", "asin(y)"),
    "acos": ("acos(y)", "acos(y)"),
    "atan": ("atan(x)", "atan(x)"),
    "if_gt": ("if_gt(x, 25, x, y - 1)", "CASE WHEN x > 25 THEN x ELSE y - 1 END"),
    "if_ge": ("if_ge(x, 25, x, y)", "CASE WHEN x >= 25 THEN x ELSE y END"),
    "if_lt": ("if_lt(x, 25, x, y)", "CASE WHEN x < 25 THEN x ELSE y END"),
    "if_le": ("if_le(x, 25, x, y)", "CASE WHEN x <= 25 THEN x ELSE y END"),
    "if_eq": ("if_eq(x, 25, 1, 0)", "CASE WHEN x = 25 THEN 1.0 ELSE 0.0 END"),
    "infix": ("-(x + 2) * 3 - y / x + 4", "-(x + 2) * 3 - y / x + 4"),
}


def _scalar(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
        value = scalar.compile(text, names={"x": F.col("l_quantity"), "y": F.col("l_discount")})
        return rows.select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"))

    return run


for _name, (_text, _sql) in SCALAR.items():
    QUERIES[f"fn_{_name}"] = _scalar(_text)
    SQL[f"fn_{_name}"] = f"WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y FROM lineitem) SELECT l_orderkey, l_linenumber, round(({_sql})::DOUBLE, 6) AS value FROM l"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty documents by BM25 with their ids."""
    c = from_tables(spark, sf_dir)
    r = ranked(c, scheme(BM25, summarizers=[Call("attribute", {}, {"name": "docid"})])).evaluate()
    return r.ranks.join(r.summary.select("docno", F.col("value").alias("docid")), "docno").select("rank", "docno", "docid", F.round("weight", 6).alias("weight")).orderBy("rank")
