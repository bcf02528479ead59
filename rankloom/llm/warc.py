"""Resolution of not-modified revisits in web archive records.

A revisit record says that a page was as before and has no payload.  Each one is joined as of its time with the latest
earlier full response of the same canonical URL.  It is resolved if the validators agree (entity tags by weak comparison,
else the last-modified times, else there is nothing to check); its headers are those of the full response, with the fields
that a not-modified answer may renew taken from the revisit.

The join is built from window and aggregate expressions.  The time line is cut into blocks.  For each URL and block the last
full response is aggregated (partial sums first); a window over a URL's blocks carries it forward; within a block a window
finds the latest earlier response.  So a URL that holds a third of all records is spread over its blocks.

Records: record_id, url, ts (a number), kind ("response" or "revisit"), status, digest, etag, last_modified, headers (map
with lower-case names).  Defined results: a record of another kind or status than 200 never answers a revisit; records at
the same ts are ordered by record_id; a null url, ts or kind resolves nothing and answers nothing, and state says so; of
headers that are null none are merged.  Repeated rows give rows each; an empty table gives none; other columns are ignored.
captures(): a page without url or html gives records without them; repeated pages give records each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified answer may renew (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m. and default port, path without final slashes or .html, query without tracking
    fields and in order; no scheme, no fragment.  A URL that names no host (no ://) stays as it is."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(\.html|/+)$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), _TRACKING, ""), r"^&+", "")
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    made = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), made).otherwise(url)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, blocks: int = 1024) -> DataFrame:
    """One row per revisit: record_id, canonical_url, state, refers_to, refers_to_ts, digest, headers.

    state: resolved, unchecked (no validator to compare), mismatch (the response is named, but neither digest nor headers
    are taken) or missing (no earlier full response)."""
    r = records.select("record_id", "ts", "kind", "status", "digest", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    # Two numbers cut the time line, a thousandth of the records beyond each, so that outliers don't widen the blocks.
    low, high = records.agg(F.percentile_approx("ts", [0.001, 0.999], 10_000)).first()[0] or (0, 0)
    span = max(1, (high - low) // blocks + 1)
    r = r.withColumn("_block", F.least(F.greatest(F.floor((F.col("ts") - F.lit(low)) / F.lit(span)), F.lit(-1)), F.lit(blocks)))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    answer = F.struct("ts", "record_id", "digest", "etag", "last_modified", "headers")
    order = F.struct("ts", "record_id")
    ends = r.filter(full).groupBy("canonical_url", "_block").agg(F.max_by(answer, order).alias("_end"))
    asked = r.filter(F.col("kind") == "revisit").select("canonical_url", "_block").distinct()
    line = asked.join(ends, ["canonical_url", "_block"], "full")
    before = Window.partitionBy("canonical_url").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.select("canonical_url", "_block", F.last("_end", True).over(before).alias("_carry"))
    inside = Window.partitionBy("canonical_url", "_block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    known = r.filter(full | (F.col("kind") == "revisit")).select("*", F.last(F.when(full, answer), True).over(inside).alias("_near")).filter(F.col("kind") == "revisit")
    joined = known.join(carried, ["canonical_url", "_block"], "left").withColumn("_a", F.when(F.col("ts").isNotNull() & F.col("canonical_url").isNotNull(), F.coalesce("_near", "_carry")))
    a = F.col("_a")
    tags = F.col("etag").isNotNull() & a["etag"].isNotNull()
    times = F.col("last_modified").isNotNull() & a["last_modified"].isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(a["etag"])).when(times, F.col("last_modified") == a["last_modified"])
    state = F.when(a.isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    taken = state.isin("resolved", "unchecked")
    renewed = F.map_filter(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(F.coalesce(a["headers"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return joined.select(
        "record_id",
        "canonical_url",
        state.alias("state"),
        a["record_id"].alias("refers_to"),
        a["ts"].alias("refers_to_ts"),
        F.when(taken, a["digest"]).alias("digest"),
        F.when(taken, F.map_concat(old, renewed)).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """An archive's records from a table of pages: each page is fetched, some are fetched again with a changed payload, and
    each is revisited later under another form of its URL; some are revisited before they were fetched, and some revisits
    carry validators that don't agree."""
    p = pages.select("page_id", "url", F.sha2("html", 256).alias("h"), F.sha2(F.concat("html", F.lit("v2")), 256).alias("h2"), F.octet_length("html").cast("string").alias("n"))
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.)?", ""), r"#.*$", "")
    other = F.concat(F.lit("https://www."), bare, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_campaign=again"))
    i = F.col("page_id")

    def tag(h: str) -> Column:
        return F.concat(F.lit('"'), F.substring(h, 1, 16), F.lit('"'))

    def headers(**fields) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in fields]), F.array(*fields.values()))

    def record(k: int, ts: Column, url: Column, kind: str, status: int, digest, etag, modified, head) -> Column:
        return F.struct((i * 5 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), digest.alias("digest"), etag.alias("etag"), modified.cast("string").alias("last_modified"), head.alias("headers"))

    first, second, later, early = i * 100, i * 100 + 30_000, i * 100 + 50_000, i * 100 - 10
    changed = i % 3 == 0
    now_tag = F.when(i % 7 == 0, F.lit('"none"')).when(changed, F.concat(F.lit("W/"), tag("h2"))).otherwise(tag("h"))
    none = F.lit(None).cast("string")
    server = F.lit("archive")
    rows = F.array(
        record(0, first, F.col("url"), "response", 200, F.col("h"), tag("h"), first, headers(content_type=F.lit("text/html"), content_length=F.col("n"), etag=tag("h"), date=first.cast("string"), server=server)),
        F.when(changed, record(1, second, F.col("url"), "response", 200, F.col("h2"), tag("h2"), second, headers(content_type=F.lit("text/html"), content_length=F.col("n"), etag=tag("h2"), date=second.cast("string"), server=server))),
        record(2, later, other, "revisit", 304, none, F.when(i % 4 != 1, now_tag), F.when(i % 4 == 1, F.when(changed, second).otherwise(first)), headers(date=later.cast("string"), cache_control=F.lit("max-age=60"), server=F.lit("other"))),
        F.when(i % 5 == 0, record(3, early, other, "revisit", 304, none, tag("h"), none, headers(date=early.cast("string")))),
        F.when(i % 11 == 0, record(4, later + 5, other, "response", 503, none, none, none, headers(date=(later + 5).cast("string")))),
    )
    return p.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("r.*")


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")


#: The query's rows in DuckDB's SQL: the same records, and an as-of join.
ORACLE = r"""
WITH p AS (
  SELECT page_id i, url, sha256(html) h, sha256(html || 'v2') h2, CAST(strlen(html) AS VARCHAR) n,
         'https://www.' || regexp_replace(regexp_replace(url, '^https?://(www\.|m\.)?', ''), '#.*$', '')
           || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_campaign=again' AS other
  FROM pages
), t AS (
  SELECT *, '"' || substr(h, 1, 16) || '"' AS t1, '"' || substr(h2, 1, 16) || '"' AS t2 FROM p
), rec AS (
  SELECT i*5 AS record_id, url, i*100 AS ts, 'response' AS kind, h AS digest, t1 AS etag, CAST(i*100 AS VARCHAR) AS last_modified,
         MAP {'content-type':'text/html','content-length':n,'etag':t1,'date':CAST(i*100 AS VARCHAR),'server':'archive'} AS headers FROM t
  UNION ALL
  SELECT i*5+1, url, i*100+30000, 'response', h2, t2, CAST(i*100+30000 AS VARCHAR),
         MAP {'content-type':'text/html','content-length':n,'etag':t2,'date':CAST(i*100+30000 AS VARCHAR),'server':'archive'} FROM t WHERE i%3=0
  UNION ALL
  SELECT i*5+2, other, i*100+50000, 'revisit', NULL,
         CASE WHEN i%4<>1 THEN CASE WHEN i%7=0 THEN '"none"' WHEN i%3=0 THEN 'W/' || t2 ELSE t1 END END,
         CASE WHEN i%4=1 THEN CAST(CASE WHEN i%3=0 THEN i*100+30000 ELSE i*100 END AS VARCHAR) END,
         MAP {'date':CAST(i*100+50000 AS VARCHAR),'cache-control':'max-age=60','server':'other'} FROM t
  UNION ALL
  SELECT i*5+3, other, i*100-10, 'revisit', NULL, t1, NULL, MAP {'date':CAST(i*100-10 AS VARCHAR)} FROM t WHERE i%5=0
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\.html|/+)$', '') AS path,
         array_to_string(list_sort(string_split(regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', ''), '&')), '&') AS query
  FROM rec
), c AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url, ts * 1000000000 + record_id AS k FROM q
), j AS (
  SELECT v.*, a.record_id AS a_id, a.ts AS a_ts, a.digest AS a_digest, a.etag AS a_etag, a.last_modified AS a_mod, a.headers AS a_headers
  FROM (SELECT * FROM c WHERE kind = 'revisit') v
  ASOF LEFT JOIN (SELECT * FROM c WHERE kind = 'response') a ON v.canonical_url = a.canonical_url AND v.k > a.k
), s AS (
  SELECT *, CASE WHEN a_id IS NULL THEN 'missing'
                 WHEN etag IS NOT NULL AND a_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(a_etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
                 WHEN last_modified IS NOT NULL AND a_mod IS NOT NULL THEN CASE WHEN last_modified = a_mod THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unchecked' END AS state FROM j
)
SELECT record_id, canonical_url, state, a_id AS refers_to, a_ts AS refers_to_ts,
       CASE WHEN state IN ('resolved', 'unchecked') THEN a_digest END AS digest,
       CASE WHEN state IN ('resolved', 'unchecked') THEN array_to_string(list_sort(list_transform(map_entries(map_concat(a_headers,
         map_from_entries(list_filter(map_entries(headers), lambda e: e.key IN ('cache-control','content-location','date','etag','expires','last-modified','vary'))))),
         lambda e: e.key || ':' || e.value)), '|') END AS headers
FROM s
"""
