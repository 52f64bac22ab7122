"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit takes its body from the latest earlier full response of the same canonical URL.  The join is a window, not a range
join: within a slice of time each URL's records run in order and carry the last full response along; across slices only one row per
URL and slice is carried, by a window over these rows.  The number of slices grows with the table (one for each ``SLICE_ROWS`` records, from
``SLICES`` to ``MOST_SLICES``), and a URL that holds a third of all records is spread over as many tasks; records without
a url or ts are spread by their record_id.  Validators are then compared (entity tags weakly, else Last-Modified), and the headers that a 304
may bring replace the stored ones.

Rows: ``records`` has record_id, url, ts (long), status, headers (map of lower-case names), and may have more columns, which are left out.
Status 200 is a full response, 304 a revisit; others are neither.  "Earlier" is a smaller ts; of responses with equal ts
the greatest record_id counts.  A url that isn't ``scheme://host...`` is a key of its own, its text without white space around it, and meets equal
texts only.  A null url matches nothing; rows with null ts are never earlier and have nothing earlier.
A null header map has no headers.  Repeated rows are resolved each.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a 304 response may update (RFC 9110, 15.4.5), and parameters that don't name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
SLICES, MOST_SLICES, SLICE_ROWS = 32, 1024, 2_000_000


#: Scheme, authority, path and query; white space is ASCII.
URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\x09-\x0D\x20]+)([^?#]*)(?:[?]([^#]*))?(?:#.*)?$"
AROUND = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and a default port, path without last slashes, parameters sorted, trackers, fragment and scheme gone.

    Schemes other than http and https stay in front.  What can't be parsed is its own text behind a space, so that it equals no parsed url.
    """
    bare = F.regexp_replace(url, AROUND, "")
    part = lambda k: F.regexp_extract(bare, URL, k)
    scheme = F.lower(part(1))
    front = F.when(scheme.isin("http", "https"), "").otherwise(F.concat(scheme, F.lit("://")))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(part(3), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    parsed = F.concat(front, host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(bare.rlike(URL), parsed).otherwise(F.concat(F.lit(" "), bare))


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """(record_id, url_key, ts, outcome, response_id, response_ts, headers) for each revisit.

    outcome: "resolved", "validators differ" (headers stay the revisit's own) or "no earlier response".
    """
    keyed = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "status", F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"))
    keyed = keyed.where(F.col("status").isin(200, 304))
    slices = slices or max(SLICES, min(MOST_SLICES, keyed.count() // SLICE_ROWS))
    cuts = sorted(set(keyed.approxQuantile("ts", [k / slices for k in range(1, slices)], 0.16 / slices))) if slices > 1 else []
    cut = F.filter(F.array(*(F.lit(int(c)) for c in cuts)).cast("array<bigint>"), lambda c: c < F.col("ts"))
    placed = F.col("ts").isNotNull() & F.col("url_key").isNotNull()
    keyed = keyed.withColumn("slice", F.when(placed, F.size(cut)).otherwise(-1 - F.pmod(F.xxhash64("record_id"), F.lit(slices)).cast("int")))
    full = F.when((F.col("status") == 200) & placed, F.struct("ts", "record_id"))
    inside = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    ends = keyed.where(placed).groupBy("url_key", "slice").agg(F.max(full).alias("f"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url_key", "slice", F.max("f").over(before).alias("carried"))
    met = keyed.withColumn("here", F.max(full).over(inside)).where("status = 304").join(carried, ["url_key", "slice"], "left")
    best = met.withColumn("r", F.when(placed, F.coalesce("here", "carried"))).drop("here", "carried", "slice", "status")
    stored = keyed.where("status = 200").select(F.col("record_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("headers").alias("stored"))
    stored = stored.groupBy("response_id", "response_ts").agg(F.min_by("stored", F.to_json("stored")).alias("stored"))
    joined = best.withColumn("response_id", F.col("r.record_id")).withColumn("response_ts", F.col("r.ts")).join(stored, ["response_id", "response_ts"], "left")
    tag = lambda c: F.regexp_replace(F.element_at(c, "etag"), r"^W/", "")
    same = F.when(tag("headers").isNotNull() & tag("stored").isNotNull(), tag("headers") == tag("stored")).otherwise(F.coalesce(F.element_at("headers", "last-modified") == F.element_at("stored", "last-modified"), F.lit(False)))
    outcome = F.when(F.col("stored").isNull(), "no earlier response").when(same, "resolved").otherwise("validators differ")
    news = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(news), k)), news)
    return joined.withColumn("outcome", outcome).select("record_id", "url_key", "ts", "outcome", "response_id", "response_ts", F.when(F.col("outcome") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records made from ``pages``: three pages in a row are captures of one address, fetched and revisited in turn.

    A page is fetched at 10 * page_id, at its group's first url, written in one of four ways; one in five groups has nothing but an error for its first
    page, and one in seven an address that is no url.  Every page is revisited 5 and 1005 time steps later with its own
    entity tag; every fourth revisit has no tag but a Last-Modified, every seventh page only the latter.  So the first revisit finds its own page, or nothing, and the second one a
    later capture of the address, which may differ.  Pages without a page_id have no records.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 8), F.lit('"'))
    group = F.floor(F.col("page_id") / 3)
    modified = F.concat(F.lit("day "), F.floor(F.col("page_id") / 2).cast("string"))
    first_url = F.first("url").over(Window.partitionBy("group").orderBy("page_id"))
    way = F.col("page_id") % 4
    url = F.when(F.col("group") % 7 == 3, F.concat(F.lit("page:"), F.col("group").cast("string"))).otherwise(F.col("u"))
    url = F.when(way == 1, F.concat(url, F.lit(" "))).when(way == 2, F.concat(F.lit("\t"), url)).otherwise(url)
    base = pages.where("page_id is not null").select("page_id", "url", F.when(F.col("page_id") % 7 == 0, F.lit(None)).otherwise(tag).alias("tag"), group.alias("group"))
    base = base.withColumn("u", first_url).select("page_id", "group", url.alias("url"), "tag", modified.alias("modified"))
    of = lambda **kv: F.map_filter(F.map_from_arrays(F.array(*(F.lit(k.replace("_", "-")) for k in kv)), F.array(*kv.values())), lambda k, v: v.isNotNull())
    status = F.when((F.col("group") % 5 == 2) & (F.col("page_id") % 3 == 0), 404).otherwise(200)
    first = base.select((F.col("page_id") * 3).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), status.alias("status"), of(etag=F.col("tag"), last_modified=F.col("modified"), content_type=F.lit("text/html"), date=F.concat(F.lit("t"), (F.col("page_id") * 10).cast("string"))).alias("headers"))
    again = base.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    later = F.col("page_id") * 10 + F.when(F.col("k") == 1, 5).otherwise(1005)
    revisit = again.select((F.col("page_id") * 3 + F.col("k")).alias("record_id"), "url", later.alias("ts"), F.lit(304).alias("status"), of(etag=F.when((F.col("page_id") + F.col("k")) % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), F.col("tag"))), last_modified=F.col("modified"), server=F.lit("x"), date=F.concat(F.lit("t"), later.cast("string"))).alias("headers"))
    return first.unionByName(revisit)


_BARE = f"regexp_replace(url, '{AROUND}', '', 'g')"
_PART = lambda k: f"regexp_extract({_BARE}, '{URL}', {k})"
_KEY = rf"""
  CASE WHEN url IS NULL THEN NULL WHEN NOT regexp_matches({_BARE}, '{URL}') THEN ' ' || {_BARE} ELSE
  CASE WHEN lower({_PART(1)}) IN ('http', 'https') THEN '' ELSE lower({_PART(1)}) || '://' END
  || regexp_replace(regexp_replace(lower({_PART(2)}), ':(80|443)?$', ''), '^www\.', '') || regexp_replace({_PART(3)}, '/+$', '')
  || coalesce((SELECT '?' || string_agg(p, '&' ORDER BY p) FROM (SELECT unnest(string_split({_PART(4)}, '&')) AS p) WHERE p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)=') HAVING count(*) > 0), '') END
"""

ORACLE = f"""
WITH grouped AS (
  SELECT page_id, html, page_id // 3 AS grp, first_value(url) OVER (PARTITION BY page_id // 3 ORDER BY page_id) AS u FROM pages WHERE page_id IS NOT NULL
), addressed AS (
  SELECT *, CASE WHEN grp % 7 = 3 THEN 'page:' || grp ELSE u END AS a FROM grouped
), written AS (
  SELECT *, CASE page_id % 4 WHEN 1 THEN a || ' ' WHEN 2 THEN chr(9) || a ELSE a END AS url FROM addressed
), base AS (
  SELECT page_id, grp, {_KEY} AS url_key, CASE WHEN page_id % 7 = 0 THEN NULL ELSE '"' || substr(md5(html), 1, 8) || '"' END AS tag, 'day ' || (page_id // 2) AS modified FROM written
), responses AS (
  SELECT page_id * 3 AS response_id, url_key, page_id * 10 AS response_ts, tag AS r_tag, modified AS r_modified FROM base WHERE NOT (grp % 5 = 2 AND page_id % 3 = 0)
), revisits AS (
  SELECT page_id * 3 + k AS record_id, url_key, page_id * 10 + CASE WHEN k = 1 THEN 5 ELSE 1005 END AS ts,
    CASE WHEN (page_id + k) % 4 = 0 THEN NULL ELSE tag END AS tag, modified FROM base, (VALUES (1), (2)) AS t(k)
), met AS (
  SELECT v.*, r.response_id, r.response_ts, r.r_tag, r.r_modified,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.response_ts DESC NULLS LAST, r.response_id DESC) AS turn
  FROM revisits v LEFT JOIN responses r ON v.url_key = r.url_key AND r.response_ts < v.ts
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no earlier response'
    WHEN CASE WHEN tag IS NOT NULL AND r_tag IS NOT NULL THEN tag = r_tag ELSE modified = r_modified END THEN 'resolved' ELSE 'validators differ' END AS outcome
  FROM met WHERE turn = 1
)
SELECT record_id, url_key, ts, outcome, response_id, response_ts,
  CASE WHEN outcome = 'resolved' AND tag IS NULL THEN r_tag WHEN tag IS NULL THEN NULL ELSE 'W/' || tag END AS etag,
  CASE WHEN outcome = 'resolved' THEN r_modified ELSE modified END AS last_modified, 't' || ts AS date, CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type,
  CASE WHEN outcome <> 'resolved' THEN 'x' END AS server
FROM judged
"""
