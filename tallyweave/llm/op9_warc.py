"""Not-modified revisit resolution for web-archive records.

A revisit record has no payload; it stands for the latest earlier full response of its canonical URL. The as-of join
finds that response, validators say whether it is the one meant, and the revisit gets its payload and its headers, with
those that a 304 may update taken from the revisit.

At scale: the as-of join runs on narrow rows. It is dealt out by (URL, stretch of time), the stretches being quantiles of all
times, so a URL with a third of all records still spreads over STRETCHES tasks; what earlier stretches end with comes
from one row a (URL, stretch). Payloads are shuffled once, by record id, and only responses that a revisit needs meet one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_dealt_anew, table, written

STRETCHES = 64
# Fields that a not-modified answer may update, in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKERS = r"([?&])(?:utm_[^=&]*|gclid|fbclid|phpsessid|sessionid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path, and query without trackers; no scheme, fragment or last slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(?:www[0-9]*\.)|:(?:80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, TRACKERS, "$1"), "&&+", "&"), r"\?&", "?")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def _header(name: str, of: str = "headers") -> Column:
    return F.get(F.map_values(F.map_filter(of, lambda k, v: F.lower(k) == name)), F.lit(0))


def _validators(digest: str, etag: str, modified: str) -> Column:
    tag = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    return (
        F.when(F.col(digest).isNotNull() & F.col(f"s.{digest}").isNotNull(), F.col(digest) == F.col(f"s.{digest}"))
        .when(F.col(etag).isNotNull() & F.col(f"s.{etag}").isNotNull(), tag(etag) == tag(f"s.{etag}"))
        .when(F.col(modified).isNotNull() & F.col(f"s.{modified}").isNotNull(), F.col(modified) == F.col(f"s.{modified}"))
        .otherwise(F.lit(True))
    )


def as_of(light: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """Revisits of light (record_id, key, ts, kind, ...) with `s`: the struct of the latest response of the key before ts."""
    cuts = light.where("ts is not null").approxQuantile("ts", [i / stretches for i in range(1, stretches)], 1 / (4 * stretches))
    stretch = F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>"), lambda c: c <= F.col("ts")))
    rows = light.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).withColumn("stretch", stretch)
    # the greatest struct is the latest response, ties by the greater id
    seen = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "etag", "modified", "headers_json"))
    rows = written(rows.withColumn("seen", seen), "captures")
    inside = Window.partitionBy("key", "stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("seen").over(inside)).where("kind = 'revisit'").drop("seen")
    ends = rows.groupBy("key", "stretch").agg(F.max("seen").alias("seen"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.max("seen").over(before)).drop("seen")
    return join_dealt_anew(near, ends, ["key", "stretch"], "left").withColumn("s", F.coalesce("near", "carried")).drop("near", "carried", "stretch")


def resolve_revisits(records: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """One row per row of records (record_id long, url, ts long, kind, headers map, payload, digest): record_id, key, ts, kind,
    status, source_id, headers, payload.

    status: 'full' (a response: itself), 'resolved', 'mismatch' (the response before it has other validators), 'missing' (none
    before, or null url or ts); the latter two have null payload and their own headers. digests are compared first, else
    etags (weakly), else last-modified; without any in common the response is taken. Responses of the same URL and time: the greatest record_id is
    the latest. A response repeated under one record_id is one response. Repeated revisits stay repeated; an empty table
    gives no row; further columns are ignored.
    """
    r = records.select(F.col("record_id").cast("long"), canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload", "digest")
    light = r.select("record_id", "key", "ts", "kind", "digest", _header("etag").alias("etag"), _header("last-modified").alias("modified"), F.to_json("headers").alias("headers_json"))
    found = as_of(light, stretches)
    fits = _validators("digest", "etag", "modified")
    status = F.when(F.col("s").isNull(), "missing").when(fits, "resolved").otherwise("mismatch")
    found = found.withColumn("status", status).select("record_id", "key", "ts", "status", F.when(F.col("status") == "resolved", F.col("s.record_id")).alias("source_id"), "headers_json", F.col("s.headers_json").alias("old_json"))
    found = found.unionByName(light.where("kind = 'revisit' and (key is null or ts is null)").select("record_id", "key", "ts", F.lit("missing").alias("status"), F.lit(None).cast("long").alias("source_id"), "headers_json", F.lit(None).cast("string").alias("old_json")))
    full = r.where("kind = 'response'")
    payloads = full.select(F.col("record_id").alias("source_id"), "payload")
    if full.groupBy("record_id").count().where("count > 1").limit(1).count():
        payloads = payloads.dropDuplicates(["source_id"])
    # what has no source needs no payload, and would all be one null key
    resolved = found.where("source_id is not null").join(payloads, "source_id")
    got = resolved.unionByName(found.where("source_id is null").withColumn("payload", F.lit(None).cast("string")))
    new, old = F.from_json("headers_json", "map<string,string>"), F.from_json("old_json", "map<string,string>")
    allowed = lambda k: F.lower(k).isin(*PERMITTED)
    fresh = F.map_filter(new, lambda k, v: allowed(k))
    names = F.transform(F.map_keys(fresh), lambda k: F.lower(k))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(names, F.lower(k))), fresh)
    got = got.select("record_id", "key", "ts", F.lit("revisit").alias("kind"), "status", "source_id", F.when(F.col("status") == "resolved", merged).otherwise(new).alias("headers"), "payload")
    return full.select("record_id", "key", "ts", "kind", F.lit("full").alias("status"), F.col("record_id").alias("source_id"), "headers", "payload").unionByName(got)


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page, from the table alone: a response, and a revisit.

    By page_id % 4 the revisit repeats the etag, repeats the last-modified date, has the etag of another page, or comes before
    the response.
    """
    tag = lambda x: F.substring(F.md5(x.cast("binary")), 1, 16)
    k = F.col("page_id") % 4
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    response = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (10 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), day, F.lit("ETag"), tag(F.col("html")), F.lit("Last-Modified"), day, F.lit("Server"), F.lit("first")).alias("headers"),
        F.col("html").alias("payload"), F.lit(None).cast("string").alias("digest"),
    )
    validator = F.when(k == 1, F.create_map(F.lit("Last-Modified"), day)).otherwise(F.create_map(F.lit("ETag"), F.when(k == 2, tag(F.col("url"))).otherwise(tag(F.col("html")))))
    revisit = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", F.when(k == 3, 10 * F.col("page_id") - 1).otherwise(10 * F.col("page_id") + 1).alias("ts"), F.lit("revisit").alias("kind"),
        F.map_concat(F.create_map(F.lit("date"), F.concat(F.lit("later "), day), F.lit("Server"), F.lit("second")), validator).alias("headers"),
        F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("digest"),
    )
    return response.unionByName(revisit)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return got.select("record_id", "key", "ts", "kind", "status", "source_id", F.sha2("payload", 256).alias("payload_sha256"), _header("date").alias("date"), _header("etag").alias("etag"), _header("server").alias("server"), _header("content-type").alias("content_type"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, html, url, 'day ' || CAST(page_id AS VARCHAR) AS day,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare
  FROM pages),
k AS (
  SELECT page_id, html, url, day,
    regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(?:www[0-9]*\.)|:(?:80|443)$', '', 'g') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
      '([?&])(?:utm_[^=&]*|gclid|fbclid|phpsessid|sessionid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS key,
    substr(md5(html), 1, 16) AS tag, substr(md5(url), 1, 16) AS other
  FROM p),
res AS (SELECT 2 * page_id AS record_id, key, 10 * page_id AS ts, html, day, tag FROM k),
rev AS (
  SELECT 2 * page_id + 1 AS record_id, key, CASE WHEN page_id % 4 = 3 THEN 10 * page_id - 1 ELSE 10 * page_id + 1 END AS ts,
    'later ' || day AS date, CASE WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 4 = 2 THEN other ELSE tag END AS etag,
    CASE WHEN page_id % 4 = 1 THEN day END AS modified
  FROM k),
j AS (
  SELECT rev.*, res.record_id AS sid, res.html, res.day AS rday, res.tag AS rtag,
    CASE WHEN res.record_id IS NULL THEN 'missing'
         WHEN CASE WHEN rev.etag IS NOT NULL THEN rev.etag = res.tag ELSE rev.modified = res.day END THEN 'resolved' ELSE 'mismatch' END AS status
  FROM rev ASOF LEFT JOIN res ON rev.key = res.key AND rev.ts > res.ts)
SELECT record_id, key, ts, 'response' AS kind, 'full' AS status, record_id AS source_id, sha256(html) AS payload_sha256, day AS date, tag AS etag, 'first' AS server, 'text/html' AS content_type FROM res
UNION ALL
SELECT record_id, key, ts, 'revisit', status, CASE WHEN status = 'resolved' THEN sid END, CASE WHEN status = 'resolved' THEN sha256(html) END, date,
  CASE WHEN status = 'resolved' THEN coalesce(etag, rtag) ELSE etag END, CASE WHEN status = 'resolved' THEN 'first' ELSE 'second' END,
  CASE WHEN status = 'resolved' THEN 'text/html' END
FROM j
"""
