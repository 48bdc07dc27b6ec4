"""Not-modified revisit resolution (operator 3).

A WARC revisit record stands for a response whose body was not stored again.
It is resolved by an as-of join: the latest earlier full response of the same
canonical URL. The pair's validators are checked (entity tags by weak
comparison, else modification dates, else payload digests), and where they
agree the stored headers are updated with those a not-modified response may
change.

The as-of join is a running "last full response" over records sorted by URL
and time. The sorted records are range-partitioned by URL *and* time and
written once, so a URL that holds a third of all records is spread over many
slices; each slice is filled by a window, and what the slices before it left
open for its first URL comes from a table with one row per slice.

Defined results: a revisit without URL (NULL, or one that names no host) or time, or without an earlier full
response, is ``missing``; full responses without URL or time serve none. A
full response at the revisit's own time is not earlier; of several at one time
the largest record id counts. Validators that disagree: ``mismatch``; none in
common: ``unverified``, headers not merged. Repeated records are resolved alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepforge.llm.util import col
from prepforge.session import cut_lineage

# Headers that a not-modified response may update; query parameters that don't tell pages apart.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
SCHEME = "[A-Za-z][A-Za-z0-9+.-]*://"
#: A host at the start of a URL without scheme: a dotted name that is no file's, IPv4, or localhost, with an optional port.
FILE_NAME = "[^/?]*[.](?:html?|php|aspx?|jsp|js|css|png|jpe?g|gif|svg|pdf|txt|xml|json)(?:[/?]|$)"
HOST_NAME = "(?:(?:[A-Za-z0-9_-]+[.])+[A-Za-z][A-Za-z0-9-]*|(?:[0-9]{1,3}[.]){3}[0-9]{1,3}|[Ll][Oo][Cc][Aa][Ll][Hh][Oo][Ss][Tt])(?::[0-9]+)?(?:[/?]|$)"
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="

FULL = ["record_id", "ts", "etag", "last_modified", "digest", "headers"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without index
    file and last slash, query parameters sorted and without tracking ones;
    scheme and fragment don't count. ``//host/path`` and ``host/path`` whose
    host has a dot, or is localhost, read as if they had a scheme; what names
    no host (relative, ``mailto:``, empty) has no canonical URL: NULL."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    named = u.rlike(f"^(?:{SCHEME}|//)[^/?]")
    bare = ~named & u.rlike(f"^{HOST_NAME}") & ~u.rlike(f"(?i)^{FILE_NAME}")
    rest = F.when(bare, u).otherwise(F.regexp_replace(u, f"^(?:{SCHEME}|//)", ""))
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "(/index[.]html?)?/*$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, "[?](.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    full = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when((named | bare) & (host != ""), full)


def latest_full(records: DataFrame) -> DataFrame:
    """``records`` (record_id, canonical, ts, full: boolean, the columns of
    ``FULL``) plus ``ref``, the latest earlier full response as a struct."""
    order = ["ts", "full", "record_id"]  # at one time revisits come first: not earlier
    placed = records.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull())
    r = cut_lineage(placed.repartitionByRange("canonical", *order).withColumn("slice", F.spark_partition_id()))
    own = F.when(F.col("full"), F.struct(*FULL))
    ends = r.groupBy("slice").agg(F.min("canonical").alias("opens"), F.max("canonical").alias("closes"))
    left = (r.where("full").join(ends.select("slice", "closes"), "slice").where("canonical = closes")
            .groupBy("slice", "canonical").agg(F.max_by(F.struct(*FULL), F.struct(*order)).alias("ref")))
    open_ = (ends.select(F.col("slice").alias("into"), "opens").join(left, (F.col("opens") == F.col("canonical")) & (F.col("slice") < F.col("into")))
             .groupBy("into", "opens").agg(F.max_by("ref", "slice").alias("before")))
    w = Window.partitionBy("slice", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = r.withColumn("within", F.last(own, ignorenulls=True).over(w))
    joined = filled.join(open_, (F.col("slice") == F.col("into")) & (F.col("canonical") == F.col("opens")), "left")
    kept = [*records.columns, F.coalesce("within", "before").alias("ref")]
    rest = records.where(F.col("canonical").isNull() | F.col("ts").isNull())
    return joined.select(*kept).unionByName(rest.select(*records.columns).withColumn("ref", F.lit(None).cast(joined.select(*kept).schema["ref"].dataType)))


def resolve(records: DataFrame) -> DataFrame:
    """Adds ``ref_id``, ``status`` and ``merged`` (headers) to every record;
    full responses are ``response`` and keep their headers."""
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    pairs = [(weak(F.col("etag")), weak(F.col("ref.etag"))), (F.col("last_modified"), F.col("ref.last_modified")), (F.col("digest"), F.col("ref.digest"))]
    agree = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs])
    status = (F.when(F.col("full"), "response").when(F.col("ref").isNull(), "missing").when(agree.isNull(), "unverified")
              .when(agree, "resolved").otherwise("mismatch"))
    new = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("ref.headers", lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)
    out = latest_full(records).withColumn("status", status)
    return out.withColumn("ref_id", F.when(F.col("status") != "response", F.col("ref.record_id"))).withColumn(
        "merged", F.when(F.col("status") == "resolved", merged).when(F.col("status") == "response", F.col("headers"))).drop("ref")


def page_records(pages: DataFrame) -> DataFrame:
    """The records of a crawl of ``pages``: page p is fetched in minute p, and
    asked for again a day later, in one of ten ways that its id decides."""
    p = pages.select(col("page_id").cast("long").alias("page_id"), col("url").alias("url"), F.md5(F.col("html").cast("binary")).alias("digest"),
                     F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    p = p.withColumn("canonical", canonical_url(F.col("url"))).withColumn("way", F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 10)
    tag, seen = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')), F.lit(1_700_000_000) + F.col("page_id") * 60
    text = lambda *x: F.concat(*x).cast("string")

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[y for k, v in pairs for y in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())

    full = p.select(
        text(F.lit("r"), F.col("page_id")).alias("record_id"), "page_id", "canonical", seen.alias("ts"), F.lit(True).alias("full"), tag.alias("etag"),
        (seen - 3600).cast("string").alias("last_modified"), "digest",
        headers(("content-type", F.lit("text/html")), ("content-length", F.col("bytes")), ("cache-control", F.concat(F.lit("max-age="), (F.col("page_id") % 7) * 600)),
                ("etag", tag), ("last-modified", seen - 3600), ("date", seen)).alias("headers"))
    w = F.col("way")
    etag = F.when(w == 0, F.lit('"changed"')).when(w == 1, F.concat(F.lit("W/"), tag)).when(w >= 6, tag)
    modified = F.when(w == 2, (seen - 3600).cast("string")).when(w == 3, seen.cast("string"))
    later = seen + 86_400
    again = p.select(
        text(F.lit("v"), F.col("page_id")).alias("record_id"), "page_id", "canonical", later.alias("ts"), F.lit(False).alias("full"), etag.alias("etag"),
        modified.alias("last_modified"), F.when(w == 4, F.col("digest")).alias("digest"),
        headers(("content-length", F.lit(0)), ("connection", F.lit("close")), ("cache-control", F.lit("max-age=60")), ("etag", etag), ("date", later)).alias("headers"))
    return full.unionByName(again)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "; ")
    return done.select("record_id", "page_id", "canonical", "ts", "status", "ref_id", listed.alias("headers"))


_PERMITTED = ", ".join(f"'{x}'" for x in PERMITTED)
SQL = rf"""
WITH a AS (SELECT page_id, md5(html) AS digest, coalesce(strlen(html), 0) AS bytes, regexp_replace(trim(url), '#.*$', '') AS u, 1700000000 + page_id * 60 AS seen FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params FROM a),
k AS (SELECT *, regexp_matches(u, '^(?:{SCHEME}|//)[^/?]') AS named, regexp_matches(u, '^{HOST_NAME}') AND NOT regexp_matches(u, '(?i)^{FILE_NAME}') AS bare FROM q),
o AS (SELECT *, CASE WHEN NOT named AND bare THEN u ELSE regexp_replace(u, '^(?:{SCHEME}|//)', '') END AS rest FROM k),
h AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]|:(80|443)$', '', 'g') AS host FROM o),
p AS (SELECT *, CASE WHEN (named OR bare) AND host <> '' THEN host || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/index[.]html?)?/*$', '')
              || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical,
             '"' || substr(digest, 1, 16) || '"' AS tag FROM h),
f AS (SELECT 'r' || page_id AS record_id, page_id, canonical, seen AS ts, tag, (seen - 3600)::VARCHAR AS modified, digest,
             ['content-type=text/html', 'content-length=' || bytes, 'cache-control=max-age=' || ((page_id % 7) * 600), 'etag=' || tag,
              'last-modified=' || (seen - 3600), 'date=' || seen] AS headers FROM p),
v AS (SELECT f.record_id AS r, 'v' || f.page_id AS record_id, f.page_id, f.canonical, f.ts + 86400 AS ts, f.tag, f.modified, f.digest,
             f.ts AS seen FROM f),
j AS (SELECT v.*, o.record_id AS ref_id, o.tag AS o_tag, o.modified AS o_modified, o.digest AS o_digest, o.headers AS o_headers
      FROM v LEFT JOIN (SELECT canonical, ts, max(record_id) AS record_id, max_by(tag, record_id) AS tag, max_by(modified, record_id) AS modified, max_by(digest, record_id) AS digest,
                               max_by(headers, record_id) AS headers FROM f GROUP BY canonical, ts) o
      ON o.canonical = v.canonical AND o.ts < v.ts
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY o.ts DESC NULLS LAST) = 1),
w AS (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % 10 AS way FROM j),
e AS (SELECT *, CASE WHEN way = 0 THEN '"changed"' WHEN way = 1 THEN 'W/' || tag WHEN way >= 6 THEN tag END AS etag FROM w),
s AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'missing' WHEN way = 0 THEN 'mismatch' WHEN way = 1 OR way >= 6 THEN CASE WHEN tag = o_tag THEN 'resolved' ELSE 'mismatch' END
                     WHEN way = 2 THEN CASE WHEN modified = o_modified THEN 'resolved' ELSE 'mismatch' END WHEN way = 3 THEN CASE WHEN seen::VARCHAR = o_modified THEN 'resolved' ELSE 'mismatch' END
                     WHEN way = 4 THEN CASE WHEN digest = o_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS status,
             list_filter(['cache-control=max-age=60', 'etag=' || etag, 'date=' || ts], lambda x: x IS NOT NULL) AS fresh FROM e)
SELECT record_id, page_id, canonical, ts, 'response' AS status, NULL AS ref_id, array_to_string(list_sort(headers), '; ') AS headers FROM f
UNION ALL
SELECT record_id, page_id, canonical, ts, status, ref_id, CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_concat(
         list_filter(o_headers, lambda x: NOT list_contains(list_transform(fresh, lambda y: string_split(y, '=')[1]), string_split(x, '=')[1])), fresh)), '; ') END FROM s
"""
