"""WARC: not-modified revisit records resolved by an as-of join to the latest earlier full response of the same address.

Addresses are compared in canonical form. A revisit takes over the payload of the response if its validators allow: the
entity tags must agree (weakly), or, without those on either side, the modification dates where both give one. Then the
response's headers are kept, but those that a not-modified answer may update are taken from the revisit.

The join is dealt by address and time, so a hot address doesn't meet in one task. Times are numbers of several digits in base
BASE. For each address and time the latest response is known first; a window looks back over the times that share all digits
but the last (BASE rows at most), one level up over the sums of those that share all but the last two, and so on. A time's
answer is that of the lowest level with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import table

#: Headers that a 304 answer may update (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Rows that a window holds at most.
BASE = 1000


def canonical_url(url: Column) -> Column:
    """Host and path, without scheme, www., default port, fragment, trailing slashes and tracking parameters; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[Hh][Tt][Tt][Pp][Ss]?://", "")
    authority = F.regexp_extract(bare, "^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    rest = F.substr(bare, F.length(authority) + 1)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|gclid|fbclid)(=|$)"))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise(""))


def latest_before(times: DataFrame, base: int) -> DataFrame:
    """(url, t, r): for each row (url, t, latest) the latest of that url at a smaller t; t from 0, rows differ in url and t."""
    top = times.agg(F.max("t")).first()[0] or 0
    levels, rows = [], times.select("url", "t", "latest")
    while True:
        rows = rows.withColumn("up", F.floor(F.col("t") / base))
        back = Window.partitionBy("url", "up").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(rows.select("url", "t", "up", F.max("latest").over(back).alias("r")))
        if top < base:
            break
        rows, top = rows.groupBy("url", "up").agg(F.max("latest").alias("latest")).withColumnRenamed("up", "t"), top // base
    found = levels.pop().drop("up")
    while levels:
        found = levels.pop().join(found.select("url", F.col("t").alias("up"), F.col("r").alias("far")), ["url", "up"]).select("url", "t", F.coalesce("r", "far").alias("r"))
    return found


def resolve_revisits(records: DataFrame, base: int = BASE) -> DataFrame:
    """One row per revisit: record_id, url, outcome, response_id, headers (sorted name=value strings), payload_digest.

    records: record_id, type, url, ts (long), status, headers map<string,string> (lower-case names), payload_digest. Full
    responses are those of type response and status 200. Earlier means a smaller ts; of responses at one ts the largest
    record_id counts. outcome: resolved, validator_mismatch (the latest earlier response has other validators) or
    no_earlier_response; without a response, headers are the revisit's own. Null url or ts: no_earlier_response. Repeated
    revisits give a row each. Empty table: no rows."""
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.expr("cast(map() as map<string,string>)"))))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    response = F.when(full, F.struct("ts", "record_id", entries.alias("headers"), "payload_digest"))
    rows = records.where(full | (F.col("type") == "revisit")).select("record_id", "type", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), F.coalesce("headers", F.expr("cast(map() as map<string,string>)")).alias("headers"), response.alias("response"))
    known = F.col("url").isNotNull() & F.col("ts").isNotNull()
    first = records.agg(F.min(F.col("ts").cast("long"))).first()[0] or 0
    rows = rows.withColumn("t", F.col("ts") - F.lit(first))
    times = rows.where(known).groupBy("url", "t").agg(F.max("response").alias("latest"))
    # url and t are dealt anew on both sides, so that a frequent pair's revisits can be split
    found = rows.where(known & (F.col("type") == "revisit")).join(latest_before(times, base), ["url", "t"]).select("record_id", "url", "headers", "r")
    lost = rows.where(~known & (F.col("type") == "revisit")).select("record_id", "url", "headers", F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    every = found.unionByName(lost)
    old = F.map_from_entries("r.headers")

    def tag(headers: Column) -> Column:
        return F.regexp_replace(headers["etag"], "^W/", "")

    agree = F.when(tag(F.col("headers")).isNotNull() & tag(old).isNotNull(), tag(F.col("headers")) == tag(old)).otherwise(F.coalesce(F.col("headers")["last-modified"] == old["last-modified"], F.lit(True)))
    outcome = F.when(F.col("r").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    newer = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(newer, k)), newer)
    resolved = F.col("outcome") == "resolved"
    shown = F.array_sort(F.transform(F.map_entries(F.when(resolved, merged).otherwise(F.col("headers"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return every.withColumn("outcome", outcome).select("record_id", "url", "outcome", F.col("r.record_id").alias("response_id"), shown.alias("headers"), F.when(resolved, F.col("r.payload_digest")).alias("payload_digest"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made from pages: a full response each, and a revisit by another form of its address.

    Every fifth revisit comes before its response; every third has another entity tag; every fourth has none."""
    i = F.col("page_id")
    date = F.concat(F.lit("day "), i.cast("string"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    response = F.map_from_arrays(F.array(*map(F.lit, ("content-type", "date", "etag", "last-modified", "set-cookie"))), F.array(F.lit("text/html"), date, F.concat(F.lit("W/"), tag), date, F.lit("a=1")))
    later = F.map_from_arrays(
        F.array(*map(F.lit, ("cache-control", "date", "last-modified", "set-cookie"))), F.array(F.lit("max-age=60"), F.concat(F.lit("later "), date), F.when(i % 8 == 0, "another day").otherwise(date), F.lit("a=2"))
    )
    tagged = F.map_concat(later, F.create_map(F.lit("etag"), F.when(i % 3 == 0, '"other"').otherwise(tag)))
    full = pages.select((i * 2).alias("record_id"), F.lit("response").alias("type"), "url", (i * 10).alias("ts"), F.lit(200).alias("status"), response.alias("headers"), F.sha1("html").alias("payload_digest"))
    revisit = pages.select(
        (i * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), F.concat(F.upper(F.regexp_extract("url", "^[^/]*//[^/]*", 0)), F.regexp_replace("url", "^[^/]*//[^/]*", ""), F.lit("#again")).alias("url"),
        F.when(i % 5 == 0, i * 10 - 3).otherwise(i * 10 + 25_003).alias("ts"), F.lit(304).alias("status"), F.when(i % 4 == 0, later).otherwise(tagged).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(revisit)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(captures(table(spark, sf_dir, "pages"))).withColumn("headers", F.array_join("headers", "; "))


OP8_SQL = r"""
WITH bare AS (
  SELECT page_id AS i, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[Hh][Tt][Tt][Pp][Ss]?://', '') AS u FROM pages
), split AS (
  SELECT *, regexp_extract(u, '^[^/?]*') AS authority FROM bare
), rest AS (
  SELECT *, regexp_replace(regexp_replace(lower(authority), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host, substr(u, length(authority) + 1) AS r FROM split
), params AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(r, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS ps FROM rest
), canonical AS (
  SELECT i, html, host || regexp_replace(regexp_extract(r, '^[^?]*'), '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url, '"' || md5(html) || '"' AS tag, 'day ' || i AS day FROM params
), revisits AS (
  SELECT 2 * i + 1 AS record_id, url, CASE WHEN i % 5 = 0 THEN i * 10 - 3 ELSE i * 10 + 25003 END AS ts, CASE WHEN i % 4 = 0 THEN NULL WHEN i % 3 = 0 THEN '"other"' ELSE tag END AS tag,
    'later ' || day AS day, CASE WHEN i % 8 = 0 THEN 'another day' ELSE day END AS modified FROM canonical
), found AS (
  SELECT v.*, c.i AS j, c.tag AS old_tag, c.day AS old_day, c.html FROM revisits v ASOF LEFT JOIN (SELECT *, i * 10 AS ts FROM canonical) c ON v.url = c.url AND v.ts > c.ts
), judged AS (
  SELECT *, CASE WHEN j IS NULL THEN 'no_earlier_response' WHEN CASE WHEN tag IS NOT NULL THEN tag = old_tag ELSE modified = old_day END THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM found
)
SELECT record_id, url, outcome, 2 * j AS response_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=60; content-type=text/html; date=' || day || '; etag=' || coalesce(tag, 'W/' || old_tag) || '; last-modified=' || modified || '; set-cookie=a=1'
    ELSE 'cache-control=max-age=60; date=' || day || coalesce('; etag=' || tag, '') || '; last-modified=' || modified || '; set-cookie=a=2' END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha1(html) END AS payload_digest
FROM judged
"""
