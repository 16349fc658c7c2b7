"""Resolution of WARC not-modified revisits.

A revisit record of a 304 answer has headers and no payload. It belongs to the
latest earlier full response of the same canonical URL; if the validators of the
two agree, it stands for that response's payload under the response's headers,
freshened by those of its own that RFC 9111 lets through.

The as-of step is a window over keys, dates and row keys alone, and validators are
compared on headers alone. Payloads move last and once: those of responses that a
resolved revisit uses, which a Bloom filter picks out where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import col, cut

#: Parameters that don't choose content.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)"
#: Fields of a 304 that never replace those of the stored response.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host, path and query; without scheme, user, ``www``, default port, fragment, last slashes and tracking.

    The host is lower-cased and the parameters are sorted. Null for null, and for
    a text without a host.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(bare, "(?s)[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(parts), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _entries(headers: Column) -> Column:
    """Header entries with names in lower case; of a name that repeats the last in order of the name as written."""
    low = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.greatest(F.size(low), F.lit(1))), lambda x: x["key"] == e["key"]))


def _header(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def resolve_revisits(
    records: DataFrame,
    id_col: str = "record_id",
    type_col: str = "type",
    url_col: str = "url",
    date_col: str = "date",
    headers_col: str = "headers",
    payload_col: str = "payload",
) -> DataFrame:
    """One row for each row of type ``revisit``.

    Columns: ``id_col``, ``canonical_url``, ``source_id`` (the response that was
    found, null if none), ``status``, ``headers`` (map, lower-case names),
    ``payload``. Status is

    * ``resolved``: the validators agree; headers are merged and payload is the response's;
    * ``mismatch``: they disagree; ``unverified``: the two share no validator;
    * ``orphan``: there is no response of that URL with a smaller date.

    Only ``resolved`` rows have a payload; the others keep their own headers.
    Validators are compared in this order, the first that both have decides:
    ``etag`` (weakly), ``last-modified``, ``warc-payload-digest``.

    Of responses with equal dates the one with the largest id is the latest, null
    ids last of all, then that with the largest row hash. Records with a null URL
    or date match nothing (a revisit is then an orphan); null headers are empty
    ones; a null payload stays null, an empty one empty. Repeated revisits come
    out as often as they come in, repeated responses count once. An empty table
    gives no rows. Other types and columns are ignored.
    """
    empty = F.create_map().cast("map<string,string>")
    plain = records.select(
        col(records, id_col).alias("id"),
        F.lower(col(records, type_col)).alias("type"),
        canonical_url(col(records, url_col)).alias("url"),
        F.unix_micros(col(records, date_col).cast("timestamp")).alias("at"),
        _entries(F.coalesce(col(records, headers_col).cast("map<string,string>"), empty)).alias("own"),
        col(records, payload_col).alias("payload"),
    )
    plain = plain.withColumn("key", F.xxhash64("id", "type", "url", "at", "own", "payload"))
    responses = plain.filter("type = 'response' AND url IS NOT NULL AND at IS NOT NULL")
    revisits = plain.filter("type = 'revisit'").drop("payload", "type")

    events = responses.select("url", "at", F.struct("at", "id", "key").alias("found"), F.lit(None).cast("long").alias("ask"))
    asked = revisits.filter("url IS NOT NULL AND at IS NOT NULL").select("url", "at", F.lit(None).cast(events.schema["found"].dataType).alias("found"), F.col("key").alias("ask"))
    earlier = Window.partitionBy("url").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    matched = events.unionAll(asked).withColumn("found", F.max("found").over(earlier)).filter("ask IS NOT NULL AND found IS NOT NULL")
    matched = matched.select("ask", F.col("found.key").alias("key"), F.col("found.id").alias("source_id")).distinct()

    wanted = matched.select("key").distinct()
    stored_by = responses.select("key", F.col("own").alias("theirs")).join(wanted, "key", "left_semi").dropDuplicates(["key"])
    found = matched.join(stored_by, "key").withColumnsRenamed({"key": "source_key", "ask": "key"})
    out = revisits.join(found, "key", "left")

    def weak(v: Column) -> Column:
        return F.regexp_replace(F.trim(v), "^W/", "")

    agree = F.lit(None).cast("boolean")
    for name in ("warc-payload-digest", "last-modified", "etag"):
        mine, other = _header(F.col("own"), name), _header(F.col("theirs"), name)
        same = weak(mine) == weak(other) if name == "etag" else F.trim(mine) == F.trim(other)
        agree = F.when(mine.isNotNull() & other.isNotNull(), same).otherwise(agree)
    status = F.when(F.col("theirs").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    allowed = F.filter("own", lambda e: ~e["key"].isin(*NOT_MERGED))
    stored = F.filter("theirs", lambda e: ~F.exists(allowed, lambda x: x["key"] == e["key"]))
    good = F.col("status") == "resolved"
    out = cut(
        out.withColumn("status", status).select(
            "id",
            F.col("url").alias("canonical_url"),
            "source_id",
            "status",
            F.map_from_entries(F.array_sort(F.when(good, F.concat(stored, allowed)).otherwise(F.col("own")))).alias("headers"),
            F.when(good, F.col("source_key")).alias("source_key"),
        )
    )
    used = out.filter("source_key IS NOT NULL").select(F.xxhash64("source_id").alias("used")).distinct()
    has = bloom.key_filter(used, used.count())
    payloads = responses.filter(has(F.xxhash64("id")) if has else F.lit(True)).select("key", "payload").filter("payload IS NOT NULL")
    payloads = payloads.dropDuplicates(["key"])
    out = out.join(payloads, F.col("source_key") == F.col("key"), "left")
    return out.select(F.col("id").alias(id_col), "canonical_url", "source_id", "status", "headers", "payload")


def crawl_log(pages: DataFrame) -> DataFrame:
    """A crawl of the pages as WARC records: each page as a response, then a 304 revisit of it a day later.

    A page's response is dated by its number, in minutes. Between it and its
    revisit another page of the same canonical URL may have been fetched. Every
    third page has a weak ETag in its revisit, and every fifth no ETag at all.
    """
    n = F.col("page_id")
    start = F.timestamp_seconds(F.lit(1704067200) + n * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    modified = F.date_format(start, "yyyy-MM-dd HH:mm:ss")
    response = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"))
    common = [F.lit("Last-Modified"), modified, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600")]
    revisit = F.when(n % 5 == 0, F.create_map(*common)).otherwise(F.create_map(*common, F.lit("ETag"), F.concat(F.when(n % 3 == 0, "W/").otherwise(""), tag)))
    one = pages.select((n * 2).alias("record_id"), F.lit("response").alias("type"), "url", start.alias("date"), response.alias("headers"), F.col("html").alias("payload"))
    two = pages.select((n * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), F.concat("url", F.lit("#again")).alias("url"), F.timestamp_seconds(F.lit(1704067200 + 86400) + n * 60).alias("date"), revisit.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return one.unionAll(two)
