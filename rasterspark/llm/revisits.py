"""WARC revisit records resolved to the full response they stand for.

A server that answers "not modified" sends no body. Its record belongs to the latest earlier full
response of the same canonical URL, if their validators agree; the headers that such an answer may
renew are taken from it, all others from the full response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import last_before

#: Headers that a not-modified answer may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: What names a full response, repeated ones of one content once. None of it is null.
KEY = ("canonical", "at", "id_text", "print")


def canonical_url(url: Column) -> Column:
    """Lower-cased host without default port, path without a last slash, sorted query without tracking, no fragment, no scheme."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def _opaque(tag: Column) -> Column:
    """An entity tag without its weakness mark, as not-modified answers compare tags weakly."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _latest_before(asks: DataFrame, responses: DataFrame) -> DataFrame:
    """Each ask with ``hit``, what tells the latest response of its URL before it, in ranges of equal row counts."""
    told = responses.select("canonical", "at", F.lit(True).alias("told"), "record_id", "print", F.struct(*responses.columns).alias("own"))
    asked = asks.select("canonical", "at", F.lit(False).alias("told"), F.struct(*asks.columns).alias("ask"))
    # asks come before responses of the same instant: only earlier ones count
    both = last_before(told.unionByName(asked, True), ["canonical"], ["at", "told", "record_id", "print"], "own", "hit")
    return both.filter("not told").select("ask.*", "hit")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit with the response it stands for.

    ``records``: record_id long, type ('response' or 'revisit'), url, at timestamp, headers
    map<string,string> with lower-case names, payload string. Result: record_id, canonical, status,
    response_id, headers, payload. status is 'resolved'; 'changed' where the latest earlier response of
    the URL has another validator (ETags compare weakly and decide where both have one, else
    Last-Modified); 'unchecked' where no validator is common; 'orphan' without an earlier response.
    Only 'resolved' and 'unchecked' get a payload and merged headers. Of responses at one instant the
    greatest record_id counts (of several contents under one id any one, the same on every run); one at the revisit's own instant is not earlier. Rows with a null url or
    time are orphans, as responses they serve nobody; null headers are empty. Repeated revisits give
    repeated rows. Other columns are ignored.
    """
    rows = records.select(
        "record_id", "type", canonical_url(F.col("url")).alias("canonical"), "at",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload",
    )
    usable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    tags = F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified")
    renewed = F.map_filter("headers", lambda k, v: k.isin(*RENEWED)).alias("renewed")
    asks = rows.filter(F.col("type") == "revisit").select("record_id", "canonical", "at", *tags, renewed)
    full = rows.filter((F.col("type") == "response") & usable).select(
        "*", F.coalesce(F.col("record_id").cast("string"), F.lit("")).alias("id_text"),
        F.xxhash64("payload", F.array_sort(F.map_entries("headers"))).alias("print"),
    )
    # only names and validators are ordered; payloads move once, to the revisits that get them
    found = _latest_before(asks.filter(usable), full.select(*KEY, "record_id", *tags))
    lost = asks.filter(~usable).withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    etags = F.col("etag").isNotNull() & F.col("hit.etag").isNotNull()
    dates = F.col("modified").isNotNull() & F.col("hit.modified").isNotNull()
    status = (
        F.when(F.col("hit").isNull(), "orphan")
        .when(etags, F.when(_opaque(F.col("etag")) == _opaque(F.col("hit.etag")), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("modified") == F.col("hit.modified"), "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    told = found.unionByName(lost).select(
        "record_id", F.col("canonical").alias("url"), status.alias("status"), F.col("hit.record_id").alias("response_id"),
        "renewed", *(F.col("hit")[k].alias(k) for k in KEY),
    )
    good = F.col("status").isin("resolved", "unchecked")
    bodies = full.groupBy(*KEY).agg(F.first("headers").alias("headers"), F.first("payload").alias("payload"))
    merged = F.map_concat(F.map_filter("headers", lambda k, v: ~F.map_contains_key("renewed", k)), "renewed")
    out = ["record_id", F.col("url").alias("canonical"), "status", "response_id"]
    served = told.filter(good).join(bodies, list(KEY)).select(*out, merged.alias("headers"), "payload")
    return served.unionByName(told.filter(~good).select(*out, *(F.lit(None).cast(served.schema[c].dataType).alias(c) for c in ("headers", "payload"))))
