"""Analytics over render traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import traces as T
from . import query


def _t(spark, sf):
    return X.traces(spark, sf)


MIX = "count(CASE WHEN decision = 'live' THEN 1 END) AS live, count(CASE WHEN decision = 'overview' THEN 1 END) AS overview, count(CASE WHEN decision = 'cache_hit' THEN 1 END) AS cache_hit"


@query("decision_mix", f"WITH {X.TRACES_SQL} SELECT layer, {MIX} FROM traces GROUP BY layer")
def decision_mix(spark, sf):
    return T.decision_mix(_t(spark, sf), ["layer"])


@query("decision_mix_by_frame", f"WITH {X.TRACES_SQL} SELECT layer, ts_ms // 86400000 AS frame, {MIX} FROM traces GROUP BY ALL")
def decision_mix_by_frame(spark, sf):
    frame = F.floor(F.unix_millis("ts") / F.lit(86400000))
    return T.decision_mix(_t(spark, sf).withColumn("frame", frame), ["layer", "frame"])


@query("hit_rate", f"WITH {X.TRACES_SQL} SELECT layer, count(*) AS total, count(CASE WHEN decision = 'cache_hit' THEN 1 END) / CAST(count(*) AS DOUBLE) AS hit_rate FROM traces GROUP BY layer")
def hit_rate(spark, sf):
    return T.hit_rate(_t(spark, sf), ["layer"])


@query(
    "latency_report",
    f"""WITH {X.TRACES_SQL}, s AS (SELECT layer, total_ms / 1000 AS sec, decision, ts_ms FROM traces)
SELECT layer, count(*) AS requests, count(CASE WHEN decision = 'overview' THEN 1 END) AS errors, round(count(*) / ((max(ts_ms) - min(ts_ms)) / 3600000.0::DOUBLE), 1) AS rps,
  round(quantile_disc(sec, 0.5) * 1000, 2) AS p50_ms, round(quantile_disc(sec, 0.95) * 1000, 2) AS p95_ms, round(quantile_disc(sec, 0.99) * 1000, 2) AS p99_ms, round(max(sec) * 1000, 2) AS max_ms FROM s GROUP BY layer""",
)
def latency_report(spark, sf):
    df = _t(spark, sf).withColumn("seconds", F.col("total_ms") / 1000).withColumn("_ms", F.unix_millis("ts"))
    wall = (F.max("_ms") - F.min("_ms")) / F.lit(3600000.0)
    return T.latency_report(df, "layer", "seconds", F.col("decision") != "overview", wall)


@query(
    "bytes_by_source",
    f"""WITH {X.TRACES_SQL}, p AS (SELECT 's' || (id % 7) AS path, bytes_read AS n FROM traces UNION ALL SELECT 's' || (id % 11), 512 FROM traces)
SELECT path, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS reads FROM p GROUP BY path""",
)
def bytes_by_source(spark, sf):
    return T.bytes_by_source(_with_provenance(spark, sf))


def _with_provenance(spark, sf):
    part = lambda n, length: F.struct(
        F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("path"), F.lit(0).cast("long").alias("offset"), length.cast("long").alias("length")
    )
    df = _t(spark, sf).withColumn("provenance", F.array(part(7, F.col("bytes_read")), part(11, F.lit(512))))
    return df.withColumn("sources", F.col("provenance.path"))


@query(
    "bytes_read_total",
    f"""WITH {X.TRACES_SQL} SELECT id, bytes_read + 512 AS bytes, CASE WHEN id % 7 = id % 11 THEN 's' || (id % 7) ELSE 's' || (id % 7) || ',s' || (id % 11) END AS sources FROM traces""",
)
def bytes_read_total(spark, sf):
    df = _with_provenance(spark, sf)
    return df.select("id", T.bytes_read("provenance").alias("bytes"), F.array_join(T.distinct_sources("sources"), ",").alias("sources"))


@query(
    "stage_timings",
    f"""WITH {X.TRACES_SQL} SELECT layer, round(avg(CAST(round(total_ms * 100) AS BIGINT) // 4), 6) AS avg_read, round(avg(CAST(round(total_ms * 100) AS BIGINT)), 6) AS avg_total FROM traces GROUP BY layer""",
)
def stage_timings(spark, sf):
    total = F.round(F.col("total_ms") * 100, 0).cast("long")
    df = _t(spark, sf).withColumn("total", total).withColumn("read", F.floor(total / 4))
    out = T.stage_timings(df, ["layer"], ["read", "total"])
    return out.select("layer", F.round("avg_read", 6).alias("avg_read"), F.round("avg_total", 6).alias("avg_total"))


@query(
    "ingest_to_pixel",
    f"""WITH {X.TRACES_SQL} SELECT id % 50 AS granule_id, min(greatest(bytes_read - 2000, 0)) AS ingest_to_pixel_ms FROM traces GROUP BY ALL""",
)
def ingest_to_pixel(spark, sf):
    done = F.timestamp_millis(F.unix_millis("ts") + F.col("bytes_read") - 2000)
    df = _t(spark, sf).select((F.col("id") % 50).alias("granule_id"), F.col("ts").alias("ingested_at"), done.alias("completed"))
    # the same clock for both sides, so finer digits of the arrival do not matter
    df = df.withColumn("ingested_at", F.timestamp_millis(F.unix_millis("ingested_at")))
    return T.ingest_to_pixel(df)


@query(
    "bytes_buckets",
    f"""WITH {X.TRACES_SQL}, r AS (SELECT min(bytes_read) AS lo, max(bytes_read) AS hi FROM traces WHERE bytes_read > 0)
SELECT id, CASE WHEN bytes_read <= 0 THEN 0 ELSE 1 + CAST(greatest(0, least(4, floor((ln(bytes_read) - ln(lo)) / (ln(hi) - ln(lo)) * 5))) AS INTEGER) END AS bucket FROM traces, r""",
)
def bytes_buckets(spark, sf):
    return T.bytes_buckets(_t(spark, sf)).select("id", "bucket")


@query(
    "rolling_quantiles",
    f"""WITH {X.TRACES_SQL} SELECT layer, id, round(quantile_cont(total_ms, 0.5) OVER w, 6) AS p50, round(quantile_cont(total_ms, 0.95) OVER w, 6) AS p95 FROM traces
WINDOW w AS (PARTITION BY layer ORDER BY id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
)
def rolling_quantiles(spark, sf):
    out = T.rolling_quantiles(_t(spark, sf), ["layer"])
    return out.select("layer", "id", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "rolling_quantiles_all",
    f"""WITH {X.TRACES_SQL} SELECT id, round(quantile_cont(total_ms, 0.5) OVER w, 6) AS p50, round(quantile_cont(total_ms, 0.95) OVER w, 6) AS p95 FROM traces
WINDOW w AS (ORDER BY id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
)
def rolling_quantiles_all(spark, sf):
    out = T.rolling_quantiles(_t(spark, sf), [])
    return out.select("id", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "latest_per_tile",
    f"""WITH {X.TRACES_SQL} SELECT layer, tile, max(id) AS id, arg_max(decision, id) AS decision FROM traces GROUP BY ALL ORDER BY id DESC LIMIT 500""",
)
def latest_per_tile(spark, sf):
    return T.latest_per_tile(_t(spark, sf), 500).select("layer", "tile", "id", "decision")


@query(
    "sequence_gaps",
    f"""WITH {X.TRACES_SQL}, g AS (SELECT layer, id, lag(id) OVER (PARTITION BY layer ORDER BY id) AS previous FROM traces)
SELECT layer, id, previous, id - previous - 1 AS missed FROM g WHERE id - previous > 1""",
)
def sequence_gaps(spark, sf):
    return T.sequence_gaps(_t(spark, sf), ["layer"])


@query(
    "cumulative_mix",
    f"""WITH {X.TRACES_SQL}, c AS (SELECT id, decision, count(CASE WHEN decision = 'live' THEN 1 END) OVER w AS live, count(CASE WHEN decision = 'overview' THEN 1 END) OVER w AS overview,
  count(CASE WHEN decision = 'cache_hit' THEN 1 END) OVER w AS cache_hit FROM traces WINDOW w AS (ORDER BY id))
SELECT *, cache_hit / CAST(live + overview + cache_hit AS DOUBLE) AS hit_rate FROM c""",
)
def cumulative_mix(spark, sf):
    return T.cumulative_mix(_t(spark, sf), [])


@query(
    "decision_kind",
    f"""WITH {X.TRACES_SQL} SELECT id, decision AS kind, CASE decision WHEN 'overview' THEN 'overview:' || (2 + id % 3) ELSE decision END AS label FROM traces""",
)
def decision_kind(spark, sf):
    df = _t(spark, sf).select("id", _decision_json().alias("d"))
    return df.select("id", T.decision_kind("d").alias("kind"), T.decision_label("d").alias("label"))


def _decision_json():
    level = (2 + F.col("id") % 3).cast("string")
    return (
        F.when(F.col("decision") == "overview", F.concat(F.lit('{"overview":{"level":'), level, F.lit("}}")))
        .when(F.col("decision") == "cache_hit", '{"cache_hit":{"key":"ab"}}')
        .otherwise(F.when(F.col("id") % 2 == 0, '"live"').otherwise("live"))
    )


@query(
    "parse_traces",
    f"""WITH {X.TRACES_SQL} SELECT id, layer, CAST(split_part(tile, '/', 2) AS BIGINT) AS x, CAST(split_part(tile, '/', 3) AS BIGINT) AS y, bytes_read, total_ms FROM traces WHERE id % 13 NOT IN (3, 5, 7)""",
)
def parse_traces(spark, sf):
    df = _t(spark, sf)
    timings = F.struct(F.col("total_ms").alias("total_ms"))
    body = F.struct(F.col("decision").alias("decision"), "bytes_read", timings.alias("timings"))
    k = F.col("id") % 13
    tile = F.when(k == 3, "7/999/1").otherwise(F.col("tile"))
    layer = F.when(k != 5, F.col("layer"))
    doc = F.to_json(F.struct("id", tile.alias("tile"), layer.alias("layer"), body.alias("trace")))
    text = F.when(k == 7, F.substring(doc, 1, 20)).otherwise(doc)
    out = T.parse_traces(df.select(text.alias("value")))
    return out.select("id", "layer", "x", "y", "trace.bytes_read", "trace.timings.total_ms")
