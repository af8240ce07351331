"""Analytics over render traces: mixes, rates, latencies, rolling quantiles, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..schema import TRACE_ENVELOPE
from .ordered import exact_quantiles, neighbour, running_totals, trailing_rows

KINDS = ("live", "overview", "cache_hit")


# --- decoding ---


def decision_kind(decision) -> Column:
    """``live``, ``overview`` or ``cache_hit`` from a bare word or a one-key JSON object."""
    text = T.col(decision)
    bare = F.regexp_replace(text, r'^"|"$', "")
    tagged = F.get(F.json_object_keys(text), F.lit(0))
    return F.when(text.startswith("{"), tagged).otherwise(bare)


def decision_label(decision) -> Column:
    """The kind, with the level for overviews: ``overview:4``."""
    text, kind = T.col(decision), decision_kind(decision)
    level = F.get_json_object(text, "$.overview.level")
    return F.when((kind == "overview") & level.isNotNull(), F.concat(F.lit("overview:"), level)).otherwise(kind)


def parse_traces(df: DataFrame, text: str = "value") -> DataFrame:
    """Envelopes from JSON text; malformed ones are dropped, never fatal."""
    envelope = F.from_json(text, TRACE_ENVELOPE, {"mode": "PERMISSIVE"})
    parsed = df.withColumn("_e", envelope).withColumn("_tile", T.parse_tile_key("_e.tile"))
    good = F.col("_tile").isNotNull() & F.col("_e.layer").isNotNull() & F.col("_e.trace").isNotNull()
    return parsed.where(good).select("_e.*", F.col("_tile.z").alias("z"), F.col("_tile.x").alias("x"), F.col("_tile.y").alias("y"))


def trace_json(df: DataFrame) -> DataFrame:
    """Envelopes ``id, tile, layer, trace`` as JSON text, one per row."""
    return df.select(F.to_json(F.struct("id", "tile", "layer", "trace")).alias("value"))


# --- counts ---


def _mix(decision: str) -> list[Column]:
    return [F.count_if(F.col(decision) == k).alias(k) for k in KINDS]


def decision_mix(traces: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """Counts by decision kind per group."""
    return traces.groupBy(*keys).agg(*_mix(decision))


def hit_rate(traces: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """Share of cache hits per group; NULL for no traces."""
    hits = F.count_if(F.col(decision) == "cache_hit")
    return traces.groupBy(*keys).agg(
        F.count("*").alias("total"), F.try_divide(hits.cast("double"), F.count("*")).alias("hit_rate")
    )


def bytes_by_source(traces: DataFrame) -> DataFrame:
    """Bytes and reads per source object from the traces' provenance."""
    reads = traces.select(F.explode("provenance").alias("p"))
    return reads.groupBy(F.col("p.path").alias("path")).agg(
        F.sum("p.length").alias("bytes"), F.count("*").alias("reads")
    )


def bytes_read(provenance="provenance") -> Column:
    """Total length of a trace's byte ranges."""
    lengths = F.transform(T.col(provenance), lambda p: p["length"])
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, n: acc + n)


def distinct_sources(sources="sources") -> Column:
    """Each source once, in order of first appearance."""
    return F.array_distinct(T.col(sources))


def stage_timings(traces: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """Mean milliseconds per stage and group."""
    return traces.groupBy(*keys).agg(*[F.avg(s).alias(f"avg_{s}") for s in stages])


def ingest_to_pixel(traces: DataFrame, granule: str = "granule_id") -> DataFrame:
    """First-render latency per granule: least ``completed - ingested`` in ms, never negative."""
    wait = F.unix_millis(F.col("completed").cast("timestamp")) - F.unix_millis(F.col("ingested_at").cast("timestamp"))
    return traces.groupBy(granule).agg(F.min(F.greatest(wait, F.lit(0))).alias("ingest_to_pixel_ms"))


def latency_report(requests: DataFrame, key: str, seconds: str, ok: Column, wall: Column) -> DataFrame:
    """Per scenario: requests, errors, rate and nearest-rank latency percentiles in ms.

    ``wall`` is an aggregate column giving the scenario's wall-clock seconds.
    """
    quantiles = exact_quantiles(requests, [key], seconds, {"_p50": 0.50, "_p95": 0.95, "_p99": 0.99})
    counts = requests.groupBy(key).agg(
        F.count("*").alias("requests"),
        F.count_if(~ok).alias("errors"),
        F.round(F.try_divide(F.count("*").cast("double"), wall), 1).alias("rps"),
        F.max(seconds).alias("_max"),
    )
    ms = lambda c: F.round(F.col(c) * 1000, 2)
    return counts.join(quantiles, key).select(
        key, "requests", "errors", "rps", ms("_p50").alias("p50_ms"), ms("_p95").alias("p95_ms"),
        ms("_p99").alias("p99_ms"), ms("_max").alias("max_ms"),
    )


def bytes_bucket(bytes_col, low, high, steps: int = 5) -> Column:
    """Intensity bucket: 0 for no bytes, else 1..steps in equal log steps between ``low`` and ``high``."""
    b, low, high = T.col(bytes_col), T.col(low), T.col(high)
    t = F.try_divide(F.ln(b) - F.ln(low), F.ln(high) - F.ln(low))
    step = F.least(F.greatest(F.floor(t * steps), F.lit(0)), F.lit(steps - 1)) + 1
    degenerate = ~F.coalesce((high > low) & (low > 0), F.lit(False))
    return F.when(b <= 0, 0).when(degenerate, steps).otherwise(step).cast("int")


def bytes_buckets(traces: DataFrame, column: str = "bytes_read", steps: int = 5) -> DataFrame:
    """Add ``bucket`` to every trace; the non-zero range is one row, attached by a join on a constant."""
    span = traces.where(F.col(column) > 0).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    joined = traces.withColumn("_one", F.lit(1)).join(F.broadcast(span.withColumn("_one", F.lit(1))), "_one", "left")
    return joined.withColumn("bucket", bytes_bucket(column, "_low", "_high", steps)).drop("_one", "_low", "_high")


# --- in order of arrival ---


def rolling_quantiles(traces: DataFrame, keys: list[str], value: str = "total_ms", order: str = "id", size: int = 200) -> DataFrame:
    """Median and 95th percentile over the last ``size`` rows, linear between ranks ``p * (n - 1)``.

    Sequences are cut into blocks that carry the rows before them, so a hot key is spread.
    """
    blocks = trailing_rows(traces, keys, order, size)
    recent = Window.partitionBy(*[F.col(k) for k in keys], "_block").orderBy(order).rowsBetween(-(size - 1), 0)
    ordered = F.sort_array(F.collect_list(value).over(recent))
    rows = blocks.withColumn("_recent", ordered).where("_home")

    def quantile(p: float) -> Column:
        rank = (F.size("_recent") - 1) * F.lit(p)
        lower = F.get("_recent", F.floor(rank).cast("int"))
        upper = F.get("_recent", F.ceil(rank).cast("int"))
        return lower + (rank - F.floor(rank)) * (upper - lower)

    return rows.select(*keys, order, quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))


def latest_per_tile(traces: DataFrame, cap: int | None = None) -> DataFrame:
    """Newest trace per layer and tile; with a ``cap``, the most recently updated of them only."""
    columns = [c for c in traces.columns if c not in ("layer", "tile")]
    newest = traces.groupBy("layer", "tile").agg(F.max_by(F.struct(*columns), F.col("id")).alias("_t"))
    found = newest.select("layer", "tile", "_t.*")
    return found if cap is None else found.orderBy(F.col("id").desc()).limit(cap)


def sequence_gaps(traces: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Rows that follow a gap in the sequence, with the number of missed ids."""
    seen = neighbour(traces.select(*keys, order), keys, order, order, "previous", -1)
    missed = F.col(order) - F.col("previous") - 1
    return seen.withColumn("missed", missed).where("missed > 0")


def cumulative_mix(traces: DataFrame, keys: list[str], decision: str = "decision", order: str = "id") -> DataFrame:
    """Running counts per decision kind and the running hit rate after each trace."""
    measures = {k: F.when(F.col(decision) == k, 1).otherwise(0).cast("long") for k in KINDS}
    counted = running_totals(traces.select(*keys, order, decision), keys, order, measures)
    total = F.col("live") + F.col("overview") + F.col("cache_hit")
    return counted.withColumn("hit_rate", F.try_divide(F.col("cache_hit").cast("double"), total))
