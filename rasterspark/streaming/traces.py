"""Metrics over a stream of render traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import position
from ..operators.traces import KINDS, rolling_quantiles
from ..session import cut_lineage

LATEST_SCHEMA = "layer string, tile string, id long, decision string"
LAG_SCHEMA = "producer string, received long, missed long, last_id long"


def trace_metrics(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Decision mix, hit rate and best ingest-to-pixel per key; runs on a stream in complete mode."""
    counts = [F.count_if(F.col("decision") == k).alias(k) for k in KINDS]
    best = [F.min("ingest_to_pixel_ms").alias("ingest_to_pixel_ms")] if "ingest_to_pixel_ms" in traces.columns else []
    hits = F.count_if(F.col("decision") == "cache_hit").cast("double")
    return traces.groupBy(*keys).agg(*counts, F.try_divide(hits, F.count("*")).alias("hit_rate"), *best)


def rolling_quantile_sink(out: str, state: str, size: int = 200) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: p50 and p95 of ``total_ms`` over the last ``size`` rows per layer, for every trace.

    A layer's window follows arrival: batch after batch, by id inside a batch. Only the last ``size - 1``
    rows of every layer are kept between batches; before a batch they are put ahead of it and the batch
    operator does the work, which cuts a hot layer into ranges of rows. Results of a batch lie in
    ``out/batch=``, the rows kept in one of two folders by turns, so a batch that runs again finds what
    it built on and replaces its own output.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("layer", "id", "total_ms", F.lit(True).alias("_new"))
        if batch_id > 0:
            kept = spark.read.parquet(f"{state}/slot={(batch_id - 1) % 2}")
            if (found := kept.agg(F.max("batch")).first()[0]) not in (None, batch_id - 1):
                raise ValueError(f"the rows kept are of batch {found}, not {batch_id - 1}")
            fresh = fresh.unionByName(kept.select("layer", "id", "total_ms", F.lit(False).alias("_new")))
        rows = cut_lineage(fresh.withColumn("_order", F.struct("_new", "id")))
        quantiles = rolling_quantiles(rows, ["layer"], "total_ms", "_order", size)
        done = quantiles.where("_order._new").select("layer", F.col("_order.id").alias("id"), "p50", "p95")
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        placed = position(rows, ["layer"], "_order", "_pos")
        counts = rows.groupBy(F.col("layer").alias("_layer")).agg(F.count("*").alias("_n"))
        last = placed.join(counts, F.col("layer").eqNullSafe(F.col("_layer"))).where(F.col("_pos") >= F.col("_n") - (size - 1))
        last.select("layer", "id", "total_ms", F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")

    return run


def latest_tile_stream(traces: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Newest trace per layer and tile as it changes; state of a tile idle for ``idle`` shrinks to its id.

    So an older trace that comes later still doesn't win. ``traces`` carries a watermark on ``ts``. Keep the most recent 500 where the output is read.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update((state.get[0], None))
            return
        best = state.get if state.exists else (-1, "")
        newest_ts = 0
        for rows in batches:
            top = rows.loc[rows["id"].idxmax()]
            newest_ts = max(newest_ts, int(rows["ts"].max().timestamp() * 1000))
            if int(top["id"]) > best[0]:
                best = (int(top["id"]), str(top["decision"]))
        state.update(best)
        state.setTimeoutTimestamp(max(newest_ts, state.getCurrentWatermarkMs() + 1) + idle_ms)
        if best[1] is not None:
            yield pd.DataFrame([(*key, *best)], columns=["layer", "tile", "id", "decision"])

    grouped = traces.select("layer", "tile", "id", "decision", "ts").groupBy("layer", "tile")
    return grouped.applyInPandasWithState(run, LATEST_SCHEMA, "id long, decision string", "update", GroupStateTimeout.EventTimeTimeout)


def lag_report(traces: DataFrame, producer: str = "layer") -> DataFrame:
    """Per producer of increasing ids: received, missed and last id, running.

    Missed is the span of ids seen minus the rows seen, so arrival order inside a batch does not
    matter and the work is a mergeable aggregate.
    """
    return traces.groupBy(F.col(producer).alias("producer")).agg(
        F.count("*").alias("received"),
        (F.max("id") - F.min("id") + 1 - F.count("*")).alias("missed"),
        F.max("id").alias("last_id"),
    )
