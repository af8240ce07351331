"""Which granule answers a request, and which files it needs.

The as-of search never compares requests with granules pairwise and never sorts a whole dataset
in one task: both sides shrink to distinct (dataset, millisecond) pairs, time is cut into
one-hour buckets (at most 3.6 million distinct instants each), and the newest granule of every
bucket is carried forward in one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import instant_ms

BUCKET_MS = 3_600_000


def _instants(granules: DataFrame) -> DataFrame:
    return granules.groupBy("dataset", instant_ms("datetime").alias("ms")).agg(F.max("id").alias("id"))


def latest(granules: DataFrame) -> DataFrame:
    """Newest granule per dataset, ties to the greatest id."""
    top = F.max(F.struct(instant_ms("datetime").alias("granule_ms"), F.col("id").alias("granule_id")))
    return granules.groupBy("dataset").agg(top.alias("_top")).select("dataset", "_top.granule_id", "_top.granule_ms")


def asof_latest(requests: DataFrame, granules: DataFrame, at: str = "t_ms") -> DataFrame:
    """Latest granule at or before each request's millisecond; NULL when there is none.

    ``requests`` has ``dataset`` and ``at`` (NULL asks for the newest overall); its rows are kept.
    """
    asks = requests.select("dataset", F.coalesce(F.col(at), F.lit(2**62)).alias("ms")).distinct()
    stamps = _instants(granules).withColumn("_kind", F.lit(0))
    line = asks.select("dataset", "ms", F.lit(None).cast(stamps.schema["id"].dataType).alias("id"), F.lit(1).alias("_kind"))
    line = stamps.unionByName(line).withColumn("_bucket", F.floor(F.col("ms") / F.lit(BUCKET_MS)))
    mark = F.when(F.col("_kind") == 0, F.struct("ms", "id"))
    inside = Window.partitionBy("dataset", "_bucket").orderBy("ms", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    hits = line.withColumn("_hit", F.last(mark, ignorenulls=True).over(inside)).where("_kind = 1")
    before = Window.partitionBy("dataset").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.groupBy("dataset", "_bucket").agg(F.max(mark).alias("_top")).select(
        "dataset", "_bucket", F.last("_top", ignorenulls=True).over(before).alias("_carry")
    )
    answers = hits.join(carried, ["dataset", "_bucket"]).select(
        F.col("dataset").alias("_d"), F.col("ms").alias("_ms"), F.coalesce("_hit", "_carry").alias("_g")
    )
    on = (F.col("dataset") == F.col("_d")) & (F.coalesce(F.col(at), F.lit(2**62)) == F.col("_ms"))
    return requests.join(answers, on, "left").select(
        *requests.columns, F.col("_g.id").alias("granule_id"), F.col("_g.ms").alias("granule_ms")
    )


def latest_in_interval(
    requests: DataFrame, granules: DataFrame, start: str = "start_ms", end: str = "end_ms"
) -> DataFrame:
    """Latest granule inside each request's inclusive interval; NULL bounds are open.

    The newest at or before the end is the answer exactly when it is not before the start, so no
    range join is needed.
    """
    found = asof_latest(requests, granules, end)
    inside = F.col(start).isNull() | (F.col("granule_ms") >= F.col(start))
    empty = F.coalesce(F.col(start) > F.col(end), F.lit(False))
    keep = inside & ~empty
    return found.withColumn("granule_id", F.when(keep, F.col("granule_id"))).withColumn(
        "granule_ms", F.when(keep, F.col("granule_ms"))
    )


def frame_index(requests: DataFrame, frames: DataFrame, at: str = "t_ms") -> DataFrame:
    """Index of the latest frame at or before the request; 0 before the first, the last when NULL."""
    as_granules = frames.select(
        "dataset", F.timestamp_millis("frame_ms").alias("datetime"), F.col("frame_index").alias("id")
    )
    found = asof_latest(requests, as_granules, at)
    return found.select(*requests.columns, F.coalesce("granule_id", F.lit(0)).alias("frame_index"))


def resolve_assets(layers: DataFrame, granules: DataFrame) -> DataFrame:
    """Each layer input matched with the granule's file: ``layer, granule_id, input, href, missing``.

    ``layers`` has ``layer, granule_id, inputs``; ``granules`` has ``id, assets``.
    """
    wanted = layers.select("layer", "granule_id", F.explode("inputs").alias("input"))
    files = granules.select(F.col("id").alias("granule_id"), F.explode("assets").alias("input", "_asset"))
    return wanted.join(files, ["granule_id", "input"], "left").select(
        "layer", "granule_id", "input", F.col("_asset.href").alias("href"), F.col("_asset").isNull().alias("missing")
    )


def mixed_crs(bands: DataFrame, rasters: DataFrame, group: list[str]) -> DataFrame:
    """Renders whose bands do not share one CRS: ``group..., crs_count``."""
    joined = bands.join(rasters.select("asset", "crs"), "asset")
    counted = joined.groupBy(*group, "crs").agg(F.lit(1).alias("_one"))
    return counted.groupBy(*group).agg(F.count("*").alias("crs_count")).where("crs_count > 1")
