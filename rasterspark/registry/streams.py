"""Streams over the tables, and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import temporal as TM
from ..operators import spatial as S
from ..operators import warp as W
from ..plans import jobs as J
from ..operators.chunks import pack_chunks
from ..operators.udf import TileUdf, ndvi_tile
from ..session import checkpoint_dir
from ..sources import granules as SG
from ..sources.chunk_reader import write_chunk_files
from ..streaming import ingest as SI
from ..streaming import traces as ST
from . import SQL, query
from .imagery import quantize_sql, rescale_sql
from .traces import MIX
from .warping import SIZE, UTM_WARP_SQL, ZOOM, asset_pixels, forward_utm_sql, shape_sql, utm_rasters


def drain(df: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream over everything available and read its output back.

    Complete output replaces itself per micro-batch; append and update output accumulates.
    """
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = df.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{base}/out" if mode == "complete" else f"{base}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    started = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    started.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def _traces(spark, sf):
    return X.traces(spark, sf, X.stream(spark, sf, "events"))


@query(
    "stream_trace_metrics",
    f"WITH {X.TRACES_SQL} SELECT layer, {MIX}, count(CASE WHEN decision = 'cache_hit' THEN 1 END) / CAST(count(*) AS DOUBLE) AS hit_rate, min(CAST(round(total_ms * 10) AS BIGINT)) AS ingest_to_pixel_ms FROM traces GROUP BY layer",
)
def stream_trace_metrics(spark, sf):
    t = _traces(spark, sf).withColumn("ingest_to_pixel_ms", F.round(F.col("total_ms") * 10, 0).cast("long"))
    return drain(ST.trace_metrics(t, ["layer"]), spark, "complete")


@query(
    "stream_rolling_quantiles",
    f"""WITH {X.TRACES_SQL} SELECT layer, id, round(quantile_cont(total_ms, 0.5) OVER w, 6) AS p50, round(quantile_cont(total_ms, 0.95) OVER w, 6) AS p95 FROM traces
WINDOW w AS (PARTITION BY layer ORDER BY id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
)
def stream_rolling_quantiles(spark, sf):
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    # two passes of one query: the second takes up the windows where the first left them
    early = X.table(spark, sf, "events").agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for low, high in ((None, early), (early, None)):
        rows = X.table(spark, sf, "events").where(F.col("event_id") <= high if low is None else F.col("event_id") > low)
        rows.write.mode("append").parquet(f"{base}/in")
        arriving = X.traces(spark, sf, spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        sink = ST.rolling_quantile_sink(f"{base}/out", f"{base}/kept")
        arriving.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("layer", "id", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("stream_latest_tiles", f"WITH {X.TRACES_SQL} SELECT layer, tile, max(id) AS id, arg_max(decision, id) AS decision FROM traces GROUP BY ALL")
def stream_latest_tiles(spark, sf):
    out = drain(ST.latest_tile_stream(_traces(spark, sf).withWatermark("ts", "1 hour")), spark, "update")
    newest = out.groupBy("layer", "tile").agg(F.max(F.struct("id", "decision")).alias("t"))
    return newest.select("layer", "tile", "t.id", "t.decision")


@query("stream_lag_report", f"WITH {X.TRACES_SQL} SELECT layer AS producer, count(*) AS received, max(id) - min(id) + 1 - count(*) AS missed, max(id) AS last_id FROM traces GROUP BY layer")
def stream_lag_report(spark, sf):
    return drain(ST.lag_report(_traces(spark, sf)), spark, "complete")


@query(
    "stream_widen_extents",
    f"WITH {X.GRANULES_SQL} SELECT dataset, min(dt_ms) AS t_start, max(dt_ms) AS t_end, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM granules GROUP BY dataset",
)
def stream_widen_extents(spark, sf):
    out = drain(SI.widen_extents(X.granules(spark, sf, X.stream(spark, sf, "orders"))), spark, "complete")
    return out.withColumns({"t_start": TM.instant_ms("t_start"), "t_end": TM.instant_ms("t_end")})


@query(
    "drop_manifests",
    f"""WITH {X.GRANULES_SQL} SELECT id AS n, CASE WHEN id % 9 NOT IN (2, 4, 6, 8) THEN dataset END AS dataset, CASE WHEN id % 9 NOT IN (2, 4, 6, 8) THEN dt_ms END AS dt_ms, CASE WHEN id % 9 NOT IN (2, 4, 6, 8) THEN east END AS east,
  CASE id % 9 WHEN 2 THEN 'unknown field' WHEN 4 THEN 'datetime is not RFC 3339 UTC' WHEN 6 THEN 'not a JSON object' WHEN 8 THEN 'bbox is not four numbers' END AS issue FROM granules""",
)
def drop_manifests(spark, sf):
    g, k = X.granules(spark, sf), F.col("id") % 9
    b = [F.col(f"bbox.{c}") for c in ("west", "south", "east", "north")]
    stamp = TM.from_unix_millis(TM.instant_ms("datetime"))
    doc = F.to_json(
        F.struct(
            "dataset", F.col("id").cast("string").alias("granule"), F.when(k == 8, F.array(b[0], b[1])).otherwise(F.array(*b)).alias("bbox"),
            F.when(k == 4, F.lit("yesterday")).otherwise(stamp).alias("datetime"), F.create_map(F.lit("red"), F.lit("r.tif")).alias("assets"),
            F.when(k == 2, F.lit(1)).alias("extra"),
        )
    )
    raw = g.select(F.when(k == 6, F.substring(doc, 1, 25)).otherwise(doc).alias("value"), F.col("id").alias("n"))
    out, fine = SG.parse_drop_manifests(raw), F.col("issue").isNull()
    return out.select(
        "n", F.when(fine, F.col("dataset")).alias("dataset"), F.when(fine, TM.instant_ms("datetime")).alias("dt_ms"),
        F.when(fine, F.col("bbox.east")).alias("east"), "issue",
    )


def _manifest():
    """A granule as drop manifest text; some are cut short, dated badly, of an unknown band or of no dataset."""
    b = [F.col(f"bbox.{c}") for c in ("west", "south", "east", "north")]
    k = F.col("id") % 11
    doc = F.to_json(F.struct(
        F.when(k == 3, F.lit("ghost")).otherwise(F.col("dataset")).alias("dataset"), F.col("id").cast("string").alias("granule"), F.array(*b).alias("bbox"),
        F.when(k == 4, F.lit("yesterday")).otherwise(TM.from_unix_millis(TM.instant_ms("datetime"))).alias("datetime"),
        F.create_map(F.when(k == 5, F.lit("x-ray")).otherwise(F.lit("red")), F.lit("r.tif")).alias("assets"),
    ))
    return F.when(k == 6, F.substring(doc, 1, 25)).otherwise(doc).alias("value")


def _ingested(spark, sf):
    """Catalog and quarantine after two runs of the ingest: all granules, then every third again with a wider box."""
    base = f"{checkpoint_dir(spark)}/ingest/{uuid.uuid4().hex}"
    granules = X.granules(spark, sf)
    datasets = X.datasets(spark, sf)
    wider = granules.where("id % 3 = 0").withColumn("bbox", F.col("bbox").withField("east", F.col("bbox.east") + 1.0))
    for part, files in ((granules, 5), (wider, 2)):
        part.select(_manifest()).repartition(files).write.mode("append").option("compression", "none").format("text").save(f"{base}/text")
        arrivals = SI.stream_granules(spark, f"{base}/text", max_files=2, lines=True, pattern="*.txt")
        SI.ingest_stream(arrivals, datasets, f"{base}/catalog", f"{base}/bad", f"{base}/state").awaitTermination()
    return SI.read_snapshot(spark, f"{base}/catalog"), spark.read.parquet(f"{base}/bad")


@query(
    "ingest_stream",
    f"""WITH {X.GRANULES_SQL} SELECT dataset, CAST(id AS VARCHAR) AS id, dt_ms, west, CASE WHEN id % 3 = 0 THEN east + 1 ELSE east END AS east, true AS stamped FROM granules WHERE id % 11 NOT IN (3, 4, 5, 6) AND dataset NOT LIKE '% %'""",
)
def ingest_stream(spark, sf):
    catalog, _ = _ingested(spark, sf)
    return catalog.select("dataset", "id", TM.instant_ms("datetime").alias("dt_ms"), "bbox.west", "bbox.east", F.col("ingested_at").isNotNull().alias("stamped"))


@query(
    "quarantine_stream",
    f"""WITH {X.GRANULES_SQL} SELECT CASE id % 11 WHEN 3 THEN 'dataset unknown' WHEN 4 THEN 'datetime is not RFC 3339 UTC' WHEN 6 THEN 'not a JSON object'
  WHEN 5 THEN CASE WHEN dataset LIKE '% %' THEN 'dataset id not url-safe; band not in vocabulary' ELSE 'band not in vocabulary' END ELSE 'dataset id not url-safe' END AS reason,
  CAST(count(*) + count(CASE WHEN id % 3 = 0 THEN 1 END) AS BIGINT) AS manifests FROM granules WHERE id % 11 IN (3, 4, 5, 6) OR dataset LIKE '% %' GROUP BY ALL""",
)
def quarantine_stream(spark, sf):
    return _ingested(spark, sf)[1].groupBy("reason").agg(F.count("*").alias("manifests"))


# --- whole jobs ---

NDVI = ("divide", ("subtract", "nir", "red"), ("add", "nir", "red"))


def scene(spark, sf):
    """Granules, rasters, pixels and tile requests of the derived UTM scene: one granule per asset and day."""
    base = utm_rasters(spark, sf)
    bands = F.array(F.lit("nir"), F.lit("red"))
    name = F.concat(F.col("asset").cast("string"), F.lit("."), F.col("_band"))
    rasters = base.withColumn("_band", F.explode(bands)).withColumn("asset", name).drop("_band")
    rasters = rasters.withColumns({"dtype": F.lit("int16"), "overview_levels": F.array().cast("array<int>")})
    href = lambda band: F.struct(F.concat(F.col("asset").cast("string"), F.lit("." + band)).alias("href"), F.lit("raster").alias("kind"))
    granules = base.select(
        F.lit("scene").alias("dataset"), F.col("asset").cast("string").alias("id"), F.timestamp_millis(F.col("asset") * 86400000).alias("datetime"),
        F.create_map(F.lit("nir"), href("nir"), F.lit("red"), href("red")).alias("assets"),
    )
    v = F.col("value")
    both = asset_pixels(spark, sf).where(v.isNotNull()).withColumn("_s", F.explode(F.array(
        F.struct(F.lit("nir").alias("b"), (F.abs(v) + 1).alias("v")), F.struct(F.lit("red").alias("b"), (F.abs(v * 3) % 700 + 1).alias("v")))))
    pixels = both.select(F.concat(F.col("asset").cast("string"), F.lit("."), F.col("_s.b")).alias("asset"), F.lit(1).alias("level"), "row", "col", F.col("_s.v").alias("value"))
    boxes = W.raster_bounds(base).select("asset", F.struct("west", "south", "east", "north").alias("bbox"))
    tiles = S.tiles_for_footprints(boxes, ZOOM).select("z", "x", "y", (F.col("asset") * 86400000).alias("t_ms"))
    return granules, rasters, pixels, tiles


LAYER = J.Layer("ndvi", "scene", ("nir", "red"), NDVI, None, -1.0, 1.0, "grayscale", "nearest", SIZE)

RENDER_SQL = f"""{UTM_WARP_SQL}, hit AS (SELECT p.asset, x, y, i, j, abs(value) + 1 AS nir, abs(value * 3) % 700 + 1 AS red FROM pos p JOIN px ON px.asset = p.asset AND px.prow = floor(frow + 1e-10) AND px.pcol = floor(fcol + 1e-10)
  JOIN assets a ON a.asset = p.asset WHERE value IS NOT NULL AND fcol >= 0 AND frow >= 0 AND fcol + 1e-10 <= a.w AND frow + 1e-10 <= a.h),
gray AS (SELECT asset, x, y, i, j, {quantize_sql(rescale_sql('((nir - red) / (nir + red))', -1.0, 1.0))} AS v FROM hit)"""


@query(
    "render_tiles",
    f"""WITH {RENDER_SQL} SELECT CAST(asset AS VARCHAR) AS granule_id, x, y, j AS "row", i AS col, v AS r, v AS g, v AS b, 255::SMALLINT AS a FROM gray""",
)
def render_tiles(spark, sf):
    granules, rasters, pixels, tiles = scene(spark, sf)
    painted, _ = J.render(LAYER, tiles, granules, rasters, pixels)
    return painted.select("granule_id", "x", "y", "row", "col", "r", "g", "b", "a")


@query("render_udf", SQL["render_tiles"])
def render_udf(spark, sf):
    """The same layer, its index computed by a user function over tiles."""
    granules, rasters, pixels, tiles = scene(spark, sf)
    layer = J.Layer("ndvi", "scene", ("nir", "red"), None, None, -1.0, 1.0, "grayscale", "nearest", SIZE, TileUdf(ndvi_tile, 1))
    painted, _ = J.render(layer, tiles, granules, rasters, pixels)
    return painted.select("granule_id", "x", "y", "row", "col", "r", "g", "b", "a")


@query(
    "render_cached",
    f"""WITH {RENDER_SQL} SELECT CAST(asset AS VARCHAR) AS granule_id, x, y, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total FROM gray WHERE (x + y) % 2 = 1 GROUP BY ALL""",
)
def render_cached(spark, sf):
    granules, rasters, pixels, tiles = scene(spark, sf)
    stored = J.tile_keys(LAYER, J.resolve_tiles(LAYER, tiles, granules)).where("(x + y) % 2 = 0").select("tile_key")
    fresh, _ = J.render_cached(LAYER, tiles, granules, rasters, pixels, stored)
    return fresh.groupBy("granule_id", "x", "y").agg(F.count("*").alias("pixels"), F.sum("r").alias("total"))


def stored_scene(spark, sf, chunk: int, codecs: list[str]):
    """The scene with its bands written as blocks to files of the shared folder: (granules, rasters, references, tiles)."""
    granules, rasters, pixels, tiles = scene(spark, sf)
    folder = f"{checkpoint_dir(spark)}/blocks/{uuid.uuid4().hex}"
    blocks = pack_chunks(pixels, ["asset", "level"], chunk)
    return granules, rasters, write_chunk_files(blocks, folder, "int16", codecs, 0.0), tiles


@query("render_refs", SQL["render_tiles"])
def render_refs(spark, sf):
    granules, rasters, refs, tiles = stored_scene(spark, sf, 16, ["shuffle", "zlib:4"])
    painted, _ = J.render_refs(LAYER, tiles, granules, rasters, refs)
    return painted.select("granule_id", "x", "y", "row", "col", "r", "g", "b", "a")


_TILES_SQL = UTM_WARP_SQL[: UTM_WARP_SQL.index(",\ntp AS")]

# A tile's window is its densified boundary in source pixels; the blocks of 16 that it overlaps are read, two bytes a sample.
REFS_SQL = f"""{_TILES_SQL}, steps AS (SELECT asset, x, y, mx, my, span, unnest(generate_series(0, 20)) / 20.0::DOUBLE AS t FROM tb),
edges AS (SELECT asset, x, y, unnest([mx + t * span, mx + t * span, mx, mx + span]) AS px, unnest([my, my - span, my - t * span, my - t * span]) AS py FROM steps),
ell AS (SELECT asset, x, y, degrees(px / 6378137.0) AS lon, degrees(atan(sinh(py / 6378137.0))) AS lat FROM edges),
{forward_utm_sql("ell", "asset, x, y")},
ext AS (SELECT u.asset, u.x, u.y, a.w, a.h, min((ux - 453720.0 - u.asset * 2500.0) / 30.0) AS c0, max((ux - 453720.0 - u.asset * 2500.0) / 30.0) AS c1, min((4353960.0 - uy) / 30.0) AS r0, max((4353960.0 - uy) / 30.0) AS r1, {SIZE} AS dw, {SIZE} AS dh
  FROM utm u JOIN assets a ON a.asset = u.asset GROUP BY ALL),
near AS (SELECT * REPLACE (CASE WHEN abs(round(c0) - c0) < 1e-6 THEN round(c0) ELSE c0 END AS c0, CASE WHEN abs(round(c1) - c1) < 1e-6 THEN round(c1) ELSE c1 END AS c1,
  CASE WHEN abs(round(r0) - r0) < 1e-6 THEN round(r0) ELSE r0 END AS r0, CASE WHEN abs(round(r1) - r1) < 1e-6 THEN round(r1) ELSE r1 END AS r1) FROM ext),
hits AS (SELECT * FROM near WHERE NOT (c0 > w OR c1 < 0 OR r0 > h OR r1 < 0)), {shape_sql(0, "hits")},
wins AS (SELECT asset, x, y, CAST(floor(off_x) AS BIGINT) AS a0, CAST(least(ceil(off_x + size_x), w) AS BIGINT) AS a1, CAST(floor(off_y) AS BIGINT) AS b0, CAST(least(ceil(off_y + size_y), h) AS BIGINT) AS b1 FROM kernel),
stored AS (SELECT DISTINCT asset, prow // 16 AS cy, pcol // 16 AS cx FROM px WHERE value IS NOT NULL)"""


@query(
    "render_refs_traces",
    f"""WITH {REFS_SQL}, n AS (SELECT w.asset, w.x, w.y, count(s.asset) * 2 AS blocks FROM wins w LEFT JOIN stored s ON s.asset = w.asset AND a1 > a0 AND b1 > b0 AND s.cy BETWEEN b0 // 16 AND (b1 - 1) // 16 AND s.cx BETWEEN a0 // 16 AND (a1 - 1) // 16 GROUP BY ALL)
SELECT '{ZOOM}/' || t.x || '/' || t.y AS tile, CAST(t.asset AS VARCHAR) AS granule_id, 'live' AS decision, CAST(coalesce(blocks, 0) * 512 AS BIGINT) AS bytes_read, CAST(coalesce(blocks, 0) AS BIGINT) AS ranges,
  t.asset || '.nir' AS source, t.asset || '.nir,' || t.asset || '.red' AS sources, 'EPSG:32613' AS crs_from, 'latest_at_or_before' AS rule, strftime(make_timestamp(t.asset * 86400000000), '%Y-%m-%d') AS granule_day, 3 AS candidates
  FROM tls t LEFT JOIN n ON n.asset = t.asset AND n.x = t.x AND n.y = t.y""",
)
def render_refs_traces(spark, sf):
    granules, rasters, refs, tiles = stored_scene(spark, sf, 16, [])
    _, traces = J.render_refs(LAYER, tiles, granules, rasters, refs)
    return traces.select(
        "tile", "granule_id", "decision", "bytes_read", F.size("provenance").cast("long").alias("ranges"), "source", F.array_join("sources", ",").alias("sources"),
        "crs_from", F.col("temporal.rule").alias("rule"), F.substring("temporal.granule_datetime", 1, 10).alias("granule_day"), F.size("plan").alias("candidates"),
    )
