"""Ingest end to end over files, and the composite jobs."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from rasterspark.plans import jobs as J
from rasterspark.registry.streams import LAYER, scene
from rasterspark.streaming import ingest as SI
from rasterspark.streaming import traces as ST


def _drop(folder, name, **changes):
    doc = {"dataset": "d", "granule": name, "bbox": [0, 0, 1, 1], "datetime": "2024-06-06T17:54:00Z", "assets": {"red": "r.tif"}}
    doc.update(changes)
    (folder / f"{name}.json").write_text(json.dumps(doc))


def test_ingest_stream(spark, tmp_path):
    drop, cat, bad, ckpt = (tmp_path / n for n in ("drop", "catalog", "bad", "ckpt"))
    drop.mkdir()
    datasets = spark.createDataFrame([("d", ["red"])], "id string, bands array<string>")
    seen = []
    run = lambda: SI.ingest_stream(
        SI.stream_granules(spark, str(drop)), datasets, str(cat), str(bad), str(ckpt), lambda g, i: seen.append((i, g.count()))
    ).awaitTermination()
    _drop(drop, "g1")
    _drop(drop, "g2", dataset="ghost")
    _drop(drop, "g3", extra=1)
    (drop / ".g4.json").write_text("{}")
    (drop / "note.txt").write_text("x")
    run()
    first = SI.read_snapshot(spark, str(cat))
    assert [(r["id"], r["ingested_at"] is not None) for r in first.collect()] == [("g1", True)]
    reasons = {r["name"]: r["reason"] for r in spark.read.parquet(str(bad) + "/v=0").collect()}
    assert reasons == {"g2.json": "dataset unknown", "g3.json": "unknown field"}
    _drop(drop, "g5", granule="g1", bbox=[5, 5, 6, 6])
    run()
    second = {r["id"]: r["bbox"]["west"] for r in SI.read_snapshot(spark, str(cat)).collect()}
    assert second == {"g1": 5.0} and seen == [(0, 1), (1, 1)]
    run()  # nothing new: no batch
    assert len(seen) == 2


def test_frame_loop_and_cache(spark, sf_dir):
    granules, rasters, pixels, tiles = scene(spark, sf_dir)
    none = spark.createDataFrame([], "tile_key string")
    where = tiles.select("z", "x", "y").distinct()
    fresh, traces = J.frame_loop(LAYER, where, [0, 1, 86400000 * 2], granules, rasters, pixels, none)
    stored = J.rendered_keys(traces)
    assert fresh.select("tile_key").distinct().join(stored, "tile_key", "left_anti").count() == 0
    again, hits = J.frame_loop(LAYER, where, [0, 1, 86400000 * 2], granules, rasters, pixels, stored)
    kinds = {r["decision"] for r in traces.collect()}
    assert kinds == {"live"}
    assert again.count() == 0 and hits.where("decision = 'cache_hit' AND bytes_read = 0").count() == stored.count()


def test_materialize(spark, tmp_path):
    rasters = spark.createDataFrame([("a", 16, 16, "int16", [], 0)], "asset string, width long, height long, dtype string, overview_levels array<int>, n int")
    pixels = spark.range(256).select(F.lit("a").alias("asset"), F.lit(1).alias("level"), F.floor(F.col("id") / 16).alias("row"), (F.col("id") % 16).alias("col"), F.col("id").cast("double").alias("value"))
    uses = spark.createDataFrame([("a", "average"), ("a", "average")], "asset string, resampling string")
    assert J.materialize(rasters, pixels, uses, str(tmp_path / "p"), 4, 4) == [2, 4]
    top = spark.read.parquet(str(tmp_path / "p")).where("factor = 4").first()
    assert len(top["values"]) == 16 and top["values"][0] == 26.0


def test_fresh_granules_are_rendered_once(spark, sf_dir, tmp_path):
    from rasterspark.operators.warp import raster_bounds
    from rasterspark.registry.warping import ZOOM, utm_rasters
    from rasterspark.streaming.render import render_after

    granules, rasters, pixels, _ = scene(spark, sf_dir)
    boxes = raster_bounds(utm_rasters(spark, sf_dir)).select(F.col("asset").cast("string").alias("id"), F.struct("west", "south", "east", "north").alias("bbox"))
    arrived = granules.join(boxes, "id")
    out = str(tmp_path / "out")
    hook = render_after(LAYER, ZOOM, lambda: rasters, lambda: pixels, out)
    hook(arrived, 0)
    first = spark.read.parquet(f"{out}/pixels/batch=0")
    assert first.select("granule_id").distinct().count() == granules.count()
    hook(arrived, 1)
    assert spark.read.parquet(f"{out}/pixels/batch=1").count() == 0
    assert {r["decision"] for r in spark.read.parquet(f"{out}/traces/batch=1").collect()} == {"cache_hit"}


def test_preview_is_one_tile_under_a_ceiling(spark, sf_dir):
    granules, rasters, pixels, _ = scene(spark, sf_dir)
    box = spark.createDataFrame([((-105.53, 39.31, -105.52, 39.32),)], "bbox struct<west:double,south:double,east:double,north:double>")
    painted, traces = J.preview(LAYER, box, granules, rasters, pixels, 10**9)
    assert painted.select("z", "x", "y").distinct().count() <= 1 and traces.count() == 1
    _, refused = J.preview(LAYER, box, granules, rasters, pixels, 1)
    assert [r["decision"] for r in refused.collect()] == ["refuse"]


def test_traces_round_trip(spark, tmp_path):
    from rasterspark.sources.exports import read_traces, write_traces

    row = (1, "3/1/2", "l", ("live", ["a"], 5))
    df = spark.createDataFrame([row, (2, "3/9/2", "l", ("live", [], 0))], "id long, tile string, layer string, trace struct<decision:string,sources:array<string>,bytes_read:long>")
    write_traces(df, str(tmp_path / "t"))
    got = read_traces(spark, str(tmp_path / "t")).collect()
    assert [(r["id"], r["x"], r["trace"]["bytes_read"]) for r in got] == [(1, 1, 5)]


def test_fresh_tiles_resolve_against_the_whole_catalog(spark, sf_dir, tmp_path):
    from rasterspark.operators.warp import raster_bounds
    from rasterspark.registry.warping import ZOOM, utm_rasters
    from rasterspark.streaming.render import render_after

    granules, rasters, pixels, _ = scene(spark, sf_dir)
    boxes = raster_bounds(utm_rasters(spark, sf_dir)).select(F.col("asset").cast("string").alias("id"), F.struct("west", "south", "east", "north").alias("bbox"))
    first = granules.where("id = '0'")
    stored = first.withColumn("id", F.lit("z"))  # of the same millisecond, with a greater id
    out = str(tmp_path / "out")
    render_after(LAYER, ZOOM, lambda: rasters, lambda: pixels, out, lambda: first.unionByName(stored))(first.join(boxes, "id"), 0)
    traces = spark.read.parquet(f"{out}/traces/batch=0").collect()
    assert traces and {r["granule_id"] for r in traces} == {"z"}
    assert spark.read.parquet(f"{out}/pixels/batch=0").where("granule_id <> 'z'").count() == 0


def test_an_older_trace_never_wins_after_idle_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    kind = "layer string, tile string, id long, decision string, ts timestamp"
    steps = [("a", 10, "live", 0), ("b", 11, "live", 5), ("b", 12, "live", 6), ("a", 3, "old", 7), ("b", 13, "live", 20), ("a", 14, "new", 21)]
    arriving = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    out = []
    # one file, one run: the state goes on from run to run
    for n, (tile, i, decision, hour) in enumerate(steps):
        spark.createDataFrame([("l", tile, i, decision, datetime(2024, 1, 1 + hour // 24, hour % 24))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = ST.latest_tile_stream(arriving, "1 hour").writeStream.outputMode("update")
        changes.foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.id, r.decision) for r in out if r.tile == "a"] == [(10, "live"), (14, "new")]
    assert [r.id for r in out if r.tile == "b"] == [11, 12, 13]
