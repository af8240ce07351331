"""What grows with the input: joins of multiplied rows, equal boxes, batches of points."""

import pyarrow as pa
from pyspark.sql import functions as F

from rasterspark import registry
from rasterspark.operators import block_warp as BW
from rasterspark.operators import pyramid as PY
from rasterspark.operators import spatial as S
from rasterspark.operators import warp as W
from rasterspark.sources import rasters as RS


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_materialize_report_broadcasts_no_grid(spark):
    rasters = spark.range(50).select(F.col("id").alias("asset"), F.lit(1000).alias("width"), F.lit(700).alias("height"))
    grid = PY.level_grid(rasters, F.array(F.lit(2), F.lit(4)), 256)
    other = spark.createDataFrame([(0, 2, 99, 0)], "asset long, factor int, cy long, cx long")
    report = PY.materialize_report(grid, grid.where("factor = 2 AND asset < 10 OR cx = 0").unionByName(other))
    assert "BroadcastHashJoin" not in plan_of(report)
    got = {(r["asset"], r["factor"]): (r["to_write"], r["skipped"], r["complete"]) for r in report.collect()}
    assert len(got) == 100
    assert got[0, 2] == (0, 4, True) and got[10, 2] == (2, 2, False) and got[0, 4] == (0, 1, True)


def test_tile_refs_broadcast_no_blocks(spark):
    rasters = spark.range(9).select(
        F.concat(F.lit("a"), "id").alias("asset"), F.lit(0).alias("level"), F.lit(600).alias("width"), F.lit(300).alias("height"),
        F.lit(256).alias("tile_w"), F.lit(256).alias("tile_h"), F.lit(False).alias("planar"),
    )
    blocks = rasters.select("asset", "level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("block"))
    refs = RS.tile_refs(rasters, blocks.select("*", (F.col("block") * 10).alias("offset"), F.lit(7).alias("length")))
    assert "BroadcastHashJoin" not in plan_of(refs)
    got = {(r["asset"], r["key"]): r["offset"] for r in refs.collect()}
    assert len(got) == 54 and got["a3", "1.1"] == 40 and got["a3", "1.2"] is None


def test_batches_of_points_are_laid_out_in_bounded_slices():
    point = {"row": 0, "col": 0, "fr": 0.5, "fc": 0.5}
    batch = pa.RecordBatch.from_pydict({"_points": [[point] * 1000] * 300 + [None], "_values": [[1.0] * 1000] * 300 + [[1.0] * 600_000]})
    parts = list(BW._slices(batch))
    assert [p.num_rows for p in parts] == [125, 125, 50, 1]
    assert pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)


def test_bilinear_rows_shuffle_points_not_samples(spark):
    cells = spark.range(40 * 40).select(F.lit(0).alias("asset"), F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"))
    source = cells.withColumn("value", F.when((F.col("row") + F.col("col")) % 7 != 0, F.col("row") * 3.0 + F.col("col")))
    one = {"scale_x": 1.0, "scale_y": 1.0, "radius_x": 1, "radius_y": 1, "raster_w": 40, "raster_h": 40}
    points = cells.select("asset", "row", "col", (F.col("col") + 0.8).alias("fcol"), (F.col("row") + 0.7).alias("frow"), *[F.lit(v).alias(k) for k, v in one.items()])
    inside = (F.col("_sr") < 40) & (F.col("_sc") < 40) & (F.col("_sr") >= 0) & (F.col("_sc") >= 0)
    support = W.kernel_weights(points).withColumn("gate_counts", inside)
    for propagate in (False, True):
        out = W.warp_bilinear(points, source, ["asset"], ["asset"], propagate)
        assert "MapInArrow" in plan_of(out)
        want = W.weighted_mean(W.attach_samples(support, source, ["asset"]), ["asset", "row", "col"], "v", propagate).where("value IS NOT NULL")
        key = lambda df: {(r["row"], r["col"]): round(r["value"], 9) for r in df.collect()}
        assert key(out) == key(want)


def test_grids_are_parsed_in_more_than_one_task(spark, sf_dir):
    registry.load()
    text = registry.QUERIES["parse_eos_grids"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in plan_of(text)


def test_equal_boxes_are_matched_once(spark, monkeypatch):
    box = lambda w, s: F.struct(w.alias("west"), s.alias("south"), (w + 3.0).alias("east"), (s + 2.0).alias("north"))
    i = F.col("id")
    left = spark.range(600).select("id", box(F.when(i % 7 == 0, 178.0).otherwise(i % 5 * 2.0) , i % 3 * 2.0).alias("bbox"))
    # boxes across the antimeridian have west > east
    wrapped = F.col("bbox").withField("east", F.when(F.col("bbox.east") > 180, F.col("bbox.east") - 360).otherwise(F.col("bbox.east")))
    left = left.withColumn("bbox", wrapped)
    right = left.where("id % 4 = 1").unionByName(spark.range(1).select((i + 5000).alias("id"), box(F.lit(-179.5), F.lit(1.0)).alias("bbox")))
    seen = []
    plain = S._meeting
    monkeypatch.setattr(S, "_meeting", lambda a, b, *rest: seen.append((a.count(), b.count())) or plain(a, b, *rest))
    monkeypatch.setattr(S, "LISTED_IDS", 7)
    got = sorted(tuple(r) for r in S.bbox_join(left, right).collect())
    assert seen[0][0] <= 18 and got == sorted(tuple(r) for r in plain(left, right, 6, "bbox", S.HOT_PAIRS).collect()) and len(got) > 5000
