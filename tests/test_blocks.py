"""Byte ranges, blocks, stored pyramids and exports: what is read, kept, refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.operators import block_warp as BW
from rasterspark.operators import pyramid as PY
from rasterspark.operators import warp as W
from rasterspark.operators.chunks import pack_chunks
from rasterspark.plans import jobs as J
from rasterspark.registry.streams import LAYER, stored_scene
from rasterspark.sources import chunk_reader as CR
from rasterspark.sources import exports as EX

REF = "asset string, level int, cy long, cx long, h int, w int, path string, offset long, length long, dtype string, codecs array<string>, nodata double"


def _ref(cy, path, offset, length, nodata=None, cx=0):
    return ("a", 1, cy, cx, 2, 2, path, offset, length, "uint8", [], nodata)


def test_ranges_merge_neighbours_only(spark):
    rows = [_ref(0, "f", 0, 4), _ref(1, "f", 4, 4), _ref(2, "f", 20, 4), _ref(3, "f", 200, 4), _ref(4, "f", 998, 4), _ref(5, "f", 1001, 4), _ref(6, "g", 6, 4)]
    refs = spark.createDataFrame([*rows, rows[0], _ref(7, "f", None, None), _ref(8, None, 0, 4), _ref(9, "f", 8, 0)], REF)
    got = sorted((r["path"], r["start"], r["bytes"], [b["cy"] for b in r["blocks"]]) for r in CR.plan_ranges(refs, max_gap=16, segment=1000).collect())
    assert got == [("f", 0, 24, [0, 1, 2]), ("f", 200, 4, [3]), ("f", 998, 4, [4]), ("f", 1001, 4, [5]), ("g", 6, 4, [6])]


@pytest.mark.parametrize("whole", [False, True])
def test_reads_mask_nodata_and_fill_sparse_blocks(spark, tmp_path, whole):
    (tmp_path / "f.bin").write_bytes(bytes(range(12)))
    rows = [_ref(0, "f.bin", 0, 4, 2.0), _ref(1, "f.bin", 8, 4), _ref(2, "f.bin", None, None), _ref(3, "f.bin", 0, 0, 9.0)]
    got = {r["cy"]: (r["values"], r["error"]) for r in CR.read_chunk_refs(spark.createDataFrame(rows, REF), str(tmp_path), whole_files=whole).collect()}
    assert got == {0: ([0.0, 1.0, None, 3.0], None), 1: ([8.0, 9.0, 10.0, 11.0], None), 2: ([0.0] * 4, None), 3: ([None] * 4, None)}
    uri = spark.createDataFrame([_ref(0, "f.bin", 4, 4)], REF)
    assert CR.read_chunk_refs(uri, f"file://{tmp_path}", whole_files=whole).first()["values"] == [4.0, 5.0, 6.0, 7.0]


def test_written_blocks_read_back(spark, tmp_path):
    z = np.random.default_rng(1).integers(-300, 300, (5, 6, 6)).astype(float)
    rows = [("a", 1, i // 2, i % 2, 6, 6, [None if v % 7 == 0 else float(v) for v in z[i].ravel()]) for i in range(5)]
    blocks = spark.createDataFrame(rows, "asset string, level int, cy long, cx long, h int, w int, values array<double>")
    refs = CR.write_chunk_files(blocks, str(tmp_path / "deep" / "er"), "int16", ["shuffle", "zlib:3"], -9999.0)
    got = {(r["cy"], r["cx"]): r["values"] for r in CR.read_chunk_refs(refs).collect()}
    assert got == {(r[2], r[3]): r[6] for r in rows}


def test_unreadable_block_fails_the_render(spark, sf_dir):
    granules, rasters, refs, tiles = stored_scene(spark, sf_dir, 16, [])
    broken = refs.withColumn("path", F.lit("/nowhere/x.bin"))
    painted, _ = J.render_refs(LAYER, tiles, granules, rasters, broken)
    with pytest.raises(Exception, match="FileNotFound"):
        painted.count()


def _shaped(spark, n, raster_n, reach, shift):
    side = raster_n * 10.0
    from rasterspark.functions import grid as G

    target = spark.range(1).select(
        F.lit("a").alias("asset"), F.lit("EPSG:3857").alias("crs"), F.lit("EPSG:3857").alias("src_crs"), G.north_up(0.0, 0.0, 10.0, -10.0).alias("transform"),
        F.lit(raster_n).alias("raster_w"), F.lit(raster_n).alias("raster_h"), F.lit(n).alias("width"), F.lit(n).alias("height"),
        F.lit(shift).alias("min_x"), F.lit(side + shift).alias("max_x"), F.lit(-shift).alias("max_y"), F.lit(-side - shift).alias("min_y"),
    )
    return W.kernel_shape(target.join(W.source_extent(target, ["asset"]), "asset"), reach)


@pytest.mark.parametrize(("n", "propagate", "size"), [(5, False, 4), (5, True, 5), (40, True, 4), (13, False, 16)])
def test_blocks_warp_like_pixels(spark, n, propagate, size):
    """Any block shape gives what pixel rows give: enlarged, shrunk, with holes, missing blocks and an overhang."""
    z = np.random.default_rng(n).integers(0, 99, (13, 13)).astype(float)
    z[3:5, 3:6] = np.nan
    z[8:13, 0:5] = np.nan
    rows = [("a", r, c, float(z[r, c])) for r in range(13) for c in range(13) if not np.isnan(z[r, c])]
    pixels = spark.createDataFrame(rows, "asset string, row long, col long, value double")
    shaped = _shaped(spark, n, 13, 1, 4.0)
    want = {(r["row"], r["col"]): r["value"] for r in W.warp_bilinear(W.target_pixels(shaped, ["asset"]), pixels, ["asset"], ["asset"], propagate).collect()}
    got = BW.warp_blocks(BW.with_block_shape(shaped, (size, size)), pack_chunks(pixels, ["asset"], size), ["asset"], ["asset"], "bilinear", None, propagate)
    got = {(r["row"], r["col"]): r["value"] for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_of_any_shape(spark):
    pixels = spark.createDataFrame([("a", r, c, float(13 * r + c)) for r in range(13) for c in range(13) if (r + c) % 5], "asset string, row long, col long, value double")
    near = _shaped(spark, 9, 13, 0, 4.0)
    want = {tuple(r) for r in W.warp_nearest(W.target_pixels(near, ["asset"]), pixels, ["asset"], ["asset"]).collect()}
    got = BW.warp_blocks(BW.with_block_shape(near, (5, 4)), pack_rect(pixels, 5, 4), ["asset"], ["asset"], "nearest")
    assert {tuple(r) for r in got.collect()} == want


def pack_rect(pixels, h, w):
    cell = F.struct(((F.col("row") % h) * w + F.col("col") % w).cast("int").alias("p"), "value")
    blocks = pixels.groupBy("asset", F.floor(F.col("row") / h).alias("cy"), F.floor(F.col("col") / w).alias("cx")).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    return blocks.select("asset", "cy", "cx", F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda p: F.try_element_at("m", p)).alias("values"))


def test_untouched_blocks_are_dropped(spark):
    shaped = BW.with_block_shape(_shaped(spark, 4, 100, 1, 0.0).withColumn("off_x", F.lit(30.0)).withColumn("size_x", F.lit(20.0)), (10, 10))
    touched = {(r["cy"], r["cx"]) for r in BW.touched_blocks(shaped, ["asset"]).collect()}
    assert touched == {(y, x) for y in range(10) for x in (3, 4)}
    blocks = spark.range(1000).select(F.lit("a").alias("asset"), F.floor(F.col("id") / 10).alias("cy"), (F.col("id") % 10).alias("cx"))
    assert BW.keep_touched(blocks, BW.touched_blocks(shaped, ["asset"]), ["asset"]).count() == 20


@pytest.mark.parametrize("dtype", ["int16", "uint8", "float64"])
def test_coarser_blocks_match_pixels(spark, dtype):
    z = np.random.default_rng(5).integers(-9, 300, (11, 14)).astype(float)
    rows = [(a, r, c, float(z[r, c])) for a in ("mean", "near") for r in range(11) for c in range(14) if z[r, c] % 5]
    pixels = spark.createDataFrame(rows, "asset string, row long, col long, value double")
    kind = F.when(F.col("asset") == "mean", "average").otherwise("nearest")
    blocks = pack_chunks(pixels, ["asset"], 4).withColumns({"resampling": kind, "dtype": F.lit(dtype)})
    from rasterspark.operators.chunks import explode_chunks

    got = {tuple(r) for r in explode_chunks(PY.coarser_blocks(blocks, ["asset"], 4), ["asset"]).where("value IS NOT NULL").collect()}
    want = set()
    for asset, how in (("mean", "average"), ("near", "nearest")):
        level = PY.build_level(pixels.where(F.col("asset") == asset), ["asset"], 2, how, dtype).where("value IS NOT NULL")
        want |= {tuple(r) for r in level.collect()}
    assert got == want


def _pyramid_inputs(spark, shift=0):
    rasters = spark.createDataFrame([("a", 16, 16, "int16", []), ("b", 16, 12, "int16", [2])], "asset string, width long, height long, dtype string, overview_levels array<int>")
    cells = [(a, 1, r, c, float(r * 16 + c + shift)) for a, h in (("a", 16), ("b", 12)) for r in range(h) for c in range(16)]
    cells += [("b", 2, r, c, 5.0) for r in range(6) for c in range(8)]
    pixels = spark.createDataFrame(cells, "asset string, level int, row long, col long, value double")
    uses = spark.createDataFrame([("a", "average"), ("b", "nearest")], "asset string, resampling string")
    return rasters, pixels, uses


def test_second_run_reads_no_samples_and_changes_refuse(spark, tmp_path):
    path = str(tmp_path / "p")
    rasters, pixels, uses = _pyramid_inputs(spark)
    named = rasters.withColumn("fingerprint", F.lit("v1"))
    assert J.materialize(named, pixels, uses, path, 4, 8) == [2]
    assert J.materialize(named, pixels, uses, path, 4, 4) == [4]
    unread = pixels.withColumn("value", F.raise_error(F.lit("a sample was read")).cast("double"))
    assert J.materialize(named, unread, uses, path, 4, 4) == []
    stored = {(r["asset"], r["factor"]): r["n"] for r in EX.read_pyramid(spark, path).groupBy("asset", "factor").agg(F.count("*").alias("n")).collect()}
    assert stored == {("a", 2): 4, ("a", 4): 1, ("b", 4): 1}
    top = EX.read_pyramid(spark, path).where("asset = 'b' AND factor = 4").first()["values"]
    assert top[0] == 5.0 and top[12:] == [None] * 4  # from the embedded level, not from full resolution
    for other in (rasters.withColumn("fingerprint", F.lit("v2")), named.withColumn("height", F.lit(15).cast("long"))):
        with pytest.raises(ValueError, match="another raster"):
            J.materialize(other, pixels, uses, path, 4, 4)
    with pytest.raises(ValueError, match="another raster"):
        J.materialize(named, pixels, uses, path, 2, 4)
    clash = uses.unionByName(spark.createDataFrame([("a", "nearest")], uses.schema))
    with pytest.raises(ValueError, match="two resamplings"):
        J.materialize(named, pixels, clash, path, 4, 4)


def test_samples_tell_a_changed_raster(spark, tmp_path):
    path = str(tmp_path / "p")
    rasters, pixels, uses = _pyramid_inputs(spark)
    assert J.materialize(rasters, pixels, uses, path, 4, 4) == [2, 4]
    assert J.materialize(rasters, pixels.repartition(5), uses, path, 4, 4) == []
    with pytest.raises(ValueError, match="another raster"):
        J.materialize(rasters, _pyramid_inputs(spark, 1)[1], uses, path, 4, 4)


def test_interrupted_level_resumes(spark, tmp_path):
    path = str(tmp_path / "p")
    rasters, pixels, uses = _pyramid_inputs(spark)
    assert J.materialize(rasters, pixels, uses, path, 4, 4) == [2, 4]
    want = sorted(map(str, EX.read_pyramid(spark, path).collect()))
    records = spark.read.parquet(f"{path}/_identity").where("factor = 2").collect()
    other = str(tmp_path / "q")
    EX.append_blocks(EX.read_pyramid(spark, path).where("factor = 2 OR cy = 0"), other)  # blocks of a run that died before it recorded factor 4
    spark.createDataFrame(records, EX._RECORDS).write.parquet(f"{other}/_identity")
    assert J.materialize(rasters, pixels, uses, other, 4, 4) == [4]
    assert sorted(map(str, EX.read_pyramid(spark, other).collect())) == want


def test_level_of_other_samples_is_refused(spark, tmp_path):
    ones = spark.range(16).select(F.lit("a").alias("asset"), F.lit(2).alias("factor"), F.floor(F.col("id") / 4).alias("row"), (F.col("id") % 4).alias("col"), F.lit(1.0).alias("value"))
    EX.write_pyramid(ones, str(tmp_path / "p"), 2)
    EX.write_pyramid(ones, str(tmp_path / "p"), 2)
    with pytest.raises(ValueError, match="other samples"):
        EX.write_pyramid(ones.withColumn("value", F.lit(9.0)), str(tmp_path / "p"), 2)


def test_reference_fingerprint_follows_the_references(spark):
    refs = spark.createDataFrame([_ref(0, "f", 0, 4), _ref(1, "f", 4, 4)], REF)
    one = EX.reference_fingerprint(refs).first()["fingerprint"]
    assert one == EX.reference_fingerprint(refs.orderBy(F.desc("cy"))).first()["fingerprint"]
    assert one != EX.reference_fingerprint(refs.withColumn("offset", F.col("offset") + 1)).first()["fingerprint"]


def test_exports_keep_other_tiles_of_a_level(spark, tmp_path):
    path = str(tmp_path / "t")
    cell = spark.range(4).select(F.lit("l").alias("layer"), F.lit(3).alias("z"), F.floor(F.col("id") / 2).alias("row"), (F.col("id") % 2).alias("col"))

    def tiles(xs, shade):
        return cell.withColumn("x", F.explode(F.array(*[F.lit(x) for x in xs]))).withColumns({"y": F.lit(1), "r": F.lit(shade), "g": F.lit(0), "b": F.lit(0), "a": F.lit(255)})

    EX.export_tiles(tiles(range(6), 10), path, 2)
    EX.export_tiles(tiles([5, 6], 20), path, 2)
    got = {r["x"]: r["rgba"][0] for r in spark.read.parquet(path).collect()}
    assert got == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 20, 6: 20}
