"""Operators against brute force and numpy on small inputs, and their edge cases."""

import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterspark.functions import grid as G
from rasterspark.operators import catalog as C
from rasterspark.operators import ordered as O
from rasterspark.operators import pyramid as PY
from rasterspark.operators import resolve as R
from rasterspark.operators import spatial as S
from rasterspark.operators import udf as U
from rasterspark.operators import warp as W
from rasterspark.sources import chunk_reader as CR
from rasterspark.sources import exports as EX


def test_ordered_helpers_match_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "cold"], 400, p=[0.9, 0.1]), "id": rng.permutation(4000)[:400] * 982_451_653, "v": rng.integers(0, 9, 400)})
    df = spark.createDataFrame(pdf)
    # sparse ids, a hot key over several ranges, blocks of 20 rows
    ranges = O.sampled_ranges(df, ["k", "id"]).groupBy("_range").count().collect()
    assert len(ranges) > 2 and max(r["count"] for r in ranges) < 250
    got = O.running_totals(df, ["k"], "id", {"total": F.col("v")}).toPandas().sort_values(["k", "id"])
    want = pdf.sort_values(["k", "id"])
    assert list(got["total"]) == list(want.groupby("k")["v"].cumsum())
    near = O.neighbour(df, ["k"], "id", "v", "prev", -1).toPandas().sort_values(["k", "id"])
    assert near["prev"].fillna(-1).tolist() == want.groupby("k")["v"].shift().fillna(-1).tolist()
    marked = df.withColumn("m", F.when(F.col("v") > 5, F.col("v")))
    last = O.last_before(marked, ["k"], ["id"], "m", "last").toPandas().sort_values(["k", "id"])
    known = want["v"].where(want["v"] > 5)
    assert last["last"].fillna(-1).tolist() == known.groupby(want["k"]).transform(lambda m: m.ffill().shift()).fillna(-1).tolist()
    blocks = O.trailing_rows(df, ["k"], "id", 7, 20)
    sizes = blocks.groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert sizes <= 26 and blocks.where("_home").count() == 400
    placed = O.position(df, [], "id").toPandas().sort_values("id")
    assert placed["position"].tolist() == list(range(400))


@pytest.mark.parametrize("sizes", [{"one": 1, "two": 2, "three": 3, None: 2}, {"hot": 90, "x": 1, "y": 2}])
def test_circle_wraps_round(spark, sizes):
    rows = [(k, i * i * 10_007) for k, n in sizes.items() for i in range(n)]
    got = O.circle(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v", ("i", "a", "b")).collect()
    at = lambda k, i: (i % sizes[k]) ** 2 * 10_007
    assert sorted(map(tuple, got), key=str) == sorted(((k, at(k, i), i, at(k, i + 1), at(k, i + 2)) for k, n in sizes.items() for i in range(n)), key=str)


@pytest.mark.parametrize("n", [1, 2, 19, 500])
def test_exact_quantiles(spark, n):
    values = np.random.default_rng(n).integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    qs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = O.exact_quantiles(df, [], "v", qs, slack=0.02).first()
    ordered = np.sort(values)
    assert [got[k] for k in qs] == [ordered[max(1, int(np.ceil(q * n))) - 1] for q in qs.values()]


def test_asof_ties_and_empty(spark):
    g = spark.createDataFrame([("d", "a", datetime(2020, 1, 1)), ("d", "b", datetime(2020, 1, 1)), ("d", "c", datetime(2021, 1, 1))], "dataset string, id string, datetime timestamp")
    day = 86400000
    first = 18262 * day
    r = spark.createDataFrame([(1, "d", first - 1), (2, "d", first), (3, "d", None), (4, "x", first)], "n int, dataset string, t_ms long")
    got = {x["n"]: x["granule_id"] for x in R.asof_latest(r, g).collect()}
    assert got == {1: None, 2: "b", 3: "c", 4: None}


def test_filter_bbox_antimeridian(spark):
    boxes = spark.createDataFrame([("a", (170.0, 0.0, -170.0, 5.0)), ("b", (-10.0, 0.0, 10.0, 5.0))], "id string, bbox struct<west:double,south:double,east:double,north:double>")
    assert [r["id"] for r in C.filter_bbox(boxes, 175, 1, 178, 2).collect()] == ["a"]
    assert [r["id"] for r in C.filter_bbox(boxes, -175, 1, -172, 2).collect()] == ["a"]
    assert {r["id"] for r in C.filter_bbox(boxes, 175, 1, 5, 2).collect()} == {"a", "b"}


def test_ladder():
    assert PY.ladder(512, 512) == [2] and PY.ladder(4000, 100, [2]) == [4, 8, 16] and PY.ladder(256, 10) == []
    assert PY.level_sources([4, 8], [2]) == [(4, 2), (8, 4)]


def _raster(spark, z, nodata=None):
    rows = [(r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1]) if nodata is None or z[r, c] != nodata]
    return spark.createDataFrame(rows, "row long, col long, value double").withColumn("asset", F.lit("a"))


def _target(spark, n, raster_n, shift=0.0, crs="EPSG:3857"):
    t = G.north_up(0.0, 0.0, 10.0, -10.0)
    side = raster_n * 10.0
    return spark.range(1).select(
        F.lit("a").alias("asset"), F.lit(crs).alias("crs"), F.lit(crs).alias("src_crs"), t.alias("transform"),
        F.lit(raster_n).alias("raster_w"), F.lit(raster_n).alias("raster_h"), F.lit(n).alias("width"), F.lit(n).alias("height"),
        F.lit(shift).alias("min_x"), F.lit(side + shift).alias("max_x"), F.lit(-shift).alias("max_y"), F.lit(-side - shift).alias("min_y"),
    )


def _warp(spark, z, n, kind, nodata=None, **kwargs):
    target = _target(spark, n, z.shape[0])
    reach = 1 if kind == "bilinear" else 0
    shaped = W.kernel_shape(target.join(W.source_extent(target, ["asset"]), "asset"), reach)
    points = W.target_pixels(shaped, ["asset"])
    fn = W.warp_bilinear if kind == "bilinear" else W.warp_nearest
    return fn(points, _raster(spark, z, nodata), ["asset"], ["asset"], **kwargs).toPandas()


def test_warp_properties(spark):
    z = np.random.default_rng(3).integers(0, 100, (12, 12)).astype(float)
    near = _warp(spark, z, 12, "nearest")
    assert len(near) == 144 and all(z[r, c] == v for r, c, v in zip(near["row"], near["col"], near["value"]))
    half = _warp(spark, z, 6, "bilinear")
    assert len(half) == 36 and half["value"].between(z.min(), z.max()).all()
    flat = _warp(spark, np.full((12, 12), 7.0), 5, "bilinear")
    assert np.allclose(flat["value"], 7.0)
    holes = z.copy()
    holes[3:5, 3:5] = -1
    loose = _warp(spark, holes, 12, "bilinear", nodata=-1)
    strict = _warp(spark, holes, 12, "bilinear", nodata=-1, propagate=True)
    assert len(loose) == 140 and len(strict) <= len(loose)
    ring = np.full((4, 4), -1.0)
    ring[0, 0] = 5.0
    assert _warp(spark, ring, 4, "nearest", nodata=-1.0)["value"].tolist() == [5.0]


def test_udf_contract(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, None)], "row long, col long, a double")

    def noisy(values, valid, params):
        out = values["a"] * params["k"]
        out[0, 0] = np.inf
        return [(out, np.ones_like(out, bool))]

    got = {(r["row"], r["col"]): r["gray"] for r in U.run_udf(df, [], ["a"], U.TileUdf(noisy, 1, {"k": 3}), 4).collect()}
    assert got == {(0, 0): None, (0, 1): 6.0, (1, 0): None}
    with pytest.raises(ValueError):
        U.TileUdf(noisy, 2)
    assert U.TileUdf(noisy, 1, {"k": 1}).identity() != U.TileUdf(noisy, 1, {"k": 2}).identity()

    def wrong(values, valid, params):
        return []

    with pytest.raises(Exception):
        U.run_udf(df, [], ["a"], U.TileUdf(wrong, 1), 4).collect()


def test_read_chunk_refs(spark, tmp_path):
    data = np.arange(16, dtype="<i2").reshape(4, 4)
    shuffled = np.frombuffer(data.tobytes(), np.uint8).reshape(-1, 2).T.tobytes()
    packed = zlib.compress(shuffled, 4)
    plain = data.tobytes()
    (tmp_path / "f.bin").write_bytes(b"head" + packed + plain)
    rows = [
        ("a", 1, 0, 0, 4, 4, "f.bin", 4, len(packed), "int16", ["shuffle", "zlib:4"]),
        ("a", 1, 0, 1, 4, 4, "f.bin", 4 + len(packed), len(plain), "int16", []),
        ("a", 1, 1, 0, 4, 5, "f.bin", 4 + len(packed), len(plain), "int16", []),
        ("a", 1, 1, 1, 4, 4, "none.bin", 0, 4, "int16", []),
        ("a", 1, 2, 0, 4, 4, "f.bin", 4, len(packed), "int16", ["szip"]),
    ]
    schema = "asset string, level int, cy long, cx long, h int, w int, path string, offset long, length long, dtype string, codecs array<string>"
    got = {(r["cy"], r["cx"]): r for r in CR.read_chunk_refs(spark.createDataFrame(rows, schema), str(tmp_path)).collect()}
    assert got[0, 0]["values"] == got[0, 1]["values"] == list(map(float, range(16)))
    assert "expected 40" in got[1, 0]["error"] and got[1, 1]["error"].startswith("FileNotFound") and "szip" in got[2, 0]["error"]


def test_write_and_read_pyramid(spark, tmp_path):
    z = np.arange(36, dtype=float).reshape(6, 6)
    levels = PY.build_pyramid(_raster(spark, z), ["asset"], [2], "average", "int16")
    EX.write_pyramid(levels.select("asset", "factor", "row", "col", "value"), str(tmp_path / "p"), 4, -1.0)
    back = EX.read_pyramid(spark, str(tmp_path / "p")).first()
    assert back["factor"] == 2 and back["values"][:4] == [4.0, 6.0, 8.0, -1.0] and len(back["values"]) == 16


def test_export_tiles_png(spark, tmp_path):
    px = spark.range(16).select(
        F.lit("l").alias("layer"), F.lit(1).alias("z"), F.lit(0).alias("x"), F.lit(1).alias("y"), F.floor(F.col("id") / 4).alias("row"),
        (F.col("id") % 4).alias("col"), F.col("id").alias("r"), F.lit(2).alias("g"), F.lit(3).alias("b"), F.lit(255).alias("a"),
    )
    EX.export_tiles(px, str(tmp_path / "t"), 4, png=True)
    tile = spark.read.parquet(str(tmp_path / "t")).first()
    assert bytes(tile["rgba"][4:8]) == bytes([1, 2, 3, 255]) and bytes(tile["png"][:8]) == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(Exception):
        EX.export_tiles(px.where("row < 3"), str(tmp_path / "u"), 4)


def test_stored_levels_survive_other_assets_and_resumes(spark, tmp_path):
    path, z = str(tmp_path / "p"), np.arange(64, dtype=float).reshape(8, 8)
    levels = PY.build_pyramid(_raster(spark, z), ["asset"], [2], "average", "int16").select("asset", "factor", "row", "col", "value")
    EX.write_pyramid(levels.where("row < 2"), path, 2)
    EX.write_pyramid(levels.withColumn("asset", F.lit("other")), path, 2)
    EX.write_pyramid(levels, path, 2)
    stored = EX.read_pyramid(spark, path)
    assert {(r["asset"] == "other", r["n"]) for r in stored.groupBy("asset").agg(F.count("*").alias("n")).collect()} == {(True, 4), (False, 4)}
    assert stored.select("asset", "factor", "cy", "cx").distinct().count() == 8


def test_exported_layers_stay(spark, tmp_path):
    px = spark.range(4).select(
        F.lit("l").alias("layer"), F.lit(1).alias("z"), F.lit(0).alias("x"), F.lit(1).alias("y"), F.floor(F.col("id") / 2).alias("row"),
        (F.col("id") % 2).alias("col"), F.col("id").alias("r"), F.lit(2).alias("g"), F.lit(3).alias("b"), F.lit(255).alias("a"),
    )
    for layer in ("one", "two", "two"):
        EX.export_tiles(px.withColumn("layer", F.lit(layer)), str(tmp_path / "t"), 2)
    assert sorted(r["layer"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["one", "two"]


def test_windows_longer_than_a_block(spark):
    df = spark.range(700).select(F.lit("k").alias("k"), "id")
    blocks = O.trailing_rows(df, ["k"], "id", 300, 100)
    window = Window.partitionBy("k", "_block").orderBy("id").rowsBetween(-299, 0)
    got = blocks.withColumn("n", F.count("*").over(window)).where("_home").select("id", "n").collect()
    assert {r["id"]: r["n"] for r in got} == {i: min(i + 1, 300) for i in range(700)}


def test_crossing_boxes_meet_once(spark):
    box = "id string, bbox struct<west double, south double, east double, north double>"
    left = spark.createDataFrame([("a", (170.0, -10.0, -170.0, 10.0)), ("b", (10.0, 1.0, 5.0, 2.0))], box)
    right = spark.createDataFrame([("r", (175.0, -5.0, -175.0, 5.0)), ("w", (-180.0, -5.0, 180.0, 5.0)), ("n", (6.0, 0.0, 9.0, 5.0))], box)
    got = sorted(tuple(r) for r in S.bbox_join(left, right).collect())
    assert got == [("a", "r"), ("a", "w"), ("b", "r"), ("b", "w")]
    for z in (0, 1, 4):
        tiles = [tuple(r) for r in S.tiles_for_footprints(left, z).select("id", "z", "x", "y").collect()]
        assert len(tiles) == len(set(tiles)) > 0


def test_hot_tiles_split(spark):
    rng = np.random.default_rng(8)

    def boxes(n, seed):
        west, south = 10.0 + 4 * rng.random(n), 42.0 + 4 * rng.random(n)  # all in one tile of zoom 6
        rows = [(int(i), (float(w), float(s), float(w + d), float(s + d))) for i, w, s, d in zip(range(n), west, south, rng.choice([0.001, 0.2, 1.5], n))]
        rows += [(n, (-180.0, -60.0, 180.0, 60.0)), (n + 1, (170.0, 41.0, 12.0, 43.0)), (n + 2, (11.0, 42.5, 11.0, 42.5))]
        return spark.createDataFrame(rows, "id long, bbox struct<west double, south double, east double, north double>"), rows

    (left, a), (right, b) = boxes(150, 1), boxes(120, 2)
    parts = lambda w, e: [(w, e)] if w <= e else [(w, 180.0), (-180.0, e)]
    meet = lambda p, q: p[1] <= q[3] and p[3] >= q[1] and any(u <= y and v >= x for u, v in parts(p[0], p[2]) for x, y in parts(q[0], q[2]))
    want = sorted((i, j) for i, p in a for j, q in b if meet(p, q))
    for hot in (S.HOT_PAIRS, 500, 1):
        got = S.bbox_join(left, right, hot_pairs=hot)
        assert sorted(map(tuple, got.collect())) == want


_SHIFT = 1.0


def _helper(x):
    return x + _SHIFT


def test_function_identity_covers_what_it_refers_to(monkeypatch):
    def made(k, table=(1, 2)):
        inner = lambda v: v * k
        return U.TileUdf(lambda values, valid, params: [(inner(_helper(values["a"])), valid["a"])], 1, {"t": table})

    one = made(2).identity()
    assert one == made(2).identity() and one != made(3).identity() and one != made(2, (1, 3)).identity()
    monkeypatch.setitem(globals(), "_SHIFT", 2.0)
    assert made(2).identity() != one
    monkeypatch.setitem(globals(), "_SHIFT", 1.0)
    monkeypatch.setitem(globals(), "_helper", lambda x: x - _SHIFT)
    assert made(2).identity() != one


def test_relief_is_the_same_in_blocks(spark):
    from rasterspark.operators.pixels import hillshade

    z = np.random.default_rng(2).integers(0, 90, (9, 11))
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(9) for c in range(11) if (r, c) != (4, 5)], "row long, col long, value double")
    whole = {(r["row"], r["col"]): r["shade"] for r in hillshade(df, []).collect()}
    small = hillshade(df, [], block=3).collect()
    assert len(small) == len(whole) and {(r["row"], r["col"]): r["shade"] for r in small} == whole
    assert sum(v is not None for v in whole.values()) == 7 * 9 - 9


def test_rolling_quantiles_of_a_hot_layer_over_batches(spark, tmp_path):
    from rasterspark.operators.traces import rolling_quantiles
    from rasterspark.streaming.traces import rolling_quantile_sink

    rng = np.random.default_rng(4)
    rows = [("hot" if rng.random() < 0.9 else "cold", i * 7_919, float(rng.integers(0, 99))) for i in range(300)]
    schema = "layer string, id long, total_ms double"
    sink = rolling_quantile_sink(str(tmp_path / "out"), str(tmp_path / "kept"), 20)
    for batch, part in enumerate((rows[:120], rows[120:125], rows[125:])):
        for _ in range(2):  # every batch runs twice
            sink(spark.createDataFrame(part, schema), batch)
    got = {(r["layer"], r["id"]): (r["p50"], r["p95"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = rolling_quantiles(spark.createDataFrame(rows, schema), ["layer"], size=20).collect()
    assert got == {(r["layer"], r["id"]): (r["p50"], r["p95"]) for r in want} and len(got) == 300


def test_interior_tiles_are_all_or_an_error(spark):
    box = spark.createDataFrame([((0.0, 0.0, 20.0, 20.0),)], "bbox struct<west:double,south:double,east:double,north:double>")
    tiles = S.tiles_for_footprints(box, 6, inset=1).count()
    assert tiles > 0 and S.interior_tiles(box, 6, tiles).count() == tiles
    for z, limit in ((6, tiles + 1), (0, 1)):
        with pytest.raises(ValueError, match="interior tiles"):
            S.interior_tiles(box, z, limit)


def test_load_collection_refuses_unknown_names(spark):
    box, asset = "bbox struct<west:double,south:double,east:double,north:double>", "map<string,struct<href:string,kind:string>>"
    granules = spark.createDataFrame(
        [("a", 1, datetime(2024, 1, 1), (0.0, 0.0, 1.0, 1.0), {"red": ("x", "raster")})], f"dataset string, id long, datetime timestamp, {box}, assets {asset}"
    )
    datasets = spark.createDataFrame([("a", ["red", "nir"]), ("bare", None)], "id string, bands array<string>")
    assert C.load_collection(granules, "a", ["red", "nir"], datasets=datasets).count() == 1
    for dataset, bands in (("b", None), ("b", ["red"]), ("a", ["blue"]), ("bare", ["red"])):
        with pytest.raises(ValueError, match="unknown"):
            C.load_collection(granules, dataset, bands, datasets=datasets)
    with pytest.raises(ValueError, match="unknown"):
        C.load_collection(granules, "a", ["red"], vocabulary=[])
