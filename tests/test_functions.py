"""Known answers and properties of the column functions."""

import pytest
from pyspark.sql import functions as F

from rasterspark.functions import bands as B
from rasterspark.functions import crs as C
from rasterspark.functions import palettes as P
from rasterspark.functions import temporal as TM
from rasterspark.functions import text as TX
from rasterspark.functions import tiles as T
from rasterspark.operators.warp import project_points


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_unix_millis_known_answers(spark):
    texts = {"2024-06-06T17:54:00Z": 1717696440000, "1969-12-31T23:59:59Z": -1000, "1970-01-01T00:00:00.123456Z": 123}
    got = one(spark, *[TM.to_unix_millis(F.lit(t)) for t in texts])
    assert list(got) == list(texts.values())


def test_malformed_instants(spark):
    bad = ["2023-02-29T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.Z"]
    assert list(one(spark, *[TM.is_rfc3339_utc(F.lit(t)) for t in bad])) == [False] * len(bad)


def test_extent_literals():
    assert TM.parse_extent(("1970", "1970-01-02")) == (0, 86399999)
    for extent in ((None, None), ("2000", "2000"), ("2001", "2000")):
        with pytest.raises(ValueError):
            TM.parse_extent(extent)
    with pytest.raises(ValueError):
        TM.parse_datetime("../..")
    assert TM.parse_datetime("1970-01-01T00:00:01Z") == (1000, 1000, True)
    assert TM.intersect_bounds((None, 5), (2, None)) == (2, 5)
    with pytest.raises(ValueError):
        TM.intersect_bounds((6, None), (None, 5))


def test_utm_truth_points(spark):
    df = spark.createDataFrame([(453720.0, 4338600.0), (469080.0, 4353960.0), (461400.0, 4346280.0)], "x double, y double")
    got = project_points(df, "x", "y", "EPSG:32613", "EPSG:3857", "p").orderBy("x").collect()
    truth = [(-11748206.85316751, 4749702.973915536), (-11738355.644225528, 4759701.971516114), (-11728484.94621834, 4769701.228007356)]
    for row, (x, y) in zip(got, truth):
        assert abs(row["p_x"] - x) < 1e-6 and abs(row["p_y"] - y) < 1e-6
    back = project_points(df, "x", "y", "EPSG:32613", "EPSG:4326", "g")
    back = project_points(back, "g_x", "g_y", "EPSG:4326", "EPSG:32613", "q").collect()
    assert all(abs(r["q_x"] - r["x"]) < 1e-6 and abs(r["q_y"] - r["y"]) < 1e-6 for r in back)


def test_domains_and_identity(spark):
    df = spark.createDataFrame([(10.0, 86.0, "EPSG:3857"), (10.0, 95.0, "EPSG:4326"), (1.0, 2.0, "EPSG:9999"), (5.0, 6.0, "EPSG:4326")], "x double, y double, crs string")
    got = project_points(df, "x", "y", "EPSG:4326", F.col("crs"), "p").collect()
    assert [r["p_x"] for r in got[:3]] == [None, 10.0, None]  # equal CRSs are the identity, domain or not
    assert (got[3]["p_x"], got[3]["p_y"]) == (5.0, 6.0)
    with pytest.raises(ValueError):
        project_points(df, "x", "y", "EPSG:4326", "EPSG:9999", "p")


def test_root_tile_bounds(spark):
    b = one(spark, T.tile_bounds_xy(F.lit(0), F.lit(0), F.lit(0)), T.tile_bounds_lonlat(F.lit(0), F.lit(0), F.lit(0)))
    assert abs(b[0]["max_y"] - T.EXTENT) < 1e-6 and abs(b[0]["min_y"] + T.EXTENT) < 1e-6
    assert abs(b[1]["north"] - 85.0511287798066) < 1e-9


def test_children_partition_parent(spark):
    tiles = spark.range(64).select(F.lit(5).alias("z"), (F.col("id") % 32).alias("x"), (F.col("id") % 7).alias("y"))
    kids = tiles.select("x", "y", F.explode(T.tile_children("z", "x", "y")).alias("c"))
    up = kids.withColumn("p", T.tile_parent("c.z", "c.x", "c.y"))
    assert up.where("p.x <> x OR p.y <> y").count() == 0 and kids.count() == 256


def test_division_and_validity(spark):
    got = one(spark, B.band_divide(F.lit(1.0), F.lit(0.0)), B.finite_or_null(F.lit(float("inf"))), B.quantize(F.lit(254.99)), B.quantize(F.lit(-3.0)))
    assert list(got) == [None, None, 254, 0]
    with pytest.raises(ValueError):
        B.rescale(F.lit(1.0), 5, 5)


def test_expression_text_and_bands(spark):
    ndvi = ("divide", ("subtract", "b8a", "b04"), ("add", "b8a", "b04"))
    assert B.expression_text(ndvi) == "(b8a - b04) / (b8a + b04)"
    assert B.referenced_bands(ndvi) == ["b8a", "b04"]
    for op in (("multiply", "a", 2.0), ("multiply", "a", 0.5)):
        df = spark.createDataFrame([(3.0,)], "a double")
        assert df.select(F.expr(B.expression_text(op))).first()[0] == 3.0 * op[2]


def test_palette_stops():
    table = P.palette("rdylgn")
    stops = {0: (165, 0, 38), 64: (248, 142, 82), 128: (254, 254, 189), 192: (132, 202, 102), 255: (0, 104, 55)}
    assert {i: table[i] for i in stops} == stops
    table = P.palette("rdylgn")
    assert [table[i] for i in (0, 25, 51, 101, 128, 204, 255)] == [(165, 0, 38), (214, 47, 38), (244, 109, 67), (253, 222, 137), (254, 254, 189), (102, 189, 99), (0, 104, 55)]
    given = [(i, 255 - i, 7) for i in range(256)]
    assert P.palette("viridis", {"viridis": given}) == given
    with pytest.raises(ValueError):
        P.palette("viridis")


def test_cfgrib_names(spark):
    names = one(
        spark,
        TX.cfgrib_name(F.lit("TMP"), F.lit(True), F.lit(2.0)),
        TX.cfgrib_name(F.lit("UGRD"), F.lit(True), F.lit(10.0)),
        TX.cfgrib_name(F.lit("FOO"), F.lit(True), F.lit(10.0)),
    )
    assert list(names) == ["t2m", "u10", "foo"]


def test_sinu_parser(spark):
    good = "+proj=sinu +lon_0=0 +x_0=0 +y_0=0 +R=6371007.181 +units=m +no_defs"
    bad = ["+proj=sinu +a=6378137 +b=6356752", "+proj=sinu +R=1 +units=km", "+proj=sinu +R=1 +zone=3", "proj=sinu +R=1", "+proj=laea +R=1"]
    df = spark.createDataFrame([(good,), *[(b,) for b in bad]], "d string")
    got = [r["s"] for r in C.with_sinu(df, F.col("d"), "s").collect()]
    assert got[0]["radius"] == 6371007.181 and got[1:] == [None] * len(bad)
