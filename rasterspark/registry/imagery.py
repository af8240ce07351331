"""Band maths, validity, palettes, zonal statistics, relief, image comparison, packing, tile functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bands as B
from ..functions.palettes import apply_palette
from ..operators import images as I
from ..operators import pixels as P
from ..operators import udf as U
from . import query

BANDS = ["red", "nir", "green"]
NDVI = ("divide", ("subtract", "nir", "red"), ("add", "nir", "red"))

NDVI_SQL = "CASE WHEN nir + red <> 0 THEN CAST(nir - red AS DOUBLE) / (nir + red) END"


def rescale_sql(value: str, low: float, high: float) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN (least(greatest({value}, {low}::DOUBLE), {high}::DOUBLE) - ({low})) / ({high} - ({low})) * 255.0 END"


def quantize_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN CAST(floor(least(greatest({value}, 0.0::DOUBLE), 255.0::DOUBLE)) AS SMALLINT) END"


# The eleven published anchors, written out here so that the table does not come from the code it checks.
LUT_SQL = """stops AS (SELECT [[165, 0, 38], [215, 48, 39], [244, 109, 67], [253, 174, 97], [254, 224, 139], [255, 255, 191], [217, 239, 139], [166, 217, 106], [102, 189, 99], [26, 152, 80], [0, 104, 55]] AS s),
spots AS (SELECT s, i, 255 * (i * (1.0::DOUBLE / 255)) AS x, list_transform(range(11), lambda k: (k * 0.1::DOUBLE) * 255) AS xs FROM stops, generate_series(0, 255) AS n(i)),
segs AS (SELECT *, least(greatest(len(list_filter(xs, lambda a: a < x)), 1), 10) AS u FROM spots),
shares AS (SELECT *, CASE i WHEN 0 THEN 0.0::DOUBLE WHEN 255 THEN 1.0::DOUBLE ELSE (x - xs[u]) / (xs[u + 1] - xs[u]) END AS t FROM segs),
mixes AS (SELECT i, list_transform([1, 2, 3], lambda c: CAST(floor((t * (s[u + 1][c] / 255.0::DOUBLE - s[u][c] / 255.0::DOUBLE) + s[u][c] / 255.0::DOUBLE) * 255) AS BIGINT)) AS m FROM shares),
lut AS (SELECT i AS idx, m[1] AS r, m[2] AS g, m[3] AS b FROM mixes)"""


def wide(spark, sf):
    return P.pivot_bands(X.pixels(spark, sf), ["row", "col"], BANDS)


def ndvi_gray(spark, sf):
    """Gray byte of the index; every declared band must be valid."""
    index = F.when(B.all_valid("red", "nir"), B.ndvi("nir", "red"))
    return wide(spark, sf).select("row", "col", B.rescale(index, -1.0, 1.0).alias("gray"))


@query(
    "render_ndvi_pixels",
    f"""WITH {X.WIDE_SQL}, {LUT_SQL}, n AS (SELECT prow, pcol, {NDVI_SQL} AS v FROM wide), g AS (SELECT prow, pcol, {rescale_sql('v', -1.0, 1.0)} AS gray FROM n),
q AS (SELECT *, {quantize_sql('gray')} AS idx FROM g)
SELECT prow AS "row", pcol AS col, CAST(coalesce(lut.r, 0) AS SMALLINT) AS r, CAST(coalesce(lut.g, 0) AS SMALLINT) AS g, CAST(coalesce(lut.b, 0) AS SMALLINT) AS b,
  CAST(CASE WHEN q.idx IS NULL THEN 0 ELSE 255 END AS SMALLINT) AS a FROM q LEFT JOIN lut ON lut.idx = q.idx""",
)
def render_ndvi_pixels(spark, sf):
    return P.colormap(ndvi_gray(spark, sf), "gray", "rdylgn").drop("gray")


@query("palette_rdylgn", f"WITH {LUT_SQL}, hits AS (SELECT prow, count(*) AS n FROM (SELECT abs(value) % 256 AS prow FROM ({'WITH ' + X.DENSE_SQL} SELECT * FROM dense)) GROUP BY prow) SELECT idx, n AS pixels, CAST(r AS SMALLINT) AS r, CAST(g AS SMALLINT) AS g, CAST(b AS SMALLINT) AS b FROM hits JOIN lut ON idx = prow")
def palette_rdylgn(spark, sf):
    """Every byte that occurs, with its colour."""
    gray = X.dense(spark, sf).groupBy((F.abs("value") % 256).cast("long").alias("idx")).agg(F.count("*").alias("pixels"))
    return gray.withColumn("c", apply_palette(F.col("idx").cast("double"), "rdylgn")).select("idx", "pixels", "c.r", "c.g", "c.b")


@query("pivot_bands", f'WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, red, nir, green FROM wide')
def pivot_bands(spark, sf):
    return wide(spark, sf)


@query(
    "align_bands",
    f"""WITH {X.SERIES_SQL}, e AS (SELECT yr, band, max(prow) AS r, max(pcol) AS c FROM series GROUP BY ALL),
s AS (SELECT yr, count(*) = 3 AND min(r) = max(r) AND min(c) = max(c) AS same_shape FROM e GROUP BY yr)
SELECT series.yr AS "year", prow AS "row", pcol AS col, max(CASE WHEN band = 'red' THEN value END) AS red, max(CASE WHEN band = 'nir' THEN value END) AS nir,
  max(CASE WHEN band = 'green' THEN value END) AS green, any_value(same_shape) AS same_shape FROM series JOIN s ON s.yr = series.yr GROUP BY ALL""",
)
def align_bands(spark, sf):
    return P.align_bands(X.series(spark, sf), ["year", "row", "col"], BANDS, ["year"])


@query("ndvi", f'WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, round({NDVI_SQL}, 9) AS ndvi FROM wide')
def ndvi(spark, sf):
    return wide(spark, sf).select("row", "col", F.round(B.ndvi("nir", "red"), 9).alias("ndvi"))


@query(
    "reduce_bands",
    f"""WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, green, round(CASE WHEN nir - red <> 0 THEN (nir * 2.0 + red) / (nir - red) END, 9) AS gray FROM wide""",
)
def reduce_bands(spark, sf):
    expr = ("divide", ("add", ("multiply", "nir", 2.0), "red"), ("subtract", "nir", "red"))
    return P.reduce_bands(wide(spark, sf), expr).withColumn("gray", F.round("gray", 9))


@query(
    "expression_text",
    f"""WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, CAST((nir - red) * 0.5 + green AS DOUBLE) AS value, '((nir - red) * 0.5) + green' AS expression FROM wide""",
)
def expression_text(spark, sf):
    text = B.expression_text(("add", ("multiply", ("subtract", "nir", "red"), 0.5), "green"))
    return wide(spark, sf).select("row", "col", F.expr(text).cast("double").alias("value"), F.lit(text).alias("expression"))


@query(
    "validity",
    f"""WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, red IS NOT NULL AND nir IS NOT NULL AND green IS NOT NULL AS valid, CASE WHEN red IS NOT NULL AND nir IS NOT NULL AND green IS NOT NULL THEN nir END AS shown FROM wide""",
)
def validity(spark, sf):
    ok = B.all_valid("red", "nir", "green")
    return wide(spark, sf).select("row", "col", ok.alias("valid"), F.when(ok, F.col("nir")).alias("shown"))


@query(
    "composite_rgba",
    f"""WITH {X.WIDE_SQL}, v AS (SELECT prow, pcol, red IS NOT NULL AND nir IS NOT NULL AND green IS NOT NULL AS ok, {quantize_sql(rescale_sql('nir', 0.0, 400.0))} AS r, {quantize_sql(rescale_sql('red', 0.0, 400.0))} AS g, {quantize_sql(rescale_sql('green', 0.0, 400.0))} AS b FROM wide)
SELECT prow AS "row", pcol AS col, CASE WHEN ok THEN r ELSE 0::SMALLINT END AS r, CASE WHEN ok THEN g ELSE 0::SMALLINT END AS g, CASE WHEN ok THEN b ELSE 0::SMALLINT END AS b, CAST(CASE WHEN ok THEN 255 ELSE 0 END AS SMALLINT) AS a FROM v""",
)
def composite_rgba(spark, sf):
    rgb = P.composite(wide(spark, sf), "nir", "red", "green")
    stretched = rgb.withColumns({c: B.rescale(F.col(c).cast("double"), 0.0, 400.0) for c in "rgb"})
    return stretched.withColumn("p", B.rgba("r", "g", "b")).select("row", "col", "p.r", "p.g", "p.b", "p.a")


@query(
    "rescale_quantize",
    f"""WITH {X.PIXELS_SQL}, s AS (SELECT prow, pcol, band, {rescale_sql('value', 40.0, 300.0)} AS gray FROM pixels)
SELECT prow AS "row", pcol AS col, band, round(gray, 6) AS gray, {quantize_sql('gray')} AS byte FROM s""",
)
def rescale_quantize(spark, sf):
    gray = B.rescale(F.col("value").cast("double"), 40.0, 300.0)
    return X.pixels(spark, sf).withColumn("g", gray).select("row", "col", "band", F.round("g", 6).alias("gray"), B.quantize("g").alias("byte"))


@query(
    "mask_nodata",
    f"""WITH {X.PIXELS_SQL} SELECT prow AS "row", pcol AS col, band, CASE WHEN value <> CASE band WHEN 'red' THEN 50 WHEN 'nir' THEN 25 ELSE -1 END THEN CAST(value AS DOUBLE) END AS value FROM pixels""",
)
def mask_nodata(spark, sf):
    rasters = X.pixels(spark, sf).select("band").distinct().select(
        F.col("band").alias("asset"), F.when(F.col("band") == "red", 50.0).when(F.col("band") == "nir", 25.0).alias("nodata")
    )
    masked = P.mask_pixels(X.pixels(spark, sf).withColumn("asset", F.col("band")), rasters)
    return masked.select("row", "col", "band", "value")


@query("coverage", f"WITH {X.PIXELS_SQL} SELECT band, count(CASE WHEN value % 7 <> 0 THEN 1 END) AS valid, count(*) AS pixels, count(CASE WHEN value % 7 = 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS nodata_share FROM pixels GROUP BY band")
def coverage(spark, sf):
    df = X.pixels(spark, sf).withColumn("value", F.when(F.col("value") % 7 != 0, F.col("value")))
    return P.coverage(df, ["band"])


ZONAL_SQL = f"""{X.SERIES_SQL}, w AS (SELECT yr, prow, pcol, max(CASE WHEN band = 'red' THEN value END) AS red, max(CASE WHEN band = 'nir' THEN value END) AS nir, max(CASE WHEN band = 'green' THEN value END) AS green FROM series GROUP BY ALL),
z AS (SELECT yr, avg({NDVI_SQL}) AS ndvi, avg(CASE WHEN nir + green <> 0 THEN CAST(nir - green AS DOUBLE) / (nir + green) END) AS nbr FROM w GROUP BY yr)"""


def zonal(spark, sf):
    series = P.pivot_bands(X.series(spark, sf), ["year", "row", "col"], BANDS)
    return P.zonal_stats(series, ["year"], "nir", "red", "green")


@query("zonal_stats", f'WITH {ZONAL_SQL} SELECT yr AS "year", round(ndvi, 9) AS ndvi, round(nbr, 9) AS nbr FROM z')
def zonal_stats(spark, sf):
    return zonal(spark, sf).select("year", F.round("ndvi", 9).alias("ndvi"), F.round("nbr", 9).alias("nbr"))


@query("change_series", f'WITH {ZONAL_SQL} SELECT yr AS "year", round(ndvi - lag(ndvi) OVER (ORDER BY yr), 9) AS change FROM z')
def change_series(spark, sf):
    return P.change_series(zonal(spark, sf), "year", "ndvi").select("year", F.round("change", 9).alias("change"))


@query(
    "burn_severity",
    f"""WITH {ZONAL_SQL}, p AS (SELECT prow, pcol, avg(CASE WHEN nir + green <> 0 AND yr < 1998 THEN CAST(nir - green AS DOUBLE) / (nir + green) END) AS pre,
  avg(CASE WHEN nir + green <> 0 AND yr >= 1998 THEN CAST(nir - green AS DOUBLE) / (nir + green) END) AS post FROM w GROUP BY ALL)
SELECT prow AS "row", pcol AS col, round(pre - post, 9) AS dnbr FROM p WHERE pre IS NOT NULL AND post IS NOT NULL""",
)
def burn_severity(spark, sf):
    from ..plans.jobs import burn_severity as job

    series = P.pivot_bands(X.series(spark, sf), ["year", "row", "col"], BANDS)
    burned = job(series, ["row", "col"], F.col("year") < 1998, "nir", "green")
    return burned.select("row", "col", F.round("dnbr", 9).alias("dnbr"))


@query(
    "block_mean_image",
    f"""WITH {X.DENSE_SQL}, i AS (SELECT prow, pcol, abs(value) % 256 AS r, abs(value * 3) % 256 AS g, abs(value * 7) % 256 AS b FROM dense), m AS (SELECT prow // 2 AS y, pcol // 2 AS x, sum(r) AS r, sum(g) AS g, sum(b) AS b, count(*) AS n FROM i GROUP BY ALL)
SELECT y AS "row", x AS col, CAST(round_even(r / CAST(n AS DOUBLE), 0) AS INTEGER) AS r, CAST(round_even(g / CAST(n AS DOUBLE), 0) AS INTEGER) AS g, CAST(round_even(b / CAST(n AS DOUBLE), 0) AS INTEGER) AS b FROM m""",
)
def block_mean_image(spark, sf):
    return P.block_mean_image(_image(spark, sf))


def _image(spark, sf, shift: int = 0):
    v = F.col("value") + shift
    return X.dense(spark, sf).select("row", "col", (F.abs(v) % 256).alias("r"), (F.abs(v * 3) % 256).alias("g"), (F.abs(v * 7) % 256).alias("b"))


@query(
    "quicklook_rgb",
    f"""WITH {X.WIDE_SQL}, n AS (SELECT prow, pcol, round({NDVI_SQL}, 3) AS v FROM wide), t AS (SELECT *, least(greatest(v + 0.1::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS t FROM n)
SELECT prow AS "row", pcol AS col, CASE WHEN v IS NULL THEN 0 ELSE CAST(round_even(CASE WHEN t < 0.5 THEN 121.0 + 101.0 * (t / 0.5) ELSE 222.0 - 205.0 * ((t - 0.5) / 0.5) END, 0) AS INTEGER) END AS r,
  CASE WHEN v IS NULL THEN 0 ELSE CAST(round_even(CASE WHEN t < 0.5 THEN 74.0 + 139.0 * (t / 0.5) ELSE 213.0 - 126.0 * ((t - 0.5) / 0.5) END, 0) AS INTEGER) END AS g,
  CASE WHEN v IS NULL THEN 0 ELSE CAST(round_even(CASE WHEN t < 0.5 THEN 44.0 + 72.0 * (t / 0.5) ELSE 116.0 - 87.0 * ((t - 0.5) / 0.5) END, 0) AS INTEGER) END AS b FROM t""",
)
def quicklook_rgb(spark, sf):
    v = F.round(B.ndvi("nir", "red"), 3)
    return wide(spark, sf).select("row", "col", B.quicklook_rgb(v).alias("p")).select("row", "col", "p.r", "p.g", "p.b")


HILL_SQL = f"""{X.DENSE_SQL}, n AS (SELECT c.prow, c.pcol, c.value, count(d.value) AS k,
  sum(d.value * (d.pcol - c.pcol) * (2 - abs(d.prow - c.prow))) / 8.0::DOUBLE AS dx, sum(d.value * (d.prow - c.prow) * (2 - abs(d.pcol - c.pcol))) / 8.0::DOUBLE AS dy
  FROM dense c JOIN dense d ON d.prow BETWEEN c.prow - 1 AND c.prow + 1 AND d.pcol BETWEEN c.pcol - 1 AND c.pcol + 1 GROUP BY ALL),
s AS (SELECT *, 0.5 * dx + 0.5 * dy + sqrt(0.5) AS dot FROM n)"""


@query(
    "hillshade",
    f"""WITH {HILL_SQL} SELECT prow AS "row", pcol AS col, CASE WHEN k = 9 THEN round(CASE WHEN dot > 0 THEN dot / sqrt(dx * dx + dy * dy + 1.0) ELSE 0.0 END, 9) END AS shade FROM s""",
)
def hillshade(spark, sf):
    return P.hillshade(X.dense(spark, sf), []).select("row", "col", F.round("shade", 9).alias("shade"))


@query(
    "udf_hillshade_tiles",
    f"""WITH {HILL_SQL} SELECT prow AS "row", pcol AS col, CASE WHEN k = 9 AND prow % 16 BETWEEN 1 AND 14 AND pcol % 16 BETWEEN 1 AND 14 THEN round(CASE WHEN dot > 0 THEN dot / sqrt(dx * dx + dy * dy + 1.0) ELSE 0.0 END, 9) END AS gray FROM s""",
)
def udf_hillshade_tiles(spark, sf):
    tiles = X.dense(spark, sf).withColumnRenamed("value", "elevation")
    out = U.run_udf(tiles, [], ["elevation"], U.TileUdf(U.hillshade_tile, 1), 16)
    return out.select("row", "col", F.round("gray", 9).alias("gray"))


@query("udf_ndvi", f'WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, round({NDVI_SQL}, 9) AS gray FROM wide')
def udf_ndvi(spark, sf):
    out = U.run_udf(wide(spark, sf), [], ["nir", "red"], U.TileUdf(U.ndvi_tile, 1), 64)
    return out.select("row", "col", F.round("gray", 9).alias("gray"))


@query(
    "udf_qa_clear",
    f"""WITH {X.WIDE_SQL} SELECT prow AS "row", pcol AS col, CASE WHEN red BETWEEN 0 AND 255 THEN CASE WHEN (red & 14) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS gray FROM wide""",
)
def udf_qa_clear(spark, sf):
    tiles = wide(spark, sf).select("row", "col", F.col("red").alias("qa"))
    return U.run_udf(tiles, [], ["qa"], U.TileUdf(U.qa_clear_tile, 1), 64)


# --- comparison and packing ---

IMAGES_SQL = f"""{X.DENSE_SQL}, pair AS (SELECT prow, pcol, prow // 50 AS image, abs(value) % 256 AS r, abs(value * 3) % 256 AS g, abs(value * 7) % 256 AS b, 255 AS a,
  abs(value + prow % 3) % 256 AS r2, abs(value * 3 + prow % 2) % 256 AS g2, abs(value * 7) % 256 AS b2, CASE WHEN value % 400 = 0 THEN 0 ELSE 255 END AS a2 FROM dense),
diff AS (SELECT image, prow, pcol, greatest(abs(r - r2), abs(g - g2), abs(b - b2), abs(a - a2)) AS max_diff, abs(r - r2) + abs(g - g2) + abs(b - b2) + abs(a - a2) AS sum_diff FROM pair)"""


def _pair(spark, sf):
    v, row = F.col("value"), F.col("row")
    image = F.floor(row / 50).alias("image")
    d = X.dense(spark, sf)
    byte = lambda c, name: (F.abs(c) % 256).cast("int").alias(name)
    left = d.select(image, "row", "col", byte(v, "r"), byte(v * 3, "g"), byte(v * 7, "b"), F.lit(255).alias("a"))
    right = d.select(
        image, "row", "col", byte(v + row % 3, "r"), byte(v * 3 + row % 2, "g"), byte(v * 7, "b"),
        F.when(v % 400 == 0, 0).otherwise(255).alias("a"),
    )
    return left, right


@query("image_diff", f'WITH {IMAGES_SQL} SELECT image, prow AS "row", pcol AS col, max_diff, sum_diff FROM diff')
def image_diff(spark, sf):
    return I.image_diff(*_pair(spark, sf), ["image"])


@query(
    "diff_report",
    f"""WITH {IMAGES_SQL} SELECT image, count(*) AS pixels, max(max_diff) AS max_abs_diff, round(sum(sum_diff) / CAST(count(*) * 4 AS DOUBLE), 9) AS mean_abs_diff,
  round(count(CASE WHEN max_diff > 2 THEN 1 END) / CAST(count(*) AS DOUBLE), 9) AS bad_share, true AS same_size, count(CASE WHEN max_diff > 2 THEN 1 END) / CAST(count(*) AS DOUBLE) <= 0.005 AS passes FROM diff GROUP BY image""",
)
def diff_report(spark, sf):
    report = I.diff_report(I.image_diff(*_pair(spark, sf), ["image"]), ["image"])
    return report.withColumns({"mean_abs_diff": F.round("mean_abs_diff", 9), "bad_share": F.round("bad_share", 9)})


@query("diff_histogram", f"WITH {IMAGES_SQL} SELECT image, max_diff, count(*) AS pixels FROM diff GROUP BY ALL")
def diff_histogram(spark, sf):
    return I.diff_histogram(I.image_diff(*_pair(spark, sf), ["image"]), ["image"])


@query(
    "pack_tiles",
    f"""WITH {X.DENSE_SQL}, p AS (SELECT prow // 16 AS ty, pcol // 16 AS tx, prow % 16 * 16 + pcol % 16 AS pos, abs(value) % 256 AS v FROM dense)
SELECT ty, tx, md5(string_agg(printf('%02x%02x%02xff', v, v * 3 % 256, v * 7 % 256), '' ORDER BY pos)) AS digest, count(*) = 256 AS complete FROM p GROUP BY ALL""",
)
def pack_tiles(spark, sf):
    v = F.abs("value") % 256
    px = X.dense(spark, sf).select(
        F.floor(F.col("row") / 16).alias("ty"), F.floor(F.col("col") / 16).alias("tx"), (F.col("row") % 16).alias("row"),
        (F.col("col") % 16).alias("col"), v.alias("r"), (v * 3 % 256).alias("g"), (v * 7 % 256).alias("b"), F.lit(255).alias("a"),
    )
    tiles = I.pack_tiles(px, ["ty", "tx"], 16)
    return tiles.select("ty", "tx", F.md5(F.lower(F.hex("rgba")).cast("binary")).alias("digest"), "complete")
