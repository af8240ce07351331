"""Resampling: raster bounds, source extents, kernel shapes, nearest and bilinear warps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import crs as C
from ..functions import grid as G
from ..functions import tiles as T
from ..operators import block_warp as BW
from ..operators import spatial as S
from ..operators import warp as W
from . import SQL, query
from .scalars import _sum_sql, lat_y, lon_x

# Rasters: every hundred embedding rows are one 64-wide asset. Multiples of 17 are nodata.
ASSETS_SQL = f"""{X.DENSE_SQL}, px AS (SELECT prow // 100 AS asset, prow % 100 AS prow, pcol, CASE WHEN value % 17 <> 0 THEN CAST(value AS DOUBLE) END AS value FROM dense),
assets AS (SELECT asset, 64 AS w, max(prow) + 1 AS h FROM px GROUP BY asset)"""


def asset_pixels(spark, sf):
    v = F.col("value")
    return X.dense(spark, sf).select(
        F.floor(F.col("row") / 100).alias("asset"), (F.col("row") % 100).alias("row"), "col",
        F.when(v % 17 != 0, v.cast("double")).alias("value"),
    )


def asset_rasters(spark, sf, crs: str, origin_x: float, origin_y: float, step: float, size: float):
    """Dimension rows; asset k starts ``k * step`` to the east."""
    dims = asset_pixels(spark, sf).groupBy("asset").agg((F.max("row") + 1).alias("height"))
    t = G.north_up(F.lit(origin_x) + F.col("asset") * step, origin_y, size, -size)
    return dims.select("asset", F.lit(crs).alias("crs"), F.lit(64).cast("long").alias("width"), "height", t.alias("transform"))


# Three target grids per asset in the raster's own CRS: shifted by half a pixel, halved, enlarged with overhang.
KINDS = ((0, 60, 90, 50.0, -50.0, 6000.0, 9000.0), (1, 32, 50, 0.0, 0.0, 6400.0, 10000.0), (2, 96, 160, -1000.0, 1200.0, 9600.0, 12000.0))


def plain_targets(spark, sf):
    rasters = asset_rasters(spark, sf, "EPSG:3857", 0.0, 0.0, 100000.0, 100.0)
    grids = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "width", "height", "x0", "y0", "dx", "dy"), k)]) for k in KINDS])
    t = rasters.withColumn("g", F.explode(grids))
    left = F.col("asset") * 100000.0 + F.col("g.x0")
    return t.select(
        "asset", "g.kind", F.col("crs").alias("src_crs"), "crs", "transform", F.col("width").alias("raster_w"), F.col("height").alias("raster_h"),
        F.col("g.width").alias("width"), F.col("g.height").alias("height"), left.alias("min_x"), (left + F.col("g.dx")).alias("max_x"),
        F.col("g.y0").alias("max_y"), (F.col("g.y0") - F.col("g.dy")).alias("min_y"),
    )


_grid_rows = ", ".join(f"({k}, {w}, {h}, {x0}::DOUBLE, {y0}::DOUBLE, {dx}::DOUBLE, {dy}::DOUBLE)" for k, w, h, x0, y0, dx, dy in KINDS)
EXTENT_SQL = f"""{ASSETS_SQL}, kinds(kind, dw, dh, x0, y0, sx, sy) AS (VALUES {_grid_rows}),
ext AS (SELECT asset, w, h, kind, dw, dh, x0, y0, sx, sy, x0 / 100 AS c0, (x0 + sx) / 100 AS c1, -y0 / 100 AS r0, (sy - y0) / 100 AS r1 FROM assets, kinds)"""


def _axis_sql(axis, lo, hi, raster, dst, source, reach):
    """Window, scale and radius along one axis from the fractional span."""
    return f"""{axis}1 AS (SELECT *, floor(greatest({lo}, 0)) AS lo_{axis}, least(ceil({hi}), {raster}) AS hi_{axis},
    CASE WHEN greatest({dst} / ({hi} - {lo}), 0.001) < 0.95 THEN ceil({reach} / greatest({dst} / ({hi} - {lo}), 0.001)) ELSE {reach} END AS pad_{axis} FROM {source}),
{axis}2 AS (SELECT *, CASE WHEN hi_{axis} - lo_{axis} > 0.9 * {raster} THEN 0 ELSE greatest(lo_{axis} - pad_{axis}, 0) END AS off_{axis} FROM {axis}1),
{axis}3 AS (SELECT *, CASE WHEN hi_{axis} - lo_{axis} > 0.9 * {raster} THEN CAST({raster} AS DOUBLE) ELSE greatest(least({raster} - off_{axis}, hi_{axis} - off_{axis} + pad_{axis}), 0) END AS size_{axis} FROM {axis}2),
{axis}4 AS (SELECT *, CASE WHEN size_{axis} <= 0 OR size_{axis} = {dst} THEN 1.0::DOUBLE WHEN {dst} / size_{axis} < 1 AND abs(size_{axis} / {dst} - floor(size_{axis} / {dst} + 0.5)) < 0.05 THEN 1.0::DOUBLE / floor(size_{axis} / {dst} + 0.5) ELSE {dst} / size_{axis} END AS s_{axis} FROM {axis}3)"""


def shape_sql(reach: int, source: str = "ext") -> str:
    return f"""{_axis_sql('x', 'c0', 'c1', 'w', 'CAST(dw AS DOUBLE)', source, reach)}, {_axis_sql('y', 'r0', 'r1', 'h', 'CAST(dh AS DOUBLE)', 'x4', reach)},
shape AS (SELECT *, CASE WHEN s_x >= 0.95 AND s_y >= 0.95 THEN 1.0::DOUBLE ELSE s_x END AS scale_x, CASE WHEN s_x >= 0.95 AND s_y >= 0.95 THEN 1.0::DOUBLE ELSE s_y END AS scale_y FROM y4),
kernel AS (SELECT *, CAST(CASE WHEN scale_x < 1 THEN ceil({reach} / scale_x) ELSE {reach} END AS INTEGER) AS radius_x, CAST(CASE WHEN scale_y < 1 THEN ceil({reach} / scale_y) ELSE {reach} END AS INTEGER) AS radius_y FROM shape)"""


TARGETS_SQL = """cells AS (SELECT *, unnest(generate_series(0, dw - 1)) AS tc FROM (SELECT *, unnest(generate_series(0, dh - 1)) AS tr FROM kernel)),
posn AS (SELECT *, (x0 + sx / dw * (tc + 0.5)) / 100 AS fcol, -(y0 - sy / dh * (tr + 0.5)) / 100 AS frow FROM cells),
placed AS (SELECT * FROM posn WHERE fcol >= off_x AND frow >= off_y AND fcol + 1e-10 <= off_x + size_x AND frow + 1e-10 <= off_y + size_y)"""

KEYS = ["asset", "kind"]


def _shaped(targets, reach, keys):
    extent = W.source_extent(targets, keys, "EPSG:3857")
    return W.kernel_shape(targets.join(extent, keys), reach)


@query("source_extent", f"WITH {EXTENT_SQL} SELECT asset, kind, c0 AS min_col, c1 AS max_col, r0 AS min_row, r1 AS max_row FROM ext")
def source_extent(spark, sf):
    return W.source_extent(plain_targets(spark, sf), KEYS)


@query(
    "kernel_shape",
    f"""WITH {EXTENT_SQL}, {shape_sql(1)} SELECT asset, kind, CAST(off_x AS DOUBLE) AS off_x, CAST(off_y AS DOUBLE) AS off_y, CAST(size_x AS DOUBLE) AS size_x, CAST(size_y AS DOUBLE) AS size_y,
  round(scale_x, 9) AS scale_x, round(scale_y, 9) AS scale_y, radius_x, radius_y FROM kernel""",
)
def kernel_shape(spark, sf):
    k = _shaped(plain_targets(spark, sf), 1, KEYS)
    return k.select("asset", "kind", "off_x", "off_y", "size_x", "size_y", F.round("scale_x", 9).alias("scale_x"), F.round("scale_y", 9).alias("scale_y"), "radius_x", "radius_y")


@query(
    "read_window",
    f"""WITH {EXTENT_SQL}, b AS (SELECT *, greatest(0, least(w, floor(c0 - 4))) AS a0, greatest(0, least(w, ceil(c1 + 4))) AS a1, greatest(0, least(h, floor(r0 - 4))) AS b0, greatest(0, least(h, ceil(r1 + 4))) AS b1 FROM ext)
SELECT asset, kind, CAST(a0 AS BIGINT) AS col_off, CAST(b0 AS BIGINT) AS row_off, CAST(a1 - a0 AS BIGINT) AS width, CAST(b1 - b0 AS BIGINT) AS height FROM b WHERE a1 > a0 AND b1 > b0""",
)
def read_window(spark, sf):
    t = plain_targets(spark, sf)
    e = t.join(W.source_extent(t, KEYS, "EPSG:3857"), KEYS).withColumn("win", W.read_window(4)).where("win IS NOT NULL")
    return e.select("asset", "kind", "win.col_off", "win.row_off", "win.width", "win.height")


@query(
    "warp_nearest",
    f"""WITH {EXTENT_SQL}, {shape_sql(0)}, {TARGETS_SQL}
SELECT p.asset, kind, tr AS "row", tc AS col, value FROM placed p JOIN px ON px.asset = p.asset AND px.prow = floor(frow + 1e-10) AND px.pcol = floor(fcol + 1e-10) WHERE value IS NOT NULL""",
)
def warp_nearest(spark, sf):
    targets = W.target_pixels(_shaped(plain_targets(spark, sf), 0, KEYS), KEYS, "EPSG:3857")
    return W.warp_nearest(targets, asset_pixels(spark, sf), KEYS, ["asset"])


BILINEAR_SQL = f"""{EXTENT_SQL}, {shape_sql(1)}, {TARGETS_SQL},
up AS (SELECT *, floor(fcol - 0.5) AS i0, floor(frow - 0.5) AS j0 FROM placed),
sup AS (SELECT *, unnest(generate_series(-radius_x, radius_x)) AS i FROM (SELECT *, unnest(generate_series(-radius_y, radius_y)) AS j FROM up)),
wts AS (SELECT asset, kind, tr, tc, w, h, CAST(i0 + i AS BIGINT) AS sc, CAST(j0 + j AS BIGINT) AS sr, greatest(0.0::DOUBLE, 1 - abs((i - (fcol - 0.5 - i0)) * least(scale_x, 1.0))) * greatest(0.0::DOUBLE, 1 - abs((j - (frow - 0.5 - j0)) * least(scale_y, 1.0))) AS wt,
  i0 + i = floor(fcol + 1e-10) AND j0 + j = floor(frow + 1e-10) AS gate FROM sup),
got AS (SELECT t.*, px.value AS v FROM wts t LEFT JOIN px ON px.asset = t.asset AND px.prow = t.sr AND px.pcol = t.sc),
acc AS (SELECT asset, kind, tr, tc, sum(wt * v) FILTER (WHERE wt > 0) AS a, sum(CASE WHEN v IS NOT NULL THEN wt END) AS sw, bool_or(gate AND v IS NULL AND sc >= 0 AND sr >= 0 AND sc < w AND sr < h) AS blocked, bool_or(v IS NULL AND wt > 0) AS missing FROM got GROUP BY ALL)"""


@query(
    "warp_bilinear",
    f"""WITH {BILINEAR_SQL} SELECT asset, kind, tr AS "row", tc AS col, round(CASE WHEN abs(sw - 1) <= 1e-5 THEN a ELSE a / sw END, 5) AS value FROM acc WHERE NOT blocked AND sw >= 1e-6""",
)
def warp_bilinear(spark, sf):
    targets = W.target_pixels(_shaped(plain_targets(spark, sf), 1, KEYS), KEYS, "EPSG:3857")
    out = W.warp_bilinear(targets, asset_pixels(spark, sf), KEYS, ["asset"])
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query(
    "warp_bilinear_propagate",
    f"""WITH {BILINEAR_SQL} SELECT asset, kind, tr AS "row", tc AS col, round(CASE WHEN abs(sw - 1) <= 1e-5 THEN a ELSE a / sw END, 5) AS value FROM acc WHERE NOT blocked AND NOT missing AND sw >= 1e-6""",
)
def warp_bilinear_propagate(spark, sf):
    targets = W.target_pixels(_shaped(plain_targets(spark, sf), 1, KEYS), KEYS, "EPSG:3857")
    out = W.warp_bilinear(targets, asset_pixels(spark, sf), KEYS, ["asset"], propagate=True)
    return out.withColumn("value", F.round("value", 5) + 0.0)


# --- the same from stored blocks, which are looked up in place ---


def asset_blocks(spark, sf):
    from ..operators.chunks import pack_chunks

    return pack_chunks(asset_pixels(spark, sf), ["asset"], 16)


def _block_targets(spark, sf, reach):
    return BW.with_block_shape(_shaped(plain_targets(spark, sf), reach, KEYS), (16, 16))


@query("warp_nearest_chunks", SQL["warp_nearest"])
def warp_nearest_chunks(spark, sf):
    return BW.warp_blocks(_block_targets(spark, sf, 0), asset_blocks(spark, sf), KEYS, ["asset"], "nearest", "EPSG:3857")


@query("warp_bilinear_chunks", SQL["warp_bilinear"])
def warp_bilinear_chunks(spark, sf):
    out = BW.warp_blocks(_block_targets(spark, sf, 1), asset_blocks(spark, sf), KEYS, ["asset"], "bilinear", "EPSG:3857")
    return out.withColumn("value", F.round("value", 5) + 0.0)


@query("warp_bilinear_propagate_chunks", SQL["warp_bilinear_propagate"])
def warp_bilinear_propagate_chunks(spark, sf):
    out = BW.warp_blocks(_block_targets(spark, sf, 1), asset_blocks(spark, sf), KEYS, ["asset"], "bilinear", "EPSG:3857", True)
    return out.withColumn("value", F.round("value", 5) + 0.0)


# --- across projections: rasters in UTM zone 13 north, tiles in web mercator ---

_SCALE = repr(C.UTM_K0 * C.RECTIFYING_RADIUS)


def inverse_utm_sql(source: str, columns: str) -> str:
    """CTEs from ``source(columns, ux, uy)`` to ``geo(columns, lon, lat)`` in zone 13 north."""
    delta = " ".join(f"+ {d!r} * sin({2 * j} * chi)" for j, d in enumerate(C.DELTA, start=1))
    return f"""iu0 AS (SELECT {columns}, uy / {_SCALE} AS xi, (ux - 500000.0) / {_SCALE} AS eta FROM {source}),
iu1 AS (SELECT {columns}, xi {_sum_sql(C.BETA, 'sin', 'cosh', 'xi', 'eta', '-')} AS xi, eta {_sum_sql(C.BETA, 'cos', 'sinh', 'xi', 'eta', '-')} AS eta FROM iu0),
iu2 AS (SELECT {columns}, asin(sin(xi) / cosh(eta)) AS chi, atan2(sinh(eta), cos(xi)) AS lam FROM iu1),
geo AS (SELECT {columns}, degrees(lam) - 105 AS lon, degrees(chi {delta}) AS lat FROM iu2)"""


def forward_utm_sql(source: str, columns: str) -> str:
    """CTEs from ``source(columns, lon, lat)`` to ``utm(columns, ux, uy)`` in zone 13 north."""
    e = repr(C.ECCENTRICITY)
    return f"""fu0 AS (SELECT {columns}, tan(radians(lat)) AS tau, sinh({e} * atanh({e} * sin(radians(lat)))) AS sg, radians(lon + 105) AS lam FROM {source}),
fu1 AS (SELECT {columns}, lam, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS tc FROM fu0),
fu2 AS (SELECT {columns}, atan2(tc, cos(lam)) AS xi0, asinh(sin(lam) / sqrt(tc * tc + cos(lam) * cos(lam))) AS eta0 FROM fu1),
utm AS (SELECT {columns}, 500000.0 + {_SCALE} * (eta0 {_sum_sql(C.ALPHA, 'cos', 'sinh', 'xi0', 'eta0')}) AS ux, {_SCALE} * (xi0 {_sum_sql(C.ALPHA, 'sin', 'cosh', 'xi0', 'eta0')}) AS uy FROM fu2)"""


def utm_rasters(spark, sf):
    return asset_rasters(spark, sf, "EPSG:32613", 453720.0, 4353960.0, 2500.0, 30.0)


CORNERS_SQL = f"""{ASSETS_SQL}, corners AS (SELECT asset, 453720.0 + asset * 2500.0 + 30.0 * w * cx AS ux, 4353960.0 - 30.0 * h * cy AS uy FROM assets, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS c(cx, cy)),
{inverse_utm_sql('corners', 'asset')}, bounds AS (SELECT asset, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM geo GROUP BY asset)"""


@query("raster_bounds", f"WITH {CORNERS_SQL} SELECT asset, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north FROM bounds")
def raster_bounds(spark, sf):
    return W.raster_bounds(utm_rasters(spark, sf)).select("asset", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


ZOOM, SIZE = 13, 64
_E = "20037508.342789244"


def mercator_targets(rasters, z: int, size: int):
    """The tiles every raster's footprint touches, as warp targets."""
    bounds = W.raster_bounds(rasters)
    boxes = bounds.select("asset", F.struct("west", "south", "east", "north").alias("bbox"))
    tiles = S.tiles_for_footprints(boxes, z).drop("bbox")
    placed = tiles.join(rasters, "asset").withColumn("_b", T.tile_bounds_xy("z", "x", "y"))
    return placed.select(
        "asset", "z", "x", "y", F.col("crs").alias("src_crs"), F.lit("EPSG:3857").alias("crs"), "transform",
        F.col("width").alias("raster_w"), F.col("height").alias("raster_h"), F.lit(size).alias("width"), F.lit(size).alias("height"),
        "_b.min_x", "_b.min_y", "_b.max_x", "_b.max_y",
    )


UTM_WARP_SQL = f"""{CORNERS_SQL}, rng AS (SELECT asset, {lon_x('west', ZOOM)} AS x0, {lon_x('east', ZOOM)} AS x1, {lat_y('north', ZOOM)} AS y0, {lat_y('south', ZOOM)} AS y1 FROM bounds),
tls AS (SELECT asset, x, unnest(generate_series(y0, y1)) AS y FROM (SELECT *, unnest(generate_series(x0, x1)) AS x FROM rng)),
tb AS (SELECT asset, x, y, 2 * {_E} / {2**ZOOM} * x - {_E} AS mx, {_E} - 2 * {_E} / {2**ZOOM} * y AS my, 2 * {_E} / {2**ZOOM} AS span FROM tls),
tp AS (SELECT asset, x, y, i, j, mx + span / {SIZE} * (i + 0.5) AS px, my - span / {SIZE} * (j + 0.5) AS py FROM tb, generate_series(0, {SIZE - 1}) AS a(i), generate_series(0, {SIZE - 1}) AS b(j)),
ll AS (SELECT asset, x, y, i, j, degrees(px / 6378137.0) AS lon, degrees(atan(sinh(py / 6378137.0))) AS lat FROM tp),
{forward_utm_sql('ll', 'asset, x, y, i, j')},
pos AS (SELECT asset, x, y, i, j, (ux - 453720.0 - asset * 2500.0) / 30.0 AS fcol, (4353960.0 - uy) / 30.0 AS frow FROM utm)"""


@query(
    "warp_utm_nearest",
    f"""WITH {UTM_WARP_SQL} SELECT p.asset, x, y, j AS "row", i AS col, value FROM pos p JOIN px ON px.asset = p.asset AND px.prow = floor(frow + 1e-10) AND px.pcol = floor(fcol + 1e-10)
  JOIN assets a ON a.asset = p.asset WHERE value IS NOT NULL AND fcol >= 0 AND frow >= 0 AND fcol + 1e-10 <= a.w AND frow + 1e-10 <= a.h""",
)
def warp_utm_nearest(spark, sf):
    keys = ["asset", "z", "x", "y"]
    targets = W.target_pixels(_shaped(mercator_targets(utm_rasters(spark, sf), ZOOM, SIZE), 0, keys), keys, "EPSG:3857")
    return W.warp_nearest(targets, asset_pixels(spark, sf), keys, ["asset"]).drop("z")
