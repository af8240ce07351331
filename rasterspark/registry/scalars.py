"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bands as B
from ..functions import crs as C
from ..functions import grid as G
from ..functions import keys as K
from ..functions import temporal as TM
from ..functions import text as TX
from ..functions import tiles as T
from . import query

E = "20037508.342789244"


def _r(column, digits=6):
    return F.round(column, digits)


# --- tiles ---

LON_X = "least(greatest(CAST(floor((greatest(least({lon}, 180.0), -180.0) + 180.0) / 360.0 * power(2, {z})) AS BIGINT), 0), CAST(power(2, {z}) AS BIGINT) - 1)"
LAT_Y = (
    "least(greatest(CAST(floor(least(greatest((1.0 - asinh(tan(radians(greatest(least({lat}, 85.0511287798066), "
    "-85.0511287798066)))) / pi()) / 2.0, 0.0), 1.0) * power(2, {z})) AS BIGINT), 0), CAST(power(2, {z}) AS BIGINT) - 1)"
)


def lon_x(lon: str, z) -> str:
    return LON_X.format(lon=lon, z=z)


def lat_y(lat: str, z) -> str:
    return LAT_Y.format(lat=lat, z=z)


@query(
    "tile_for_lonlat",
    f"""WITH {X.GRANULES_SQL}
SELECT id, {lon_x('west', 9)} AS x, {lat_y('north', 9)} AS y FROM granules""",
)
def tile_for_lonlat(spark, sf):
    g = X.granules(spark, sf)
    return g.select("id", T.tile_x_for_lon("bbox.west", 9).alias("x"), T.tile_y_for_lat("bbox.north", 9).alias("y"))


@query(
    "tile_for_xy",
    f"""WITH {X.GRANULES_SQL}, m AS (SELECT id, west * 120000.0 AS mx, south * 260000.0 AS my FROM granules)
SELECT id,
  least(greatest(CAST(floor((mx + {E}) / (2 * {E} / power(2, 11))) AS BIGINT), 0), 2047) AS x,
  least(greatest(CAST(floor(({E} - my) / (2 * {E} / power(2, 11))) AS BIGINT), 0), 2047) AS y
FROM m""",
)
def tile_for_xy(spark, sf):
    g = X.granules(spark, sf)
    x, y = F.col("bbox.west") * 120000.0, F.col("bbox.south") * 260000.0
    return g.select("id", T.tile_x_for_x(x, 11).alias("x"), T.tile_y_for_y(y, 11).alias("y"))


TILES_SQL = "tiles AS (SELECT event_id AS id, CAST(event_id % 12 AS INTEGER) AS z, user_id % CAST(power(2, event_id % 12) AS BIGINT) AS x, (user_id * 7) % CAST(power(2, event_id % 12) AS BIGINT) AS y FROM events)"


def _tiles(spark, sf):
    width = F.pow(F.lit(2.0), F.col("event_id") % 12).cast("long")
    return X.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 12).cast("int").alias("z"),
        (F.col("user_id") % width).alias("x"),
        ((F.col("user_id") * 7) % width).alias("y"),
    )


@query(
    "tile_bounds_xy",
    f"""WITH {TILES_SQL}, b AS (SELECT *, 2 * {E} / power(2, z) AS span FROM tiles)
SELECT id, round(span * x - {E}, 4) AS min_x, round({E} - span * y - span, 4) AS min_y,
  round(span * x - {E} + span, 4) AS max_x, round({E} - span * y, 4) AS max_y FROM b""",
)
def tile_bounds_xy(spark, sf):
    df = _tiles(spark, sf).withColumn("b", T.tile_bounds_xy("z", "x", "y"))
    return df.select("id", *[_r(F.col(f"b.{c}"), 4).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(
    "tile_bounds_lonlat",
    f"""WITH {TILES_SQL}, b AS (SELECT *, 2 * {E} / power(2, z) AS span FROM tiles)
SELECT id, round((span * x - {E}) / {E} * 180, 9) AS west, round((span * (x + 1) - {E}) / {E} * 180, 9) AS east,
  round(degrees(atan(sinh(({E} - span * (y + 1)) / 6378137.0))), 7) AS south,
  round(degrees(atan(sinh(({E} - span * y) / 6378137.0))), 7) AS north FROM b""",
)
def tile_bounds_lonlat(spark, sf):
    df = _tiles(spark, sf).withColumn("b", T.tile_bounds_lonlat("z", "x", "y"))
    return df.select("id", *[(_r(F.col(f"b.{c}"), 9 if c in ("west", "east") else 7) + 0.0).alias(c) for c in ("west", "east", "south", "north")])


@query(
    "tile_parent",
    f"""WITH {TILES_SQL}
SELECT id, CASE WHEN z > 0 THEN z - 1 END AS pz, CASE WHEN z > 0 THEN x // 2 END AS px, CASE WHEN z > 0 THEN y // 2 END AS py FROM tiles""",
)
def tile_parent(spark, sf):
    df = _tiles(spark, sf).withColumn("p", T.tile_parent("z", "x", "y"))
    return df.select("id", F.col("p.z").alias("pz"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(
    "tile_children",
    f"""WITH {TILES_SQL}
SELECT id, CAST(z + 1 AS INTEGER) AS cz, x * 2 + dx AS cx, y * 2 + dy AS cy
FROM tiles, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS q(dx, dy)""",
)
def tile_children(spark, sf):
    df = _tiles(spark, sf).select("id", F.explode(T.tile_children("z", "x", "y")).alias("c"))
    return df.select("id", F.col("c.z").alias("cz"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query(
    "tile_key_parse",
    f"""WITH {X.TRACES_SQL}, t AS (SELECT id, (id % 14) || '/' || (bytes_read % 97) || '/' || (id % 61) AS text FROM traces),
p AS (SELECT id, text, CAST(split_part(text, '/', 1) AS BIGINT) AS z, CAST(split_part(text, '/', 2) AS BIGINT) AS a, CAST(split_part(text, '/', 3) AS BIGINT) AS b FROM t),
q AS (SELECT *, a < power(2, z) AND b < power(2, z) AS ok FROM p)
SELECT id, text, ok AS valid, CASE WHEN ok THEN a END AS x, CASE WHEN ok THEN b END AS y, CASE WHEN ok THEN b END AS ogc_x,
  CASE WHEN ok THEN z || '/' || a || '/' || b END AS again FROM q""",
)
def tile_key_parse(spark, sf):
    t = X.traces(spark, sf)
    text = F.concat_ws("/", *[(c).cast("string") for c in (F.col("id") % 14, F.col("bytes_read") % 97, F.col("id") % 61)])
    df = t.select("id", text.alias("text")).withColumn("t", T.parse_tile_key("text")).withColumn("o", T.parse_ogc_tile_key("text"))
    return df.select(
        "id",
        "text",
        F.col("t").isNotNull().alias("valid"),
        F.col("t.x").alias("x"),
        F.col("t.y").alias("y"),
        F.col("o.x").alias("ogc_x"),
        F.when(F.col("t").isNotNull(), T.tile_key("t.z", "t.x", "t.y")).alias("again"),
    )


# --- projections ---


@query(
    "web_mercator",
    f"""WITH {X.GRANULES_SQL}, c AS (SELECT id, west AS lon, south * 1.1 AS lat FROM granules),
m AS (SELECT id, lon, lat, CASE WHEN abs(lat) <= 85.051129 THEN radians(lon) * 6378137.0 END AS mx,
  CASE WHEN abs(lat) <= 85.051129 THEN 6378137.0 * asinh(tan(radians(lat))) END AS my FROM c)
SELECT id, round(mx, 3) AS x, round(my, 3) AS y, round(degrees(mx / 6378137.0), 8) AS lon_back,
  round(degrees(atan(sinh(my / 6378137.0))), 8) AS lat_back FROM m""",
)
def web_mercator(spark, sf):
    c = X.granules(spark, sf).select("id", F.col("bbox.west").alias("lon"), (F.col("bbox.south") * 1.1).alias("lat"))
    m = c.withColumn("m", C.lonlat_to_mercator("lon", "lat")).withColumn("b", C.mercator_to_lonlat("m.x", "m.y"))
    return m.select(
        "id", _r(F.col("m.x"), 3).alias("x"), (_r(F.col("m.y"), 3) + 0.0).alias("y"),
        _r(F.col("b.x"), 8).alias("lon_back"), (_r(F.col("b.y"), 8) + 0.0).alias("lat_back"),
    )


@query(
    "sinusoidal",
    f"""WITH {X.GRANULES_SQL}, c AS (SELECT id, west + 0.25 AS lon, south AS lat FROM granules),
m AS (SELECT id, 6371007.181 * radians(lon) * cos(radians(lat)) AS sx, 6371007.181 * radians(lat) AS sy FROM c)
SELECT id, round(sx, 3) AS x, round(sy, 3) AS y,
  round(degrees(sx / (6371007.181 * cos(sy / 6371007.181))), 7) AS lon_back, round(degrees(sy / 6371007.181), 7) AS lat_back FROM m""",
)
def sinusoidal(spark, sf):
    c = X.granules(spark, sf).select("id", (F.col("bbox.west") + 0.25).alias("lon"), F.col("bbox.south").alias("lat"))
    m = c.withColumn("m", C.lonlat_to_sinu("lon", "lat")).withColumn("b", C.sinu_to_lonlat("m.x", "m.y"))
    return m.select(
        "id", _r(F.col("m.x"), 3).alias("x"), _r(F.col("m.y"), 3).alias("y"),
        _r(F.col("b.x"), 7).alias("lon_back"), _r(F.col("b.y"), 7).alias("lat_back"),
    )


def _sum_sql(coefficients, fn_a, fn_b, xi, eta, sign="+"):
    return " ".join(
        f"{sign} {c!r} * {fn_a}({2 * j} * {xi}) * {fn_b}({2 * j} * {eta})" for j, c in enumerate(coefficients, start=1)
    )


_K = repr(C.UTM_K0 * C.RECTIFYING_RADIUS)
UTM_SQL = f"""c AS (SELECT id, west + 0.25 AS lon, south AS lat, CAST(floor((west + 180) / 6) + 1 AS BIGINT) AS zone FROM granules),
a AS (SELECT *, tan(radians(lat)) AS tau, radians(lon - (zone * 6 - 183)) AS lam FROM c),
b AS (SELECT *, sinh({C.ECCENTRICITY!r} * atanh({C.ECCENTRICITY!r} * tau / sqrt(1 + tau * tau))) AS sg FROM a),
d AS (SELECT *, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS tc FROM b),
e AS (SELECT *, atan2(tc, cos(lam)) AS xi0, asinh(sin(lam) / sqrt(tc * tc + cos(lam) * cos(lam))) AS eta0 FROM d),
u AS (SELECT id, lon, lat, zone,
  500000.0 + {_K} * (eta0 {_sum_sql(C.ALPHA, 'cos', 'sinh', 'xi0', 'eta0')}) AS ux,
  {_K} * (xi0 {_sum_sql(C.ALPHA, 'sin', 'cosh', 'xi0', 'eta0')}) + CASE WHEN lat < 0 THEN 10000000.0 ELSE 0 END AS uy FROM e)"""


@query("utm_forward", f"WITH {X.GRANULES_SQL}, {UTM_SQL} SELECT id, zone, round(ux, 3) AS x, round(uy, 3) AS y FROM u")
def utm_forward(spark, sf):
    c = C.add_utm(_utm_points(spark, sf), F.col("lon"), F.col("lat"), F.col("zone"), F.col("lat") < 0, "u")
    return c.select("id", "zone", _r(F.col("u_x"), 3).alias("x"), (_r(F.col("u_y"), 3) + 0.0).alias("y"))


def _utm_points(spark, sf):
    lon, lat = F.col("bbox.west") + 0.25, F.col("bbox.south")
    zone = (F.floor((F.col("bbox.west") + 180) / 6) + 1).cast("long")
    return X.granules(spark, sf).select("id", lon.alias("lon"), lat.alias("lat"), zone.alias("zone"))


@query(
    "utm_roundtrip",
    f"WITH {X.GRANULES_SQL}, {UTM_SQL} SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM u",
)
def utm_roundtrip(spark, sf):
    south = F.col("lat") < 0
    c = C.add_utm(_utm_points(spark, sf), F.col("lon"), F.col("lat"), F.col("zone"), south, "u")
    b = C.add_lonlat_of_utm(c, F.col("u_x"), F.col("u_y"), F.col("zone"), south, "b")
    return b.select("id", _r(F.col("b_x"), 7).alias("lon"), (_r(F.col("b_y"), 7) + 0.0).alias("lat"))


@query(
    "reproject_any",
    f"""WITH {X.GRANULES_SQL}, {UTM_SQL}
SELECT id, CASE id % 4 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'EPSG:3857' WHEN 2 THEN 'sinu' ELSE 'utm' END AS target,
  CASE id % 4 WHEN 0 THEN round(lon, 3) WHEN 1 THEN round(radians(lon) * 6378137.0, 3)
    WHEN 2 THEN round(6371007.181 * radians(lon) * cos(radians(lat)), 3) ELSE round(ux, 3) END AS x,
  CASE id % 4 WHEN 0 THEN round(lat, 3) WHEN 1 THEN round(6378137.0 * asinh(tan(radians(lat))), 3)
    WHEN 2 THEN round(6371007.181 * radians(lat), 3) ELSE round(uy, 3) END AS y FROM u""",
)
def reproject_any(spark, sf):
    from ..operators.warp import project_points

    sinu = "+proj=sinu +lon_0=0 +x_0=0 +y_0=0 +R=6371007.181 +units=m +no_defs"
    epsg = F.when(F.col("lat") < 0, 32700).otherwise(32600) + F.col("zone")
    kind = F.col("id") % 4
    crs = (
        F.when(kind == 0, "EPSG:4326")
        .when(kind == 1, "EPSG:3857")
        .when(kind == 2, sinu)
        .otherwise(F.concat(F.lit("EPSG:"), epsg.cast("string")))
    )
    name = F.when(kind == 0, "EPSG:4326").when(kind == 1, "EPSG:3857").when(kind == 2, "sinu").otherwise("utm")
    points = _utm_points(spark, sf).withColumn("target", name)
    moved = project_points(points, "lon", "lat", "EPSG:4326", crs, "p")
    return moved.select("id", "target", _r(F.col("p_x"), 3).alias("x"), (_r(F.col("p_y"), 3) + 0.0).alias("y"))


@query(
    "crs_definitions",
    """WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN 32600 + c_custkey % 65 WHEN 3 THEN 32700 + c_custkey % 62 ELSE 2000 + c_custkey END AS epsg FROM customer)
SELECT id, CASE WHEN epsg = 4326 THEN '+proj=longlat +datum=WGS84 +no_defs'
  WHEN epsg = 3857 THEN '+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null +no_defs'
  WHEN epsg BETWEEN 32601 AND 32660 THEN '+proj=utm +zone=' || (epsg - 32600) || ' +datum=WGS84 +units=m +no_defs'
  WHEN epsg BETWEEN 32701 AND 32760 THEN '+proj=utm +zone=' || (epsg - 32700) || ' +south +datum=WGS84 +units=m +no_defs' END AS proj
FROM e""",
)
def crs_definitions(spark, sf):
    k = F.col("c_custkey")
    epsg = F.when(k % 5 == 0, 4326).when(k % 5 == 1, 3857).when(k % 5 == 2, 32600 + k % 65).when(k % 5 == 3, 32700 + k % 62).otherwise(2000 + k)
    return X.table(spark, sf, "customer").select(k.alias("id"), C.crs_to_proj(epsg).alias("proj"))


@query(
    "sinu_definitions",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 IN (0, 3) THEN CAST(6371000 + s_suppkey AS DOUBLE) END AS radius,
  CASE WHEN s_suppkey % 4 IN (0, 3) THEN CAST(s_nationkey AS DOUBLE) END AS lon_0 FROM supplier""",
)
def sinu_definitions(spark, sf):
    k = F.col("s_suppkey")
    r, lon = (k + 6371000).cast("string"), F.col("s_nationkey").cast("string")
    tail = F.concat(F.lit(" +lon_0="), lon, F.lit(" +units=m +no_defs"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("+proj=sinu +R="), r, tail))
        .when(k % 4 == 1, F.concat(F.lit("+proj=sinu +a="), r, F.lit(" +b=1"), tail))
        .when(k % 4 == 2, F.concat(F.lit("+proj=laea +R="), r, tail))
        .otherwise(F.concat(F.lit("+proj=sinu +a="), r, F.lit(" +b="), r, tail))
    )
    df = C.with_sinu(X.table(spark, sf, "supplier"), text, "s")
    return df.select(k.alias("id"), F.col("s.radius").alias("radius"), F.col("s.lon_0").alias("lon_0"))


# --- grids ---


@query(
    "affine_roundtrip",
    """SELECT p_partkey AS id, CAST(453720.0 + 30.0 * p_size AS DOUBLE) AS x, CAST(4353960.0 - 30.0 * p_partkey AS DOUBLE) AS y,
  CAST(p_size AS DOUBLE) AS col_back, CAST(p_partkey AS DOUBLE) AS row_back FROM part""",
)
def affine_roundtrip(spark, sf):
    t = G.north_up(453720.0, 4353960.0, 30.0, -30.0)
    p = X.table(spark, sf, "part").withColumn("p", G.pixel_to_crs("p_size", "p_partkey", t))
    p = p.withColumn("q", G.crs_to_pixel("p.x", "p.y", t))
    return p.select(F.col("p_partkey").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.col").alias("col_back"), F.col("q.row").alias("row_back"))


@query(
    "level_geometry",
    """WITH r AS (SELECT p_partkey AS id, 100 + p_partkey * 3 AS w, 50 + p_size * 7 AS h, CAST(power(2, p_size % 5) AS BIGINT) AS f FROM part),
l AS (SELECT *, CAST(ceil(w / CAST(f AS DOUBLE)) AS BIGINT) AS lw, CAST(ceil(h / CAST(f AS DOUBLE)) AS BIGINT) AS lh FROM r)
SELECT id, lw, lh, round(30.0 * (CAST(w AS DOUBLE) / lw), 6) AS px, round(-30.0 * (CAST(h AS DOUBLE) / lh), 6) AS py,
  CASE WHEN w = lw AND h = lh THEN 10 ELSE CAST(floor(10 / (CAST(w AS DOUBLE) / lw)) AS BIGINT) END AS col_off,
  CASE WHEN w = lw AND h = lh THEN 41 ELSE CAST(ceil(51 / (CAST(w AS DOUBLE) / lw)) AS BIGINT) - CAST(floor(10 / (CAST(w AS DOUBLE) / lw)) AS BIGINT) END AS width
FROM l""",
)
def level_geometry(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    r = X.table(spark, sf, "part").select(
        k.alias("id"), (100 + k * 3).alias("w"), (50 + s * 7).cast("long").alias("h"), F.pow(F.lit(2.0), s % 5).cast("long").alias("f")
    )
    r = r.withColumn("lw", G.level_dim("w", "f")).withColumn("lh", G.level_dim("h", "f"))
    t = G.level_transform(G.north_up(0.0, 0.0, 30.0, -30.0), "w", "h", "f")
    win = G.to_level_window(G.window(10, 10, 41, 20), "w", "h", "lw", "lh")
    r = r.withColumn("t", t).withColumn("win", win)
    return r.select("id", "lw", "lh", _r(F.col("t.a")).alias("px"), _r(F.col("t.e")).alias("py"), F.col("win.col_off").alias("col_off"), F.col("win.width").alias("width"))


@query(
    "window_overlap",
    """WITH w AS (SELECT p_partkey AS id, p_partkey % 90 AS c0, p_size AS r0, 40 + p_partkey % 7 AS c1, 30 AS r1 FROM part),
o AS (SELECT id, greatest(c0, c1) AS col_off, greatest(r0, r1) AS row_off, least(c0 + 25, c1 + 20) - greatest(c0, c1) AS width,
  least(r0 + 15, r1 + 10) - greatest(r0, r1) AS height FROM w)
SELECT id, CASE WHEN width > 0 AND height > 0 THEN col_off END AS col_off, CASE WHEN width > 0 AND height > 0 THEN CAST(row_off AS BIGINT) END AS row_off,
  CASE WHEN width > 0 AND height > 0 THEN width END AS width, CASE WHEN width > 0 AND height > 0 THEN CAST(height AS BIGINT) END AS height FROM o""",
)
def window_overlap(spark, sf):
    k = F.col("p_partkey")
    o = G.window_intersection(G.window(k % 90, "p_size", 25, 15), G.window(40 + k % 7, 30, 20, 10))
    df = X.table(spark, sf, "part").select(k.alias("id"), o.alias("o"))
    return df.select("id", "o.col_off", "o.row_off", "o.width", "o.height")


@query(
    "bound_intersection",
    """WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS s0, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 END AS s1,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey + 500 END AS e0, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 1000 + 100 END AS e1 FROM orders)
SELECT id, greatest(s0, s1) AS start_ms, least(e0, e1) AS end_ms FROM w""",
)
def bound_intersection(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s0, s1 = F.when(o % 3 != 0, c), F.when(o % 5 != 0, o % 1000)
    e0, e1 = F.when(o % 7 != 0, c + 500), F.when(o % 4 != 0, o % 1000 + 100)
    return X.table(spark, sf, "orders").select(o.alias("id"), G.later_start(s0, s1).alias("start_ms"), G.earlier_end(e0, e1).alias("end_ms"))


@query(
    "triangle_weight",
    "SELECT event_id AS id, greatest(0.0::DOUBLE, 1.0 - abs((event_id % 33 - 16) / 8.0)) AS w FROM events",
)
def triangle_weight(spark, sf):
    t = (F.col("event_id") % 33 - 16) / F.lit(8.0)
    return X.table(spark, sf, "events").select(F.col("event_id").alias("id"), G.triangle(t).alias("w"))


@query(
    "desired_ratio",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE least(l_quantity * 20 / (128.0 * (l_partkey % 3)), l_suppkey * 3 / (128.0 * (l_partkey % 3))) END AS ratio FROM lineitem""",
)
def desired_ratio(spark, sf):
    size = F.lit(128.0) * (F.col("l_partkey") % 3)
    ratio = G.desired_ratio(F.col("l_quantity") * 20, F.col("l_suppkey") * 3, size)
    return X.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), ratio.alias("ratio")
    )


# --- pixel words ---


@query(
    "qa_clear",
    f"""WITH {X.PIXELS_SQL}, q AS (SELECT prow, pcol, band, CASE WHEN (prow + pcol) % 9 = 0 THEN value + 0.5 ELSE CAST(value AS DOUBLE) END AS w FROM pixels)
SELECT prow AS "row", pcol AS col, band, CASE WHEN w <> floor(w) OR w < 0 OR w > 255 THEN NULL WHEN (CAST(floor(w) AS BIGINT) & 14) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS clear FROM q""",
)
def qa_clear(spark, sf):
    word = F.col("value") + F.when((F.col("row") + F.col("col")) % 9 == 0, 0.5).otherwise(0.0)
    return X.pixels(spark, sf).select("row", "col", "band", B.qa_clear(word).alias("clear"))


@query(
    "band_arithmetic",
    f"""WITH {X.WIDE_SQL}
SELECT prow AS "row", pcol AS col, CAST(nir + red AS DOUBLE) AS added, CAST(nir - red AS DOUBLE) AS subtracted, CAST(nir * red AS DOUBLE) AS multiplied,
  CASE WHEN green - red <> 0 THEN round(nir / CAST(green - red AS DOUBLE), 9) END AS divided FROM wide""",
)
def band_arithmetic(spark, sf):
    from ..operators.pixels import pivot_bands

    w = pivot_bands(X.pixels(spark, sf), ["row", "col"], ["red", "nir", "green"])
    return w.select(
        "row", "col", B.band_add("nir", "red").alias("added"), B.band_subtract("nir", "red").alias("subtracted"),
        B.band_multiply("nir", "red").alias("multiplied"),
        _r(B.finite_or_null(B.band_divide("nir", B.band_subtract("green", "red"))), 9).alias("divided"),
    )


@query(
    "array_element",
    "SELECT vec_id AS id, CAST(embedding[8] AS DOUBLE) AS seventh, CAST(embedding[1] AS DOUBLE) AS red FROM embeddings",
)
def array_element(spark, sf):
    e = F.col("embedding")
    labels = ["red", "nir", *[f"b{i}" for i in range(2, 64)]]
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), B.array_element(e, index=7).cast("double").alias("seventh"),
        B.array_element(e, label="red", labels=labels).cast("double").alias("red"),
    )


# --- instants ---

INSTANT_TEXT_SQL = """t AS (SELECT event_id AS id, CASE event_id % 8
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || 'Z'
  WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN '2023-02-' || lpad(CAST(25 + user_id % 7 AS VARCHAR), 2, '0') || 'T10:00:00Z'
  WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN '2024-02-29T' || lpad(CAST(20 + user_id % 6 AS VARCHAR), 2, '0') || ':59:59Z'
  WHEN 6 THEN CAST(1900 + user_id % 300 AS VARCHAR) ELSE '1969-12-31T23:59:59.' || CAST(user_id AS VARCHAR) || '999Z' END AS text FROM events)"""


def _instant_texts(spark, sf):
    e, u = F.col("event_id") % 8, F.col("user_id")
    ts = F.col("ts")
    day, sec = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = (
        F.when(e == 0, F.concat(sec, F.lit("Z")))
        .when(e == 1, F.concat(sec, F.lit("."), pad(u % 1000, 3), F.lit("Z")))
        .when(e == 2, day)
        .when(e == 3, F.concat(F.lit("2023-02-"), pad(25 + u % 7, 2), F.lit("T10:00:00Z")))
        .when(e == 4, sec)
        .when(e == 5, F.concat(F.lit("2024-02-29T"), pad(20 + u % 6, 2), F.lit(":59:59Z")))
        .when(e == 6, (1900 + u % 300).cast("string"))
        .otherwise(F.concat(F.lit("1969-12-31T23:59:59."), u.cast("string"), F.lit("999Z")))
    )
    return X.table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("text"))


@query(
    "rfc3339_check",
    f"""WITH {INSTANT_TEXT_SQL}
SELECT id, text, regexp_full_match(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z') AND TRY_CAST(substr(text, 1, 19) AS TIMESTAMP) IS NOT NULL AS ok FROM t""",
)
def rfc3339_check(spark, sf):
    return _instant_texts(spark, sf).select("id", "text", TM.is_rfc3339_utc("text").alias("ok"))


@query(
    "unix_millis_text",
    f"""WITH {INSTANT_TEXT_SQL}, o AS (SELECT *, regexp_full_match(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z') AND TRY_CAST(substr(text, 1, 19) AS TIMESTAMP) IS NOT NULL AS ok FROM t),
m AS (SELECT id, CASE WHEN ok THEN CAST(epoch_ms(CAST(substr(text, 1, 19) AS TIMESTAMP)) AS BIGINT) + CAST(rpad(substr(regexp_extract(text, '\\.(\\d+)Z', 1), 1, 3), 3, '0') AS BIGINT) END AS ms FROM o)
SELECT id, ms, CASE WHEN ms IS NOT NULL THEN strftime(make_timestamp((ms - (ms % 1000 + 1000) % 1000) * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN (ms % 1000 + 1000) % 1000 = 0 THEN '' ELSE '.' || lpad(CAST((ms % 1000 + 1000) % 1000 AS VARCHAR), 3, '0') END || 'Z' END AS text FROM m""",
)
def unix_millis_text(spark, sf):
    m = _instant_texts(spark, sf).select("id", TM.to_unix_millis("text").alias("ms"))
    return m.withColumn("text", TM.from_unix_millis("ms"))


@query(
    "temporal_instant",
    f"""WITH {INSTANT_TEXT_SQL}, f AS (SELECT id, CASE WHEN length(text) = 4 THEN text || '-01-01T00:00:00Z' WHEN length(text) = 10 THEN text || 'T00:00:00Z' ELSE text END AS text FROM t)
SELECT id, CASE WHEN regexp_full_match(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z') AND TRY_CAST(substr(text, 1, 19) AS TIMESTAMP) IS NOT NULL THEN text END AS instant FROM f""",
)
def temporal_instant(spark, sf):
    return _instant_texts(spark, sf).select("id", TM.temporal_instant("text").alias("instant"))


INTERVAL_SQL = f"""{X.REQUESTS_SQL}, s AS (SELECT request_id AS id, t_ms, strftime(make_timestamp((t_ms // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS a,
  strftime(make_timestamp((t_ms // 1000 + 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS b, (t_ms // 1000) * 1000 AS ms FROM requests)"""


def _interval_texts(spark, sf):
    ms = F.floor(F.col("t_ms") / 1000) * 1000
    q = X.requests(spark, sf).select(F.col("request_id").alias("id"), ms.alias("ms"))
    a, b = TM.from_unix_millis("ms"), TM.from_unix_millis(F.col("ms") + 86400000)
    k = F.col("id") % 7
    text = (
        F.when(k == 0, a).when(k == 1, F.concat_ws("/", a, b)).when(k == 2, F.concat(F.lit("../"), b))
        .when(k == 3, F.concat(a, F.lit("/.."))).when(k == 4, "../..").when(k == 5, "..").otherwise(F.substring(a, 1, 10))
    )
    return q.withColumn("text", text)


@query(
    "datetime_interval",
    f"""WITH {INTERVAL_SQL}
SELECT id, CASE WHEN id % 7 IN (0, 1, 3) THEN ms END AS start_ms, CASE id % 7 WHEN 0 THEN ms WHEN 1 THEN ms + 86400000 WHEN 2 THEN ms + 86400000 END AS end_ms,
  CASE WHEN id % 7 IN (1, 3) THEN ms END AS frame_start, CASE WHEN id % 7 < 4 THEN CASE WHEN id % 7 = 0 THEN 'latest_at_or_before' ELSE 'latest_in_interval' END ELSE 'latest' END AS rule FROM s""",
)
def datetime_interval(spark, sf):
    q = _interval_texts(spark, sf).withColumn("p", TM.parse_datetime_interval("text"))
    return q.select(
        "id", F.col("p.start_ms").alias("start_ms"), F.col("p.end_ms").alias("end_ms"),
        TM.frame_window(F.col("p"))["start_ms"].alias("frame_start"), TM.temporal_rule(F.col("p")).alias("rule"),
    )


# --- text ---


@query(
    "parse_bbox",
    """WITH b AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || ',' || o_custkey || ',' || (o_orderkey + 1) || ',' || (o_custkey + 1.5)
  WHEN 1 THEN o_orderkey || ',9,5' WHEN 2 THEN '1,' || (o_custkey + 2) || ',3,' || o_custkey WHEN 3 THEN '1,2,x,4' ELSE '1e2, -5.25,3,' || o_custkey END AS text FROM orders)
SELECT id, CASE id % 5 WHEN 0 THEN CAST(split_part(text, ',', 1) AS DOUBLE) WHEN 4 THEN 100.0::DOUBLE END AS west, CASE id % 5 WHEN 0 THEN CAST(split_part(text, ',', 2) AS DOUBLE) WHEN 4 THEN -5.25::DOUBLE END AS south,
  CASE WHEN id % 5 IN (0, 4) THEN CAST(split_part(text, ',', 4) AS DOUBLE) END AS north FROM b""",
)
def parse_bbox(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda v: v.cast("string")
    text = (
        F.when(o % 5 == 0, F.concat_ws(",", s(o), s(c), s(o + 1), s(c + 1.5)))
        .when(o % 5 == 1, F.concat(s(o), F.lit(",9,5")))
        .when(o % 5 == 2, F.concat(F.lit("1,"), s(c + 2), F.lit(",3,"), s(c)))
        .when(o % 5 == 3, "1,2,x,4")
        .otherwise(F.concat(F.lit("1e2, -5.25,3,"), s(c)))
    )
    df = X.table(spark, sf, "orders").select(o.alias("id"), TX.parse_bbox(text).alias("b"))
    return df.select("id", F.col("b.west").alias("west"), F.col("b.south").alias("south"), F.col("b.north").alias("north"))


@query(
    "granule_names",
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%j') AS day,
  'hlss30-t10tfk-' || strftime(o_orderdate, '%Y%j') || '-' || CASE o_orderkey % 2 WHEN 0 THEN 'b8a' ELSE 'fmask' END || '.tif' AS file FROM orders""",
)
def granule_names(spark, sf):
    name = F.concat(F.lit("HLS.S30.T10TFK."), F.date_format("o_orderdate", "yyyyDDD"), F.lit("T184919.v2.0"))
    band = F.when(F.col("o_orderkey") % 2 == 0, "B8A").otherwise("Fmask")
    df = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), name.alias("n"), band.alias("b"))
    return df.select("id", TX.sensing_day("n").alias("day"), TX.fixture_name("n", "b").alias("file"))


@query(
    "classify_links",
    """WITH p AS (SELECT page_id AS id, url, regexp_extract(url, '^[^?#]*') AS path FROM pages),
s AS (SELECT id, path, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '\\.[A-Za-z0-9]+$', '') AS stem FROM p)
SELECT id, CASE WHEN lower(path) LIKE '%.json' THEN 'stac' ELSE 'cog' END AS kind, stem,
  lower(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM s""",
)
def classify_links(spark, sf):
    p = X.table(spark, sf, "pages")
    return p.select(
        F.col("page_id").alias("id"), TX.classify_link("url").alias("kind"), TX.stem("url").alias("stem"), TX.slug(TX.stem("url")).alias("slug")
    )


@query(
    "split_fragment",
    """SELECT page_id AS id, CASE WHEN instr(url, '#') > 0 AND instr(url, '#') < length(url) THEN substr(url, 1, instr(url, '#') - 1) END AS key,
  CASE WHEN instr(url, '#') > 0 AND instr(url, '#') < length(url) THEN substr(url, instr(url, '#') + 1) END AS fragment FROM pages""",
)
def split_fragment(spark, sf):
    p = X.table(spark, sf, "pages").select(F.col("page_id").alias("id"), TX.split_fragment("url").alias("f"))
    return p.select("id", F.col("f.key").alias("key"), F.col("f.array").alias("fragment"))


@query(
    "chunk_keys",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, CASE WHEN l_partkey % 4 <> 3 THEN l_suppkey END AS cy, CASE WHEN l_partkey % 4 <> 3 THEN l_partkey % 64 END AS cx,
  'root/2/' || l_suppkey || '.' || (l_partkey % 64) AS path FROM lineitem""",
)
def chunk_keys(spark, sf):
    key = F.concat_ws(".", F.col("l_suppkey").cast("string"), F.when(F.col("l_partkey") % 4 == 3, "x").otherwise((F.col("l_partkey") % 64).cast("string")))
    df = X.table(spark, sf, "lineitem").withColumn("c", TX.parse_chunk_key(key))
    path = TX.chunk_path(F.lit("root"), F.lit(2), F.col("l_suppkey"), F.col("l_partkey") % 64)
    return df.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("c.cy").alias("cy"), F.col("c.cx").alias("cx"), path.alias("path"))


@query(
    "codec_parts",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'shuffle' ELSE 'zlib' END AS name,
  CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_size <= 9 THEN p_size ELSE 6 END WHEN 2 THEN 6 WHEN 3 THEN 6 END AS level FROM part""",
)
def codec_parts(spark, sf):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "shuffle").when(k == 1, F.concat(F.lit("zlib:"), F.col("p_size").cast("string"))).when(k == 2, "zlib:x").otherwise("zlib")
    df = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), TX.parse_codec(text).alias("c"))
    return df.select("id", F.col("c.name").alias("name"), F.col("c.level").alias("level"))


@query(
    "weather_names",
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 't' || p_size || 'm' ELSE 't' END
  WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'u' || p_size ELSE 'u' END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'gh' || p_size ELSE 'gh' END
  WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'prmsl' || p_size ELSE 'prmsl' END ELSE lower(p_type) END AS name,
  CASE p_size % 45 WHEN 0 THEN 'grib2:simple' WHEN 2 THEN 'grib2:complex' WHEN 3 THEN 'grib2:complex-spatial-diff' WHEN 4 THEN 'grib2:ieee-float'
  WHEN 40 THEN 'grib2:jpeg2000' WHEN 41 THEN 'grib2:png' WHEN 42 THEN 'grib2:aec' ELSE 'grib2:template' || (p_size % 45) END AS codec FROM part""",
)
def weather_names(spark, sf):
    k = F.col("p_partkey") % 5
    abbrev = F.when(k == 0, "TMP").when(k == 1, "UGRD").when(k == 2, "HGT").when(k == 3, "PRMSL").otherwise(F.col("p_type"))
    name = TX.cfgrib_name(abbrev, F.col("p_size") % 2 == 0, F.col("p_size").cast("double"))
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), TX.packing_codec(F.col("p_size") % 45).alias("codec"))


@query(
    "sample_types",
    """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'uint8' WHEN 1 THEN 'uint16' WHEN 2 THEN 'int16' WHEN 3 THEN 'int32' WHEN 4 THEN 'float32' WHEN 5 THEN 'float64' END AS dtype,
  CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 8 END AS bytes,
  CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS fill FROM customer""",
)
def sample_types(spark, sf):
    k = (F.col("c_custkey") % 7).cast("int")
    fmt = F.element_at(F.array(*map(F.lit, ("Uint", "Uint", "Int", "Int", "Float", "Float", "Float"))), k + 1)
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 16, 32, 32, 64, 16))), k + 1)
    dtype = TX.dtype_from_tags(fmt, bits)
    fill = TX.numeric_fill(F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), dtype.alias("dtype"), TX.size_bytes(dtype).alias("bytes"), fill.alias("fill"))


# --- keys ---


def _le(value: str, width: int) -> str:
    return "||".join(f"unhex(printf('%02X', (CAST({value} AS BIGINT) >> {8 * i}) & 255))" for i in range(width))


def _field_sql(data: str, length: str) -> str:
    return f"{_le(length, 8)} || {data}"


def _text_field_sql(text: str) -> str:
    return _field_sql(f"encode({text})", f"octet_length(encode({text}))")


@query(
    "tile_content_key",
    f"""WITH {X.TRACES_SQL}, k AS (SELECT id, layer, tile, id || '@' || sha256('{{"v":' || (id % 3) || '}}') AS version, '{{"v":' || (id % 3) || '}}' AS plan,
  CAST(split_part(tile, '/', 2) AS BIGINT) AS x, CAST(split_part(tile, '/', 3) AS BIGINT) AS y FROM traces)
SELECT id, version, sha256({_text_field_sql("'" + K.KEY_DOMAIN + "'")} || {_text_field_sql('layer')} || {_text_field_sql('version')} || {_text_field_sql('plan')} || {_text_field_sql("'WebMercatorQuad'")}
  || {_field_sql(_le('7', 1), '1')} || {_field_sql(_le('x', 4), '4')} || {_field_sql(_le('y', 4), '4')} || {_field_sql(_le('256', 4), '4')}) AS tile_key FROM k""",
)
def tile_content_key(spark, sf):
    plan = F.concat(F.lit('{"v":'), (F.col("id") % 3).cast("string"), F.lit("}"))
    t = X.traces(spark, sf).withColumn("plan", plan).withColumn("t", T.parse_tile_key("tile"))
    t = t.withColumn("version", K.layer_version("id", "plan"))
    key = K.tile_key_hash("layer", "version", "plan", F.lit("WebMercatorQuad"), "t.z", "t.x", "t.y", F.lit(256))
    return t.select("id", "version", key.alias("tile_key"))
