"""Catalog queries: filters, as-of resolution, extents, browsing, upserts, spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import temporal as TM
from ..operators import catalog as C
from ..operators import resolve as R
from ..operators import spatial as S
from ..sources import granules as SG
from . import query
from .scalars import lat_y, lon_x


def _g(spark, sf):
    return X.granules(spark, sf)


def _ms(df, column="datetime"):
    return df.withColumn("dt_ms", TM.instant_ms(column))


# --- filters ---


@query(
    "load_collection",
    f"""WITH {X.FILES_SQL}
SELECT id, band, href FROM files WHERE dataset = '2-HIGH' AND band IN ('red', 'nir') AND dt >= TIMESTAMP '1996-01-01' AND dt < TIMESTAMP '1999-07-01'""",
)
def load_collection(spark, sf):
    vocabulary = {"red": "red", "near_infrared": "nir", "green": "green"}
    loaded = C.load_collection(X.granule_assets(spark, sf), "2-HIGH", ["red", "near_infrared"], ("1996", "1999-07-01"), vocabulary)
    return loaded.select("id", "band", "href")


@query(
    "filter_temporal",
    f"WITH {X.GRANULES_SQL} SELECT id, dataset FROM granules WHERE dt >= TIMESTAMP '1997-01-01' AND dt < TIMESTAMP '1998-03-05 00:00:00'",
)
def filter_temporal(spark, sf):
    return C.filter_temporal(_g(spark, sf), ("1997", "1998-03-05"), dimension="t").select("id", "dataset")


@query(
    "filter_bbox",
    f"""WITH {X.GRANULES_SQL}
SELECT id, 'plain' AS box FROM granules WHERE west <= 20 AND east >= -10 AND south <= 30 AND north >= 5
UNION ALL SELECT id, 'crossing' FROM granules WHERE (west <= 180 AND east >= 170 OR west <= -165 AND east >= -180) AND south <= 10 AND north >= -20""",
)
def filter_bbox(spark, sf):
    g = _g(spark, sf)
    plain = C.filter_bbox(g, -10, 5, 20, 30).select("id", F.lit("plain").alias("box"))
    return plain.unionAll(C.filter_bbox(g, 170, -20, -165, 10).select("id", F.lit("crossing").alias("box")))


@query(
    "filter_datetime",
    f"""WITH {X.GRANULES_SQL}
SELECT id, 'instant' AS kind FROM granules WHERE dt = TIMESTAMP '1998-10-03' UNION ALL
SELECT id, 'interval' FROM granules WHERE dt BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-02-01' UNION ALL
SELECT id, 'until' FROM granules WHERE dt <= TIMESTAMP '1995-03-01' UNION ALL
SELECT id, 'since' FROM granules WHERE dt >= TIMESTAMP '2001-05-01'""",
)
def filter_datetime(spark, sf):
    g = _g(spark, sf)
    texts = {
        "instant": "1998-10-03T00:00:00Z",
        "interval": "1999-01-01T00:00:00Z/1999-02-01T00:00:00Z",
        "until": "../1995-03-01T00:00:00Z",
        "since": "2001-05-01T00:00:00Z/..",
    }
    out = None
    for kind, text in texts.items():
        part = C.filter_datetime(g, text).select("id", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionAll(part)
    return out


# --- validation ---

DATASETS_SQL = """datasets AS (SELECT DISTINCT o_orderpriority AS id,
  CASE WHEN o_orderpriority[1] IN ('1', '3', '5') THEN ['nir', 'red'] ELSE ['green', 'nir', 'red'] END AS bands FROM orders)"""


def _candidates(spark, sf):
    """Granules with assets where some lack an instant, some carry an unsafe or unknown dataset."""
    g = X.granule_assets(spark, sf)
    k = F.col("id") % 11
    return g.select(
        F.when(k == 3, F.lit("")).otherwise(F.col("id").cast("string")).alias("id"),
        F.when(k == 5, F.lit("no such set")).when(k == 7, "ghost").otherwise(F.regexp_replace("dataset", " ", "_")).alias("dataset"),
        F.when(k != 2, F.col("datetime")).alias("datetime"),
        "assets",
        F.col("id").alias("n"),
    )


def _datasets(spark, sf):
    return X.datasets(spark, sf).withColumn("id", F.regexp_replace("id", " ", "_"))


@query(
    "validate_granules",
    f"""WITH {X.FILES_SQL}, {DATASETS_SQL}, a AS (SELECT id AS n, any_value(dataset) AS dataset, any_value(dt) AS dt, list(band) AS keys FROM files GROUP BY id),
j AS (SELECT n, CASE n % 11 WHEN 5 THEN 'no such set' WHEN 7 THEN 'ghost' ELSE replace(a.dataset, ' ', '_') END AS dataset, keys, d.bands,
  n % 11 = 2 AS no_dt, n % 11 = 3 AS no_id, n % 11 IN (5, 7) AS unknown FROM a JOIN datasets d ON d.id = a.dataset)
SELECT n, dataset, array_to_string(list_filter([CASE WHEN no_id THEN 'id missing' END, CASE WHEN no_dt THEN 'datetime missing' END,
  CASE WHEN n % 11 = 5 THEN 'dataset id not url-safe' END, CASE WHEN unknown THEN 'dataset unknown' END,
  CASE WHEN NOT unknown AND len(list_filter(keys, lambda k: NOT list_contains(bands, k))) > 0 THEN 'band not in vocabulary' END], lambda t: t IS NOT NULL), '; ') AS issues FROM j""",
)
def validate_granules(spark, sf):
    good, bad = C.validate_granules(_candidates(spark, sf), _datasets(spark, sf))
    fine = good.select("n", "dataset", F.lit("").alias("issues"))
    return fine.unionAll(bad.select("n", "dataset", F.array_join("issues", "; ").alias("issues")))


@query(
    "known_dataset",
    f"""WITH {X.GRANULES_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS verdict FROM granules""",
)
def known_dataset(spark, sf):
    g = _g(spark, sf).withColumn("dataset", F.when(F.col("id") % 7 == 0, "ghost").otherwise(F.col("dataset")))
    yes, no = C.known_dataset(g, X.datasets(spark, sf))
    return yes.select("id", F.lit("accepted").alias("verdict")).unionAll(no.select("id", F.lit("rejected").alias("verdict")))


@query(
    "unknown_bands",
    f"""WITH {X.FILES_SQL}, {DATASETS_SQL}
SELECT f.id, string_agg(CASE WHEN NOT list_contains(d.bands, f.band) THEN f.band END, ',' ORDER BY f.band) AS unknown FROM files f JOIN datasets d ON d.id = f.dataset GROUP BY f.id""",
)
def unknown_bands(spark, sf):
    df = C.unknown_bands(X.granule_assets(spark, sf), X.datasets(spark, sf))
    return df.select("id", F.when(F.size("unknown") > 0, F.array_join("unknown", ",")).alias("unknown"))


@query(
    "valid_layers",
    f"""WITH {DATASETS_SQL}, layers AS (SELECT o_orderkey AS layer, o_orderpriority AS dataset, CASE o_custkey % 3 WHEN 0 THEN ['nir', 'red'] WHEN 1 THEN ['green'] ELSE ['red', 'swir'] END AS inputs FROM orders)
SELECT layer FROM layers l JOIN datasets d ON d.id = l.dataset WHERE len(list_filter(inputs, lambda b: NOT list_contains(bands, b))) = 0""",
)
def valid_layers(spark, sf):
    k = F.col("o_custkey") % 3
    arr = lambda *v: F.array(*map(F.lit, v))
    layers = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("layer"), F.col("o_orderpriority").alias("dataset"),
        F.when(k == 0, arr("nir", "red")).when(k == 1, arr("green")).otherwise(arr("red", "swir")).alias("inputs"),
    )
    return C.valid_layers(layers, X.datasets(spark, sf)).select("layer")


# --- extents ---


@query("temporal_interval", f"WITH {X.GRANULES_SQL} SELECT dataset, min(dt_ms) AS t_start, max(dt_ms) AS t_end FROM granules GROUP BY dataset")
def temporal_interval(spark, sf):
    df = C.temporal_interval(_g(spark, sf))
    return df.select("dataset", TM.instant_ms("t_start").alias("t_start"), TM.instant_ms("t_end").alias("t_end"))


@query("union_bbox", f"WITH {X.GRANULES_SQL} SELECT dataset, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM granules GROUP BY dataset")
def union_bbox(spark, sf):
    return C.union_bbox(_g(spark, sf))


@query(
    "heal_extents",
    f"""WITH {X.GRANULES_SQL}, d AS (SELECT dataset AS id, min(dt_ms) AS t_start, max(dt_ms) AS t_end, min(west) AS west, max(north) AS north FROM granules GROUP BY dataset)
SELECT a.id, t_start, t_end, west, north FROM (SELECT DISTINCT dataset AS id FROM granules UNION ALL SELECT 'empty') a LEFT JOIN d ON d.id = a.id""",
)
def heal_extents(spark, sf):
    known = X.datasets(spark, sf).select("id")
    healed = C.heal_extents(known.unionAll(spark.range(1).select(F.lit("empty").alias("id"))), _g(spark, sf))
    return healed.select("id", TM.instant_ms("t_start").alias("t_start"), TM.instant_ms("t_end").alias("t_end"), F.col("bbox.west").alias("west"), F.col("bbox.north").alias("north"))


# --- browsing ---


@query(
    "browse_granules",
    f"""WITH {X.GRANULES_SQL}
SELECT id, dt_ms FROM granules WHERE dataset = '1-URGENT' AND west <= 60 AND east >= -60 AND south <= 60 AND north >= -60 AND dt <= TIMESTAMP '2000-06-01' ORDER BY dt DESC, id DESC LIMIT 100 OFFSET 50""",
)
def browse_granules(spark, sf):
    page = C.browse_granules(_g(spark, sf), "1-URGENT", (-60, -60, 60, 60), "../2000-06-01T00:00:00Z", 100, 50)
    return _ms(page).select("id", "dt_ms")


@query(
    "browse_summary",
    f"""WITH {X.GRANULES_SQL}, m AS (SELECT count(*) AS n FROM granules WHERE dataset = '3-MEDIUM' AND dt >= TIMESTAMP '2000-01-01')
SELECT n AS number_matched, least(greatest(n - 100, 0), 100) AS number_returned, n > 200 AS has_next FROM m""",
)
def browse_summary(spark, sf):
    m = C.matching_granules(_g(spark, sf), "3-MEDIUM", datetime="2000-01-01T00:00:00Z/..")
    return C.browse_summary(m, 100, 100).withColumn("number_returned", F.col("number_returned").cast("long"))


@query("list_datasets", "SELECT DISTINCT o_orderpriority AS id, 'title ' || o_orderpriority AS title FROM orders ORDER BY id")
def list_datasets(spark, sf):
    return C.list_by_id(X.datasets(spark, sf).select("id", "title"))


@query(
    "upsert",
    f"""WITH {X.GRANULES_SQL}, u AS (SELECT dataset, id, dt_ms, 0 AS version FROM granules UNION ALL SELECT dataset, id, dt_ms + 1000 * (id % 4), 1 + id % 3 FROM granules)
SELECT dataset, id, arg_max(dt_ms, version) AS dt_ms, max(version) AS version FROM u GROUP BY dataset, id""",
)
def upsert(spark, sf):
    base = _ms(_g(spark, sf)).select("dataset", "id", "dt_ms", F.lit(0).alias("version"))
    newer = base.withColumns({"dt_ms": F.col("dt_ms") + 1000 * (F.col("id") % 4), "version": 1 + F.col("id") % 3})
    return C.upsert(base.withColumn("version", F.col("version").cast("long")), newer, ["dataset", "id"], "version")


@query(
    "frames",
    f"""WITH {X.GRANULES_SQL}, d AS (SELECT dataset, dt_ms AS frame_ms, count(*) AS granules FROM granules GROUP BY ALL)
SELECT dataset, frame_ms, granules, row_number() OVER w - 1 AS frame_index,
  coalesce(lead(frame_ms, 1) OVER w, first_value(frame_ms) OVER w) AS next_ms,
  coalesce(lead(frame_ms, 2) OVER w, CASE WHEN lead(frame_ms, 1) OVER w IS NULL THEN nth_value(frame_ms, 2) OVER (PARTITION BY dataset ORDER BY frame_ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE first_value(frame_ms) OVER w END) AS after_next_ms
FROM d WINDOW w AS (PARTITION BY dataset ORDER BY frame_ms)""",
)
def frames(spark, sf):
    return C.frames(_g(spark, sf))


# --- resolution ---


@query(
    "asof_latest",
    f"""WITH {X.GRANULES_SQL}, {X.REQUESTS_SQL}, i AS (SELECT dataset, dt_ms, max(id) AS id FROM granules GROUP BY ALL)
SELECT r.request_id, r.dataset, r.t_ms, i.id AS granule_id, i.dt_ms AS granule_ms FROM requests r ASOF LEFT JOIN i ON r.dataset = i.dataset AND r.t_ms >= i.dt_ms""",
)
def asof_latest(spark, sf):
    return R.asof_latest(X.requests(spark, sf), _g(spark, sf))


WINDOWS_SQL = f"{X.REQUESTS_SQL}, w AS (SELECT *, CASE WHEN request_id % 5 <> 0 THEN t_ms - 86400000 * (request_id % 9) END AS start_ms, CASE WHEN request_id % 6 <> 0 THEN t_ms + 86400000 * (request_id % 3 - 1) END AS end_ms FROM requests)"


@query(
    "latest_in_interval",
    f"""WITH {X.GRANULES_SQL}, {WINDOWS_SQL}, i AS (SELECT dataset, dt_ms, max(id) AS id FROM granules GROUP BY ALL),
f AS (SELECT w.*, i.id, i.dt_ms FROM w ASOF LEFT JOIN i ON w.dataset = i.dataset AND coalesce(w.end_ms, 9e15::BIGINT) >= i.dt_ms)
SELECT request_id, CASE WHEN (start_ms IS NULL OR dt_ms >= start_ms) AND NOT coalesce(start_ms > end_ms, false) THEN id END AS granule_id,
  CASE WHEN (start_ms IS NULL OR dt_ms >= start_ms) AND NOT coalesce(start_ms > end_ms, false) THEN dt_ms END AS granule_ms FROM f""",
)
def latest_in_interval(spark, sf):
    k, t = F.col("request_id"), F.col("t_ms")
    w = X.requests(spark, sf).select(
        "request_id", "dataset",
        F.when(k % 5 != 0, t - 86400000 * (k % 9)).alias("start_ms"), F.when(k % 6 != 0, t + 86400000 * (k % 3 - 1)).alias("end_ms"),
    )
    return R.latest_in_interval(w, _g(spark, sf)).select("request_id", "granule_id", "granule_ms")


@query("latest", f"WITH {X.GRANULES_SQL} SELECT dataset, id AS granule_id, dt_ms AS granule_ms FROM granules QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY dt_ms DESC, id DESC) = 1")
def latest(spark, sf):
    return R.latest(_g(spark, sf))


@query(
    "frame_index",
    f"""WITH {X.GRANULES_SQL}, {X.REQUESTS_SQL}, d AS (SELECT dataset, dt_ms, row_number() OVER (PARTITION BY dataset ORDER BY dt_ms) - 1 AS n FROM (SELECT DISTINCT dataset, dt_ms FROM granules)),
r AS (SELECT request_id, dataset, CASE WHEN request_id % 10 <> 0 THEN t_ms END AS t_ms FROM requests)
SELECT request_id, coalesce(n, 0) AS frame_index FROM r ASOF LEFT JOIN d ON r.dataset = d.dataset AND coalesce(r.t_ms, 9e15::BIGINT) >= d.dt_ms""",
)
def frame_index(spark, sf):
    r = X.requests(spark, sf).withColumn("t_ms", F.when(F.col("request_id") % 10 != 0, F.col("t_ms")))
    return R.frame_index(r, C.frames(_g(spark, sf))).select("request_id", "frame_index")


@query(
    "resolve_assets",
    f"""WITH {X.FILES_SQL}, layers AS (SELECT o_orderkey AS granule_id, 'L' || o_custkey % 5 AS layer, unnest(['nir', 'red', 'swir']) AS input FROM orders)
SELECT layer, granule_id, input, href, href IS NULL AS missing FROM layers l LEFT JOIN files f ON f.id = l.granule_id AND f.band = l.input""",
)
def resolve_assets(spark, sf):
    layers = X.table(spark, sf, "orders").select(
        F.concat(F.lit("L"), (F.col("o_custkey") % 5).cast("string")).alias("layer"), F.col("o_orderkey").alias("granule_id"),
        F.array(F.lit("nir"), F.lit("red"), F.lit("swir")).alias("inputs"),
    )
    return R.resolve_assets(layers, X.granule_assets(spark, sf))


@query(
    "mixed_crs",
    """WITH b AS (SELECT l_orderkey AS render, 'p' || l_partkey AS asset FROM lineitem), r AS (SELECT 'p' || p_partkey AS asset, 'EPSG:' || (32600 + p_size % 3) AS crs FROM part)
SELECT render, count(DISTINCT crs) AS crs_count FROM b JOIN r USING (asset) GROUP BY render HAVING count(DISTINCT crs) > 1""",
)
def mixed_crs(spark, sf):
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    bands = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("render"), name("l_partkey").alias("asset"))
    rasters = X.table(spark, sf, "part").select(name("p_partkey").alias("asset"), F.concat(F.lit("EPSG:"), (32600 + F.col("p_size") % 3).cast("string")).alias("crs"))
    return R.mixed_crs(bands, rasters, ["render"])


# --- spatial ---

RANGES_SQL = f"""t AS (SELECT id, {lon_x('west', 6)} AS x0, {lon_x('east', 6)} AS x1, {lat_y('north', 6)} AS y0, {lat_y('south', 6)} AS y1 FROM granules),
cells AS (SELECT id, x, unnest(generate_series(y0, y1)) AS y FROM (SELECT *, unnest(generate_series(x0, x1)) AS x FROM t))"""


@query("tiles_for_footprints", f"WITH {X.GRANULES_SQL}, {RANGES_SQL} SELECT id, 6 AS z, x, y FROM cells")
def tiles_for_footprints(spark, sf):
    return S.tiles_for_footprints(_g(spark, sf), 6).select("id", "z", "x", "y")


@query(
    "interior_tiles",
    f"""WITH {X.GRANULES_SQL}, t AS (SELECT {lon_x('west', 7)} + 1 AS x0, {lon_x('east', 7)} - 1 AS x1, {lat_y('north', 7)} + 1 AS y0, {lat_y('south', 7)} - 1 AS y1 FROM granules)
SELECT DISTINCT 7 AS z, x, y FROM (SELECT x, unnest(generate_series(y0, y1)) AS y FROM (SELECT *, unnest(generate_series(x0, x1)) AS x FROM t)) ORDER BY y, x LIMIT 128""",
)
def interior_tiles(spark, sf):
    return S.interior_tiles(_g(spark, sf), 7, 128)


BOXES_SQL = """boxes AS (SELECT event_id AS id, -170.0::DOUBLE + (event_id * 7) % 340 AS west, -60.0::DOUBLE + (event_id * 3) % 120 AS south FROM events)"""


@query(
    "bbox_join",
    f"""WITH {X.GRANULES_SQL}, areas AS (SELECT c_custkey AS id, -178.0::DOUBLE + (c_custkey * 11) % 340 AS west, -75.0::DOUBLE + (c_custkey * 5) % 140 AS south FROM customer)
SELECT g.id AS left_id, a.id AS right_id FROM granules g JOIN areas a ON g.west <= a.west + 2.5 AND g.east >= a.west AND g.south <= a.south + 1.5 AND g.north >= a.south""",
)
def bbox_join(spark, sf):
    c = F.col("c_custkey")
    west, south = F.lit(-178.0) + (c * 11) % 340, F.lit(-75.0) + (c * 5) % 140
    box = F.struct(west.alias("west"), south.alias("south"), (west + 2.5).alias("east"), (south + 1.5).alias("north"))
    areas = X.table(spark, sf, "customer").select(c.alias("id"), box.alias("bbox"))
    return S.bbox_join(_g(spark, sf), areas)


@query(
    "parent_child",
    f"""WITH {X.GRANULES_SQL}, {RANGES_SQL}, child AS (SELECT DISTINCT x, y FROM cells), parent AS (SELECT {lon_x('west', 5)} AS x, {lat_y('north', 5)} AS y, count(*) AS n FROM granules GROUP BY ALL)
SELECT c.x, c.y, p.x AS parent_x, p.y AS parent_y, p.n AS parent_n FROM child c JOIN parent p ON p.x = c.x // 2 AND p.y = c.y // 2""",
)
def parent_child(spark, sf):
    from ..functions import tiles as T

    g = _g(spark, sf)
    child = S.tiles_for_footprints(g, 6).select("z", "x", "y").distinct()
    parent = g.groupBy(F.lit(5).alias("z"), T.tile_x_for_lon("bbox.west", 5).alias("x"), T.tile_y_for_lat("bbox.north", 5).alias("y")).agg(F.count("*").alias("n"))
    return S.parent_child(child, parent).select("x", "y", "parent_x", "parent_y", "parent_n")


@query(
    "deepest_containing_tile",
    f"""WITH {X.GRANULES_SQL}, b AS (SELECT id, west + 0.1 AS west, south + 0.1 AS south, west + 0.1 + (id % 13) / 50.0 AS east, south + 0.1 + (id % 7) / 40.0 AS north FROM granules),
z AS (SELECT *, unnest(generate_series(0, 24)) AS z FROM b),
t AS (SELECT id, z, {lon_x('west', 'z')} AS x0, {lon_x('east', 'z')} AS x1, {lat_y('north', 'z')} AS y0, {lat_y('south', 'z')} AS y1 FROM z)
SELECT id, CAST(max(z) AS INTEGER) AS z, arg_max(x0, z) AS x, arg_max(y0, z) AS y FROM t WHERE x0 = x1 AND y0 = y1 GROUP BY id""",
)
def deepest_containing_tile(spark, sf):
    i, w, s = F.col("id"), F.col("bbox.west") + 0.1, F.col("bbox.south") + 0.1
    t = S.deepest_containing_tile(w, s, w + (i % 13) / F.lit(50.0), s + (i % 7) / F.lit(40.0))
    return _g(spark, sf).select("id", t.alias("t")).select("id", "t.z", "t.x", "t.y")


@query(
    "footprint_geojson",
    f"""WITH {X.GRANULES_SQL} SELECT id, 'Polygon' AS kind, 5 AS points, west AS first_x, south AS first_y, east AS third_x, north AS third_y FROM granules WHERE south <= north""",
)
def footprint_geojson(spark, sf):
    df = _g(spark, sf).select("id", C.footprint_geojson().alias("doc")).where("doc IS NOT NULL")
    df = df.withColumn("d", F.from_json("doc", "type string, coordinates array<array<array<double>>>"))
    ring = F.col("d.coordinates")[0]
    return df.select("id", F.col("d.type").alias("kind"), F.size(ring).alias("points"), ring[0][0].alias("first_x"), ring[0][1].alias("first_y"), ring[2][0].alias("third_x"), ring[2][1].alias("third_y"))


# --- documents ---


@query(
    "stac_items",
    f"""WITH {X.FILES_SQL}, {X.GRANULES_SQL}, n AS (SELECT id, count(*) AS assets, min(href) AS first_href FROM files GROUP BY id)
SELECT CAST(g.id AS VARCHAR) AS id, dataset AS collection, strftime(dt, '%Y-%m-%dT%H:%M:%SZ') AS datetime, west, north, assets, first_href FROM granules g JOIN n ON n.id = g.id""",
)
def stac_items(spark, sf):
    docs = SG.to_stac_items(X.granule_assets(spark, sf))
    d = lambda p: F.get_json_object("doc", p)
    assets = F.from_json(d("$.assets"), "map<string,struct<href:string>>")
    return docs.select(
        d("$.id").alias("id"), d("$.collection").alias("collection"), d("$.properties.datetime").alias("datetime"),
        d("$.bbox[0]").cast("double").alias("west"), d("$.bbox[3]").cast("double").alias("north"),
        F.size(assets).cast("long").alias("assets"), F.array_min(F.transform(F.map_values(assets), lambda a: a["href"])).alias("first_href"),
    )


@query(
    "stac_collections",
    f"""WITH {X.GRANULES_SQL}, {DATASETS_SQL}, e AS (SELECT dataset, min(dt) AS a, max(west) AS unused, min(west) AS west, max(north) AS north FROM granules GROUP BY dataset)
SELECT id, 'CC0-1.0' AS license, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS t_start, west, north, array_to_string(bands, ',') AS bands FROM datasets JOIN e ON e.dataset = id""",
)
def stac_collections(spark, sf):
    healed = C.heal_extents(X.datasets(spark, sf), _g(spark, sf)).withColumn("layers", F.array().cast("array<string>"))
    back = SG.from_stac_collections(SG.to_stac_collections(healed)).where("issue IS NULL")
    return back.select("id", "license", TM.from_unix_millis(TM.instant_ms("t_start")).alias("t_start"), F.col("bbox.west").alias("west"), F.col("bbox.north").alias("north"), F.array_join("bands", ",").alias("bands"))


@query(
    "stac_collection_layers",
    f"""WITH {DATASETS_SQL}, b AS (SELECT id, unnest(bands) AS band FROM datasets)
SELECT id, id || '/' || band AS layer, band, CAST(length(band) AS DOUBLE) / 2 AS high FROM b""",
)
def stac_collection_layers(spark, sf):
    layer = lambda b: F.struct(F.concat("id", F.lit("/"), b).alias("name"), F.array(b).alias("bands"), (F.length(b) / 2).alias("high"))
    healed = C.heal_extents(X.datasets(spark, sf), _g(spark, sf)).withColumn("layers", F.transform("bands", layer))
    kind = "array<struct<name:string,bands:array<string>,high:double>>"
    back = SG.from_stac_collections(SG.to_stac_collections(healed), layers=kind).where("issue IS NULL")
    return back.select("id", F.explode("layers").alias("l")).select("id", F.col("l.name").alias("layer"), F.col("l.bands")[0].alias("band"), "l.high")


@query(
    "from_stac_items",
    f"""WITH {X.FILES_SQL}, {X.GRANULES_SQL}, n AS (SELECT id, count(*) AS assets FROM files GROUP BY id)
SELECT g.id, CASE g.id % 6 WHEN 1 THEN 'type' WHEN 2 THEN 'stac_version' WHEN 3 THEN 'properties.datetime' WHEN 4 THEN 'assets.href' END AS issue,
  CASE WHEN g.id % 6 IN (0, 5) THEN dt_ms END AS dt_ms, CASE WHEN g.id % 6 IN (0, 5) THEN east END AS east, CASE WHEN g.id % 6 IN (0, 5) THEN assets END AS assets FROM granules g JOIN n ON n.id = g.id""",
)
def from_stac_items(spark, sf):
    docs = SG.to_stac_items(X.granule_assets(spark, sf))
    k = F.col("id") % 6
    broken = (
        F.when(k == 1, F.replace("doc", F.lit('"Feature"'), F.lit('"Thing"')))
        .when(k == 2, F.replace("doc", F.lit('"1.1.0"'), F.lit('"0.9"')))
        .when(k == 3, F.replace("doc", F.lit("T00:00:00Z"), F.lit(" 00:00")))
        .when(k == 4, F.replace("doc", F.lit('"href"'), F.lit('"url"')))
        .otherwise(F.col("doc"))
    )
    back = SG.from_stac_items(docs.withColumn("doc", broken)).where("id IS NOT NULL")
    fine = F.col("issue").isNull()
    return back.select(
        F.col("id").cast("long").alias("id"), "issue", F.when(fine, TM.instant_ms("datetime")).alias("dt_ms"),
        F.when(fine, F.col("bbox.east")).alias("east"), F.when(fine, F.size("assets")).cast("long").alias("assets"),
    )


@query(
    "expand_legacy_assets",
    f"""WITH {X.FILES_SQL}, f AS (SELECT *, split_part(href, '#', 1) AS file FROM files)
SELECT id, band, CASE WHEN file LIKE '%.tif' THEN href ELSE file || '.vmanifest.json' || CASE WHEN contains(href, '#') THEN '#' || split_part(href, '#', 2) ELSE '' END END AS href,
  CASE WHEN file LIKE '%.tif' THEN 'raster' ELSE 'virtual_cube' END AS kind FROM f""",
)
def expand_legacy_assets(spark, sf):
    wide = SG.expand_legacy_assets(X.granule_assets(spark, sf))
    return wide.select("id", F.explode("assets").alias("band", "a")).select("id", "band", "a.href", "a.kind")


@query(
    "legacy_files",
    f"""WITH {X.FILES_SQL} SELECT DISTINCT split_part(href, '#', 1) AS file FROM files WHERE split_part(href, '#', 1) NOT LIKE '%.tif'""",
)
def legacy_files(spark, sf):
    return SG.legacy_files(X.granule_assets(spark, sf))
