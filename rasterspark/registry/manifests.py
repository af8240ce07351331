"""Image directories, byte-range manifests, grid metadata text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..session import deal_out, tasks_for
from ..sources import manifests as MF
from ..sources import rasters as RS
from . import query

# Every order is a file; its lines are the file's image directories.
IFDS_SQL = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS ifd FROM lineitem),
ifds AS (SELECT l_orderkey AS path, ifd, CASE WHEN ifd = 0 THEN 1000 + l_orderkey % 500 ELSE greatest(1, (1000 + l_orderkey % 500) // CAST(power(2, ifd) AS BIGINT)) END AS width, l_partkey, l_suppkey FROM lines)"""


def ifds(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    lines = X.table(spark, sf, "lineitem").withColumn("ifd", (F.row_number().over(order) - 1).cast("long"))
    full = 1000 + F.col("l_orderkey") % 500
    part = F.col("l_partkey")
    arr = lambda v: F.array(v, v)
    fmt = F.element_at(F.array(*map(F.lit, ("Uint", "Int", "Float", "Uint"))), (part % 4 + 1).cast("int"))
    bits = F.element_at(F.array(*map(F.lit, (8, 16, 32, 12))), (part % 4 + 1).cast("int"))
    return lines.select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("path"),
        "ifd",
        F.when(F.col("ifd") == 0, full).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(full / F.pow(F.lit(2.0), F.col("ifd"))))).alias("width"),
        (full + 10).alias("height"),
        F.when(F.col("ifd") == 0, 0).otherwise(F.when(part % 7 == 0, 2).otherwise(1)).alias("subfile"),
        F.when(part % 11 == 0, F.array(F.lit(8), F.lit(16))).otherwise(arr(bits)).alias("bits"),
        arr(fmt).alias("fmt"),
        F.lit(30.0).alias("sx"),
        F.lit(30.0).alias("sy"),
        F.col("l_suppkey").cast("double").alias("i"),
        F.lit(2.0).alias("j"),
        (part * 100).cast("double").alias("x"),
        F.lit(5000.0).alias("y"),
        F.when(part % 13 != 0, (32600 + part % 60).cast("int")).alias("epsg"),
        F.when(part % 5 == 0, F.lit(" -9999 ")).when(part % 5 == 1, "nan?").alias("nodata"),
        F.lit(2).alias("bands"),
    )


@query(
    "raster_info",
    f"""WITH {IFDS_SQL}, p AS (SELECT * FROM ifds WHERE ifd = 0), o AS (SELECT i.path, string_agg(DISTINCT CAST(round(p.width / CAST(i.width AS DOUBLE)) AS INTEGER), ',' ORDER BY CAST(round(p.width / CAST(i.width AS DOUBLE)) AS INTEGER)) AS levels
  FROM ifds i JOIN p ON p.path = i.path WHERE i.ifd > 0 AND i.l_partkey % 7 <> 0 GROUP BY i.path)
SELECT 'f' || p.path AS asset, width, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 'uint8' WHEN l_partkey % 4 = 1 THEN 'int16' WHEN l_partkey % 4 = 2 THEN 'float32' END AS dtype,
  CASE WHEN l_partkey % 5 = 0 THEN -9999.0::DOUBLE END AS nodata, CAST(l_partkey * 100 - l_suppkey * 30 AS DOUBLE) AS origin_x, 5060.0::DOUBLE AS origin_y, coalesce(levels, '') AS levels,
  CASE WHEN l_partkey % 11 = 0 THEN 'mixed per-sample dtypes' WHEN l_partkey % 4 = 3 THEN 'unsupported sample format' WHEN l_partkey % 13 = 0 THEN 'no EPSG code' WHEN l_partkey % 5 = 1 THEN 'unparseable nodata' END AS issue
FROM p LEFT JOIN o ON o.path = p.path""",
)
def raster_info(spark, sf):
    r = RS.raster_info(ifds(spark, sf))
    return r.select("asset", "width", "dtype", "nodata", F.col("transform.c").alias("origin_x"), F.col("transform.f").alias("origin_y"), F.array_join("overview_levels", ",").alias("levels"), "issue")


@query(
    "tile_refs",
    """WITH r AS (SELECT c_custkey AS asset, 500 + c_custkey % 300 AS w, 400 + c_custkey % 90 AS h FROM customer WHERE c_custkey % 10 NOT IN (3, 7)),
g AS (SELECT asset, nx, cy, unnest(generate_series(0, nx - 1)) AS cx FROM (SELECT asset, CAST(ceil(w / 256.0) AS BIGINT) AS nx, unnest(generate_series(0, CAST(ceil(h / 256.0) AS BIGINT) - 1)) AS cy FROM r))
SELECT 'c' || asset AS path, cy || '.' || cx AS key, CASE WHEN (cy * nx + cx) < 5 THEN (cy * nx + cx) * 1000 + asset END AS "offset", CASE WHEN (cy * nx + cx) < 5 THEN 900 + asset % 50 END AS length FROM g""",
)
def tile_refs(spark, sf):
    c = F.col("c_custkey")
    name = F.concat(F.lit("c"), c.cast("string"))
    r = X.table(spark, sf, "customer").select(
        name.alias("asset"), F.lit(0).alias("level"), (500 + c % 300).alias("width"), (400 + c % 90).alias("height"),
        F.when(c % 10 != 3, 256).alias("tile_w"), F.when(c % 10 != 3, 256).alias("tile_h"), (c % 10 == 7).alias("planar"),
    )
    blocks = X.table(spark, sf, "customer").select(
        name.alias("asset"), F.lit(0).alias("level"), c.alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("block")
    )
    blocks = blocks.select("asset", "level", "block", (F.col("block") * 1000 + F.col("_c")).alias("offset"), (900 + F.col("_c") % 50).alias("length"))
    return RS.tile_refs(r, blocks).select("path", "key", "offset", "length")


# --- manifests: suppliers are sources, parts are arrays, order lines are chunks ---

REFS_SQL = """ra AS (SELECT l_suppkey AS source, l_partkey AS name, l_orderkey || '.' || l_linenumber AS key, min(l_orderkey * 100) AS "offset", max(l_partkey + 10) AS length FROM lineitem GROUP BY ALL),
rb AS (SELECT source, name, key, "offset" + CASE WHEN length % 97 = 0 THEN 1 ELSE 0 END AS "offset", length FROM ra WHERE "offset" % 1300 <> 0 AND name % 50 <> 49)"""


#: Order lines of a task; what a task holds then stays the same as the table grows.
LINES_PER_TASK = 500_000


def _tasks(spark, sf):
    return tasks_for(spark, X.table(spark, sf, "lineitem").count(), LINES_PER_TASK)


def _refs(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("name"),
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        (F.col("l_orderkey") * 100).alias("_o"), (F.col("l_partkey") + 10).alias("_l"),
    )
    lines = deal_out(lines, "source", "name", "key", tasks=_tasks(spark, sf))
    a = lines.groupBy("source", "name", "key").agg(F.min("_o").alias("offset"), F.max("_l").alias("length"))
    shifted = F.col("offset") + F.when(F.col("length") % 97 == 0, 1).otherwise(0)
    b = a.where("offset % 1300 <> 0 AND name % 50 <> 49").withColumn("offset", shifted)
    return a, b


def _manifest_arrays(refs, changed: bool, tasks: int):
    k = F.col("name")
    codec = F.concat(F.lit("zlib:"), (k % 9).cast("string"))
    shape = F.array(k + 1, F.lit(64).cast("long"))
    return deal_out(refs.select("source", "name"), "source", "name", tasks=tasks).distinct().select(
        "source", "name", shape.alias("shape"), F.array(F.lit(16).cast("long"), F.lit(16).cast("long")).alias("chunks"),
        (F.when(k % 40 == 3, "float32").otherwise("int16") if changed else F.lit("int16")).alias("dtype"), F.array(F.lit("shuffle"), codec).alias("codecs"),
    )


@query(
    "compare_refs",
    f"""WITH {REFS_SQL}, n AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM (SELECT source, name, count(*) AS n FROM ra GROUP BY ALL) a FULL JOIN (SELECT source, name, count(*) AS n FROM rb GROUP BY ALL) b ON a.source = b.source AND a.name = b.name)
SELECT a.source, a.name, a.key, CASE WHEN b.key IS NULL THEN 'missing in B' ELSE 'offset/length differs' END AS issue FROM ra a LEFT JOIN rb b ON b.source = a.source AND b.name = a.name AND b.key = a.key WHERE b.key IS NULL OR a."offset" <> b."offset" OR a.length <> b.length
UNION ALL SELECT source, name, NULL, 'ref count differs' FROM n WHERE na <> nb""",
)
def compare_refs(spark, sf):
    return MF.compare_refs(*_refs(spark, sf))


@query(
    "compare_manifests",
    f"""WITH {REFS_SQL}, aa AS (SELECT DISTINCT source, name FROM ra), ab AS (SELECT DISTINCT source, name, name % 40 = 3 AS changed FROM rb),
g AS (SELECT aa.source, count(*) AS arrays_a, count(ab.name) AS arrays_b, count(ab.name) AS matched_arrays, count(CASE WHEN ab.name IS NULL OR changed THEN 1 END) AS grid_mismatches FROM aa LEFT JOIN ab ON ab.source = aa.source AND ab.name = aa.name GROUP BY aa.source),
x AS (SELECT a.source, a.name, count(*) AS na, count(b.key) AS nb, count(CASE WHEN b.key IS NULL OR a."offset" <> b."offset" OR a.length <> b.length THEN 1 END) AS bad FROM ra a JOIN ab ON ab.source = a.source AND ab.name = a.name LEFT JOIN rb b ON b.source = a.source AND b.name = a.name AND b.key = a.key GROUP BY ALL),
c AS (SELECT source, sum(bad + CASE WHEN na <> nb THEN 1 ELSE 0 END) AS n FROM x GROUP BY source)
SELECT g.source, arrays_a, arrays_b, matched_arrays, grid_mismatches, CAST(coalesce(n, 0) AS BIGINT) AS chunk_mismatches, arrays_a = arrays_b AND matched_arrays = arrays_a AND grid_mismatches = 0 AND coalesce(n, 0) = 0 AS equivalent FROM g LEFT JOIN c ON c.source = g.source""",
)
def compare_manifests(spark, sf):
    a, b = _refs(spark, sf)
    tasks = _tasks(spark, sf)
    return MF.compare_manifests(_manifest_arrays(a, False, tasks), a, _manifest_arrays(b, True, tasks), b, tasks)


@query("manifest_summary", f"WITH {REFS_SQL} SELECT source, count(DISTINCT name) AS arrays, count(*) AS refs FROM ra GROUP BY source")
def manifest_summary(spark, sf):
    return MF.manifest_summary(_refs(spark, sf)[0])


@query(
    "commit_report",
    """WITH a AS (SELECT p_partkey AS name, CASE p_partkey % 6 WHEN 0 THEN '|S' || p_size ELSE 'int16' END AS dtype, CASE p_partkey % 5 WHEN 0 THEN 'zlib:' || p_size WHEN 1 THEN 'zlib:x' WHEN 2 THEN 'szip' END AS codec FROM part)
SELECT name, CASE WHEN name % 6 = 0 THEN 'dtype `' || dtype || '` is not a sample type of the store' WHEN codec = 'zlib:x' THEN 'compression level `x` is no whole number of a byte' WHEN codec = 'szip' THEN 'filter `szip` is unknown to the store' END AS reason FROM a""",
)
def commit_report(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    dtype = F.when(k % 6 == 0, F.concat(F.lit("|S"), size)).otherwise("int16")
    second = F.when(k % 5 == 0, F.concat(F.lit("zlib:"), size)).when(k % 5 == 1, "zlib:x").when(k % 5 == 2, "szip")
    codecs = F.when(second.isNull(), F.array(F.lit("shuffle"))).otherwise(F.array(F.lit("shuffle"), second))
    arrays = X.table(spark, sf, "part").select(k.alias("name"), dtype.alias("dtype"), codecs.alias("codecs"))
    return MF.commit_report(arrays).select("name", "reason")


@query(
    "unique_names",
    """WITH a AS (SELECT o_custkey AS source, o_orderstatus AS name, o_orderkey AS "offset" FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY "offset") - 1 AS k FROM a)
SELECT source, "offset", name || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS unique_name FROM n""",
)
def unique_names(spark, sf):
    a = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("name"), F.col("o_orderkey").alias("offset"))
    return MF.unique_names(a, ["source"]).select("source", "offset", "unique_name")


@query(
    "parse_eos_grids",
    """SELECT p_partkey AS id, 'GRID_' || g AS block, 'grid' || p_partkey AS name, CAST(p_size AS BIGINT) AS xdim, CASE WHEN p_partkey % 4 = 1 OR g = 2 THEN NULL ELSE '+proj=sinu +lon_0=0 +x_0=0 +y_0=0 +R=6371007.181 +units=m +no_defs' END AS crs,
  CASE WHEN p_partkey % 4 = 1 OR g = 2 THEN NULL ELSE 100.0::DOUBLE END AS cell_w, CASE WHEN p_partkey % 4 = 1 OR g = 2 THEN NULL ELSE -50.0::DOUBLE END AS cell_h,
  CASE WHEN g = 2 THEN 'missing YDim' WHEN p_partkey % 4 = 1 THEN 'unsupported projection' END AS issue FROM part, (VALUES (1), (2)) AS v(g)""",
)
def parse_eos_grids(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    fixed = lambda c: F.format_string("%.6f", c.cast("double"))
    projection = F.when(k % 4 == 1, "HE5_GCTP_UTM").otherwise("HE5_GCTP_SNSOID")

    def block(n: int, ydim):
        return F.concat(
            F.lit(f"\tGROUP=GRID_{n}\n\t\tGridName=\"grid"), s(k), F.lit('"\n\t\tXDim='), s(size), F.lit("\n"), ydim,
            F.lit("\t\tUpperLeftPointMtrs=("), fixed(k * 10), F.lit(",1000.000000)\n\t\tLowerRightMtrs=("), fixed(k * 10 + size * 100), F.lit(","), fixed(F.lit(1000) - k * 50 - 50),
            F.lit(")\n\t\tProjection="), projection, F.lit("\n\t\tProjParams=(6371007.181000,0,0,0)\n\t\tGridOrigin=HE5_HDFE_GD_UL\n\t\tGROUP=Dimension\n\t\t\tXDim=7\n\t\tEND_GROUP=Dimension\n"), F.lit(f"\tEND_GROUP=GRID_{n}\n"),
        )

    text = F.concat(
        F.lit("GROUP=GridStructure\n"), block(1, F.concat(F.lit("\t\tYDim="), s(k + 1), F.lit("\n"))), block(2, F.lit("")), F.lit("END_GROUP=GridStructure\n")
    )
    parts = deal_out(X.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")  # short rows that become long texts
    grids = MF.parse_eos_grids(parts.select(k.alias("id"), text.alias("text")), "id", "text")
    return grids.select("id", "block", "name", "xdim", "crs", F.col("transform.a").alias("cell_w"), F.col("transform.e").alias("cell_h"), "issue")
