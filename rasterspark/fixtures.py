"""Raster, catalog and trace tables derived from the given parquet tables, for checks and the bench.

Values are cast to whole numbers before they are summed, so two engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = {"A": "red", "N": "nir", "R": "green"}

# The five order priorities stand for five datasets.
DATASETS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _band():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "red").when(flag == "N", "nir").otherwise("green")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: a three-band raster with holes: ``row, col, band, value``."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 64).alias("col"), _band().alias("band"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: R1 per ship year."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.year("l_shipdate").alias("year"),
            F.col("l_suppkey").alias("row"),
            (F.col("l_partkey") % 64).alias("col"),
            _band().alias("band"),
        )
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3: a dense 64-wide raster: ``row, col, value``."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return cells.select("row", F.col("col").cast("long").alias("col"), F.round(F.col("v").cast("double") * 1000, 0).cast("int").alias("value"))


def granules(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """G1: acquisitions with footprints: ``id, dataset, datetime, bbox`` (from a stream when given)."""
    west = F.lit(-180.0) + (F.col("o_orderkey") % 350)
    south = F.lit(-80.0) + (F.col("o_custkey") % 150)
    return (orders if orders is not None else table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderdate").cast("timestamp").alias("datetime"),
        F.struct(
            west.alias("west"),
            south.alias("south"),
            (west + 1 + F.col("o_orderkey") % 10).alias("east"),
            (south + 1 + F.col("o_custkey") % 10).alias("north"),
        ).alias("bbox"),
    )


def granule_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with an asset map: every order line's return flag is a band file."""
    files = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"), _band().alias("band"))
        .agg(F.max("l_partkey").alias("part"))
    )
    ext = F.element_at(F.array(*[F.lit(e) for e in ("tif", "h5", "nc", "grib2")]), (F.col("part") % 4 + 1).cast("int"))
    href = F.concat(
        F.lit("s"), F.col("id").cast("string"), F.lit("/p"), F.col("part").cast("string"), F.lit("."), ext,
        F.when(F.col("part") % 4 == 0, "").otherwise(F.concat(F.lit("#"), F.col("band"))),
    )
    asset = F.struct(href.alias("href"), F.lit("raster").alias("kind"))
    maps = files.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("band", asset))).alias("assets"))
    return granules(spark, sf_dir).join(maps, "id").withColumn("ingested_at", F.lit(None).cast("timestamp"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order priority, declaring the bands its lines carry most often (two of three)."""
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("id")).distinct()
    bands = F.when(F.col("id").rlike("^[135]"), F.array(F.lit("nir"), F.lit("red"))).otherwise(
        F.array(F.lit("green"), F.lit("nir"), F.lit("red"))
    )
    return names.select(
        "id",
        F.concat(F.lit("title "), F.col("id")).alias("title"),
        F.lit("derived").alias("description"),
        F.lit("CC0-1.0").alias("license"),
        bands.alias("bands"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: frame requests: ``request_id, dataset, t_ms``."""
    names = F.array(*[F.lit(d) for d in DATASETS])
    shifted = F.unix_millis(F.col("ts").cast("timestamp")) + ((F.col("event_id") % 2400) - 10592).cast("long") * 86400000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("dataset"),
        shifted.alias("t_ms"),
    )


def traces(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """T1: render traces: ``id, layer, tile, decision, total_ms, bytes_read, ts`` (from a stream when given)."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("user_id") % 3
    return (events if events is not None else table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("layer"),
        F.concat(F.lit("7/"), (k % 10).cast("string"), F.lit("/"), F.floor(k / 10).cast("string")).alias("tile"),
        F.when(kind == 0, "cache_hit").when(kind == 1, "overview").otherwise("live").alias("decision"),
        F.col("value").alias("total_ms"),
        F.when(kind == 0, 0).otherwise(k * 1024).cast("long").alias("bytes_read"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


# --- the same tables in SQL, as common table expressions ---

PIXELS_SQL = """pixels AS (
  SELECT l_suppkey AS prow, l_partkey % 64 AS pcol,
         CASE l_returnflag WHEN 'A' THEN 'red' WHEN 'N' THEN 'nir' ELSE 'green' END AS band,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
  FROM lineitem GROUP BY ALL)"""

WIDE_SQL = PIXELS_SQL + """, wide AS (
  SELECT prow, pcol, max(CASE WHEN band = 'red' THEN value END) AS red,
         max(CASE WHEN band = 'nir' THEN value END) AS nir,
         max(CASE WHEN band = 'green' THEN value END) AS green
  FROM pixels GROUP BY ALL)"""

SERIES_SQL = """series AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, l_suppkey AS prow, l_partkey % 64 AS pcol,
         CASE l_returnflag WHEN 'A' THEN 'red' WHEN 'N' THEN 'nir' ELSE 'green' END AS band,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
  FROM lineitem GROUP BY ALL)"""

DENSE_SQL = """dense AS (
  SELECT vec_id AS prow, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS pcol,
         CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS INTEGER) AS value
  FROM embeddings)"""

GRANULES_SQL = """granules AS (
  SELECT o_orderkey AS id, o_orderpriority AS dataset, o_orderdate AS dt,
         CAST(epoch_ms(o_orderdate) AS BIGINT) AS dt_ms,
         -180.0::DOUBLE + o_orderkey % 350 AS west, -80.0::DOUBLE + o_custkey % 150 AS south,
         -180.0::DOUBLE + o_orderkey % 350 + 1 + o_orderkey % 10 AS east,
         -80.0::DOUBLE + o_custkey % 150 + 1 + o_custkey % 10 AS north
  FROM orders)"""

FILES_SQL = """parts AS (
  SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'red' WHEN 'N' THEN 'nir' ELSE 'green' END AS band,
         max(l_partkey) AS part
  FROM lineitem GROUP BY ALL),
files AS (
  SELECT p.id, o.o_orderpriority AS dataset, o.o_orderdate AS dt, band,
         's' || p.id || '/p' || part || '.' || CASE part % 4 WHEN 0 THEN 'tif' WHEN 1 THEN 'h5' WHEN 2 THEN 'nc' ELSE 'grib2' END
           || CASE WHEN part % 4 = 0 THEN '' ELSE '#' || band END AS href
  FROM parts p JOIN orders o ON o.o_orderkey = p.id)"""

REQUESTS_SQL = """requests AS (
  SELECT event_id AS request_id,
         CASE user_id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
              WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS dataset,
         CAST(floor(epoch_us(ts) / 1000) AS BIGINT) + (event_id % 2400 - 10592) * 86400000 AS t_ms
  FROM events)"""

TRACES_SQL = """traces AS (
  SELECT event_id AS id, event_type AS layer,
         '7/' || (k % 10) || '/' || (k // 10) AS tile,
         CASE user_id % 3 WHEN 0 THEN 'cache_hit' WHEN 1 THEN 'overview' ELSE 'live' END AS decision,
         value AS total_ms, CASE WHEN user_id % 3 = 0 THEN 0 ELSE k * 1024 END AS bytes_read, ts,
         CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
