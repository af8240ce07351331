"""Writing pyramids, tiles and traces, and reading traces back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import pack_chunks
from ..operators.images import encode_png, pack_tiles
from ..operators.traces import parse_traces, trace_json
from ..session import cut_lineage

#: What a stored level was made of and how; another value of any of these is another pyramid.
IDENTITY = ["width", "height", "dtype", "chunk", "resampling", "layout", "fingerprint"]
#: Version of the stored layout.
LAYOUT = 1
#: Folders that the assets of a level, and the tiles of an exported level, are dealt to.
ASSET_BUCKETS = 64
TILE_BUCKETS = 256

_BLOCKS = "asset string, cy long, cx long, h int, w int, values array<double>, factor int, bucket int"
_RECORDS = "asset string, factor int, width long, height long, dtype string, chunk int, resampling string, layout int, fingerprint string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A stored table, or None where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def stored_pyramid(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``read_pyramid`` gives, or None where nothing is stored yet."""
    blocks = _stored(spark, path, _BLOCKS)
    return None if blocks is None else blocks.select("asset", "factor", "cy", "cx", "h", "w", "values")


def append_blocks(blocks: DataFrame, path: str) -> None:
    """Add blocks (``asset, factor, cy, cx, h, w, values``) that are not stored yet; stored ones stay as they are.

    A stored block with other samples than the one given fails the job before anything is written: it
    describes another raster, which needs a path of its own.
    """
    stored = stored_pyramid(blocks.sparkSession, path)
    key = ["asset", "factor", "cy", "cx"]
    if stored is not None:
        blocks = cut_lineage(blocks)
        digest = lambda name: F.xxhash64("h", "w", F.col("values").cast("array<double>")).alias(name)
        both = blocks.select(*key, digest("_new")).join(stored.select(*key, digest("_old")), key)
        if changed := both.where("_new <> _old").select("asset", "factor").distinct().limit(5).collect():
            names = ", ".join(f"{r['asset']} at {r['factor']}" for r in changed)
            raise ValueError(f"stored blocks hold other samples: {names}")
        blocks = blocks.join(stored.select(*key), key, "left_anti")
    bucket = F.pmod(F.xxhash64("asset"), F.lit(ASSET_BUCKETS)).cast("int")
    blocks.withColumn("bucket", bucket).write.mode("append").partitionBy("factor", "bucket").parquet(path)


def write_pyramid(levels: DataFrame, path: str, chunk: int, fill: float = 0.0) -> None:
    """Persist levels (``asset, factor, row, col, value``) as padded blocks, resuming what is stored.

    Blocks appear with the job commit; those stored before, of these or other assets, are never touched,
    and a level that differs from its stored blocks is refused. ``materialize`` also keeps identities.
    """
    append_blocks(pack_chunks(levels, ["asset", "factor"], chunk, fill), path)


def read_pyramid(spark: SparkSession, path: str) -> DataFrame:
    """Stored blocks ``asset, factor, cy, cx, h, w, values``."""
    return spark.read.schema(_BLOCKS).parquet(path).select("asset", "factor", "cy", "cx", "h", "w", "values")


def content_fingerprint(blocks: DataFrame) -> DataFrame:
    """``asset, fingerprint`` of the samples of full-resolution blocks; their order does not matter."""
    row = F.xxhash64("cy", "cx", F.col("values").cast("array<double>")).cast("decimal(38,0)")
    total = F.concat_ws("-", F.sum(row).cast("string"), F.bit_xor(F.xxhash64(F.lit(1), "cy", "cx", F.col("values").cast("array<double>"))).cast("string"))
    return blocks.groupBy("asset").agg(total.alias("fingerprint"))


def reference_fingerprint(refs: DataFrame) -> DataFrame:
    """``asset, fingerprint`` of where full-resolution blocks are stored, for files that never change in place; reads no samples."""
    return content_fingerprint(refs.where("level = 1").withColumn("values", F.array(F.xxhash64("path", "offset", "length").cast("double"))))


def stored_identities(spark: SparkSession, path: str) -> DataFrame:
    """``asset, factor`` of complete levels with their identity. The records lie in a hidden folder beside the blocks."""
    records = _stored(spark, f"{path}/_identity", _RECORDS)
    return spark.createDataFrame([], _RECORDS) if records is None else records


def record_identities(levels: DataFrame, path: str) -> None:
    """Say that levels (``asset, factor`` and identity) are complete; to be called after their blocks are stored."""
    levels.select("asset", "factor", *IDENTITY).write.mode("append").parquet(f"{path}/_identity")


def pyramid_conflicts(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``asset, factor`` whose stored level describes another raster and must not be resumed."""
    old = stored.select("asset", "factor", F.struct(*IDENTITY).alias("_old"))
    both = wanted.select("asset", "factor", F.struct(*(F.col(c).cast(t) for c, t in _IDENTITY_TYPES.items())).alias("_new")).join(old, ["asset", "factor"])
    return both.where(~F.col("_new").eqNullSafe(F.col("_old"))).select("asset", "factor")


_IDENTITY_TYPES = {n: t for n, t in (c.split() for c in _RECORDS.split(", ")) if n in IDENTITY}


def export_tiles(pixels: DataFrame, path: str, size: int, png: bool = False) -> None:
    """Write packed tiles under ``layer=/z=/bucket=``; an incomplete tile fails the job.

    A tile replaces its stored self; all others stay. Only the buckets that new tiles fall into are
    written again, each with the stored tiles it keeps.
    """
    spark = pixels.sparkSession
    tiles = pack_tiles(pixels, ["layer", "z", "x", "y"], size)
    message = F.concat(F.lit("incomplete tile "), F.concat_ws("/", "layer", "z", "x", "y"))
    out = tiles.withColumn("rgba", F.when(F.col("complete"), F.col("rgba")).otherwise(F.raise_error(message).cast("binary"))).drop("complete")
    if png:
        out = encode_png(out, size)
    kinds = {"layer": "string", "z": "int", "x": "long", "y": "long"}
    bucket = F.pmod(F.xxhash64("x", "y"), F.lit(TILE_BUCKETS)).cast("int").alias("bucket")
    out = out.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), *[c for c in out.columns if c not in kinds]).select("*", bucket)
    stored = _stored(spark, path, "x long, y long, rgba binary, png binary, layer string, z int, bucket int")
    if stored is not None:
        out = cut_lineage(out)
        home = ["layer", "z", "bucket"]
        kept = stored.join(out.select(*home).distinct(), home, "left_semi").join(out.select("layer", "z", "x", "y"), ["layer", "z", "x", "y"], "left_anti")
        out = out.unionByName(cut_lineage(kept), allowMissingColumns=True)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "z", "bucket").parquet(path)


def write_traces(traces: DataFrame, path: str) -> None:
    """Envelopes as JSON lines."""
    trace_json(traces).write.mode("append").text(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of JSON lines; malformed rows are dropped."""
    return parse_traces(spark.read.text(path))
