"""Explicit schemas of the tables the package works on. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


BBOX = _struct(
    ("west", T.DoubleType()), ("south", T.DoubleType()), ("east", T.DoubleType()), ("north", T.DoubleType())
)

ASSET = _struct(("href", T.StringType()), ("kind", T.StringType()))

# north-up or rotated affine: x = a*col + b*row + c, y = d*col + e*row + f
TRANSFORM = _struct(*[(name, T.DoubleType()) for name in ("a", "b", "c", "d", "e", "f")])

PLAN = _struct(
    ("kind", T.StringType()),
    ("r", T.StringType()),
    ("g", T.StringType()),
    ("b", T.StringType()),
    ("expression", T.StringType()),
    ("code_hash", T.StringType()),
)

LAYER = _struct(
    ("id", T.StringType()),
    ("title", T.StringType()),
    ("inputs", T.ArrayType(T.StringType())),
    ("plan", PLAN),
    ("rescale_min", T.DoubleType()),
    ("rescale_max", T.DoubleType()),
    ("colormap", T.StringType()),
    ("resampling", T.StringType()),
    ("tile_size", T.IntegerType()),
)

DATASETS = _struct(
    ("id", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("license", T.StringType()),
    ("bbox", BBOX),
    ("t_start", T.TimestampType()),
    ("t_end", T.TimestampType()),
    ("bands", T.ArrayType(T.StringType())),
    ("layers", T.ArrayType(LAYER)),
)

GRANULES = _struct(
    ("dataset", T.StringType()),
    ("id", T.StringType()),
    ("bbox", BBOX),
    ("datetime", T.TimestampType()),
    ("assets", T.MapType(T.StringType(), ASSET)),
    ("ingested_at", T.TimestampType()),
)

RASTERS = _struct(
    ("asset", T.StringType()),
    ("crs", T.StringType()),
    ("width", T.LongType()),
    ("height", T.LongType()),
    ("transform", TRANSFORM),
    ("band_count", T.IntegerType()),
    ("dtype", T.StringType()),
    ("nodata", T.DoubleType()),
    ("overview_levels", T.ArrayType(T.IntegerType())),
)

CHUNKS = _struct(
    ("asset", T.StringType()),
    ("level", T.IntegerType()),
    ("cy", T.LongType()),
    ("cx", T.LongType()),
    ("h", T.IntegerType()),
    ("w", T.IntegerType()),
    ("values", T.ArrayType(T.DoubleType())),
)

# A drop manifest as it lies on disk. Unknown fields are a reason to quarantine.
DROP_MANIFEST = _struct(
    ("dataset", T.StringType()),
    ("granule", T.StringType()),
    ("bbox", T.ArrayType(T.DoubleType())),
    ("datetime", T.StringType()),
    ("assets", T.MapType(T.StringType(), T.StringType())),
)

CHUNK_REF = _struct(
    ("key", T.StringType()), ("path", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())
)

GEOREF = _struct(
    ("crs", T.StringType()),
    ("transform", TRANSFORM),
    ("nodata", T.DoubleType()),
    ("band", T.StringType()),
)

MANIFEST_ARRAY = _struct(
    ("name", T.StringType()),
    ("shape", T.ArrayType(T.LongType())),
    ("chunks", T.ArrayType(T.LongType())),
    ("dtype", T.StringType()),
    ("codecs", T.ArrayType(T.StringType())),
    ("georef", GEOREF),
    ("refs", T.ArrayType(CHUNK_REF)),
)

MANIFEST = _struct(
    ("manifest_version", T.IntegerType()),
    ("generator", T.StringType()),
    ("source", T.StringType()),
    ("arrays", T.ArrayType(MANIFEST_ARRAY)),
)

TIMINGS = _struct(
    *[(name, T.DoubleType()) for name in ("read_ms", "warp_ms", "pixel_ops_ms", "encode_ms", "total_ms")]
)

PROVENANCE = _struct(("path", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))

TEMPORAL = _struct(
    ("granule_id", T.StringType()),
    ("granule_datetime", T.StringType()),
    ("requested", T.StringType()),
    ("rule", T.StringType()),
)

# ``decision`` is a bare string or a one-key object, so it stays JSON text here.
TRACE = _struct(
    ("decision", T.StringType()),
    ("source", T.StringType()),
    ("sources", T.ArrayType(T.StringType())),
    ("crs_from", T.StringType()),
    ("crs_to", T.StringType()),
    ("bytes_read", T.LongType()),
    ("provenance", T.ArrayType(PROVENANCE)),
    ("timings", TIMINGS),
    ("ingest_to_pixel_ms", T.LongType()),
    ("temporal", TEMPORAL),
)

TRACE_ENVELOPE = _struct(
    ("id", T.LongType()), ("tile", T.StringType()), ("layer", T.StringType()), ("trace", TRACE)
)
