"""RGBA images as rows: comparison and packing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = ("r", "g", "b", "a")

# Comparison defaults, difference per channel and share of bad pixels.
TOLERANCE = 2
MAX_BAD_SHARE = 0.005


def image_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per pixel the largest and the summed channel difference of two images.

    Pixels only one side has carry NULL differences, which ``diff_report`` counts as a size mismatch.
    """
    b = right.select(*keys, "row", "col", *[F.col(c).alias(f"_{c}") for c in CHANNELS])
    both = left.select(*keys, "row", "col", *CHANNELS).join(b, [*keys, "row", "col"], "full")
    apart = [F.abs(F.col(c).cast("int") - F.col(f"_{c}").cast("int")) for c in CHANNELS]
    paired = F.col("a").isNotNull() & F.col("_a").isNotNull()
    return both.select(
        *keys,
        "row",
        "col",
        F.when(paired, F.greatest(*apart)).alias("max_diff"),
        F.when(paired, apart[0] + apart[1] + apart[2] + apart[3]).alias("sum_diff"),
    )


def diff_report(diff: DataFrame, keys: list[str], tolerance: int = TOLERANCE, max_bad: float = MAX_BAD_SHARE) -> DataFrame:
    """Per image: pixels, largest and mean channel difference, bad share, verdict."""
    bad = F.count_if(F.col("max_diff") > tolerance)
    report = diff.groupBy(*keys).agg(
        F.count("*").alias("pixels"),
        F.max("max_diff").alias("max_abs_diff"),
        F.try_divide(F.sum("sum_diff").cast("double"), F.count("*") * 4).alias("mean_abs_diff"),
        F.try_divide(bad.cast("double"), F.count("*")).alias("bad_share"),
        (F.count("max_diff") == F.count("*")).alias("same_size"),
    )
    return report.withColumn("passes", F.col("same_size") & (F.col("bad_share") <= max_bad))


def diff_histogram(diff: DataFrame, keys: list[str]) -> DataFrame:
    """How many pixels differ by exactly d at most."""
    return diff.where(F.col("max_diff").isNotNull()).groupBy(*keys, "max_diff").agg(F.count("*").alias("pixels"))


@F.pandas_udf(T.BinaryType())
def _ordered_rgba(positions: pd.Series, words: pd.Series) -> pd.Series:
    """Packed colours in order of position."""
    one = lambda at, word: np.asarray(word, np.int64)[np.argsort(np.asarray(at, np.int64), kind="stable")].astype(">u4").tobytes()
    return pd.Series([one(*r) for r in zip(positions, words)], dtype=object)


def pack_tiles(pixels: DataFrame, keys: list[str], size: Column | int) -> DataFrame:
    """``keys..., rgba`` (row-major bytes), ``complete`` when every pixel of the tile was there.

    A tile gathers ``size * size`` pixels of one packed colour each, put in order by numpy.
    """
    width = size if isinstance(size, Column) else F.lit(size)
    shifted = [F.col(c).cast("long") * (1 << shift) for c, shift in zip(CHANNELS, (24, 16, 8, 0))]
    cell = F.struct((F.col("row") * width + F.col("col")).cast("int").alias("pos"), (shifted[0] + shifted[1] + shifted[2] + shifted[3]).alias("word"))
    tiles = pixels.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"), F.max((width * width).cast("int")).alias("_n"))
    complete = F.size(F.array_distinct("_cells.pos")) == F.col("_n")
    return tiles.select(*keys, _ordered_rgba("_cells.pos", "_cells.word").alias("rgba"), complete.alias("complete"))


def _png_bytes(rgba: bytes, size: int) -> bytes:
    """A truecolour-with-alpha PNG with no row filters."""
    rows = np.frombuffer(rgba, dtype=np.uint8).reshape(size, size * 4)
    raw = np.concatenate([np.zeros((size, 1), np.uint8), rows], axis=1).tobytes()

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", size, size, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def encode_png(tiles: DataFrame, size: int) -> DataFrame:
    """Add ``png`` bytes to packed tiles."""
    schema = T.StructType([*tiles.schema.fields, T.StructField("png", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["png"] = [_png_bytes(bytes(b), size) for b in batch["rgba"]]
            yield batch

    return tiles.mapInPandas(run, schema)
