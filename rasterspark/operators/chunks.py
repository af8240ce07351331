"""Chunked arrays: packing pixels into blocks, taking windows, filling what was never stored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import mask_nodata


def explode_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (``cy, cx, h, w, values``) to pixels (``row, col, value``)."""
    cells = chunks.select(*keys, "cy", "cx", "h", "w", F.posexplode("values").alias("_pos", "value"))
    return cells.select(
        *keys,
        (F.col("cy") * F.col("h") + F.floor(F.col("_pos") / F.col("w"))).alias("row"),
        (F.col("cx") * F.col("w") + F.col("_pos") % F.col("w")).alias("col"),
        "value",
    )


def _scatter(size: int, fill: float):
    """Lay collected (position, value) pairs of one block out row by row."""

    @F.pandas_udf("array<double>")
    def scatter(positions: pd.Series, values: pd.Series) -> pd.Series:
        def one(at, v):
            block = np.full(size * size, fill)
            block[np.asarray(at, dtype=np.int64)] = np.asarray(v, dtype=np.float64)
            return block

        return pd.Series([one(at, v) for at, v in zip(positions, values)])

    return scatter


def pack_chunks(pixels: DataFrame, keys: list[str], size: int, fill: float | None = None) -> DataFrame:
    """Pixels to full-size row-major blocks; absent and invalid pixels hold ``fill`` (default NULL).

    A block gathers at most ``size * size`` pixels; the scatter into it is one numpy assignment.
    """
    cell = F.struct(
        ((F.col("row") % size) * size + F.col("col") % size).cast("int").alias("pos"),
        F.col("value").cast("double").alias("v"),
    )
    blocks = (
        pixels.where(F.col("value").isNotNull())
        .groupBy(*keys, F.floor(F.col("row") / size).alias("cy"), F.floor(F.col("col") / size).alias("cx"))
        .agg(F.collect_list(cell).alias("_cells"))
    )
    scatter = _scatter(size, float("nan") if fill is None else fill)
    values = scatter(F.col("_cells.pos"), F.col("_cells.v"))
    if fill is None:
        values = F.transform(values, lambda v: F.when(~F.isnan(v), v))
    return blocks.select(*keys, "cy", "cx", F.lit(size).alias("h"), F.lit(size).alias("w"), values.alias("values"))


def chunk_grid(arrays: DataFrame, keys: list[str], shape: str = "shape", chunks: str = "chunks") -> DataFrame:
    """Every grid position of 2-D arrays: ``cy, cx, key`` (dotted, row by row)."""
    count = lambda i: F.ceil(F.get(shape, F.lit(i)) / F.get(chunks, F.lit(i))).cast("long")
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))
    grid = arrays.withColumn("cy", F.explode(steps(count(0)))).withColumn("cx", F.explode(steps(count(1))))
    return grid.select(*keys, "cy", "cx", F.concat_ws(".", F.col("cy").cast("string"), F.col("cx").cast("string")).alias("key"))


def chunks_touching(windows: DataFrame, keys: list[str], chunk_h: Column, chunk_w: Column) -> DataFrame:
    """Chunk positions each window (``col_off, row_off, width, height``) overlaps."""
    first = lambda off, size: F.floor(F.col(off) / size)
    last = lambda off, n, size: F.floor((F.col(off) + F.col(n) - 1) / size)
    span = windows.where((F.col("width") > 0) & (F.col("height") > 0))
    return (
        span.withColumn("cy", F.explode(F.sequence(first("row_off", chunk_h), last("row_off", "height", chunk_h))))
        .withColumn("cx", F.explode(F.sequence(first("col_off", chunk_w), last("col_off", "width", chunk_w))))
        .select(*keys, "cy", "cx")
    )


def read_windows(windows: DataFrame, chunks: DataFrame, keys: list[str], chunk_h: int, chunk_w: int) -> DataFrame:
    """Pixels of each window, by an equi-join on the chunks it touches.

    ``windows`` has ``window_id``, the shared ``keys`` and the rectangle; gives
    ``window_id, keys..., row, col, value`` in raster coordinates.
    """
    rect = ["col_off", "row_off", "width", "height"]
    touched = chunks_touching(windows, ["window_id", *keys, *rect], F.lit(chunk_h), F.lit(chunk_w))
    joined = touched.join(chunks, [*keys, "cy", "cx"])
    pixels = explode_chunks(joined, ["window_id", *keys, *rect])
    inside = (
        (F.col("row") >= F.col("row_off"))
        & (F.col("row") < F.col("row_off") + F.col("height"))
        & (F.col("col") >= F.col("col_off"))
        & (F.col("col") < F.col("col_off") + F.col("width"))
    )
    return pixels.where(inside).select("window_id", *keys, "row", "col", "value")


def fill_missing_chunks(grid: DataFrame, chunks: DataFrame, keys: list[str], nodata: Column) -> DataFrame:
    """Every grid position with its stored block, or a block of nodata (0 when there is none).

    ``grid`` has the keys, ``cy``, ``cx``, ``h``, ``w``; adds ``allocated``.
    """
    stored = chunks.select(*keys, "cy", "cx", F.col("values").alias("_values"))
    empty = F.array_repeat(F.coalesce(nodata, F.lit(0.0)), (F.col("h") * F.col("w")).cast("int"))
    return grid.join(stored, [*keys, "cy", "cx"], "left").select(
        *grid.columns,
        F.coalesce(F.col("_values"), empty).alias("values"),
        F.col("_values").isNotNull().alias("allocated"),
    )


def missing_chunks(grid: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Grid positions with no stored block: what a resumed job still has to write."""
    return grid.join(existing.select(*keys, "cy", "cx"), [*keys, "cy", "cx"], "left_anti")


def valid_pixels(chunks: DataFrame, keys: list[str], nodata: Column) -> DataFrame:
    """Exploded pixels with the sentinel masked to NULL."""
    return explode_chunks(chunks, keys).withColumn("value", mask_nodata("value", nodata))
