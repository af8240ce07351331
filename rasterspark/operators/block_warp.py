"""Resampling from stored blocks: arrays of points meet whole blocks, partial sums meet per pixel.

The points of a band of target rows that touch one block travel as one array and meet that block once.
Inside a task numpy looks their samples up, so neither the source nor the kernel's support samples ever
become rows. A nearest sample is final there; a bilinear pixel whose support reaches over several
blocks is the sum of one (weighted sum, weight) per block, folded after one exchange of those arrays.
Blocks no target window touches are dropped before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .chunks import chunks_touching
from .warp import INDEX_EPSILON, settled_mean, target_pixels

#: Target rows whose points travel together.
BAND_ROWS = 64
#: Up to so many touched blocks (about 100 bytes each) are broadcast to prune the source; more are joined by shuffle.
BROADCAST_BLOCKS = 200_000

#: Points and samples that a task lays out at once, about 200 bytes each.
AT_ONCE = 250_000

_SHAPE = ["scale_x", "scale_y", "radius_x", "radius_y", "raster_w", "raster_h", "block_h", "block_w"]
_POINTS = "array<struct<row: int, col: int, fr: double, fc: double>>"


def with_block_shape(shaped: DataFrame, chunk: tuple[int, int]) -> DataFrame:
    """Targets of rasters that are all stored in blocks of one shape."""
    return shaped.withColumns({"block_h": F.lit(int(chunk[0])), "block_w": F.lit(int(chunk[1]))})


def touched_blocks(shaped: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., cy, cx`` of the blocks inside each target's kernel window, each once.

    ``shaped`` is what ``kernel_shape`` gives, with ``block_h, block_w``. The kernel window holds every
    sample a target may use, so no pixel has to be looked at.
    """
    edge = lambda axis: F.ceil(F.col(f"off_{axis}") + F.col(f"size_{axis}")).cast("long") - F.floor(F.col(f"off_{axis}")).cast("long")
    inside = lambda axis, top: F.least(edge(axis), F.col(top).cast("long") - F.floor(F.col(f"off_{axis}")).cast("long"))
    windows = shaped.select(
        *keys, "block_h", "block_w", F.floor("off_x").cast("long").alias("col_off"), F.floor("off_y").cast("long").alias("row_off"),
        inside("x", "raster_w").alias("width"), inside("y", "raster_h").alias("height"),
    )
    return chunks_touching(windows, keys, F.col("block_h"), F.col("block_w")).distinct()


def keep_touched(blocks: DataFrame, touched: DataFrame, join_keys: list[str]) -> DataFrame:
    """Blocks some target touches. Their list is counted first and broadcast only while it is short."""
    names = [*join_keys, "cy", "cx"]
    wanted = cut_lineage(touched.select(*names).distinct())
    if wanted.count() <= BROADCAST_BLOCKS:
        wanted = F.broadcast(wanted)
    return blocks.join(wanted, names, "left_semi")


def _span(axis: str, position: str, bilinear: bool) -> tuple[Column, Column]:
    """First and last source index along an axis that a point has a weight on, or lies in."""
    own = F.floor(F.col(position) + INDEX_EPSILON)
    if not bilinear:
        return own, own
    u, reach = F.col(position) - 0.5, F.lit(1.0) / F.least(F.col(f"scale_{axis}"), F.lit(1.0))
    low = F.greatest(F.floor(u - reach) + 1, F.floor(u) - F.col(f"radius_{axis}"))
    high = F.least(F.ceil(u + reach) - 1, F.floor(u) + F.col(f"radius_{axis}"))
    return F.least(low, own), F.greatest(high, own)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Length of every list (null: 0) and the elements of all."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, column.flatten()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows that hold up to ``AT_ONCE`` points and samples, or one row."""
    load = _lists(batch.column("_points"))[0] + _lists(batch.column("_values"))[0]
    ends, start = np.cumsum(load), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class _Batch:
    """One batch of (points, block) rows, laid out flat."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.sizes, points = _lists(batch.column("_points"))
        self.row, self.col, self.fr, self.fc = (points.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        self.own = np.repeat(np.arange(batch.num_rows), self.sizes)
        held, values = _lists(batch.column("_values"))
        self.values = values.to_numpy(zero_copy_only=False).astype(np.float64)
        self.start = np.cumsum(held) - held
        self.held = held
        self.cy, self.cx = number("cy").astype(np.int64), number("cx").astype(np.int64)
        self.shape = {n: number(n) for n in _SHAPE}
        self.block_h, self.block_w = self.shape["block_h"].astype(np.int64), self.shape["block_w"].astype(np.int64)

    def look_up(self, pick: np.ndarray, sr: np.ndarray, sc: np.ndarray) -> np.ndarray:
        """Samples of points ``pick`` at raster cells of their block; NaN where there is none."""
        own = self.own[pick]
        at = (sr - self.cy[own] * self.block_h[own]) * self.block_w[own] + sc - self.cx[own] * self.block_w[own]
        real = (sr >= 0) & (sc >= 0) & (sr < self.shape["raster_h"][own]) & (sc < self.shape["raster_w"][own]) & (at < self.held[own])
        out = np.full(len(pick), np.nan)
        out[real] = self.values[(self.start[own] + at)[real]]
        return out


def _nearest(b: _Batch, names: list[str]) -> pa.RecordBatch:
    every = np.arange(len(b.own))
    v = b.look_up(every, np.floor(b.fr + INDEX_EPSILON).astype(np.int64), np.floor(b.fc + INDEX_EPSILON).astype(np.int64))
    ok = np.flatnonzero(~np.isnan(v))
    take = pa.array(b.own[ok])
    columns = [b.batch.column(n).take(take) for n in names]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(b.row[ok].astype(np.int64)), pa.array(b.col[ok].astype(np.int64)), pa.array(v[ok])], [*names, "row", "col", "value"]
    )


def _bilinear(b: _Batch, names: list[str]) -> pa.RecordBatch:
    n = len(b.own)
    acc, weight, missing, blocked = np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    shape = {k: v[b.own] for k, v in b.shape.items()}
    u, v = b.fc - 0.5, b.fr - 0.5
    i0, j0 = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    gate_r, gate_c = np.floor(b.fr + INDEX_EPSILON).astype(np.int64), np.floor(b.fc + INDEX_EPSILON).astype(np.int64)
    near = lambda step, off, scale: np.maximum(0.0, 1.0 - np.abs((step - off) * np.minimum(scale, 1.0)))
    reach = lambda name: int(b.shape[name].max(initial=0))
    for dj in range(-reach("radius_y"), reach("radius_y") + 1):
        sr = j0 + dj
        wy = near(dj, v - j0, shape["scale_y"])
        rows = np.flatnonzero(
            (np.abs(dj) <= shape["radius_y"]) & (sr // shape["block_h"].astype(np.int64) == b.cy[b.own]) & ((wy > 0) | (sr == gate_r))
        )
        for di in range(-reach("radius_x"), reach("radius_x") + 1):
            sc = i0[rows] + di
            w = wy[rows] * near(di, u[rows] - i0[rows], shape["scale_x"][rows])
            gate = (sr[rows] == gate_r[rows]) & (sc == gate_c[rows])
            here = (np.abs(di) <= shape["radius_x"][rows]) & (sc // shape["block_w"][rows].astype(np.int64) == b.cx[b.own[rows]]) & ((w > 0) | gate)
            p, sc, w, gate = rows[here], sc[here], w[here], gate[here]
            value = b.look_up(p, sr[p], sc)
            ok = ~np.isnan(value)
            acc[p[ok]] += w[ok] * value[ok]
            weight[p[ok]] += w[ok]
            missing[p] |= ~ok & (w > 0)
            real = (sr[p] >= 0) & (sc >= 0) & (sr[p] < shape["raster_h"][p]) & (sc < shape["raster_w"][p])
            blocked[p] |= ~ok & gate & real
    ends = pa.array(np.concatenate([[0], np.cumsum(b.sizes)]).astype(np.int32))
    flags = (missing + 2 * blocked).astype(np.int8)
    parts = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (b.row, b.col, acc, weight, flags)]
    return pa.RecordBatch.from_arrays([*(b.batch.column(x) for x in names), *parts], [*names, "_row", "_col", "_acc", "_weight", "_flags"])


def warp_blocks(
    shaped: DataFrame, blocks: DataFrame, keys: list[str], join_keys: list[str], kernel: str, crs: str | None = None, propagate: bool = False
) -> DataFrame:
    """``keys..., row, col, value`` of valid target pixels, from stored blocks.

    ``shaped`` is what ``kernel_shape`` gives, with the blocks' ``block_h, block_w`` (see
    ``with_block_shape``); ``blocks`` is ``join_keys..., cy, cx, values``, padded to full size, with NULL
    or NaN for invalid samples. ``kernel`` is ``nearest`` or ``bilinear``, ``propagate`` as in
    ``warp_bilinear``. Blocks that are not stored hold no valid sample.
    """
    if kernel not in ("nearest", "bilinear"):
        raise ValueError(f"unknown kernel {kernel!r}")
    source = keep_touched(blocks, touched_blocks(shaped, join_keys), join_keys)
    points = target_pixels(shaped, keys, crs, band=BAND_ROWS, keep=["block_h", "block_w"])
    return sample_blocks(points, source, keys, join_keys, kernel, propagate)


def sample_blocks(points: DataFrame, source: DataFrame, keys: list[str], join_keys: list[str], kernel: str, propagate: bool = False) -> DataFrame:
    """What ``warp_blocks`` gives, for target pixels with their source position, band ``_rows`` and block shape."""
    bilinear = kernel == "bilinear"
    names = list(dict.fromkeys([*keys, *join_keys]))
    spans = {}
    for axis, position, top, size in (("y", "frow", "raster_h", "block_h"), ("x", "fcol", "raster_w", "block_w")):
        low, high = _span(axis, position, bilinear)
        if not propagate:  # samples outside the raster count only where they invalidate
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.col(top).cast("long") - 1)
        first, last = F.floor(low / F.col(size)), F.floor(high / F.col(size))
        spans[f"c{axis}"] = F.explode(F.when(last >= first, F.sequence(first, last)))
    placed = points.withColumn("cy", spans["cy"]).withColumn("cx", spans["cx"])
    point = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("frow").alias("fr"), F.col("fcol").alias("fc"))
    # the band is part of how the points are dealt out already, so this grouping needs no exchange
    grouped = placed.groupBy(*names, "_rows", *_SHAPE, "cy", "cx").agg(F.collect_list(point).cast(_POINTS).alias("_points"))
    stored = source.select(*join_keys, "cy", "cx", F.col("values").cast("array<double>").alias("_values"))
    met = grouped.join(stored, [*join_keys, "cy", "cx"], "left").select(*names, "_rows", *_SHAPE, "cy", "cx", "_points", "_values")
    types = {f.name: f.dataType for f in met.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _bilinear(_Batch(part), [*keys, "_rows"]) if bilinear else _nearest(_Batch(part), keys)

    field = lambda n, t: T.StructField(n, t)
    if not bilinear:
        schema = [field(k, types[k]) for k in keys] + [field("row", T.LongType()), field("col", T.LongType()), field("value", T.DoubleType())]
        return met.mapInArrow(run, T.StructType(schema))
    arrays = {"_row": T.IntegerType(), "_col": T.IntegerType(), "_acc": T.DoubleType(), "_weight": T.DoubleType(), "_flags": T.ByteType()}
    schema = [field(k, types[k]) for k in [*keys, "_rows"]] + [field(n, T.ArrayType(t)) for n, t in arrays.items()]
    partial = met.mapInArrow(run, T.StructType(schema)).repartition(*keys, "_rows")
    each = partial.select(*keys, "_rows", F.inline(F.arrays_zip(*arrays)))
    sums = each.groupBy(*keys, "_rows", F.col("_row").cast("long").alias("row"), F.col("_col").cast("long").alias("col")).agg(
        F.sum("_acc").alias("_acc"), F.sum("_weight").alias("_weight"), F.max(F.col("_flags").bitwiseAND(1)).alias("_missing"),
        F.max(F.shiftright("_flags", 1)).alias("_blocked"),
    )
    return settled_mean(sums, [*keys, "row", "col"], propagate).where(F.col("value").isNotNull())
