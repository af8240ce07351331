"""User functions over whole tiles.

A function gets a dict of float64 planes and a dict of validity masks (both ``size`` x ``size``)
plus its parameters, and gives a list of (values, validity) planes: one for gray, three for RGB.
A tile is the unit of work and has a fixed size, so a group is bounded.
"""

from __future__ import annotations

import hashlib
import json
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Planes = dict[str, np.ndarray]
TileFunction = Callable[[Planes, Planes, dict], list[tuple[np.ndarray, np.ndarray]]]

OUTPUT_NAMES = {1: ["gray"], 3: ["r", "g", "b"]}


def _content(value, seen: set[int]) -> list[str]:  # noqa: ANN001 - any value a function may refer to
    """Texts that change whenever what a function does may change: code, constants, defaults, closures, helpers."""
    if isinstance(value, types.ModuleType):
        return ["module", value.__name__]
    if isinstance(value, types.CodeType):
        inner = [t for c in value.co_consts for t in _content(c, seen)]
        return ["code", value.co_code.hex(), *value.co_names, *value.co_varnames, *inner]
    if isinstance(value, types.MethodType):
        return ["method", *_content(value.__self__, seen), *_content(value.__func__, seen)]
    if isinstance(value, types.FunctionType):
        if id(value) in seen:
            return ["again", value.__qualname__]
        seen.add(id(value))
        cells = [t for c in value.__closure__ or () for t in _content(c.cell_contents, seen)]
        rest = [t for d in (value.__defaults__, value.__kwdefaults__) for t in _content(d, seen)]
        names = {n for code in _codes(value.__code__) for n in code.co_names if n in value.__globals__}
        helpers = [t for n in sorted(names) for t in [n, *_content(value.__globals__[n], seen)]]
        return ["function", *_content(value.__code__, seen), *cells, *rest, *helpers]
    if isinstance(value, (list, tuple)):
        return [type(value).__name__, *(t for v in value for t in _content(v, seen)), "end"]
    if isinstance(value, dict):
        return ["dict", *(t for k in sorted(value, key=repr) for t in [repr(k), *_content(value[k], seen)]), "end"]
    if isinstance(value, np.ndarray):
        return ["array", str(value.dtype), str(value.shape), hashlib.sha256(np.ascontiguousarray(value).tobytes()).hexdigest()]
    if value is None or isinstance(value, (bool, int, float, complex, str, bytes, frozenset)):
        return [type(value).__name__, repr(sorted(value, key=repr) if isinstance(value, frozenset) else value)]
    if isinstance(value, type):
        return ["class", value.__module__, value.__qualname__]
    return ["pickled", hashlib.sha256(cloudpickle.dumps(value)).hexdigest()]


def _codes(code: types.CodeType) -> Iterator[types.CodeType]:
    """A code object and those nested in it."""
    yield code
    for const in code.co_consts:
        if isinstance(const, types.CodeType):
            yield from _codes(const)


@dataclass(frozen=True)
class TileUdf:
    """A user function with what identifies it: code digest, output planes, parameters.

    The digest covers the function's code and all that it refers to: helpers, closures, defaults, global
    constants; modules by name. It holds for one Python version, whose byte code it reads.
    """

    fn: TileFunction
    output_planes: int
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.output_planes not in OUTPUT_NAMES:
            raise ValueError("a tile function gives 1 or 3 planes")

    @property
    def code_hash(self) -> str:
        return hashlib.sha256("\x1f".join(_content(self.fn, set())).encode()).hexdigest()

    def identity(self) -> str:
        """Canonical text that goes into a tile's content key."""
        return json.dumps(
            {"code": self.code_hash, "planes": self.output_planes, "params": self.params}, sort_keys=True
        )


def registry_table(spark: SparkSession, functions: dict[str, TileUdf]) -> DataFrame:
    """Registered functions: ``name, code_hash, output_planes, params``."""
    rows = [(n, u.code_hash, u.output_planes, json.dumps(u.params, sort_keys=True)) for n, u in functions.items()]
    return spark.createDataFrame(rows, "name string, code_hash string, output_planes int, params string")


def run_udf(wide: DataFrame, keys: list[str], inputs: list[str], udf: TileUdf, size: int) -> DataFrame:
    """Run a tile function: ``keys..., row, col`` and the output planes; invalid pixels are NULL.

    A pixel is valid where all inputs are and the function says so; a non-finite result is invalid.
    Wrong plane counts or shapes fail the job.
    """
    names = OUTPUT_NAMES[udf.output_planes]
    fields = [wide.schema[k] for k in keys]
    fields += [T.StructField("row", T.LongType()), T.StructField("col", T.LongType())]
    fields += [T.StructField(n, T.DoubleType()) for n in names]
    fn, params, planes_out = udf.fn, dict(udf.params), udf.output_planes

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(tile["row"].min()) // size * size, int(tile["col"].min()) // size * size
        r, c = tile["row"].to_numpy(np.int64) - row0, tile["col"].to_numpy(np.int64) - col0
        values, valid = {}, {}
        for name in inputs:
            column = tile[name].to_numpy(np.float64)
            plane, mask = np.zeros((size, size)), np.zeros((size, size), bool)
            ok = ~np.isnan(column)
            plane[r[ok], c[ok]], mask[r[ok], c[ok]] = column[ok], True
            values[name], valid[name] = plane, mask
        out = fn(values, valid, params)
        if len(out) != planes_out:
            raise ValueError(f"tile function gave {len(out)} planes, declared {planes_out}")
        inputs_ok = np.logical_and.reduce([valid[n] for n in inputs])
        frame = {k: tile[k] for k in keys}
        frame["row"], frame["col"] = tile["row"].astype(np.int64), tile["col"].astype(np.int64)
        for name, (plane, mask) in zip(names, out):
            plane, mask = np.asarray(plane, np.float64), np.asarray(mask, bool)
            if plane.shape != (size, size) or mask.shape != (size, size):
                raise ValueError(f"plane {name} is {plane.shape}, expected {(size, size)}")
            good = inputs_ok & mask & np.isfinite(plane)
            frame[name] = np.where(good[r, c], plane[r, c], np.nan)
        return pd.DataFrame(frame)

    columns = [F.col(k) for k in keys] + [F.col("row"), F.col("col"), *[F.col(i).cast("double") for i in inputs]]
    by_tile = [F.floor(F.col("row") / size).alias("_ty"), F.floor(F.col("col") / size).alias("_tx")]
    tiles = wide.select(*columns).groupBy(*keys, *by_tile)
    result = tiles.applyInPandas(lambda _, tile: run(tile), T.StructType(fields))
    return result.select(*keys, "row", "col", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


# --- the example functions ---


def ndvi_tile(values: Planes, valid: Planes, params: dict):
    """Vegetation index of planes ``nir`` and ``red``."""
    total = values["nir"] + values["red"]
    ok = total != 0
    return [((values["nir"] - values["red"]) / np.where(ok, total, 1.0), ok)]


def qa_clear_tile(values: Planes, valid: Planes, params: dict):
    """1 where a QA word has none of the cloud bits."""
    word = values["qa"]
    whole = (word >= 0) & (word <= 255) & (word == np.floor(word))
    return [(np.where(np.where(whole, word, 0).astype(np.int64) & 14 == 0, 1.0, 0.0), whole)]


def hillshade_tile(values: Planes, valid: Planes, params: dict):
    """Relief shading inside one tile; its outermost ring is invalid."""
    z, ok = values["elevation"], valid["elevation"]
    h, w = z.shape
    n = lambda a, dr, dc: a[1 + dr : h - 1 + dr, 1 + dc : w - 1 + dc]
    east = n(z, -1, 1) + 2 * n(z, 0, 1) + n(z, 1, 1)
    west = n(z, -1, -1) + 2 * n(z, 0, -1) + n(z, 1, -1)
    south = n(z, 1, -1) + 2 * n(z, 1, 0) + n(z, 1, 1)
    north = n(z, -1, -1) + 2 * n(z, -1, 0) + n(z, -1, 1)
    dx, dy = (east - west) / 8.0, (south - north) / 8.0
    dot = 0.5 * dx + 0.5 * dy + np.sqrt(0.5)
    shade, mask = np.zeros_like(z), np.zeros_like(ok)
    shade[1:-1, 1:-1] = np.where(dot > 0, dot / np.sqrt(dx * dx + dy * dy + 1.0), 0.0)
    mask[1:-1, 1:-1] = np.logical_and.reduce([n(ok, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return [(shade, mask)]
