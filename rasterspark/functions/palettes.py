"""256-entry palettes. A gray value is looked up by its quantised byte, never interpolated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bands import quantize

# The eleven published anchor colours of the red-yellow-green diverging map.
RDYLGN_ANCHORS = (
    (165, 0, 38),
    (215, 48, 39),
    (244, 109, 67),
    (253, 174, 97),
    (254, 224, 139),
    (255, 255, 191),
    (217, 239, 139),
    (166, 217, 106),
    (102, 189, 99),
    (26, 152, 80),
    (0, 104, 55),
)

Palette = list[tuple[int, int, int]]


def palette_from_stops(stops, size: int = 256) -> Palette:
    """Evenly spaced colours joined by straight lines, as published segmented maps are: in doubles, bytes drop their fraction."""
    colors = np.array(stops, float) / 255.0
    at = np.linspace(0.0, 1.0, len(stops)) * (size - 1)
    x = (size - 1) * np.linspace(0.0, 1.0, size)
    upper = np.searchsorted(at, x)[1:-1]
    share = ((x[1:-1] - at[upper - 1]) / (at[upper] - at[upper - 1]))[:, None]
    inner = share * (colors[upper] - colors[upper - 1]) + colors[upper - 1]
    levels = np.clip(np.concatenate([colors[:1], inner, colors[-1:]]), 0.0, 1.0)
    return [tuple(c) for c in (levels * 255).astype(int).tolist()]


def palette_from_rows(rows) -> Palette:
    """A palette given as ``(idx, r, g, b)`` rows; every index 0..255 must appear once."""
    table = {int(i): (int(r), int(g), int(b)) for i, r, g, b in rows}
    if sorted(table) != list(range(256)) or len(rows) != 256:
        raise ValueError("a palette needs each index 0..255 exactly once")
    return [table[i] for i in range(256)]


def load_palette(spark: SparkSession, path: str) -> Palette:
    """A published table from a CSV file of rows ``idx,r,g,b`` (with a header)."""
    rows = spark.read.csv(path, schema="idx int, r int, g int, b int", header=True)
    return palette_from_rows([tuple(r) for r in rows.limit(257).collect()])


def palette(name: str, tables: dict[str, Palette] | None = None) -> Palette:
    """A palette by name: grayscale, rdylgn, or one of ``tables``.

    Maps that follow no rule, such as viridis and magma, are given as tables of 256 rows.
    """
    if tables and name in tables:
        return tables[name]
    if name == "grayscale":
        return [(i, i, i) for i in range(256)]
    if name == "rdylgn":
        return palette_from_stops(RDYLGN_ANCHORS)
    raise ValueError(f"palette {name!r} has no rule; give its table")


def palette_table(spark: SparkSession, name: str) -> DataFrame:
    """A palette as a table ``idx, r, g, b`` of 256 rows."""
    rows = [(i, r, g, b) for i, (r, g, b) in enumerate(palette(name))]
    return spark.createDataFrame(rows, "idx int, r short, g short, b short")


def apply_palette(gray, table: Palette | str) -> Column:
    """``struct<r,g,b>`` of a gray value: the entry of its quantised byte; NULL when invalid.

    The palette is one constant of 256 packed integers, so the lookup is a narrow expression.
    """
    table = palette(table) if isinstance(table, str) else table
    if len(table) != 256:
        raise ValueError("a palette has 256 entries")
    packed = F.array(*[F.lit(r << 16 | g << 8 | b) for r, g, b in table])
    entry = F.get(packed, quantize(gray).cast("int"))
    part = lambda shift: F.shiftright(entry, shift).bitwiseAND(F.lit(255)).cast("short")
    return F.when(entry.isNotNull(), F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b")))
