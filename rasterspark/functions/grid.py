"""Pixel grids: affine transforms, overview levels, windows, sampling weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tiles import col


def affine(a, b, c, d, e, f) -> Column:
    """Six coefficients as a transform struct: x = a*col + b*row + c, y = d*col + e*row + f."""
    return F.struct(*[col(v).cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f))])


def north_up(origin_x, origin_y, pixel_width, pixel_height) -> Column:
    """A transform without rotation; ``pixel_height`` is negative for north-up grids."""
    return affine(pixel_width, 0.0, origin_x, 0.0, pixel_height, origin_y)


def pixel_to_crs(px, py, t: Column) -> Column:
    """Pixel position (column, row) to CRS coordinates ``struct<x,y>``."""
    px, py = col(px), col(py)
    x = t["a"] * px + t["b"] * py + t["c"]
    y = t["d"] * px + t["e"] * py + t["f"]
    return F.struct(x.alias("x"), y.alias("y"))


def crs_to_pixel(x, y, t: Column) -> Column:
    """CRS coordinates to fractional ``struct<col,row>``; NULL for a singular transform."""
    x, y = col(x), col(y)
    det = t["a"] * t["e"] - t["b"] * t["d"]
    dx, dy = x - t["c"], y - t["f"]
    return F.when(
        det != 0,
        F.struct(
            F.try_divide(t["e"] * dx - t["b"] * dy, det).alias("col"),
            F.try_divide(t["a"] * dy - t["d"] * dx, det).alias("row"),
        ),
    )


def level_dim(full, factor) -> Column:
    """Pixels along one axis at a decimation factor: ceil(full / factor)."""
    f = F.greatest(col(factor), F.lit(1))
    return F.ceil(col(full) / f).cast("long")


def level_transform(t: Column, width, height, factor) -> Column:
    """The full-resolution transform with its pixel size scaled by the exact full/level ratio."""
    rx = col(width) / level_dim(width, factor)
    ry = col(height) / level_dim(height, factor)
    return affine(t["a"] * rx, t["b"], t["c"], t["d"], t["e"] * ry, t["f"])


def window(col_off, row_off, width, height) -> Column:
    """A pixel rectangle."""
    names = ("col_off", "row_off", "width", "height")
    return F.struct(*[col(v).cast("long").alias(n) for n, v in zip(names, (col_off, row_off, width, height))])


def to_level_window(win: Column, full_w, full_h, level_w, level_h) -> Column:
    """A full-resolution window mapped onto a level: starts round down, ends round up."""
    rx, ry = col(full_w) / col(level_w), col(full_h) / col(level_h)
    c0 = F.floor(win["col_off"] / rx)
    r0 = F.floor(win["row_off"] / ry)
    c1 = F.ceil((win["col_off"] + win["width"]) / rx)
    r1 = F.ceil((win["row_off"] + win["height"]) / ry)
    same = (col(full_w) == col(level_w)) & (col(full_h) == col(level_h))
    return F.when(same, win).otherwise(window(c0, r0, F.greatest(c1 - c0, F.lit(0)), F.greatest(r1 - r0, F.lit(0))))


def window_intersection(p: Column, q: Column) -> Column:
    """The common rectangle, NULL when the two only touch or are apart."""
    c0, r0 = F.greatest(p["col_off"], q["col_off"]), F.greatest(p["row_off"], q["row_off"])
    c1 = F.least(p["col_off"] + p["width"], q["col_off"] + q["width"])
    r1 = F.least(p["row_off"] + p["height"], q["row_off"] + q["height"])
    return F.when((c1 > c0) & (r1 > r0), window(c0, r0, c1 - c0, r1 - r0))


def desired_ratio(cols, rows, tile_size) -> Column:
    """How many source pixels one tile pixel covers along the finer axis; NULL for tile size 0."""
    size = F.nullif(col(tile_size).cast("double"), F.lit(0.0))
    return F.least(F.try_divide(col(cols).cast("double"), size), F.try_divide(col(rows).cast("double"), size))


def triangle(t) -> Column:
    """Triangle filter weight max(0, 1 - |t|)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(col(t)))


def later_start(a, b) -> Column:
    """The later of two lower bounds; NULL is open."""
    return F.greatest(col(a), col(b))


def earlier_end(a, b) -> Column:
    """The earlier of two upper bounds; NULL is open."""
    return F.least(col(a), col(b))
