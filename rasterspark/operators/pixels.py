"""Pixel tables: one row per pixel (and band). NULL values are invalid pixels."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.palettes import Palette, apply_palette

# Fixed value: light from azimuth 315, altitude 45 degrees (east, north, up).
LIGHT = (-0.5, 0.5, 1 / sqrt(2))


def mask_pixels(pixels: DataFrame, rasters: DataFrame, value: str = "value") -> DataFrame:
    """NULL out nodata samples using each raster's sentinel."""
    sentinels = rasters.select("asset", F.col("nodata").alias("_nodata"))
    masked = pixels.join(sentinels, "asset", "left").withColumn(value, B.mask_nodata(value, "_nodata"))
    return masked.drop("_nodata")


def pivot_bands(pixels: DataFrame, keys: list[str], bands: list[str], value: str = "value") -> DataFrame:
    """Long band rows to one row per pixel; a missing band is NULL. One shuffle, partially aggregated."""
    picks = [F.max(F.when(F.col("band") == b, F.col(value))).alias(b) for b in bands]
    return pixels.where(F.col("band").isin(bands)).groupBy(*keys).agg(*picks)


def align_bands(pixels: DataFrame, keys: list[str], bands: list[str], shape_keys: list[str], value: str = "value") -> DataFrame:
    """Like ``pivot_bands``, with ``same_shape`` telling whether all bands of a group span one grid.

    ``shape_keys`` name the group (asset set or tile); the grid is compared by its last row and column.
    """
    wanted = pixels.where(F.col("band").isin(bands))
    extents = wanted.groupBy(*shape_keys, "band").agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    agree = extents.groupBy(*shape_keys).agg(
        (
            (F.count("*") == len(bands))
            & (F.min("_r") == F.max("_r"))
            & (F.min("_c") == F.max("_c"))
        ).alias("same_shape")
    )
    return pivot_bands(wanted, keys, bands, value).join(agree, shape_keys)


def reduce_bands(wide: DataFrame, expr, name: str = "gray") -> DataFrame:
    """Replace the band columns by one gray value computed from an expression tuple."""
    used = B.referenced_bands(expr)
    rest = [c for c in wide.columns if c not in used]
    return wide.select(*rest, B.expression_column(expr).alias(name))


def composite(wide: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """Three band columns as ``r, g, b``; the other columns stay."""
    rest = [c for c in wide.columns if c not in (r, g, b)]
    return wide.select(*rest, F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b"))


def colormap(df: DataFrame, gray: str, table: Palette | str, valid: Column | None = None) -> DataFrame:
    """Add ``r, g, b, a`` of a gray column (already on 0..255) through a palette."""
    ok = F.col(gray).isNotNull() if valid is None else valid & F.col(gray).isNotNull()
    shades = df.withColumn("_rgb", F.when(ok, apply_palette(gray, table)))
    zero = F.lit(0).cast("short")
    return shades.select(
        *df.columns,
        *[F.coalesce(F.col(f"_rgb.{c}"), zero).alias(c) for c in "rgb"],
        F.when(F.col("_rgb").isNotNull(), F.lit(255)).otherwise(0).cast("short").alias("a"),
    )


def coverage(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Valid pixels, all pixels and the nodata share per group."""
    return pixels.groupBy(*keys).agg(
        F.count(value).alias("valid"),
        F.count("*").alias("pixels"),
        F.try_divide(F.count("*") - F.count(value), F.count("*")).alias("nodata_share"),
    )


def zonal_stats(wide: DataFrame, keys: list[str], nir: str, red: str, swir: str) -> DataFrame:
    """Mean vegetation index and burn ratio per group over the valid pixels."""
    return wide.groupBy(*keys).agg(
        F.avg(B.ndvi(nir, red)).alias("ndvi"), F.avg(B.nbr(nir, swir)).alias("nbr")
    )


def change_between(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Burn-ratio drop between two zonal tables: ``dnbr = pre - post``."""
    before = pre.select(*keys, F.col("nbr").alias("_pre"))
    after = post.select(*keys, F.col("nbr").alias("_post"))
    return before.join(after, keys).select(*keys, (F.col("_pre") - F.col("_post")).alias("dnbr"))


def change_series(zonal: DataFrame, date: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Change of a zonal mean from date to date (one row per date and zone, so windows stay small)."""
    order = Window.partitionBy(*[F.col(k) for k in keys or []] or [F.lit(0)]).orderBy(date)
    return zonal.withColumn("change", F.col(value) - F.lag(value).over(order))


def block_mean_image(image: DataFrame, size: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Mean of ``size`` x ``size`` blocks of ``r, g, b``; halves round to even."""
    by = [F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")]
    means = [F.bround(F.avg(c), 0).cast("int").alias(c) for c in "rgb"]
    return image.groupBy(*(keys or []), *by).agg(*means)


def _horn_shade(z: list[list[Column]]) -> Column:
    """Shade of a 3x3 neighbourhood given row by row."""
    dz_dx = ((z[0][2] + 2 * z[1][2] + z[2][2]) - (z[0][0] + 2 * z[1][0] + z[2][0])) / 8.0
    dz_dy = ((z[2][0] + 2 * z[2][1] + z[2][2]) - (z[0][0] + 2 * z[0][1] + z[0][2])) / 8.0
    dot = -dz_dx * LIGHT[0] + dz_dy * LIGHT[1] + F.lit(LIGHT[2])
    norm = F.sqrt(dz_dx * dz_dx + dz_dy * dz_dy + F.lit(1.0))
    return B.finite_or_null(F.when(dot > 0, dot / norm).otherwise(F.when(dot.isNotNull(), F.lit(0.0))))


#: Pixels along a side of the blocks that relief is shaded in.
SHADE_BLOCK = 512


def hillshade(pixels: DataFrame, keys: list[str], value: str = "value", tile_size: int | None = None, block: int = SHADE_BLOCK) -> DataFrame:
    """Relief shading ``shade`` (3x3 gradient); NULL at borders and next to invalid pixels.

    Pixels are dealt once to blocks with a halo of one cell, which a border pixel's neighbours need; the
    windows across and down stay inside a block, so no partition grows with the raster. ``tile_size``
    makes tile edges count as borders too.
    """
    near = lambda axis: F.array_distinct(F.array(F.floor((F.col(axis) - 1) / block), F.floor((F.col(axis) + 1) / block)))
    dealt = pixels.withColumn("_by", F.explode(near("row"))).withColumn("_bx", F.explode(near("col")))
    home = [*keys, "_by", "_bx"]
    dealt = dealt.repartition(*home)
    block_keys = [F.col(k) for k in home]
    across = Window.partitionBy(*block_keys, "row").orderBy("col")
    down = Window.partitionBy(*block_keys, "col").orderBy("row")
    # a neighbour counts only when it is the adjacent cell, since invalid pixels may have no row
    left = F.when(F.lag("col").over(across) == F.col("col") - 1, F.lag(value).over(across))
    right = F.when(F.lead("col").over(across) == F.col("col") + 1, F.lead(value).over(across))
    triple = F.when(
        left.isNotNull() & right.isNotNull() & F.col(value).isNotNull(),
        F.struct(left.cast("double").alias("p"), F.col(value).cast("double").alias("q"), right.cast("double").alias("s")),
    )
    rows = dealt.withColumn("_mid", triple)
    above = F.when(F.lag("row").over(down) == F.col("row") - 1, F.lag("_mid").over(down))
    below = F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("_mid").over(down))
    stacked = rows.withColumn("_up", above).withColumn("_down", below)
    own = (F.floor(F.col("row") / block) == F.col("_by")) & (F.floor(F.col("col") / block) == F.col("_bx"))
    grid = [[F.col(f"{line}.{c}") for c in "pqs"] for line in ("_up", "_mid", "_down")]
    inside = F.lit(True)
    if tile_size is not None:
        for axis in ("row", "col"):
            inside = inside & (F.col(axis) % tile_size).between(1, tile_size - 2)
    return stacked.where(own).withColumn("shade", F.when(inside, _horn_shade(grid))).drop("_mid", "_up", "_down", "_by", "_bx")
