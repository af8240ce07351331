"""Raster dimension rows and block references from a table of image directories.

``ifds`` has one row per image directory of a file: ``path, ifd, width, height, subfile, bits
array<int>, fmt array<string>, sx, sy, i, j, x, y, epsg, nodata, bands``. Directory 0 is the full
image; a reduced-resolution directory (subfile bit 1) is an overview.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import north_up
from ..functions.text import dtype_from_tags
from ..session import deal_out


def raster_info(ifds: DataFrame) -> DataFrame:
    """One row per file: ``asset, crs, width, height, transform, band_count, dtype, nodata, overview_levels, issue``."""
    first = F.col("ifd") == 0
    mixed = (F.size(F.array_distinct("bits")) > 1) | (F.size(F.array_distinct("fmt")) > 1)
    dtype = F.when(~mixed, dtype_from_tags(F.get("fmt", F.lit(0)), F.get("bits", F.lit(0))))
    text = F.trim(F.regexp_replace(F.trim("nodata"), "\\x00+$", ""))
    primary = F.struct(
        "width",
        "height",
        F.col("bands").alias("band_count"),
        "epsg",
        dtype.alias("dtype"),
        mixed.alias("mixed"),
        text.alias("nodata_text"),
        north_up(F.col("x") - F.col("i") * F.col("sx"), F.col("y") + F.col("j") * F.col("sy"), F.col("sx"), -F.col("sy")).alias("transform"),
        (F.col("sx").isNull() | F.col("sy").isNull()).alias("no_scale"),
        (F.col("x").isNull() | F.col("y").isNull()).alias("no_tiepoint"),
    )
    overview = ~first & (F.col("subfile").bitwiseAND(F.lit(1)) != 0)
    files = ifds.groupBy("path").agg(
        F.max(F.when(first, primary)).alias("p"), F.collect_set(F.when(overview, F.col("width"))).alias("_widths")
    )
    number = F.col("p.nodata_text").try_cast("double")
    issue = (
        F.when(F.col("p").isNull(), "no image directory")
        .when(F.col("p.mixed"), "mixed per-sample dtypes")
        .when(F.col("p.dtype").isNull(), "unsupported sample format")
        .when(F.col("p.epsg").isNull(), "no EPSG code")
        .when(F.col("p.no_scale"), "no pixel scale")
        .when(F.col("p.no_tiepoint"), "no tiepoint")
        .when(F.col("p.nodata_text").isNotNull() & number.isNull(), "unparseable nodata")
    )
    factors = F.array_sort(F.transform("_widths", lambda w: F.round(F.try_divide(F.col("p.width").cast("double"), w), 0).cast("int")))
    return files.select(
        F.col("path").alias("asset"),
        F.concat(F.lit("EPSG:"), F.col("p.epsg").cast("string")).alias("crs"),
        "p.width",
        "p.height",
        "p.transform",
        "p.band_count",
        "p.dtype",
        number.alias("nodata"),
        factors.alias("overview_levels"),
        issue.alias("issue"),
    )


def tile_refs(rasters: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks a tiled image is stored in as chunk references.

    ``rasters`` has ``asset, level, width, height, tile_w, tile_h, planar``; ``blocks`` has ``asset,
    level, block, offset, length`` with blocks numbered row by row. Striped (no tile size) and planar
    images give no rows; see ``refused_layouts``.
    """
    good = rasters.where(layout_issue().isNull())
    across = F.ceil(F.col("width") / F.col("tile_w")).cast("long")
    down = F.ceil(F.col("height") / F.col("tile_h")).cast("long")
    zero = F.lit(0).cast("long")
    grid = deal_out(good, "asset").withColumn("_n", across).withColumn("cy", F.explode(F.sequence(zero, down - 1)))
    grid = grid.withColumn("cx", F.explode(F.sequence(zero, F.col("_n") - 1)))
    numbered = grid.withColumn("block", F.col("cy") * F.col("_n") + F.col("cx"))
    key = F.concat_ws(".", F.col("cy").cast("string"), F.col("cx").cast("string"))
    # sorted and merged: both sides are far larger than what they are made from, so an estimate would broadcast one
    return numbered.join(blocks.hint("merge"), ["asset", "level", "block"], "left").select(
        "asset", "level", "cy", "cx", key.alias("key"), F.col("asset").alias("path"), "offset", "length"
    )


def layout_issue() -> Column:
    """Why a block layout cannot be read; NULL when it can."""
    return F.when(F.col("planar"), "planar configuration").when(
        F.col("tile_w").isNull() | F.col("tile_h").isNull(), "striped, no tile grid"
    )


def refused_layouts(rasters: DataFrame) -> DataFrame:
    return rasters.select("asset", "level", layout_issue().alias("issue")).where(F.col("issue").isNotNull())
