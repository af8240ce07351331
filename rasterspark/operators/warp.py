"""Resampling rasters onto target grids as joins.

Targets are rows: a grid (tile) has bounds ``min_x, min_y, max_x, max_y`` in ``crs`` and a pixel size
``width`` x ``height``. Per (target, asset) a small row of geometry is computed first (source extent,
kernel shape); pixels then find their source samples by equi-joins on (asset, level, row, col).
Nothing is compared pairwise and no target is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions.grid import crs_to_pixel, pixel_to_crs, triangle, window
from ..session import deal_out
from .chunks import pack_chunks

# Boundary density, index epsilon, weight cut-offs, decimation threshold.
EDGE_SAMPLES = 21
INDEX_EPSILON = 1e-10
MIN_WEIGHT = 1e-6
UNIT_WEIGHT_SLACK = 1e-5
DECIMATING = 0.95

#: Side of the blocks that pixel rows are packed into for the bilinear filter.
PACKED = 32

EXTENT = ["min_col", "max_col", "min_row", "max_row"]


def project_points(df: DataFrame, x: str, y: str, source, target, out: str) -> DataFrame:
    """Add ``{out}_x, {out}_y``: a point moved between two CRSs through lon/lat.

    CRSs are literals, columns or parsed columns; equal CRSs are the exact identity; NULL outside a
    domain. The hub is its own projection step, so it is computed once per row.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    if isinstance(source, str) and isinstance(target, str) and source == target:
        return df.withColumns({f"{out}_x": px, f"{out}_y": py})
    if isinstance(source, str) and isinstance(target, str):
        hub = C.add_lonlat(df, px, py, source, "_hub")
        return C.add_projected(hub, "_hub_x", "_hub_y", target, out).drop("_hub_x", "_hub_y")
    made = []
    if not isinstance(source, (str, C.ParsedCrs)):
        df, source = C.with_crs(df, source, "_from"), C.ParsedCrs("_from")
        made += source.columns
    if not isinstance(target, (str, C.ParsedCrs)):
        df, target = C.with_crs(df, target, "_into"), C.ParsedCrs("_into")
        made += target.columns
    hub = C.add_lonlat(df, px, py, source, "_hub")
    hub = C.add_projected(hub, "_hub_x", "_hub_y", target, "_moved")
    pick = lambda here, there: F.when(_same_crs(source, target), here).otherwise(F.col(there))
    moved = {f"{out}_x": pick(px, "_moved_x"), f"{out}_y": pick(py, "_moved_y")}
    return hub.withColumns(moved).drop(*made, "_hub_x", "_hub_y", "_moved_x", "_moved_y")


def _same_crs(a, b) -> Column:
    """Whether two CRSs, at most one of them a literal, are equal."""
    if isinstance(b, str):
        a, b = b, a
    if isinstance(a, str):
        return b["epsg"].eqNullSafe(F.lit(int(a[5:]))) if a.startswith("EPSG:") else F.lit(False)
    both = a["epsg"].eqNullSafe(b["epsg"]) & a["sinu"].eqNullSafe(b["sinu"])
    return both & (a["epsg"].isNotNull() | a["sinu"].isNotNull())


def _parsed(df: DataFrame, crs: str | None):
    """CRS texts parsed once per target, before points are generated: (table, target CRS, source CRS)."""
    df = C.with_crs(df, F.col("src_crs"), "_src")
    if crs is not None:
        return df, crs, C.ParsedCrs("_src")
    return C.with_crs(df, F.col("crs"), "_dst"), C.ParsedCrs("_dst"), C.ParsedCrs("_src")


def raster_bounds(rasters: DataFrame, dst_crs: str = C.WGS84, edge_samples: int = 2) -> DataFrame:
    """Bounds of each raster in ``dst_crs``; two samples per edge are the four corners."""
    steps = F.sequence(F.lit(0), F.lit(edge_samples - 1))
    points = rasters.select("asset", "crs", "width", "height", "transform", F.explode(steps).alias("_i"))
    t = F.col("_i") / F.lit(edge_samples - 1)
    along_x, along_y = F.col("width") * t, F.col("height") * t
    zero = F.lit(0.0)
    edges = [
        (along_x, zero),
        (along_x, F.col("height").cast("double")),
        (zero, along_y),
        (F.col("width").cast("double"), along_y),
    ]
    edge = F.explode(F.array(*[F.struct(px.alias("px"), py.alias("py")) for px, py in edges]))
    placed = points.withColumn("_e", edge).withColumn("_p", pixel_to_crs("_e.px", "_e.py", F.col("transform")))
    placed = placed.select("asset", "crs", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    moved = project_points(placed, "_x", "_y", F.col("crs"), dst_crs, "_q")
    return moved.groupBy("asset").agg(
        F.min("_q_x").alias("west"), F.min("_q_y").alias("south"), F.max("_q_x").alias("east"), F.max("_q_y").alias("north")
    )


def source_extent(pairs: DataFrame, keys: list[str], crs: str | None = None) -> DataFrame:
    """Fractional source-pixel box of each target's densified boundary.

    ``pairs`` has ``keys``, the target (``min_x..max_y, crs``) and the raster
    (``src_crs, transform``). Points outside the projection's domain are skipped; targets with no
    point left drop out. ``crs`` names the target CRS when it is one literal for all targets.
    """
    steps = F.sequence(F.lit(0), F.lit(EDGE_SAMPLES - 1))
    pairs, dst, src = _parsed(pairs, crs)
    points = pairs.withColumn("_t", F.explode(steps)).withColumn("_t", F.col("_t") / F.lit(float(EDGE_SAMPLES - 1)))
    x = F.col("min_x") + F.col("_t") * (F.col("max_x") - F.col("min_x"))
    y = F.col("min_y") + F.col("_t") * (F.col("max_y") - F.col("min_y"))
    edges = [(x, F.col("max_y")), (x, F.col("min_y")), (F.col("min_x"), y), (F.col("max_x"), y)]
    edge = F.explode(F.array(*[F.struct(ex.alias("x"), ey.alias("y")) for ex, ey in edges]))
    placed = points.withColumn("_e", edge).withColumn("_ex", F.col("_e.x")).withColumn("_ey", F.col("_e.y"))
    moved = project_points(placed, "_ex", "_ey", dst, src, "_p")
    # flat columns and no filter here: a filter would be pushed below the projection steps and
    # repeat all of them; min and max skip the NULL points anyway
    pixel = moved.withColumn("_px", crs_to_pixel("_p_x", "_p_y", F.col("transform")))
    extent = pixel.select(*keys, F.col("_px.col").alias("_col"), F.col("_px.row").alias("_row")).groupBy(*keys).agg(
        F.min("_col").alias("min_col"),
        F.max("_col").alias("max_col"),
        F.min("_row").alias("min_row"),
        F.max("_row").alias("max_row"),
    )
    return extent.where(F.col("min_col").isNotNull())


def read_window(margin: Column | int, raster_w: str = "raster_w", raster_h: str = "raster_h") -> Column:
    """The extent grown by ``margin``, snapped outward and clipped; NULL when it misses the raster."""
    w, h = F.col(raster_w), F.col(raster_h)
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0)), top).cast("long")
    c0, c1 = clip(F.floor(F.col("min_col") - margin), w), clip(F.ceil(F.col("max_col") + margin), w)
    r0, r1 = clip(F.floor(F.col("min_row") - margin), h), clip(F.ceil(F.col("max_row") + margin), h)
    return F.when((c1 > c0) & (r1 > r0), window(c0, r0, c1 - c0, r1 - r0))


def kernel_shape(extents: DataFrame, filter_radius: int) -> DataFrame:
    """Add the resampling geometry of each target: window ``off/size``, ``scale`` and ``radius`` per axis.

    Expects the extent columns, ``width, height`` of the target and ``raster_w, raster_h``.
    ``filter_radius`` is 1 for bilinear, 0 for nearest. Targets entirely off the raster drop out.
    """
    near = lambda v: F.when(F.abs(F.round(v, 0) - v) < 1e-6, F.round(v, 0)).otherwise(v)
    reach = F.lit(float(filter_radius))
    df = extents
    for name in EXTENT:
        df = df.withColumn(name, near(F.col(name)))
    df = df.where(
        ~(
            (F.col("min_col") > F.col("raster_w"))
            | (F.col("max_col") < 0)
            | (F.col("min_row") > F.col("raster_h"))
            | (F.col("max_row") < 0)
        )
    )
    for axis, low, high, raster, dst in (
        ("x", "min_col", "max_col", "raster_w", "width"),
        ("y", "min_row", "max_row", "raster_h", "height"),
    ):
        full, size = F.col(raster).cast("double"), F.col(dst).cast("double")
        ratio = F.greatest(F.coalesce(F.try_divide(size, F.col(high) - F.col(low)), F.lit(float("inf"))), F.lit(1e-3))
        pad = F.when(ratio < DECIMATING, F.ceil(reach / ratio).cast("double")).otherwise(reach)
        lo = F.floor(F.greatest(F.col(low), F.lit(0.0))).cast("double")
        hi = F.least(F.ceil(F.col(high)).cast("double"), full)
        df = df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_pad", pad)
        whole = F.col("_hi") - F.col("_lo") > full * 0.9
        off = F.least(F.greatest(F.col("_lo") - F.col("_pad"), F.lit(0.0)), full)
        df = df.withColumn(f"off_{axis}", F.when(whole, 0.0).otherwise(off))
        span = F.greatest(F.least(full - F.col(f"off_{axis}"), F.col("_hi") - F.col(f"off_{axis}") + F.col("_pad")), F.lit(0.0))
        df = df.withColumn(f"size_{axis}", F.when(whole, full).otherwise(span))
        scale = F.try_divide(size, F.col(f"size_{axis}"))
        inverse = F.try_divide(F.col(f"size_{axis}"), size)
        whole_step = F.floor(inverse + 0.5)
        snapped = F.when((scale < 1) & (F.abs(inverse - whole_step) < 0.05), F.lit(1.0) / whole_step).otherwise(scale)
        unit = (F.col(f"size_{axis}") <= 0) | (F.col(f"size_{axis}") == size)
        df = df.withColumn(f"scale_{axis}", F.when(unit, 1.0).otherwise(snapped))
    plain = (F.col("scale_x") >= DECIMATING) & (F.col("scale_y") >= DECIMATING)
    df = df.withColumn("_plain", plain)
    for axis in "xy":
        s = F.when(F.col("_plain"), 1.0).otherwise(F.col(f"scale_{axis}"))
        df = df.withColumn(f"scale_{axis}", s)
        radius = F.when(F.col(f"scale_{axis}") < 1, F.ceil(reach / F.col(f"scale_{axis}"))).otherwise(F.lit(filter_radius))
        df = df.withColumn(f"radius_{axis}", radius.cast("int"))
    return df.drop("_lo", "_hi", "_pad", "_plain")


def target_pixels(
    shaped: DataFrame, keys: list[str], crs: str | None = None, band: int | None = None, keep: list[str] = ()
) -> DataFrame:
    """Pixels of every target with their fractional source position ``fcol, frow``.

    Rows are spread over the cluster before columns are generated: one target row is the unit that
    is shuffled, its pixels are made afterwards. With ``band`` so many rows stay together, numbered in a
    column ``_rows``. ``keep`` names further columns of ``shaped`` to hand on. Pixels whose point has no source position, or lies
    outside the kernel window, are left out (they are invalid).
    """
    shaped, dst, src = _parsed(shaped, crs)
    lines = shaped.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)))
    if band is not None:
        lines = lines.withColumn("_rows", F.floor(F.col("row") / band))
    lines = deal_out(lines, *keys, "row" if band is None else "_rows")
    pixels = lines.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)))
    dx = (F.col("max_x") - F.col("min_x")) / F.col("width")
    dy = (F.col("max_y") - F.col("min_y")) / F.col("height")
    placed = pixels.withColumn("_x", F.col("min_x") + dx * (F.col("col") + 0.5)).withColumn(
        "_y", F.col("max_y") - dy * (F.col("row") + 0.5)
    )
    moved = project_points(placed, "_x", "_y", dst, src, "_p")
    at = moved.withColumn("_f", crs_to_pixel("_p_x", "_p_y", F.col("transform")))
    geometry = ["scale_x", "scale_y", "radius_x", "radius_y", "raster_w", "raster_h", *keep, *(["_rows"] if band is not None else [])]
    # The row number is a fence: a filter is never pushed below a projection that numbers its rows,
    # so the projection steps are not repeated inside the predicate.
    framed = at.select(
        *keys, "row", "col", F.col("_f.col").alias("fcol"), F.col("_f.row").alias("frow"), *geometry,
        "off_x", "off_y", "size_x", "size_y", F.monotonically_increasing_id().alias("_fence"),
    )
    inside = (
        (F.col("_fence") >= 0)
        & (F.col("fcol") >= F.col("off_x"))
        & (F.col("frow") >= F.col("off_y"))
        & (F.col("fcol") + INDEX_EPSILON <= F.col("off_x") + F.col("size_x"))
        & (F.col("frow") + INDEX_EPSILON <= F.col("off_y") + F.col("size_y"))
    )
    return framed.where(inside).drop("off_x", "off_y", "size_x", "size_y", "_fence")


def containing_cell(position: str) -> Column:
    return F.floor(F.col(position) + INDEX_EPSILON)


def _samples(source: DataFrame, join_keys: list[str], value: str) -> DataFrame:
    return source.select(*join_keys, F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col("value").alias(value))


def attach_samples(points: DataFrame, source: DataFrame, join_keys: list[str]) -> DataFrame:
    """Add ``v``, the source sample (``join_keys..., row, col, value``) at ``_sr, _sc``; NULL when invalid or absent."""
    samples = _samples(source.where(F.col("value").isNotNull()), join_keys, "v")
    return points.join(samples, [*join_keys, "_sr", "_sc"], "left")


def warp_nearest(targets: DataFrame, source: DataFrame, keys: list[str], join_keys: list[str]) -> DataFrame:
    """``keys..., row, col, value`` of valid target pixels: the sample of the pixel holding the point.

    ``source`` holds pixel rows; NULL (or absent) samples are invalid. Stored blocks: ``warp_blocks``.
    """
    cell = {"_sr": containing_cell("frow"), "_sc": containing_cell("fcol")}
    placed = targets.withColumns(cell).select(*dict.fromkeys([*keys, *join_keys]), "row", "col", "_sr", "_sc")
    hit = attach_samples(placed, source, join_keys)
    return hit.where(F.col("v").isNotNull()).select(*keys, "row", "col", F.col("v").alias("value"))


def kernel_weights(targets: DataFrame) -> DataFrame:
    """Support samples of every target pixel: source cell ``_sr, _sc``, weight ``w``, ``gate``.

    ``gate`` marks the sample of the pixel that contains the point; it is always among the rows.
    """
    u, v = F.col("fcol") - 0.5, F.col("frow") - 0.5
    placed = targets.withColumn("_i0", F.floor(u)).withColumn("_j0", F.floor(v))
    placed = placed.withColumn("_dx", u - F.col("_i0")).withColumn("_dy", v - F.col("_j0"))
    factor = lambda s: F.least(F.col(s), F.lit(1.0))
    rows = placed.withColumn("_j", F.explode(F.sequence(-F.col("radius_y"), F.col("radius_y"))))
    rows = rows.withColumn("_wy", triangle((F.col("_j") - F.col("_dy")) * factor("scale_y"))).withColumn(
        "_sr", F.col("_j0") + F.col("_j")
    )
    on_gate_row = F.col("_sr") == containing_cell("frow")
    rows = rows.where((F.col("_wy") > 0) | on_gate_row)
    cells = rows.withColumn("_i", F.explode(F.sequence(-F.col("radius_x"), F.col("radius_x"))))
    cells = cells.withColumn("_wx", triangle((F.col("_i") - F.col("_dx")) * factor("scale_x"))).withColumn(
        "_sc", F.col("_i0") + F.col("_i")
    )
    gate = on_gate_row & (F.col("_sc") == containing_cell("fcol"))
    return (
        cells.withColumn("w", F.col("_wx") * F.col("_wy"))
        .withColumn("gate", gate)
        .where((F.col("w") > 0) | F.col("gate"))
    )


def weighted_mean(support: DataFrame, keys: list[str], value: str = "v", propagate: bool = False) -> DataFrame:
    """Weighted mean of support rows (``w``, value, ``gate``) per target; NULL where invalid.

    Missing samples are dropped and the rest renormalised; ``propagate`` makes any missing sample of
    positive weight invalidate the pixel instead. A missing gate sample always does.
    """
    v, w = F.col(value), F.col("w")
    sums = support.groupBy(*keys).agg(
        F.sum(F.when(v.isNotNull(), w * v)).alias("_acc"),
        F.sum(F.when(v.isNotNull(), w)).alias("_weight"),
        F.max(F.when(v.isNull() & (w > 0), 1).otherwise(0)).alias("_missing"),
        F.max(F.when(v.isNull() & F.col("gate") & F.col("gate_counts"), 1).otherwise(0)).alias("_blocked"),
    )
    return settled_mean(sums, keys, propagate)


def settled_mean(sums: DataFrame, keys: list[str], propagate: bool) -> DataFrame:
    """``keys..., value`` from ``_acc, _weight, _missing, _blocked`` per pixel; NULL where invalid."""
    ok = (F.col("_blocked") == 0) & (F.col("_weight") >= MIN_WEIGHT)
    if propagate:
        ok = ok & (F.col("_missing") == 0)
    unit = F.abs(F.col("_weight") - 1.0) <= UNIT_WEIGHT_SLACK
    mean = F.when(unit, F.col("_acc")).otherwise(F.try_divide("_acc", "_weight"))
    return sums.select(*keys, F.when(ok, mean).alias("value"))


def warp_bilinear(
    targets: DataFrame,
    source: DataFrame,
    keys: list[str],
    join_keys: list[str],
    propagate: bool = False,
) -> DataFrame:
    """``keys..., row, col, value`` of valid target pixels under the (scaled) triangle filter.

    ``source`` holds pixel rows, one per sample; NULL, NaN or absent samples are invalid. They are packed into
    blocks, so a target pixel is shuffled once for each block it reaches, not once for each sample. Stored
    blocks: ``warp_blocks``.
    """
    from . import block_warp as BW

    rows = F.floor(F.col("row") / BW.BAND_ROWS)
    points = targets.withColumns({"_rows": rows, "block_h": F.lit(PACKED), "block_w": F.lit(PACKED)})
    return BW.sample_blocks(points, pack_chunks(source, join_keys, PACKED), keys, join_keys, "bilinear", propagate)
