"""Composite jobs: rendering tables of tiles, cached rendering, pyramids, registration, frame loops.

A job takes tables and gives tables. Geometry, resolution choice and granule resolution are small
per-tile rows, computed once and stored in the checkpoint folder because several steps read them;
the one large join is pixels against target pixels.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import grid as G
from ..functions import keys as K
from ..functions import tiles as T
from ..functions.crs import WEB_MERCATOR
from ..functions.palettes import apply_palette
from ..functions.temporal import from_unix_millis
from ..functions.text import size_bytes
from ..operators import block_warp as BW
from ..operators import catalog as C
from ..operators import pyramid as PY
from ..operators import resolve as R
from ..operators import warp as W
from ..operators.chunks import pack_chunks
from ..operators.images import CHANNELS
from ..operators.pixels import pivot_bands
from ..operators.spatial import deepest_containing_tile
from ..operators.udf import TileUdf, run_udf
from ..schema import PROVENANCE as PROVENANCE_TYPE
from ..session import cut_lineage
from ..sources.chunk_reader import allocated, read_chunk_refs
from ..sources.exports import (
    LAYOUT, append_blocks, content_fingerprint, pyramid_conflicts, record_identities, stored_identities, stored_pyramid,
)
from .materialization import materialization_plan, missing_tiles

PROVENANCE = PROVENANCE_TYPE.simpleString()
TILE = ["z", "x", "y", "granule_id"]
BAND = [*TILE, "band", "asset", "level"]


@dataclass(frozen=True)
class Layer:
    """How a dataset is shown: an expression tuple (gray), three bands (RGB) or a user function (either), stretch and palette."""

    id: str
    dataset: str
    inputs: tuple[str, ...]
    expression: tuple | None = None
    rgb: tuple[str, str, str] | None = None
    low: float = 0.0
    high: float = 255.0
    palette: str = "grayscale"
    resampling: str = "bilinear"
    tile_size: int = 256
    udf: TileUdf | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.expression, self.rgb, self.udf)) != 1:
            raise ValueError("a layer has one of an expression, three bands and a user function")
        used = self.inputs if self.udf else self.rgb or B.referenced_bands(self.expression)
        if missing := [b for b in used if b not in self.inputs]:
            raise ValueError(f"layer {self.id!r} uses undeclared bands {missing}")
        if not self.low < self.high:
            raise ValueError("degenerate stretch")

    def plan_json(self) -> str:
        """Canonical text of everything that shapes the pixels."""
        plan = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("id", "dataset", "udf")}
        if self.udf is not None:
            plan["udf"] = json.loads(self.udf.identity())
        return json.dumps(plan, sort_keys=True)


def resolve_tiles(layer: Layer, tiles: DataFrame, granules: DataFrame) -> DataFrame:
    """Requested tiles (``z, x, y, t_ms``) with the granule that answers them, each pair once.

    Requests of different times that resolve to one granule are one tile, asked for at the latest of them
    (``requested_ms``). Tiles nothing answers drop out.
    """
    asked = tiles.withColumn("dataset", F.lit(layer.dataset))
    found = R.asof_latest(asked, granules.where(F.col("dataset") == layer.dataset))
    return found.where(F.col("granule_id").isNotNull()).groupBy(*TILE).agg(F.max("t_ms").alias("requested_ms"))


def _targets(layer: Layer, resolved: DataFrame, granules: DataFrame, rasters: DataFrame) -> DataFrame:
    """One row per tile and input band: target grid, source raster. Tiles with a missing band or mixed
    CRSs drop out."""
    files = granules.where(F.col("dataset") == layer.dataset).select(
        F.col("id").alias("granule_id"), F.col("datetime").alias("granule_at"), F.explode("assets").alias("band", "_a")
    )
    files = files.where(F.col("band").isin(list(layer.inputs))).select("granule_id", "granule_at", "band", F.col("_a.href").alias("asset"))
    # full resolution rows of the rasters, and per granule whether the inputs fit together
    rows = files.join(rasters, "asset")
    fit = rows.groupBy("granule_id").agg(F.count("*").alias("_n"), F.min("crs").alias("_lo"), F.max("crs").alias("_hi"))
    fit = fit.where((F.col("_n") == len(layer.inputs)) & (F.col("_lo") == F.col("_hi"))).select("granule_id")
    rows = rows.join(fit, "granule_id", "left_semi")
    placed = resolved.join(rows, "granule_id").withColumn("_b", T.tile_bounds_xy("z", "x", "y"))
    return placed.select(
        *TILE, "band", "asset", F.col("crs").alias("src_crs"), F.lit(WEB_MERCATOR).alias("crs"), "transform", "dtype",
        "overview_levels", F.col("width").alias("full_w"), F.col("height").alias("full_h"),
        F.lit(layer.tile_size).alias("width"), F.lit(layer.tile_size).alias("height"),
        "_b.min_x", "_b.min_y", "_b.max_x", "_b.max_y", "requested_ms", "granule_at",
    )


def plan_tiles(layer: Layer, targets: DataFrame, max_live_bytes: int | None = None) -> DataFrame:
    """Per tile the resolution to read (see ``materialization_plan``)."""
    keys = [*TILE, "band"]
    extent = W.source_extent(targets, keys, WEB_MERCATOR)
    spans = targets.join(extent, keys).select(
        *TILE, (F.col("max_col") - F.col("min_col")).alias("cols"), (F.col("max_row") - F.col("min_row")).alias("rows"),
        size_bytes("dtype").alias("bytes_per_sample"), F.col("overview_levels").alias("factors"),
    )
    return materialization_plan(spans, TILE, None, layer.tile_size, max_live_bytes)


def shape_tiles(layer: Layer, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Kernel geometry of every planned tile and band at the chosen level, stored as several steps read it."""
    factor = F.col("factor")
    chosen = targets.join(plan.where("chosen <> 'refuse'").select(*TILE, factor.cast("int").alias("factor")), TILE)
    level = chosen.withColumns(
        {
            "transform": G.level_transform(F.col("transform"), "full_w", "full_h", "factor"),
            "raster_w": G.level_dim("full_w", "factor"),
            "raster_h": G.level_dim("full_h", "factor"),
            "level": factor,
        }
    )
    extent = W.source_extent(level, BAND, WEB_MERCATOR)
    return cut_lineage(W.kernel_shape(level.join(extent, BAND), 1 if layer.resampling == "bilinear" else 0))


def warp_tiles(layer: Layer, shaped: DataFrame, pixels: DataFrame, chunk: tuple[int, int] | None = None) -> DataFrame:
    """Band values of every planned tile pixel: ``z, x, y, granule_id, row, col, <inputs>``.

    ``pixels`` is ``asset, level, row, col, value``; ``level`` is the decimation factor. With ``chunk``
    it is stored blocks ``asset, level, cy, cx, values`` of that shape, which are never exploded; where
    ``shaped`` already says ``block_h, block_w``, blocks of those shapes.
    """
    if chunk is not None:
        shaped = BW.with_block_shape(shaped, chunk)
    if "block_h" in shaped.columns:
        values = BW.warp_blocks(shaped, pixels, BAND, ["asset", "level"], layer.resampling, WEB_MERCATOR)
    else:
        points = W.target_pixels(shaped, BAND, WEB_MERCATOR)
        values = (W.warp_bilinear if layer.resampling == "bilinear" else W.warp_nearest)(points, pixels, BAND, ["asset", "level"])
    return pivot_bands(values, [*TILE, "row", "col"], list(layer.inputs))


def paint(layer: Layer, wide: DataFrame) -> DataFrame:
    """Band values to ``r, g, b, a``; every declared input must be valid."""
    valid = B.all_valid(*layer.inputs)
    if layer.udf:
        wide = run_udf(wide, TILE, list(layer.inputs), layer.udf, layer.tile_size)
        if layer.udf.output_planes == 3:
            color = F.struct(*[B.quantize(B.rescale(c, layer.low, layer.high)).alias(c) for c in "rgb"])
        else:
            color = apply_palette(B.rescale("gray", layer.low, layer.high), layer.palette)
    elif layer.rgb:
        shade = [B.rescale(b, layer.low, layer.high) for b in layer.rgb]
        color = F.when(valid, F.struct(*[B.quantize(s).alias(n) for s, n in zip(shade, "rgb")]))
    else:
        gray = B.rescale(F.when(valid, B.expression_column(layer.expression)), layer.low, layer.high)
        color = apply_palette(gray, layer.palette)
    painted = wide.withColumn("_c", color)
    zero = F.lit(0).cast("short")
    shown = F.col("_c.r").isNotNull() & F.col("_c.g").isNotNull() & F.col("_c.b").isNotNull()
    return painted.select(
        F.lit(layer.id).alias("layer"), *TILE, "row", "col", *[F.when(shown, F.col(f"_c.{c}")).otherwise(zero).alias(c) for c in "rgb"],
        F.when(shown, F.lit(255)).otherwise(0).cast("short").alias("a"),
    )


def fill_transparent(painted: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Complete tiles: pixels nothing covers become transparent black. ``tiles`` has the tile key columns."""
    steps = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    keys = [c for c in tiles.columns if c in ("layer", *TILE)]
    grid = tiles.select(*keys).withColumn("row", F.explode(steps)).withColumn("col", F.explode(steps))
    zero = F.lit(0).cast("short")
    return grid.join(painted.select(*keys, "row", "col", *CHANNELS), [*keys, "row", "col"], "left").select(
        *keys, "row", "col", *[F.coalesce(c, zero).alias(c) for c in CHANNELS]
    )


def trace_rows(layer: Layer, targets: DataFrame, plan: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """One trace per tile: decision, bytes, sources in the layer's order, CRSs, plan and temporal rule.

    ``reads`` holds the byte ranges of each tile (``z, x, y, granule_id, path, offset, length``); without
    it ``bytes_read`` is the plan's estimate and ``provenance`` is NULL.
    """
    order = F.array_position(F.array(*[F.lit(b) for b in layer.inputs]), F.col("band"))
    about = targets.groupBy(*TILE).agg(
        F.array_sort(F.collect_set(F.struct(order.alias("at"), "asset"))).alias("_s"), F.max("src_crs").alias("crs_from"),
        F.max("requested_ms").alias("_asked"), F.max("granule_at").alias("_at"),
    )
    decision = F.when(F.col("chosen") == "overview", F.concat(F.lit("overview:"), F.col("factor").cast("string"))).otherwise(F.col("chosen"))
    rows = plan.join(about, TILE)
    range_ = F.struct("path", "offset", "length")
    if reads is not None:
        # a tile's blocks are bounded by its window
        found = reads.groupBy(*TILE).agg(F.array_sort(F.collect_set(range_)).alias("provenance"))
        found = found.withColumn("_bytes", F.aggregate("provenance", F.lit(0).cast("long"), lambda n, p: n + p["length"]))
        rows = rows.join(found, TILE, "left").withColumn("bytes_read", F.coalesce("_bytes", F.lit(0)))
        rows = rows.withColumn("provenance", F.coalesce("provenance", F.array().cast(f"array<{PROVENANCE}>")))
    else:
        rows = rows.withColumn("bytes_read", F.col("cost")).withColumn("provenance", F.lit(None).cast(f"array<{PROVENANCE}>"))
    temporal = F.struct(
        "granule_id", from_unix_millis(F.unix_millis(F.col("_at").cast("timestamp"))).alias("granule_datetime"),
        from_unix_millis("_asked").alias("requested"), F.when(F.col("_asked").isNull(), "latest").otherwise("latest_at_or_before").alias("rule"),
    )
    sources = F.transform("_s", lambda s: s["asset"])
    return rows.select(
        F.lit(layer.id).alias("layer"), T.tile_key("z", "x", "y").alias("tile"), "granule_id", decision.alias("decision"), "bytes_read",
        F.element_at(sources, 1).alias("source"), F.array_distinct(sources).alias("sources"), "crs_from", F.lit(WEB_MERCATOR).alias("crs_to"),
        "provenance", F.col("considered").alias("plan"), temporal.alias("temporal"),
    )


def render(
    layer: Layer,
    tiles: DataFrame,
    granules: DataFrame,
    rasters: DataFrame,
    pixels: DataFrame,
    max_live_bytes: int | None = None,
    chunk: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Render a table of tiles: (tile pixels that a raster covers, traces). See ``warp_tiles`` for ``chunk``."""
    resolved = resolve_tiles(layer, tiles, granules)
    targets = cut_lineage(_targets(layer, resolved, granules, rasters))
    plan = cut_lineage(plan_tiles(layer, targets, max_live_bytes))
    painted = paint(layer, warp_tiles(layer, shape_tiles(layer, targets, plan), pixels, chunk))
    return painted, trace_rows(layer, targets, plan)


def tile_reads(shaped: DataFrame, refs: DataFrame) -> DataFrame:
    """``z, x, y, granule_id, path, offset, length`` of the stored blocks in every tile's windows."""
    touched = BW.touched_blocks(shaped, BAND)
    return touched.join(refs.where(allocated(refs)), ["asset", "level", "cy", "cx"]).select(*TILE, "path", "offset", "length")


def render_refs(
    layer: Layer,
    tiles: DataFrame,
    granules: DataFrame,
    rasters: DataFrame,
    refs: DataFrame,
    root: str = "",
    max_live_bytes: int | None = None,
    whole_files: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Render from byte ranges of stored files: (tile pixels, traces with the ranges each tile took).

    ``refs`` is the table ``read_chunk_refs`` reads, one row per block of every asset and level; its
    ``nodata`` defaults to the raster's. Only blocks some tile's window touches are read, each once, and
    neighbours in a file in one request. A block that cannot be read fails the job.
    """
    resolved = resolve_tiles(layer, tiles, granules)
    targets = cut_lineage(_targets(layer, resolved, granules, rasters))
    plan = cut_lineage(plan_tiles(layer, targets, max_live_bytes))
    shapes = refs.groupBy("asset", "level").agg(F.max("h").alias("block_h"), F.max("w").alias("block_w"))
    shaped = cut_lineage(shape_tiles(layer, targets, plan).join(shapes, ["asset", "level"]))
    if "nodata" not in refs.columns and "nodata" in rasters.columns:
        refs = refs.join(rasters.select("asset", "nodata"), "asset", "left")
    wanted = BW.keep_touched(refs, BW.touched_blocks(shaped, ["asset", "level"]), ["asset", "level"])
    read = read_chunk_refs(wanted, root, whole_files=whole_files)
    where = F.concat_ws(" ", F.lit("block"), "asset", "level", "cy", "cx", "error")
    blocks = read.withColumn("values", F.when(F.col("error").isNull(), F.col("values")).otherwise(F.raise_error(where).cast("array<double>")))
    return paint(layer, warp_tiles(layer, shaped, blocks)), trace_rows(layer, targets, plan, tile_reads(shaped, refs))


def tile_keys(layer: Layer, resolved: DataFrame) -> DataFrame:
    """Resolved tiles with their content key."""
    plan = F.lit(layer.plan_json())
    versioned = resolved.withColumn("version", K.layer_version("granule_id", plan))
    key = K.tile_key_hash(F.lit(layer.id), "version", plan, F.lit("WebMercatorQuad"), "z", "x", "y", F.lit(layer.tile_size))
    return versioned.withColumn("tile_key", key)


def render_cached(
    layer: Layer, tiles: DataFrame, granules: DataFrame, rasters: DataFrame, pixels: DataFrame, stored: DataFrame,
    chunk: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Render only tiles whose key is not among ``stored`` (``tile_key``): (new pixels, traces of all).

    Stored tiles are traced as hits that read no bytes. Traces carry ``tile_key``; a tile no pixel of
    which is covered has a trace but no pixels, so the traces say what is done.
    """
    keyed = cut_lineage(tile_keys(layer, resolve_tiles(layer, tiles, granules)))
    todo = missing_tiles(keyed, stored)
    targets = cut_lineage(_targets(layer, todo.select(*TILE, "requested_ms"), granules, rasters))
    plan = cut_lineage(plan_tiles(layer, targets))
    fresh = paint(layer, warp_tiles(layer, shape_tiles(layer, targets, plan), pixels, chunk)).join(todo.select(*TILE, "tile_key"), TILE)
    hits = keyed.join(stored.select("tile_key"), "tile_key", "left_semi").select(
        F.lit(layer.id).alias("layer"), T.tile_key("z", "x", "y").alias("tile"), "granule_id", F.lit("cache_hit").alias("decision"),
        F.lit(0).cast("long").alias("bytes_read"), F.array().cast("array<string>").alias("sources"),
        F.lit(None).cast("string").alias("crs_from"), F.lit(WEB_MERCATOR).alias("crs_to"),
        F.array().cast(f"array<{PROVENANCE}>").alias("provenance"), "tile_key",
    )
    named = todo.select(T.tile_key("z", "x", "y").alias("tile"), "granule_id", "tile_key")
    done = trace_rows(layer, targets, plan).join(named, ["tile", "granule_id"])
    return fresh, done.unionByName(hits, allowMissingColumns=True)


def rendered_keys(traces: DataFrame) -> DataFrame:
    """Keys a cached render has newly done: what to add to the stored ones."""
    return traces.where(~F.col("decision").isin("cache_hit", "refuse")).select("tile_key").distinct()


def preview(
    layer: Layer, boxes: DataFrame, granules: DataFrame, rasters: DataFrame, pixels: DataFrame, max_live_bytes: int, chunk: tuple[int, int] | None = None
):
    """One small render per bbox: the deepest tile that holds it whole, under a byte ceiling."""
    b = F.col("bbox")
    tile = deepest_containing_tile(b["west"], b["south"], b["east"], b["north"])
    tiles = boxes.select(tile.alias("t")).select("t.*", F.lit(None).cast("long").alias("t_ms")).distinct()
    return render(layer, tiles, granules, rasters, pixels, max_live_bytes, chunk)


def frame_loop(
    layer: Layer, tiles: DataFrame, instants_ms: list[int], granules: DataFrame, rasters: DataFrame, pixels: DataFrame, stored: DataFrame,
    chunk: tuple[int, int] | None = None,
):
    """Every tile at every instant through the cache; the instants are a short literal list."""
    times = F.explode(F.array(*[F.lit(int(t)).cast("long") for t in instants_ms]))
    return render_cached(layer, tiles.select("z", "x", "y", times.alias("t_ms")), granules, rasters, pixels, stored, chunk)


# --- pyramids ---


def materialize(
    rasters: DataFrame, source: DataFrame, layer_assets: DataFrame, path: str, chunk: int = 256, min_dim: int = 256, fill: float | None = None
) -> list[int]:
    """Build and store every missing overview level of the layers' assets; gives the factors written.

    ``source`` is blocks ``asset, level, cy, cx, values`` of ``chunk`` pixels a side, or pixel rows
    ``asset, level, row, col, value``, which are packed first (embedded levels included); ``layer_assets``
    is ``asset, resampling``. ``rasters`` may name the source's ``fingerprint`` (see
    ``reference_fingerprint``); otherwise it is taken from the samples. A level counts once its identity
    is recorded after its blocks: recorded levels are skipped, unrecorded ones resume, and a level whose
    record differs refuses the whole job, as do conflicting resamplings. Blocks are halved in place and
    read back from storage to build the next level. ``fill`` is stored for invalid samples (default NULL).
    """
    spark = source.sparkSession
    wanted = PY.dedup_assets(layer_assets)
    if not wanted.where("conflict").isEmpty():
        raise ValueError("an asset is used with two resamplings")
    blocks = source if "values" in source.columns else pack_chunks(source, ["asset", "level"], chunk)
    if "fingerprint" not in rasters.columns:
        rasters = rasters.join(content_fingerprint(blocks.where("level = 1")), "asset", "left")
    assets = rasters.join(wanted.select("asset", F.col("resamplings")[0].alias("resampling")), "asset")
    ladder = PY.ladder_column("width", "height", F.col("overview_levels"), min_dim)
    levels = cut_lineage(assets.select(
        "asset", F.explode(ladder.cast("array<int>")).alias("factor"), "width", "height", "dtype", F.lit(chunk).alias("chunk"), "resampling",
        F.lit(LAYOUT).alias("layout"), "fingerprint",
    ))
    known = stored_identities(spark, path)
    if refused := pyramid_conflicts(levels, known).limit(5).collect():
        names = ", ".join(f"{r['asset']} at {r['factor']}" for r in refused)
        raise ValueError(f"stored levels describe another raster: {names}")
    todo = cut_lineage(levels.join(known.select("asset", "factor"), ["asset", "factor"], "left_anti"))
    written = sorted(r["factor"] for r in todo.select("factor").distinct().collect())
    given = blocks.select("asset", F.col("level").cast("int").alias("factor"), "cy", "cx", "values")
    for factor in written:
        mine = todo.where(F.col("factor") == factor)
        below = given
        if (stored := stored_pyramid(spark, path)) is not None:
            plain = F.col("values") if fill is None else F.transform("values", lambda v: F.when(v != fill, v))
            below = given.unionByName(stored.select("asset", "factor", "cy", "cx", plain.alias("values")))
        base = below.where(F.col("factor") == factor // 2).join(mine.select("asset", "resampling", "dtype"), "asset")
        level = PY.coarser_blocks(base, ["asset"], chunk)
        if fill is not None:
            level = level.withColumn("values", F.transform("values", lambda v: F.coalesce(v, F.lit(float(fill)))))
        append_blocks(level.withColumn("factor", F.lit(factor)), path)
        record_identities(mine, path)
    return written


# --- registration ---


def register(granules: DataFrame, catalog: DataFrame, datasets: DataFrame, rasters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validate and upsert granules: (new catalog, datasets with extents derived again, quarantined).

    A granule without a bbox gets the box of its first asset's raster. Both granule tables have
    ``dataset, id, bbox, datetime, assets, version``.
    """
    good, bad = C.validate_granules(granules, datasets)
    first = F.get(F.array_sort(F.map_keys("assets")), F.lit(0))
    named = good.withColumn("_asset", F.when(F.col("bbox").isNull(), F.element_at("assets", first)["href"]))
    boxes = W.raster_bounds(rasters).select(F.col("asset").alias("_asset"), F.struct("west", "south", "east", "north").alias("_box"))
    placed = named.join(boxes, "_asset", "left").withColumn("bbox", F.coalesce("bbox", "_box")).select(*good.columns)
    merged = C.upsert(catalog, placed, ["dataset", "id"], "version")
    return merged, C.heal_extents(datasets, merged), bad


def burn_severity(series: DataFrame, keys: list[str], before: Column, nir: str, swir: str) -> DataFrame:
    """Burn-ratio drop per key: mean ratio of the rows ``before`` minus that of the others."""
    ratio = B.nbr(nir, swir)
    means = series.groupBy(*keys).agg(
        F.avg(F.when(before, ratio)).alias("_pre"), F.avg(F.when(~before, ratio)).alias("_post")
    )
    both = F.col("_pre").isNotNull() & F.col("_post").isNotNull()
    return means.where(both).select(*keys, (F.col("_pre") - F.col("_post")).alias("dnbr"))
