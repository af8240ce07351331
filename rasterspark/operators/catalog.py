"""Catalog tables: filters, validation, extents, browsing, upserts, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal
from .ordered import circle

SAFE_ID = r"^[A-Za-z0-9_-]+$"


# --- filters ---


def load_collection(
    granules: DataFrame,
    dataset: str,
    bands: list[str] | None = None,
    extent: tuple[str | None, str | None] | None = None,
    vocabulary: dict[str, str] | list[str] | None = None,
    datasets: DataFrame | None = None,
) -> DataFrame:
    """One row per granule and band of a dataset: ``dataset, id, datetime, bbox, band, href, kind``.

    ``vocabulary`` is the dataset's band list, or a map of alias to band; an unknown band raises. With
    ``datasets`` (id, bands) an unknown dataset raises too, and its bands are the vocabulary if none is given.
    """
    if datasets is not None:
        known = datasets.where(F.col("id") == dataset).select("bands").first()
        if known is None:
            raise ValueError(f"unknown dataset {dataset!r}")
        vocabulary = vocabulary if vocabulary is not None else list(known["bands"] or [])
    out = granules.where(F.col("dataset") == dataset)
    if extent is not None:
        out = filter_temporal(out, extent)
    out = out.select("dataset", "id", "datetime", "bbox", F.explode("assets").alias("band", "asset"))
    if bands is not None:
        names = vocabulary if isinstance(vocabulary, dict) else {b: b for b in (bands if vocabulary is None else vocabulary)}
        known = {**names, **{b: b for b in names.values()}}
        unknown = [b for b in bands if b not in known]
        if unknown:
            raise ValueError(f"unknown bands {unknown} of dataset {dataset!r}")
        out = out.where(F.col("band").isin([known[b] for b in bands]))
    return out.select("dataset", "id", "datetime", "bbox", "band", "asset.href", "asset.kind")


def _bounds(column: str, start: int | None, end: int | None) -> Column:
    """Inclusive millisecond bounds on a timestamp column, in a form parquet can push down."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(column) >= F.timestamp_millis(F.lit(start)))
    if end is not None:  # finer digits of the column are cut to the millisecond
        keep = keep & (F.col(column) < F.timestamp_millis(F.lit(end + 1)))
    return keep


def filter_temporal(
    df: DataFrame, extent: tuple[str | None, str | None], dimension: str | None = None, column: str = "datetime"
) -> DataFrame:
    """Keep the left-closed interval ``[start, end)``; bounds are instants, dates, years or None."""
    if dimension not in (None, "t"):
        raise ValueError(f"dimension {dimension!r} is not available")
    return df.where(_bounds(column, *temporal.parse_extent(extent)))


def filter_datetime(df: DataFrame, text: str, column: str = "datetime") -> DataFrame:
    """Keep rows in an instant or ``a/b`` interval; an instant keeps exactly that millisecond."""
    start, end, _ = temporal.parse_datetime(text)
    return df.where(_bounds(column, start, end))


def filter_bbox(df: DataFrame, west: float, south: float, east: float, north: float, bbox: str = "bbox") -> DataFrame:
    """Keep footprints meeting the box. Either side may cross the antimeridian (west > east)."""
    w, s, e, n = (F.col(f"{bbox}.{k}") for k in ("west", "south", "east", "north"))
    query = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    keep = F.lit(False)
    for lo, hi in query:
        plain = (w <= hi) & (e >= lo)
        wrapped = (w <= hi) | (e >= lo)
        keep = keep | F.when(w <= e, plain).otherwise(wrapped)
    return df.where((s <= north) & (n >= south) & keep)


# --- validation ---


def granule_issues(dataset_bands: Column | str = "bands") -> Column:
    """Reasons a granule row is refused, empty when it is fine.

    Expects ``dataset, id, datetime, assets`` and the dataset's ``bands`` (NULL = unknown dataset).
    """
    bands = F.col(dataset_bands) if isinstance(dataset_bands, str) else dataset_bands
    keys = F.map_keys("assets")
    rules = [
        (F.coalesce(F.trim("id") == "", F.lit(True)), "id missing"),
        (F.col("datetime").isNull(), "datetime missing"),
        (F.coalesce(F.size(keys) < 1, F.lit(True)), "assets missing"),
        (~F.coalesce(F.col("dataset").rlike(SAFE_ID), F.lit(False)), "dataset id not url-safe"),
        (bands.isNull(), "dataset unknown"),
        (F.coalesce(F.size(F.array_except(keys, bands)) > 0, F.lit(False)), "band not in vocabulary"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in rules]), lambda t: t.isNotNull())


def validate_granules(granules: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split granules into (good, quarantined); the latter keep their ``issues``."""
    known = datasets.select(F.col("id").alias("dataset"), F.col("bands").alias("_bands"))
    checked = granules.join(known, "dataset", "left").withColumn("issues", granule_issues("_bands")).drop("_bands")
    good = checked.where(F.size("issues") == 0).drop("issues")
    return good, checked.where(F.size("issues") > 0)


def known_dataset(events: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split arrivals into (accepted, rejected) by whether their dataset exists."""
    ids = datasets.select(F.col("id").alias("dataset"))
    return events.join(ids, "dataset", "left_semi"), events.join(ids, "dataset", "left_anti")


def unknown_bands(granules: DataFrame, datasets: DataFrame) -> DataFrame:
    """Bands of each granule that its dataset does not declare."""
    known = datasets.select(F.col("id").alias("dataset"), "bands")
    unknown = F.array_sort(F.array_except(F.map_keys("assets"), F.col("bands")))
    return granules.join(known, "dataset").select("dataset", "id", unknown.alias("unknown"))


def valid_layers(layers: DataFrame, datasets: DataFrame) -> DataFrame:
    """Layers whose inputs all still exist in their dataset's bands."""
    known = datasets.select(F.col("id").alias("dataset"), F.col("bands").alias("_bands"))
    return (
        layers.join(known, "dataset")
        .where(F.size(F.array_except("inputs", "_bands")) == 0)
        .drop("_bands")
    )


# --- extents ---


def temporal_interval(granules: DataFrame) -> DataFrame:
    """First and last acquisition per dataset."""
    return granules.groupBy("dataset").agg(F.min("datetime").alias("t_start"), F.max("datetime").alias("t_end"))


def union_bbox(granules: DataFrame) -> DataFrame:
    """Envelope of all footprints per dataset (a plain envelope, also across the antimeridian)."""
    return granules.groupBy("dataset").agg(
        F.min("bbox.west").alias("west"),
        F.min("bbox.south").alias("south"),
        F.max("bbox.east").alias("east"),
        F.max("bbox.north").alias("north"),
    )


def heal_extents(datasets: DataFrame, granules: DataFrame) -> DataFrame:
    """Datasets with box and interval derived again from all granules; both NULL without any."""
    derived = granules.groupBy(F.col("dataset").alias("id")).agg(
        F.min("datetime").alias("t_start"),
        F.max("datetime").alias("t_end"),
        F.struct(
            F.min("bbox.west").alias("west"),
            F.min("bbox.south").alias("south"),
            F.max("bbox.east").alias("east"),
            F.max("bbox.north").alias("north"),
        ).alias("bbox"),
    )
    return datasets.drop("t_start", "t_end", "bbox").join(derived, "id", "left")


# --- browsing and order ---


def browse_granules(
    granules: DataFrame,
    dataset: str,
    bbox: tuple[float, float, float, float] | None = None,
    datetime: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page, newest first, ties by id descending."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be in 1..1000")
    page = matching_granules(granules, dataset, bbox, datetime)
    return page.orderBy(F.col("datetime").desc(), F.col("id").desc()).offset(offset).limit(limit)


def matching_granules(
    granules: DataFrame,
    dataset: str,
    bbox: tuple[float, float, float, float] | None = None,
    datetime: str | None = None,
) -> DataFrame:
    """The granules a browse request selects, before paging."""
    out = granules.where(F.col("dataset") == dataset)
    if bbox is not None:
        out = filter_bbox(out, *bbox)
    return filter_datetime(out, datetime) if datetime is not None else out


def browse_summary(matching: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """``number_matched, number_returned, has_next`` of a page."""
    n = F.col("number_matched")
    returned = F.least(F.greatest(n - offset, F.lit(0)), F.lit(limit))
    return matching.agg(F.count("*").alias("number_matched")).select(
        n, returned.alias("number_returned"), (n > offset + limit).alias("has_next")
    )


def list_by_id(df: DataFrame) -> DataFrame:
    """Datasets or layers in id order."""
    return df.orderBy("id")


# --- upserts ---


def upsert(catalog: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Create or replace by key; the highest ``version`` wins, updates win over the catalog on ties.

    One partially aggregated group-by: a key with very many copies is folded before the shuffle.
    """
    columns = catalog.columns
    both = catalog.withColumn("_from", F.lit(0)).unionByName(updates.withColumn("_from", F.lit(1)))
    order = F.struct(F.col(version), F.col("_from"))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return newest.select("_row.*")


# --- frames ---


def frames(granules: DataFrame) -> DataFrame:
    """Distinct acquisition instants per dataset with index, next and after-next (wrapping round).

    Granules of one instant are one frame. One pass over sampled ranges gives all three.
    """
    distinct = granules.groupBy("dataset", temporal.instant_ms("datetime").alias("frame_ms")).agg(F.count("*").alias("granules"))
    found = circle(distinct, ["dataset"], "frame_ms", ("frame_index", "next_ms", "after_next_ms"))
    return found.select("dataset", "frame_ms", "frame_index", "granules", "next_ms", "after_next_ms")


# --- footprints ---


def footprint_geojson(bbox: Column | str = "bbox") -> Column:
    """A bbox as GeoJSON polygon text (closed counter-clockwise ring); NULL when malformed."""
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    w, s, e, n = (b[k] for k in ("west", "south", "east", "north"))
    ring = F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    ok = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull() & (s <= n)
    return F.when(ok, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
