"""Granules from drop manifests and from STAC documents, and back to STAC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.text import LEGACY_EXTENSIONS, extension
from ..schema import DROP_MANIFEST

# The document version written and accepted, the prefix of our own fields.
STAC_VERSION = "1.1.0"
PREFIX = "raster"
ASSET_KINDS = ("raster", "virtual_cube")


def read_granules(spark: SparkSession, path: str) -> DataFrame:
    """Drop manifests ``*.json`` of a directory as raw text rows ``value, name``.

    One manifest is one file; dot and underscore names are staging files and are never listed.
    """
    files = spark.read.option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
    return files.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))


def parse_drop_manifests(raw: DataFrame) -> DataFrame:
    """Raw manifest text to granule columns plus ``issue`` (NULL when it is well formed)."""
    doc = F.from_json("value", DROP_MANIFEST, {"mode": "PERMISSIVE"})
    allowed = [f.name for f in DROP_MANIFEST.fields]
    df = raw.withColumn("_d", doc).withColumn("_keys", F.json_object_keys("value"))
    box = F.col("_d.bbox")
    issue = (
        F.when(F.col("_keys").isNull(), "not a JSON object")
        .when(F.size(F.array_except("_keys", F.array(*map(F.lit, allowed)))) > 0, "unknown field")
        .when(F.col("_d.dataset").isNull() | F.col("_d.granule").isNull(), "missing dataset or granule")
        .when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull()), "bbox is not four numbers")
        .when(~temporal.is_rfc3339_utc("_d.datetime"), "datetime is not RFC 3339 UTC")
        .when(F.col("_d.assets").isNull(), "missing assets")
    )
    names = ("west", "south", "east", "north")
    asset = lambda _, href: F.struct(href.alias("href"), F.lit("raster").alias("kind"))
    return df.withColumn("issue", issue).select(
        F.col("_d.dataset").alias("dataset"),
        F.col("_d.granule").alias("id"),
        F.struct(*[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(names)]).alias("bbox"),
        F.timestamp_millis(temporal.to_unix_millis("_d.datetime")).alias("datetime"),
        F.transform_values("_d.assets", asset).alias("assets"),
        F.lit(None).cast("timestamp").alias("ingested_at"),
        *[c for c in raw.columns if c != "value"],
        F.col("value").alias("raw"),
        "issue",
    )


# --- legacy containers ---


def rewrite_legacy_asset(asset: Column, extensions=LEGACY_EXTENSIONS) -> Column:
    """One asset of a legacy file pointed at its manifest; other assets unchanged.

    ``file#array`` becomes ``file.vmanifest.json#array`` of kind ``virtual_cube``. A legacy file that
    is absolute or carries a scheme gives NULL.
    """
    href = asset["href"]
    at = F.instr(href, "#")
    file = F.when(at > 0, href.substr(F.lit(1), at - 1)).otherwise(href)
    tail = F.when(at > 0, href.substr(at, F.length(href))).otherwise("")
    legacy = extension(file).isin(*extensions)
    refused = legacy & (file.startswith("/") | file.contains("://"))
    rewritten = F.struct(F.concat(file, F.lit(".vmanifest.json"), tail).alias("href"), F.lit("virtual_cube").alias("kind"))
    return F.when(refused, None).when(legacy, rewritten).otherwise(F.struct(href.alias("href"), asset["kind"].alias("kind")))


def expand_legacy_assets(granules: DataFrame, extensions=LEGACY_EXTENSIONS) -> DataFrame:
    """Granules with legacy assets rewritten and ``refused`` listing bands that cannot be referenced."""
    changed = F.transform_values("assets", lambda _, a: rewrite_legacy_asset(a, extensions))
    df = granules.withColumn("_new", changed)
    bad = F.map_keys(F.map_filter("_new", lambda _, a: a.isNull()))
    good = F.map_filter("_new", lambda _, a: a.isNotNull())
    return df.select(*[c for c in granules.columns if c != "assets"], good.alias("assets"), bad.alias("refused"))


def legacy_files(granules: DataFrame, extensions=LEGACY_EXTENSIONS) -> DataFrame:
    """Distinct legacy files the granules need referenced, each once."""
    files = granules.select(F.explode("assets").alias("band", "a")).select(
        F.substring_index("a.href", "#", 1).alias("file")
    )
    keep = extension("file").isin(*extensions) & ~F.col("file").startswith("/") & ~F.col("file").contains("://")
    return files.where(keep).distinct()


# --- STAC ---


def to_stac_items(granules: DataFrame) -> DataFrame:
    """Granules as STAC item documents ``dataset, id, doc``; geometry is derived from the bbox."""
    b = F.col("bbox")
    w, s, e, n = (b[k] for k in ("west", "south", "east", "north"))
    ring = F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    asset = lambda _, a: F.struct(
        a["href"].alias("href"), F.when(a["kind"] != "raster", a["kind"]).alias(f"{PREFIX}:kind")
    )
    properties = F.struct(
        temporal.from_unix_millis(temporal.instant_ms("datetime")).alias("datetime"),
        temporal.from_unix_millis(temporal.instant_ms("ingested_at")).alias(f"{PREFIX}:ingested_at"),
    )
    doc = F.struct(
        F.lit("Feature").alias("type"),
        F.lit(STAC_VERSION).alias("stac_version"),
        F.col("id").cast("string").alias("id"),
        F.col("dataset").alias("collection"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.array(w, s, e, n).alias("bbox"),
        properties.alias("properties"),
        F.transform_values("assets", asset).alias("assets"),
    )
    return granules.select("dataset", "id", F.to_json(doc).alias("doc"))


def to_stac_collections(datasets: DataFrame) -> DataFrame:
    """Datasets as STAC collection documents ``id, doc``; open bounds are written as null."""
    b = F.col("bbox")
    instant = lambda c: temporal.from_unix_millis(temporal.instant_ms(c))
    extent = F.struct(
        F.struct(F.array(F.array(*[b[k] for k in ("west", "south", "east", "north")])).alias("bbox")).alias("spatial"),
        F.struct(F.array(F.array(instant("t_start"), instant("t_end"))).alias("interval")).alias("temporal"),
    )
    doc = F.struct(
        F.lit("Collection").alias("type"),
        F.lit(STAC_VERSION).alias("stac_version"),
        "id",
        "title",
        "description",
        "license",
        extent.alias("extent"),
        F.array().cast("array<string>").alias("links"),
        F.col("bands").alias(f"{PREFIX}:bands"),
        F.col("layers").alias(f"{PREFIX}:layers"),
    )
    return datasets.select("id", F.to_json(doc, {"ignoreNullFields": "true"}).alias("doc"))


_ITEM = (
    "type string, stac_version string, id string, collection string, bbox array<double>, "
    f"properties struct<datetime:string,`{PREFIX}:ingested_at`:string>, "
    f"assets map<string,struct<href:string,`{PREFIX}:kind`:string>>"
)


def from_stac_items(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Item documents to granules plus ``issue``, the path of the first broken field (NULL when fine)."""
    parsed = df.withColumn("_d", F.from_json(doc, _ITEM, {"mode": "PERMISSIVE"}))
    d = F.col("_d")
    box, props, assets = d["bbox"], d["properties"], d["assets"]
    kind = lambda a: a[f"{PREFIX}:kind"]
    ingested = props[f"{PREFIX}:ingested_at"]
    issue = (
        F.when(F.coalesce(d["type"] != "Feature", F.lit(True)), "type")
        .when(F.coalesce(d["stac_version"] != STAC_VERSION, F.lit(True)), "stac_version")
        .when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull()), "bbox")
        .when(~temporal.is_rfc3339_utc(props["datetime"]), "properties.datetime")
        .when(ingested.isNotNull() & ~temporal.is_rfc3339_utc(ingested), f"properties.{PREFIX}:ingested_at")
        .when(assets.isNull(), "assets")
        .when(F.exists(F.map_values(assets), lambda a: a["href"].isNull()), "assets.href")
        .when(
            F.exists(F.map_values(assets), lambda a: ~F.coalesce(kind(a), F.lit("raster")).isin(*ASSET_KINDS)),
            f"assets.{PREFIX}:kind",
        )
        .when(d["id"].isNull(), "id")
        .when(d["collection"].isNull(), "collection")
    )
    names = ("west", "south", "east", "north")
    asset = lambda _, a: F.struct(
        a["href"].alias("href"), F.coalesce(kind(a), F.lit("raster")).alias("kind")
    )
    return parsed.withColumn("issue", issue).select(
        d["collection"].alias("dataset"),
        d["id"].alias("id"),
        F.struct(*[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(names)]).alias("bbox"),
        F.timestamp_millis(temporal.to_unix_millis(props["datetime"])).alias("datetime"),
        F.transform_values(assets, asset).alias("assets"),
        F.timestamp_millis(temporal.to_unix_millis(ingested)).alias("ingested_at"),
        "issue",
    )


_COLLECTION = (
    "type string, stac_version string, id string, title string, description string, license string, "
    "extent struct<spatial:struct<bbox:array<array<double>>>,temporal:struct<interval:array<array<string>>>>, "
    f"`{PREFIX}:bands` array<string>"
)


def from_stac_collections(df: DataFrame, doc: str = "doc", layers: str = "array<string>") -> DataFrame:
    """Collection documents to datasets plus ``issue``; foreign collections lack our fields and are named so.

    ``layers`` is the type of the layers as they were written. A collection without any has null there.
    """
    parsed = df.withColumn("_d", F.from_json(doc, f"{_COLLECTION}, `{PREFIX}:layers` {layers}", {"mode": "PERMISSIVE"}))
    d = F.col("_d")
    box = F.get(d["extent"]["spatial"]["bbox"], F.lit(0))
    span = F.get(d["extent"]["temporal"]["interval"], F.lit(0))
    start, end = F.get(span, F.lit(0)), F.get(span, F.lit(1))
    bad = lambda t: t.isNotNull() & ~temporal.is_rfc3339_utc(t)
    issue = (
        F.when(F.coalesce(d["type"] != "Collection", F.lit(True)), "type")
        .when(F.coalesce(d["stac_version"] != STAC_VERSION, F.lit(True)), "stac_version")
        .when(box.isNull() | (F.size(box) != 4), "extent.spatial.bbox")
        .when(span.isNull() | (F.size(span) != 2) | bad(start) | bad(end), "extent.temporal.interval")
        .when(d[f"{PREFIX}:bands"].isNull(), f"{PREFIX}:bands")
        .when(d["id"].isNull(), "id")
    )
    names = ("west", "south", "east", "north")
    stamp = lambda t: F.timestamp_millis(temporal.to_unix_millis(t))
    return parsed.withColumn("issue", issue).select(
        d["id"].alias("id"),
        d["title"].alias("title"),
        d["description"].alias("description"),
        d["license"].alias("license"),
        F.struct(*[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(names)]).alias("bbox"),
        stamp(start).alias("t_start"),
        stamp(end).alias("t_end"),
        F.array_sort(F.array_distinct(d[f"{PREFIX}:bands"])).alias("bands"),
        d[f"{PREFIX}:layers"].alias("layers"),
        "issue",
    )
