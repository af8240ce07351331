"""Small text and metadata functions: links, file names, codecs, chunk keys, variable names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tiles import col

# Extensions of legacy container formats.
LEGACY_EXTENSIONS = ("h5", "hdf5", "nc", "nc4", "grib2", "grb2", "grib")

# Sample types a raster can have, with their widths in bytes.
SAMPLE_BYTES = {"uint8": 1, "int16": 2, "uint16": 2, "int32": 4, "float32": 4, "float64": 8}

# Sample types a chunked-array store can represent.
STORE_DTYPES = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64")

# Data representation template number to codec name.
PACKING_CODECS = {
    0: "grib2:simple",
    2: "grib2:complex",
    3: "grib2:complex-spatial-diff",
    4: "grib2:ieee-float",
    40: "grib2:jpeg2000",
    41: "grib2:png",
    42: "grib2:aec",
}

# Weather-model abbreviation to short variable name.
SHORT_NAMES = {
    "TMP": "t",
    "UGRD": "u",
    "VGRD": "v",
    "RH": "r",
    "HGT": "gh",
    "SPFH": "q",
    "DPT": "dpt",
    "PRMSL": "prmsl",
}


def literal_map(values: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


# --- links ---


def link_path(link) -> Column:
    """A link without query and fragment."""
    return F.regexp_extract(col(link), r"^[^?#]*", 0)


def classify_link(link) -> Column:
    """``stac`` for a ``.json`` document, ``cog`` for anything else."""
    return F.when(F.lower(link_path(link)).endswith(".json"), "stac").otherwise("cog")


def stem(link) -> Column:
    """The last non-empty path segment without its extension."""
    name = F.regexp_extract(link_path(link), r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def slug(text) -> Column:
    """Lower-case text of letters, digits, ``-`` and ``_``; every other run becomes one ``-``."""
    dashed = F.regexp_replace(col(text), r"[^A-Za-z0-9_-]+", "-")
    return F.lower(F.regexp_replace(dashed, r"^-+|-+$", ""))


def split_fragment(href) -> Column:
    """``file#array`` at the first ``#`` to ``struct<key,array>``; NULL without a fragment."""
    href = col(href)
    at = F.instr(href, "#")
    array = href.substr(at + 1, F.length(href))
    return F.when(
        (at > 0) & (F.length(array) > 0),
        F.struct(href.substr(F.lit(1), at - 1).alias("key"), array.alias("array")),
    )


def extension(path) -> Column:
    """Lower-case extension of a path, empty when it has none."""
    return F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]*)$", 1))


# --- names ---


def sensing_day(granule) -> Column:
    """The day part of a granule name: fourth dotted part up to its ``T``."""
    return F.split_part(F.split_part(col(granule), F.lit("."), F.lit(4)), F.lit("T"), F.lit(1))


def fixture_name(granule, band, prefix: str = "hlss30-t10tfk") -> Column:
    """File name of one date and band."""
    return F.concat(F.lit(prefix + "-"), sensing_day(granule), F.lit("-"), F.lower(col(band)), F.lit(".tif"))


def cfgrib_name(abbrev, height_above_ground, level) -> Column:
    """Variable name of a weather field; height-above-ground levels are appended (t2m, u10)."""
    abbrev, level = col(abbrev), col(level)
    base = F.element_at(literal_map(SHORT_NAMES), abbrev)
    suffix = F.when(base == "t", "m").otherwise("")
    levelled = F.concat(base, F.bround(level, 0).cast("long").cast("string"), suffix)
    return (
        F.when(base.isNull(), F.lower(abbrev))
        .when(col(height_above_ground) & level.isNotNull(), levelled)
        .otherwise(base)
    )


def packing_codec(template) -> Column:
    """Codec name of a data representation template."""
    template = col(template).cast("int")
    known = F.element_at(literal_map(PACKING_CODECS), template)
    return F.coalesce(known, F.concat(F.lit("grib2:template"), template.cast("string")))


# --- boxes ---


def parse_bbox(text) -> Column:
    """``w,s,e,n`` to a bbox struct; NULL unless four finite numbers with south <= north."""
    parts = F.split(col(text), ",")
    nums = [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]
    ok = F.size(parts) == 4
    for n in nums:
        ok = ok & (F.abs(n) < float("inf")) & ~F.isnan(n)
    names = ("west", "south", "east", "north")
    return F.when(ok & (nums[1] <= nums[3]), F.struct(*[n.alias(k) for n, k in zip(nums, names)]))


# --- chunks and codecs ---


def parse_chunk_key(key) -> Column:
    """Dotted ``row.col`` chunk key to ``struct<cy,cx>``; NULL when malformed."""
    key = col(key)
    shape = key.rlike(r"^\d{1,18}\.\d{1,18}$")
    parts = F.split(key, r"\.")
    return F.when(
        shape,
        F.struct(
            parts.getItem(0).try_cast("long").alias("cy"), parts.getItem(1).try_cast("long").alias("cx")
        ),
    )


def chunk_path(root, factor, cy, cx) -> Column:
    """Where one chunk of a level lies: ``root/factor/row.col``."""
    key = F.concat_ws(".", col(cy).cast("string"), col(cx).cast("string"))
    return F.concat_ws("/", col(root), col(factor).cast("string"), key)


def parse_codec(codec) -> Column:
    """``name[:level]`` to ``struct<name,level>``; a zlib level outside 0-9 or unreadable is 6."""
    codec = col(codec)
    name = F.substring_index(codec, ":", 1)
    level = F.when(F.instr(codec, ":") > 0, codec.substr(F.instr(codec, ":") + 1, F.length(codec)))
    valid = F.when(level.rlike(r"^\+?\d{1,9}$"), level.try_cast("int"))
    return F.struct(
        name.alias("name"),
        F.when(name == "zlib", F.coalesce(F.when(valid.between(0, 9), valid), F.lit(6))).alias("level"),
    )


def size_bytes(dtype) -> Column:
    """Bytes per sample; NULL for a type a raster cannot have."""
    return F.try_element_at(literal_map(SAMPLE_BYTES), col(dtype))


def dtype_from_tags(sample_format, bits) -> Column:
    """Sample type from an image directory's format name and bit depth; NULL when unsupported."""
    tag = F.concat_ws("", F.lower(col(sample_format)), col(bits).cast("string"))
    return F.when(tag.isin(*SAMPLE_BYTES), tag)


def numeric_fill(nodata) -> Column:
    """What padding holds: the nodata sentinel, or 0 when there is none."""
    return F.coalesce(col(nodata), F.lit(0.0))
