"""Byte-range manifests: reading them, comparing them, summarising them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import north_up
from ..functions.text import STORE_DTYPES
from ..operators.ordered import position
from ..schema import MANIFEST
from ..session import deal_out

MANIFEST_VERSION = 1


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents of a directory, one file each: ``file, doc, issue``."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
    return parse_manifests(files.select("value", F.col("_metadata.file_path").alias("file")))


def parse_manifests(raw: DataFrame) -> DataFrame:
    """Manifest text to ``doc`` (NULL when refused) and ``issue`` (why)."""
    keys = F.json_object_keys("value")
    known = F.array(*[F.lit(f.name) for f in MANIFEST.fields])
    parsed = raw.withColumn("_doc", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}))
    issue = (
        F.when(keys.isNull(), "not a JSON object")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown field")
        .when(F.coalesce(F.col("_doc.manifest_version") != MANIFEST_VERSION, F.lit(True)), "unsupported manifest_version")
        .when(F.col("_doc.source").isNull() | F.col("_doc.arrays").isNull(), "missing field")
    )
    checked = parsed.withColumn("issue", issue)
    return checked.withColumn("doc", F.when(F.col("issue").isNull(), F.col("_doc"))).drop("_doc", "value")


def manifest_arrays(manifests: DataFrame) -> DataFrame:
    """One row per array: ``source, name, shape, chunks, dtype, codecs, georef``."""
    rows = manifests.where(F.col("doc").isNotNull()).select("doc.source", F.explode("doc.arrays").alias("a"))
    return rows.select("source", "a.name", "a.shape", "a.chunks", "a.dtype", "a.codecs", "a.georef")


def chunk_refs(manifests: DataFrame) -> DataFrame:
    """One row per stored chunk: ``source, name, key, path, offset, length``."""
    rows = manifests.where(F.col("doc").isNotNull()).select("doc.source", F.explode("doc.arrays").alias("a"))
    refs = rows.select("source", "a.name", F.explode("a.refs").alias("r"))
    return refs.select("source", "name", "r.key", "r.path", "r.offset", "r.length")


# --- comparison ---


def compare_arrays(a: DataFrame, b: DataFrame) -> DataFrame:
    """Arrays of two manifest tables matched by ``source, name``: ``in_a, in_b, same_grid``."""
    fields = ("shape", "chunks", "dtype", "codecs")
    left = a.select("source", "name", F.struct(*fields).alias("_a"))
    right = b.select("source", "name", F.struct(*fields).alias("_b"))
    return left.join(right, ["source", "name"], "full").select(
        "source",
        "name",
        F.col("_a").isNotNull().alias("in_a"),
        F.col("_b").isNotNull().alias("in_b"),
        F.col("_a").eqNullSafe(F.col("_b")).alias("same_grid"),
    )


def _matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """References of both sides by ``source, name, key``, with ``_a`` and ``_b``; sides that are dealt by these lie as they are."""
    left = a.select("source", "name", "key", F.struct("offset", "length").alias("_a"))
    right = b.select("source", "name", "key", F.struct("offset", "length").alias("_b"))
    return left.join(right, ["source", "name", "key"], "full")


def compare_refs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks of arrays both sides have that disagree: ``source, name, key, issue``.

    Chunks only B has are not listed one by one; they show as a count difference of the array.
    """
    both = _matched(a, b)
    counts = both.groupBy("source", "name").agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"))
    per_array = counts.where(F.col("_na") != F.col("_nb")).select(
        "source", "name", F.lit(None).cast("string").alias("key"), F.lit("ref count differs").alias("issue")
    )
    issue = F.when(F.col("_b").isNull(), "missing in B").when(F.col("_a") != F.col("_b"), "offset/length differs")
    per_chunk = both.where(F.col("_a").isNotNull()).withColumn("issue", issue).where(F.col("issue").isNotNull())
    return per_chunk.select("source", "name", "key", "issue").unionByName(per_array)


def compare_manifests(arrays_a: DataFrame, refs_a: DataFrame, arrays_b: DataFrame, refs_b: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per source: array counts, mismatch counts and ``equivalent``.

    With ``tasks``, the chunks of an array are counted in that many tasks, so that it can follow the tables' rows (an
    array's chunks then meet as short rows). References that are dealt by ``source, name, key`` and arrays that are
    dealt by ``source, name`` are matched as they lie.
    """
    both = _matched(refs_a, refs_b)
    if tasks is not None:
        same = F.when(F.col("_a").isNotNull(), F.col("_a").eqNullSafe(F.col("_b"))).alias("_same")
        both = deal_out(both.select("source", "name", same, F.col("_b").isNotNull().alias("_in_b")), "source", "name", tasks=tasks)
        bad, uneven = F.count_if(~F.col("_same")), F.count("_same") != F.count_if("_in_b")
    else:
        bad = F.count_if(F.col("_a").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")))
        uneven = F.count("_a") != F.count("_b")
    chunks = both.groupBy("source", "name").agg(bad.alias("_bad"), uneven.cast("int").alias("_uneven"))
    # chunk differences only count for arrays both sides have; the others are grid mismatches already
    matched = F.col("in_a") & F.col("in_b")
    issues = F.when(matched, F.coalesce(F.col("_bad") + F.col("_uneven"), F.lit(0))).otherwise(0)
    report = compare_arrays(arrays_a, arrays_b).join(chunks, ["source", "name"], "left").groupBy("source").agg(
        F.count_if("in_a").alias("arrays_a"),
        F.count_if("in_b").alias("arrays_b"),
        F.count_if(matched).alias("matched_arrays"),
        F.count_if(F.col("in_a") & ~F.col("same_grid")).alias("grid_mismatches"),
        F.sum(issues).alias("chunk_mismatches"),
    )
    same = (
        (F.col("arrays_a") == F.col("arrays_b"))
        & (F.col("matched_arrays") == F.col("arrays_a"))
        & (F.col("grid_mismatches") == 0)
        & (F.col("chunk_mismatches") == 0)
    )
    return report.withColumn("equivalent", same)


# --- summaries ---


def manifest_summary(refs: DataFrame) -> DataFrame:
    """Arrays and chunk references per source."""
    per_array = refs.groupBy("source", "name").agg(F.count("*").alias("_n"))
    return per_array.groupBy("source").agg(F.count("*").alias("arrays"), F.sum("_n").alias("refs"))


def skip_reason(dtype: str = "dtype", codecs: str = "codecs") -> Column:
    """Why a chunked-array store cannot represent an array; NULL when it can."""
    supported = lambda c: (c == "shuffle") | c.rlike(r"^zlib:")
    first_bad = F.get(F.filter(codecs, lambda c: ~supported(c) | (c.rlike(r"^zlib:") & ~_level_ok(c))), F.lit(0))
    return (
        F.when(
            ~F.col(dtype).isin(*STORE_DTYPES),
            F.concat(F.lit("dtype `"), F.col(dtype), F.lit("` is not a sample type of the store")),
        )
        .when(
            first_bad.rlike(r"^zlib:"),
            F.concat(F.lit("compression level `"), F.substring_index(first_bad, ":", -1), F.lit("` is no whole number of a byte")),
        )
        .when(first_bad.isNotNull(), F.concat(F.lit("filter `"), first_bad, F.lit("` is unknown to the store")))
    )


def _level_ok(codec: Column) -> Column:
    """A level is a whole number of one byte."""
    digits = F.regexp_extract(codec, r"^zlib:\+?(\d{1,9})$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("int") <= 255), F.lit(False))


def commit_report(arrays: DataFrame) -> DataFrame:
    """Every array with ``reason`` (NULL = representable)."""
    return arrays.withColumn("reason", skip_reason())


def unique_names(arrays: DataFrame, keys: list[str], name: str = "name", order: str = "offset") -> DataFrame:
    """The k-th repeat of a name gets the suffix ``_k``; the first keeps its name."""
    numbered = position(arrays, [*keys, name], order, "_k")
    suffixed = F.when(F.col("_k") > 0, F.concat(F.col(name), F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col(name))
    return numbered.withColumn("unique_name", suffixed).drop("_k")


# --- grid metadata text ---

EOS_FIELDS = ("GridName", "XDim", "YDim", "UpperLeftPointMtrs", "LowerRightMtrs", "Projection", "ProjParams", "GridOrigin")


def parse_eos_grids(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``GROUP=GRID_n`` blocks of metadata text to grids, one row each.

    The first occurrence of a field in a block counts. Only upper-left sinusoidal grids are accepted;
    ``issue`` says why a block is not. Blocks are cut out of the text row by row, so nothing is shuffled.
    """
    lines = F.transform(F.split(text, "\n"), lambda t: F.trim(F.regexp_replace(t, r"^[\t\r ]+|[\t\r ]+$", "")))
    body = F.array_join(lines, "\n")
    block = F.explode(F.regexp_extract_all(body, F.lit(r"(?s)(?:^|\n)GROUP=(GRID_[^\n]*\n.*?)\nEND_GROUP=GRID_"), 1))
    blocks = texts.select(key, block.alias("_b")).select(
        key, F.substring_index("_b", "\n", 1).alias("block"), F.concat(F.lit("\n"), F.col("_b"), F.lit("\n")).alias("_b")
    )

    def field(name: str) -> Column:
        # NULL without a hit: the text after the first ``\nname=``, up to the end of that line
        at = F.instr("_b", f"\n{name}=")
        rest = F.substring(F.col("_b"), at + len(name) + 2, F.length("_b"))
        return F.when(at > 0, F.substring_index(rest, "\n", 1))

    raw = blocks.select(key, "block", *[field(n).alias(n) for n in EOS_FIELDS])

    def pair(column: str, i: int) -> Column:
        parts = F.split(F.regexp_replace(column, r"^\(|\)$", ""), ",")
        return F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(i))).try_cast("double"))

    xdim, ydim = F.col("XDim").try_cast("long"), F.col("YDim").try_cast("long")
    ulx, uly = pair("UpperLeftPointMtrs", 0), pair("UpperLeftPointMtrs", 1)
    lrx, lry = pair("LowerRightMtrs", 0), pair("LowerRightMtrs", 1)
    radius_text = F.trim(F.substring_index(F.regexp_replace("ProjParams", r"^\(+", ""), ",", 1))
    radius = F.when((radius_text.try_cast("double") > 0) & (radius_text.try_cast("double") < float("inf")), radius_text.try_cast("double"))
    missing = F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in EOS_FIELDS]), lambda v: v.isNotNull())
    issue = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.get(missing, F.lit(0))))
        .when(xdim.isNull(), "unparsable XDim")
        .when(ydim.isNull(), "unparsable YDim")
        .when((xdim <= 0) | (ydim <= 0), "zero-sized grid")
        .when(ulx.isNull() | uly.isNull() | lrx.isNull() | lry.isNull(), "unparsable corner")
        .when(F.col("GridOrigin") != "HE5_HDFE_GD_UL", "unsupported origin")
        .when(F.col("Projection") != "HE5_GCTP_SNSOID", "unsupported projection")
        .when(radius.isNull(), "unparsable sphere radius")
        .when((lrx == ulx) | (lry == uly), "zero-area grid")
    )
    plain = F.regexp_replace(F.format_string("%.6f", radius), r"\.?0+$", "")
    crs = F.concat(F.lit("+proj=sinu +lon_0=0 +x_0=0 +y_0=0 +R="), plain, F.lit(" +units=m +no_defs"))
    cell_w, cell_h = F.try_divide(lrx - ulx, xdim.cast("double")), F.try_divide(lry - uly, ydim.cast("double"))
    ok = issue.isNull()
    return raw.select(
        key,
        "block",
        F.regexp_replace("GridName", r'^"+|"+$', "").alias("name"),
        xdim.alias("xdim"),
        ydim.alias("ydim"),
        F.when(ok, crs).alias("crs"),
        F.when(ok, north_up(ulx, uly, cell_w, cell_h)).alias("transform"),
        issue.alias("issue"),
    )
