"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

The targets have a closed form: sources fill in order of the level at which they reach their cap, and
the first level that leaves all others under theirs is the common one. Resharing any excess by weight
until no source is above its cap ends in the same place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the columns alone."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share the total of all sizes
    by them. No target passes ``max_epochs`` times its source's size; the excess goes to the others by
    weight until none is above. One row per source is ordered in one task; documents never are.
    """
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (
            F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1
        ).cast("int")).cast("long").alias("weight"),
    )
    by_level = Window.orderBy("full", F.asc_nulls_last("source"))
    cap = F.col("source_size") * max_epochs
    levels = (
        ranked.withColumn("cap", cap).withColumn("full", F.col("cap") / F.col("weight"))
        .withColumn("before", F.sum("cap").over(by_level) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(total))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("open"))
        .withColumn("place", F.row_number().over(by_level))
    )
    chosen = levels.withColumn("common", F.min_by("level", F.when(F.col("level") <= F.col("full"), F.col("place"))).over(total))
    target = F.when(F.col("full") <= F.col("common"), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight"))
    return chosen.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """All of ``docs`` with size, source_size, target, whole, part, part_start and taken.

    Every document is repeated ``whole`` times and then once more with ``part`` of its words, a run
    that starts at word ``part_start`` and goes on from the first word after the last one. ``part`` is
    rounded up or down by a seeded draw, so a source's words come within a fraction of a word per
    document of its target and reruns agree. taken = whole * size + part, never over
    ``max_epochs`` * size. Null or empty texts have size 0 and are never taken. A null source is a
    source of its own. Repeated rows share one draw and are taken alike. ``docs`` needs doc_id, text
    and source; its other columns stay, except that the names given above are replaced.
    """
    own = {"size", "source_size", "weight", "target", "whole", "part", "part_start", "taken"}
    rows = docs.select(*(c for c in docs.columns if c.lower() not in own), word_count(F.col("text")).alias("size"))
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, max_epochs)
    joined = rows.alias("d").join(
        targets.withColumnRenamed("source", "of_source").alias("t"), F.col("d.source").eqNullSafe(F.col("t.of_source")), "left"
    ).select("d.*", "t.source_size", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    part = F.floor((rate - whole) * F.col("size") + unit_hash(seed, F.col("doc_id")))
    return (
        joined.withColumn("whole", whole)
        .withColumn("part", F.when(F.col("size") > 0, part).otherwise(F.lit(0)).cast("long"))
        .withColumn("part_start", F.floor(unit_hash(seed + "-start", F.col("doc_id")) * F.col("size")))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    )


def repetitions(mixed: DataFrame) -> DataFrame:
    """One row (doc_id, lang, source, repetition, text) per repetition that the mix takes."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    turned = F.concat(F.slice(words, F.col("part_start") + 1, F.col("size")), F.slice(words, F.lit(1), F.col("part_start")))
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    return mixed.filter("taken > 0").select(
        "doc_id", "lang", "source", "text", "size", "whole", "part", "part_start",
        F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("repetition"),
    ).select(
        "doc_id", "lang", "source", "repetition",
        F.when(F.col("repetition") < F.col("whole"), F.col("text"))
        .otherwise(F.array_join(F.slice(turned, F.lit(1), F.col("part").cast("int")), " ")).alias("text"),
    )
