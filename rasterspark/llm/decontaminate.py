"""Benchmark decontamination with DataFrame operations only.

Benchmark items give a set of normalised grams of up to half a window. A text is cut into blocks of
that many words, and any whole window inside it contains one whole block, so only every seventh gram
of a text is looked up. Blocks that hit are verified by the words around them: the run of equal words
on that alignment must reach a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Grams of the benchmark up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_GRAMS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _benchmark_grams(items: DataFrame, window: int) -> DataFrame:
    """(gram, block, item_id, need, left, right): each gram of an item with the words before and after it."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    sized = words.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("need")).withColumn(
        "block", F.floor((F.col("need") + 1) / 2).cast("int")
    )
    at = sized.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("block"))).alias("o"))
    reach = F.col("need") - F.col("block")
    return at.select(
        "item_id", "need", "block", F.xxhash64(F.slice("w", F.col("o") + 1, F.col("block"))).alias("gram"),
        F.slice("w", F.col("o") + 1, F.col("block")).alias("item_words"),
        F.reverse(F.slice("w", F.greatest(F.col("o") - reach, F.lit(0)) + 1, F.least("o", reach))).alias("item_left"),
        F.slice("w", F.col("o") + F.col("block") + 1, reach).alias("item_right"),
    )


def _block(size: int, reach: int) -> Callable[[Column], Column]:
    """The block of ``w`` that starts at a word, with up to ``reach`` words on both sides."""
    return lambda i: F.struct(
        i.alias("at"), F.xxhash64(F.slice("w", i + 1, size)).alias("gram"),
        F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + (size + reach)).alias("around"),
    )


def _equal_ahead(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint, n_words, spans, items) of every row of ``docs``.

    Texts are lower-cased in A-Z and cut into runs of letters, digits and non-ASCII characters. A
    benchmark window is ``window`` consecutive words of an item, or the whole item if it is shorter.
    ``spans`` are the sorted disjoint word ranges [start, end) inside occurrences of windows, ``items``
    the sorted ids (as strings) of items with occurring windows. Null and empty texts have no words,
    empty items no window. Rows are told apart by doc_id and ``fingerprint``, a hash of the text, so a
    null or repeated doc_id is no obstacle and repeated rows get equal results. Other columns are
    ignored. The benchmark's grams are broadcast after a count, or joined by shuffle beyond
    ``BROADCAST_GRAMS``.
    """
    grams = _benchmark_grams(items, window)
    sizes = [(r["block"], r["need"]) for r in grams.groupBy("block").agg(F.max("need").alias("need")).collect()]
    few = grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS if sizes else True
    rows = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), words_of(F.col("text")).alias("w"))
    base = rows.select("doc_id", "fingerprint", F.size("w").cast("long").alias("n_words"))
    hits = None
    for block, need in sorted(sizes):
        reach = need - block
        cut = F.transform(F.sequence(F.lit(0), F.size("w") - block, F.lit(block)), _block(block, reach))
        blocks = rows.select("doc_id", "fingerprint", F.explode(F.when(F.size("w") >= block, cut)).alias("c")).select(
            "doc_id", "fingerprint", "c.*"
        )
        side = grams.filter(F.col("block") == block)
        met = blocks.join(F.broadcast(side) if few else side, "gram")
        before = F.least("at", F.lit(reach))
        met = met.filter(F.slice("around", before + 1, block) == F.col("item_words")).select(
            "doc_id", "fingerprint", "item_id", "at", "need",
            _equal_ahead(F.reverse(F.slice("around", F.lit(1), before)), F.col("item_left")).alias("back"),
            _equal_ahead(F.slice("around", before + block + 1, F.lit(reach)), F.col("item_right")).alias("ahead"),
        ).filter(F.col("back") + block + F.col("ahead") >= F.col("need")).select(
            "doc_id", "fingerprint", F.col("item_id").cast("string").alias("item"),
            F.struct((F.col("at") - F.col("back")).alias("start"), (F.col("at") + block + F.col("ahead")).alias("end")).alias("span"),
        )
        hits = met if hits is None else hits.unionAll(met)
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    if hits is None:
        return base.select("*", nothing.alias("spans"), F.array().cast("array<string>").alias("items"))
    found = hits.groupBy("doc_id", "fingerprint").agg(
        F.array_sort(F.collect_set("span")).alias("raw"), F.array_sort(F.collect_set("item")).alias("items")
    ).select(
        F.col("doc_id").alias("of_doc"), F.col("fingerprint").alias("of_text"), "items",
        F.aggregate("raw", nothing, lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")
            ))),
        ).otherwise(F.concat(done, F.array(s)))).alias("spans"),
    )
    return base.join(
        found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("fingerprint") == F.col("of_text")), "left"
    ).select(
        "doc_id", "fingerprint", "n_words", F.coalesce("spans", nothing).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """Whether a document goes: at least one word in ``share`` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents, all columns kept whatever their names; matched by doc_id and text.

    Null and empty texts are never contaminated and stay, as does all of ``docs`` if ``items`` is empty. Rows
    with a null or repeated doc_id are judged by their own text, so repeated rows stay or go together.
    """
    found = contamination(docs, items, window)
    gone = found.filter(contaminated(F.col("n_words"), hit_words(F.col("spans")), share)).select(
        F.col("doc_id").alias("of_doc"), F.col("fingerprint").alias("of_text")
    ).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["of_doc"]) & (F.xxhash64(docs["text"]) == gone["of_text"]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): texts with the hit words cut out, as the words left joined by one space."""
    found = contamination(docs, items, window).filter(F.size("spans") > 0)
    joined = docs.select("doc_id", "text").join(
        found.select(F.col("doc_id").alias("of_doc"), F.col("fingerprint").alias("of_text"), "spans").distinct(),
        F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_text")), "left",
    )
    left = F.filter(words_of(F.col("text")), lambda w, i: ~F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, " ")).alias("text"))
