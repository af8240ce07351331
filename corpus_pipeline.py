"""A training-corpus pipeline over ``documents``: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterspark.llm import decontaminate, mixture, ngram_join, quality, suffix_dedup
from rasterspark.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with their columns.

    Null and empty texts have no words and go. Repeated rows are judged alike; an empty table stays empty.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id.

    Documents without words and those with a null doc_id stay. Rows that share one doc_id are one document
    and stay or go together. An empty table stays empty.
    """
    groups = ngram_join.similar_documents(docs).filter("component_id is not null and component_id < doc_id")
    gone = groups.select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that occurred before; a character that is cut goes whole.

    Documents that are null, empty or emptied go. Of rows that share a doc_id the smaller text comes first,
    of equal rows one is whole. n_chars is counted anew, other columns are carried.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffix_dedup.remove_repeats(docs, carry=rest).select("doc_id", "carried", F.col("kept").cast("string").alias("raw"))
    text = F.when(F.is_valid_utf8("raw"), F.col("raw")).otherwise(F.replace(F.make_valid_utf8("raw"), F.lit("\ufffd"), F.lit("")))
    out = found.select("doc_id", *(F.col("carried")[c].alias(c) for c in rest), text.alias("text")).filter("text != ''")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items, with their columns.

    Null and empty texts stay, as does everything if there are no items. Repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row (doc_id, lang, source, repetition, text) per repetition that it takes.

    Null and empty texts are never taken, a null source is one of its own, repeated rows are taken alike,
    and an empty table gives an empty mix.
    """
    return mixture.repetitions(mixture.mix_sources(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
]

#: Shingle groups and byte positions are not expressible in SQL at this size; the operators are held against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored in the shared folder and read again.

    Rows are those of the last stage; an empty table runs through all of them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
