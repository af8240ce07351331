"""Connected components of links, without gathering them anywhere.

Alternating large and small stars: every round joins each node's neighbours to its smallest one.
All steps are partially aggregated group-bys and equi-joins, so a hub of many links is spread. Steps
run in as many tasks as the links need: a shuffle file costs disk and time however few links are in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Links that a task writes at least; with fewer links in all, up to MERGED partitions are merged before each shuffle.
LINKS_PER_TASK = 20_000
#: Few, as each merged partition has its own join buffers.
MERGED = 16


def _large(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct()


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    edges = edges.coalesce(tasks)
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).coalesce(tasks).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that isn't the smallest of its component.

    ``edges`` has columns a and b (long, any direction; loops are ignored). Nodes without links do
    not appear. Each round is cut off in the shared checkpoint folder; rounds end when a whole
    round changes nothing.
    """
    least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // MERGED
    now = cut_lineage(edges.filter("a != b").select("a", "b").distinct())
    seen = _mark(now)
    while seen[0]:
        tasks = max(-(-seen[0] // LINKS_PER_TASK), least)
        now = cut_lineage(_small(_large(now.coalesce(tasks), tasks), tasks).coalesce(tasks))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
