"""Rare cells and much repeated boxes."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rasterspark import registry
from rasterspark.operators import pyramid as PY
from rasterspark.operators import spatial as S


def test_means_of_no_valid_sample_follow_the_sql(spark, tmp_path):
    registry.load()
    values = np.random.default_rng(3).integers(-200, 200, (230, 64))
    values[40:42, 6:8] = values[100:104, 20:24] = values[201:204, 9:13] = 17  # no sample counts; rows of assets 0, 1 and 2
    rows = [(i, [float(v) / 1000 for v in r]) for i, r in enumerate(values) if i not in (70, 71, 225)]  # and some are absent
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["materialize"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.SQL["materialize"]).fetchall())
    assert (0, 2, 20, 3, -32768.0) in got and (1, 2, 0, 10, -32768.0) not in got


def test_plain_means_leave_empty_cells_out(spark):
    block = spark.createDataFrame([("a", 0, 0, [None, None, 4.0, 8.0, None, None, None, 8.0] + [None] * 8)], "asset string, cy long, cx long, values array<double>")
    levels = {}
    for kind, mark in (("average", None), (PY.OR_LOWEST, float("-inf"))):
        marked = F.transform("values", lambda v, i: F.when(i < 8, F.coalesce(v, F.lit(mark).cast("double"))))  # noqa: B023
        level = PY.coarser_blocks(block.select("asset", "cy", "cx", marked.alias("values"), F.lit(kind).alias("resampling"), F.lit("int16").alias("dtype")), ["asset"], 4)
        levels[kind] = level.first()["values"][:6]
    assert levels == {"average": [None, 7.0, None, None, None, None], PY.OR_LOWEST: [-32768.0, 7.0, None, None, None, None]}


def test_pairs_of_lists_are_dealt_out_before_they_are_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "LISTED_IDS", 5)
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 100)
    i = F.col("id")
    box = lambda w: F.struct(w.alias("west"), F.lit(1.0).alias("south"), (w + 3.0).alias("east"), F.lit(2.0).alias("north"))
    # one box holds most rows; an id is missing in three, one of them of a box that meets none
    rows = spark.range(200).select(F.when(~i.isin(3, 4, 199), i).alias("id"), box(F.when(i < 150, 1.0).when(i < 199, i % 9 * 2.0).otherwise(90.0)).alias("bbox"))
    left, right = rows, rows.where("id % 3 <> 1 OR id IS NULL")
    joined = S.bbox_join(left, right)
    got, want = (sorted((tuple(r) for r in df.collect()), key=str) for df in (joined, S._meeting(left, right, 6, "bbox", S.HOT_PAIRS)))
    assert got == want and any(r[0] is None for r in got) and any(r[1] is None for r in got)
    assert joined.rdd.getNumPartitions() == -(-len(want) // 100)
