"""Tasks follow the rows of the tables."""

from pyspark.sql import functions as F

from rasterspark.registry import manifests as RM
from rasterspark.sources import manifests as MF


def test_references_are_matched_in_as_many_tasks_as_their_rows_need(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(RM, "LINES_PER_TASK", 500)
    a, b = RM._refs(spark, sf_dir)
    assert a.rdd.getNumPartitions() >= 12
    assert MF._matched(a, b).rdd.getNumPartitions() >= 12


def test_chunks_counted_in_given_tasks_are_the_same(spark):
    refs = "source long, name long, key string, offset long, length long"
    a = spark.createDataFrame([(1, 1, "a", 0, 5), (1, 1, "b", 5, 5), (1, 1, "c", None, 5), (1, 2, "a", 0, 5), (2, 1, "a", 0, 5)], refs)
    b = spark.createDataFrame([(1, 1, "a", 0, 5), (1, 1, "b", 6, 5), (1, 1, "d", 9, 1), (1, 3, "a", 0, 5), (2, 1, "a", 0, 5)], refs)
    arrays = lambda r: r.select("source", "name").distinct().withColumns({c: F.lit(1) for c in ("shape", "chunks", "dtype", "codecs")})
    plain, dealt = (sorted(map(tuple, MF.compare_manifests(arrays(a), a, arrays(b), b, n).collect())) for n in (None, 7))
    assert plain == dealt
    assert [r[-2] for r in plain] == [2, 0]
