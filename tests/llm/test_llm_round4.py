"""What the operators leave on disk."""

from pathlib import Path

from rasterspark.llm import ngram_join
from rasterspark.llm.components import MERGED, components
from rasterspark.session import checkpoint_dir

HELD = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_few_links_are_written_by_few_tasks(spark):
    before = {k: spark.conf.get(k) for k in HELD}
    try:
        for k, v in HELD.items():
            spark.conf.set(k, v)
        found = components(spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "a long, b long"))
        assert found.rdd.getNumPartitions() <= 64 // MERGED
        assert {tuple(r) for r in found.collect()} == {(i, 1) for i in range(2, 31)} | {(51, 50)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_token_tables_go_before_the_result_is_read(spark):
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    bytes_in = lambda: {p: p.stat().st_size for p in root.rglob("part-*")}
    before = bytes_in()
    texts = [(i, " ".join(f"w{(i * 7919 + j * 104729) % 1000003}" for j in range(4000))) for i in range(20)]
    found = ngram_join.similar_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    left = sum(size for p, size in bytes_in().items() if p not in before)
    assert left < 20 * 800 * 8 * 1.5, left  # the rare tokens of all texts once; before, four times
    assert found.count() == 20
