"""The segmented catalog: what is visible, what is written, what goes."""

import os

from pyspark.sql import functions as F

from rasterspark.streaming import delta_catalog as D


def _rows(spark, ids, value):
    return spark.createDataFrame([("d", i, value) for i in ids], "dataset string, id long, value string")


def _state(catalog):
    snapshot = catalog.snapshot()
    return None if snapshot is None else {r["id"]: r["value"] for r in snapshot.collect()}


def test_commits_replace_rows_and_replays_do_nothing(spark, tmp_path):
    catalog = D.DeltaCatalog(spark, str(tmp_path / "c"), ["dataset", "id"])
    assert _state(catalog) is None
    assert catalog.commit(_rows(spark, range(6), "a"), 0)
    assert catalog.commit(_rows(spark, [5, 6], "b"), 1)
    want = dict.fromkeys(range(5), "a") | {5: "b", 6: "b"}
    assert _state(catalog) == want
    assert not catalog.commit(_rows(spark, [0], "late"), 1)
    assert _state(catalog) == want
    assert catalog.commit(_rows(spark, [], "x"), 2) and _state(catalog) == want
    os.makedirs(tmp_path / "c" / "s=3-3")  # a batch that died before it was named
    (tmp_path / "c" / "s=3-3" / "part.parquet").write_bytes(b"half")
    assert _state(catalog) == want
    assert catalog.commit(_rows(spark, [1], "c").withColumn("more", F.lit(7)), 3)  # a later batch may bring a column
    assert _state(catalog) == want | {1: "c"}


def test_writes_follow_the_batch_and_old_segments_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "KEEP_COMMITS", 2)
    written = []
    real = D.DeltaCatalog._write
    monkeypatch.setattr(D.DeltaCatalog, "_write", lambda self, rows, name, count: (written.append(count), real(self, rows, name, count))[1])
    catalog = D.DeltaCatalog(spark, str(tmp_path / "c"), ["dataset", "id"])
    catalog.commit(_rows(spark, range(1000), "base"), 0)
    for batch in range(1, 9):
        catalog.commit(_rows(spark, range(batch * 10, batch * 10 + 4), f"v{batch}"), batch)
    assert sum(written[1:]) <= 8 * 4 * 5 and max(written[1:]) < 64, "the base is not rewritten"
    state = catalog.pointer()
    sizes = [n for _, n in state.segments]
    assert sizes[0] == 1000 and all(a >= D.GROWTH * b for a, b in zip(sizes, sizes[1:]))
    named = {s for s, _ in state.segments} | {s for s, _ in state.retired}
    on_disk = {n for n in os.listdir(tmp_path / "c") if n.startswith("s=")}
    assert on_disk == named and len(on_disk) < 9
    got = _state(catalog)
    assert len(got) == 1000 and got[83] == "v8" and got[84] == "base" and got[10] == "v1"
