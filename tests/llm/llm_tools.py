"""Comparison of this subpackage's queries with their SQL, and helpers of its tests."""

from check_oracle import _plain

from rasterspark.llm import queries


def differences(spark, con, name, sf_dir):
    """Empty when Spark and SQL agree, else the first rows that differ."""
    got = queries.QUERIES[name](spark, sf_dir)
    rows = sorted((tuple(_plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert rows, "no rows"
    if len(rows) != len(want):
        return [(len(rows), len(want))]
    return [(a, b) for a, b in zip(rows, want, strict=True) if a != b][:3]
