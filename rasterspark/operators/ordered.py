"""Ordered analytics that never gather a whole key, or the whole table, in one task.

A window over a hot key would sort all its rows in one task. Here the rows are cut into ranges of about
equal counts in order of key and order column, at cuts that Spark samples, so neither a hot key nor sparse
or clustered values make a range large. Work inside a range is a window over it; what crosses ranges
travels in one small row per key and range, of which there are as many as ranges and keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def sampled_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted by ``order`` and stored as ranges of about equal row counts.

    Adds ``_range`` and ``_at``, the row's place in its range. Spark samples the cuts, so sparse or
    uneven values don't matter; rows equal in ``order`` share a range. Give enough columns to order all.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id that Spark gives holds the partition above 33 bits of the row's place in it
    place = F.monotonically_increasing_id()
    return cut_lineage(ordered.select("*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_at")))


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Zero-based position of every row in the order of the whole table, beside ``_range`` and ``_at``."""
    rows = sampled_ranges(df, order)
    # one row per range, whose number is the session's setting
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = rows.join(F.broadcast(starts), "_range")
    return joined.select(*df.columns, (F.col("_start") + F.col("_at")).alias(name), "_range", "_at")


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _whole(keys: list[str]) -> Window:
    """A key's ranges in order: one row each."""
    return Window.partitionBy(*(_keys(keys) or [F.lit(0)])).orderBy("_range")


def _with_span(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their key's row of the range; null keys are keys too."""
    named = spans.select(F.col("_range").alias("_sr"), *(F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)), *[c for c in spans.columns if c not in (*keys, "_range")])
    same = reduce(lambda c, i: c & F.col(keys[i]).eqNullSafe(F.col(f"_sk{i}")), range(len(keys)), F.col("_range") == F.col("_sr"))
    return rows.join(named, same).drop("_sr", *(f"_sk{i}" for i in range(len(keys))))


def running_totals(df: DataFrame, keys: list[str], order: str, measures: dict[str, Column]) -> DataFrame:
    """Add cumulative sums of ``measures`` in ``order``, the current row included."""
    measured = df.select("*", *[m.alias(f"_m_{n}") for n, m in measures.items()])
    cut = sampled_ranges(measured, [*keys, order])
    inside = Window.partitionBy("_range", *_keys(keys)).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    before = _whole(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in measures])
    summed = cut.select("*", *[F.sum(f"_m_{n}").over(inside).alias(f"_s_{n}") for n in measures])
    out = [(F.col(f"_s_{n}") + F.col(f"_c_{n}")).alias(n) for n in measures]
    return _with_span(summed, carry, keys).select(*[F.col(c) for c in df.columns if c not in measures], *out)


def _positioned(df: DataFrame, keys: list[str], order: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Ranges with the position in the key, no window over rows; and the spans (key, range, first place, rows)."""
    cut = sampled_ranges(df, [*keys, order])
    spans = cut.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(_whole(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select(*keys, "_range", (before - F.col("_first")).alias("_shift"))
    placed = _with_span(cut, starts, keys).withColumn(name, F.col("_at") + F.col("_shift")).drop("_shift")
    return placed, spans


def position(df: DataFrame, keys: list[str], order: str, name: str = "position") -> DataFrame:
    """Add the zero-based position of every row within its key."""
    return _positioned(df, keys, order, name)[0].drop("_range", "_at")


def neighbour(df: DataFrame, keys: list[str], order: str, column: str, name: str, step: int = -1) -> DataFrame:
    """Add ``column`` of the row before (``step=-1``) or after (``step=1``) in ``order``."""
    cut = sampled_ranges(df, [*keys, order])
    inside = Window.partitionBy("_range", *_keys(keys)).orderBy("_at")
    if step < 0:
        near, edge, far = F.lag(column).over(inside), F.max_by(F.col(column), F.col("_at")), F.lag("_edge").over(_whole(keys))
        at_edge = F.lag("_at").over(inside).isNull()
    else:
        near, edge, far = F.lead(column).over(inside), F.min_by(F.col(column), F.col("_at")), F.lead("_edge").over(_whole(keys))
        at_edge = F.lead("_at").over(inside).isNull()
    edges = cut.groupBy(*keys, "_range").agg(edge.alias("_edge")).select(*keys, "_range", far.alias("_far"))
    joined = _with_span(cut.select("*", near.alias("_near"), at_edge.alias("_at_edge")), edges, keys)
    value = F.when(F.col("_at_edge"), F.col("_far")).otherwise(F.col("_near"))
    return joined.select(*df.columns, value.alias(name))


def last_before(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Add the last value of ``column`` that isn't null among the rows before, in ``order``."""
    cut = sampled_ranges(df, [*keys, *order])
    inside = Window.partitionBy("_range", *_keys(keys)).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_range").agg(F.max(F.when(F.col(column).isNotNull(), F.struct("_at", column))).alias("_end"))
    before = _whole(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_range", F.last(F.col("_end")[column], ignorenulls=True).over(before).alias("_far"))
    joined = _with_span(cut.withColumn("_near", F.last(column, ignorenulls=True).over(inside)), carry, keys)
    return joined.select(*df.columns, F.coalesce("_near", "_far").alias(name))


def circle(df: DataFrame, keys: list[str], order: str, names: tuple[str, str, str]) -> DataFrame:
    """Add the position in the key and ``order`` of the next and the next but one row, wrapping round, in one range pass."""
    index, following, second = names
    placed, spans = _positioned(df, keys, order, index)
    # the first two of every key and range, in order: each range's last one of them leads to what lies beyond
    starts = _with_span(placed, spans.select(*keys, "_range", "_first", "_rows"), keys)
    first_two = starts.where(F.col("_at") - F.col("_first") < 2).select(*keys, "_range", "_at", "_first", "_rows", F.col(order).alias("_v"), F.col(index).alias("_i"))
    row = Window.partitionBy(*(_keys(keys) or [F.lit(0)])).orderBy("_i")
    everything = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = first_two.select(
        *keys, "_range", "_at", "_first", "_rows", F.lead("_v", 1).over(row).alias("_beyond"), F.lead("_v", 2).over(row).alias("_farther"),
        F.first("_v").over(everything).alias("_head"), F.nth_value("_v", 2).over(everything).alias("_head2"),
    )
    last = (F.col("_at") - F.col("_first")) == F.least(F.col("_rows"), F.lit(2)) - 1
    edges = seen.where(last).select(*keys, "_range", "_beyond", "_farther", "_head", F.coalesce("_head2", "_head").alias("_head2"))
    inside = Window.partitionBy("_range", *_keys(keys)).orderBy("_at")
    near = placed.select("*", F.lead(order, 1).over(inside).alias("_one"), F.lead(order, 2).over(inside).alias("_two"))
    met = _with_span(near, edges, keys)
    one = F.coalesce("_one", "_beyond")
    two = F.when(F.col("_one").isNotNull(), F.coalesce("_two", "_beyond")).otherwise(F.col("_farther"))
    return met.select(
        *df.columns, index, F.coalesce(one, F.col("_head")).alias(following),
        F.when(one.isNull(), F.col("_head2")).otherwise(F.coalesce(two, F.col("_head"))).alias(second),
    )


def trailing_rows(df: DataFrame, keys: list[str], order: str, size: int, block: int = 100_000) -> DataFrame:
    """Cut each key's sequence into blocks that carry the ``size - 1`` rows before them.

    Adds ``_block`` and ``_home``; a window of ``size`` rows partitioned by key and ``_block`` is
    complete for every row with ``_home`` true, also where it reaches over several blocks.
    """
    placed = position(df, keys, order, "_pos")
    home = F.floor(F.col("_pos") / F.lit(block))
    blocks = F.sequence(home, F.floor((F.col("_pos") + (size - 1)) / F.lit(block)))
    return (
        placed.withColumn("_b", home)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_home", F.col("_b") == F.col("_block"))
        .drop("_b")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], slack: float = 0.001
) -> DataFrame:
    """Nearest-rank quantiles (rank ``ceil(q * n)``), exact, one column per quantile.

    A mergeable sketch brackets each rank between two values of the column; the second pass counts
    the rows under the bracket and orders only the distinct values inside it.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, quantiles, slack)
        return whole.drop("_all")
    names = list(quantiles)
    data = df.where(F.col(value).isNotNull())
    low = [max(0.0, quantiles[n] - slack) for n in names]
    high = [min(1.0, quantiles[n] + slack) for n in names]
    accuracy = int(4 / slack)
    sketch = data.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(value, low, accuracy).alias("_lo"),
        F.percentile_approx(value, high, accuracy).alias("_hi"),
    )
    brackets = sketch.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("_q"),
                        F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(quantiles[n]))).alias("_rank"),
                        # the ends of the range are taken exactly, so the bracket always holds the rank
                        (F.col("_min") if low[i] == 0.0 else F.col("_lo")[i]).alias("_from"),
                        (F.col("_max") if high[i] == 1.0 else F.col("_hi")[i]).alias("_to"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("_bracket"),
    ).select(*keys, "_bracket.*")
    counted = data.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    inside = (
        counted.join(brackets, keys)
        .where(F.col(value) <= F.col("_to"))
        .groupBy(*keys, "_q", "_rank", F.when(F.col(value) >= F.col("_from"), F.col(value)).alias("_v"))
        .agg(F.sum("_c").alias("_c"))
    )
    order = Window.partitionBy(*_keys(keys), "_q").orderBy(F.col("_v").asc_nulls_first())
    ranked = inside.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hit = ranked.where((F.col("_upto") >= F.col("_rank")) & F.col("_v").isNotNull())
    picks = [F.min(F.when(F.col("_q") == n, F.col("_v"))).alias(n) for n in names]
    return hit.groupBy(*keys).agg(*picks)
