"""Merkle manifest of a dataset: a hash tree per group, a tree over the groups, and a proof for every row.

Slot pivot: the children of a parent are spread by conditional aggregates into ``fanout`` columns, one
per slot. The columns concatenated hash to the parent; leaving a child's own column out gives its
siblings. Levels are built from the leaves up and stored; proofs travel from the root down, one join
per level on (group, node). A group of any size is cut by node number, never gathered.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..session import cut_lineage

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields' texts in order."""
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, _UPPER, _LOWER)


def proof_hash(proof: Column) -> Column:
    """Hash of a proof's siblings, level by level from the leaf, each from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def _parents(nodes: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """One row per parent: its children in slot columns, how many nodes its tree has on their level, its hash."""
    slot = F.pmod("p", F.lit(fanout))
    child = F.struct("h", *payload)
    pivoted = nodes.groupBy("tree", F.floor(F.col("p") / fanout).alias("p")).agg(
        F.first("size").alias("size"), *(F.max(F.when(slot == s, child)).alias(f"c{s}") for s in range(fanout))
    )
    joined = F.sha2(F.concat_ws("", *(F.col(c)["h"] for c in _slots(fanout))), 256)
    # a lone node is the root of its tree itself
    return cut_lineage(pivoted.withColumn("h", F.when(F.col("size") > 1, joined).otherwise(F.col("c0")["h"])))


def _levels(nodes: DataFrame, size: int, payload: list[str], fanout: int) -> list[DataFrame]:
    """Parents of every level up to the roots; ``size`` is that of the largest tree."""
    levels = [_parents(nodes, payload, fanout)]
    while (size := -(-size // fanout)) > 1:
        above = levels[-1].select("tree", "p", F.ceil(F.col("size") / fanout).alias("size"), "h")
        levels.append(_parents(above, [], fanout))
    return levels


def _children(parents: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """Nodes of a level with their proofs, from the parents' slots and the parents' own proofs."""
    slots = _slots(fanout)

    def step(s: int) -> Column:
        side = lambda names: F.concat_ws("", *(F.col(c)["h"] for c in names)) if names else F.lit("")
        return F.struct(side(slots[:s]).alias("left"), side(slots[s + 1 :]).alias("right"))

    # the step of a slot is built after its child is known, so that a row holds one proof at a time
    taken = parents.select(*parents.columns, F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("slot"))
    pick = lambda of: reduce(lambda rest, s: F.when(F.col("slot") == s, of(s)).otherwise(rest), range(fanout - 1), of(fanout - 1))
    own = taken.withColumn("own", pick(lambda s: F.col(slots[s]))).filter("own is not null")
    proof = F.when(F.col("size") > 1, F.concat(F.array(pick(step)), F.col("proof"))).otherwise(F.col("proof"))
    kept = [c for c in ("subroot", "root") if c in parents.columns]
    return own.select(
        "tree", (F.col("p") * fanout + F.col("slot")).alias("p"), F.col("own.h").alias("h"),
        *(F.col(f"own.{c}").alias(c) for c in payload), proof.alias("proof"), *kept,
    )


def _descend(levels: list[DataFrame], top: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """The leaves of all trees with their proofs; ``top`` holds the roots' (tree, p, proof, ...)."""
    for k in range(len(levels) - 1, -1, -1):
        met = levels[k].drop("h").join(top, ["tree", "p"])
        nodes = _children(met, payload if k == 0 else [], fanout)
        top = nodes if k == 0 else nodes.drop("h")
    return top


def prove(
    docs: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", carry: Mapping[str, Column] | None = None, fanout: int = FANOUT
) -> DataFrame:
    """(row_group, row_key, leaf, carried columns, subroot, root, proof) of every row.

    ``leaf`` is the row's hash, ``carry`` further columns to compute beside it, as a struct ``carried``.
    In a group rows ascend by ``order``, null first; ties follow the leaf, and equal rows are equal leaves
    next to one another. While a level has several nodes, every ``fanout`` consecutive ones become their
    hash (the last run may be of one node); a lone leaf is its group's root. Group roots, ordered by
    group (null first, by bytes), give the root likewise. ``proof`` lists the steps from the leaf to the
    root, each with the siblings left and right of the node. An empty table gives no rows; columns not
    named are left out, whatever their names.
    """
    extra = carry or {}
    values = F.struct(*(v.alias(n) for n, v in extra.items())) if extra else F.lit(None).cast("void")
    rows = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf.alias("h"), values.alias("carried"))
    rows = numbered(rows, ["g", "o", "h"])
    # a group's rows lie in neighbouring ranges: the table of (group, range) is small and its keys are not hot
    spans = rows.groupBy("g", "_range").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    groups = numbered(spans.groupBy("g").agg(F.min("first").alias("start"), F.sum("n").alias("size")), ["start"], "tree").drop("_range", "_at")
    by_span = spans.select(F.col("g").alias("sg"), F.col("_range").alias("sr")).join(groups, F.col("sg").eqNullSafe(F.col("g"))).drop("g")
    nodes = rows.join(by_span, (F.col("_range") == F.col("sr")) & F.col("g").eqNullSafe(F.col("sg"))).select(
        "tree", (F.col("position") - F.col("start")).alias("p"), "size", "h", "g", "o", "carried"
    )
    largest, count = groups.agg(F.max("size"), F.count("*")).first()
    payload = ["g", "o", "carried"]
    inner = _levels(nodes, largest or 0, payload, fanout)
    tops = inner[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("p"), F.lit(count).alias("size"), "h")
    outer = _levels(tops, count, [], fanout)
    empty = F.array().cast("array<struct<left: string, right: string>>")
    root = outer[-1].select("tree", "p", empty.alias("proof"), F.col("h").alias("root"))
    found = _descend(outer, root, [], fanout)
    subroots = found.select(F.col("p").alias("tree"), F.lit(0).cast("long").alias("p"), "proof", F.col("h").alias("subroot"), "root")
    leaves = _descend(inner, subroots, payload, fanout)
    return leaves.select(F.col("g").alias("row_group"), F.col("o").alias("row_key"), F.col("h").alias("leaf"), "carried", "subroot", "root", "proof")


def verify(docs: DataFrame, tampered: Mapping[str, Column], where: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows of ``prove`` with (proof_sha256, folded_root, verified) after some columns of some rows were changed.

    The leaf is recomputed from ``tampered`` columns where ``where`` holds (null: it doesn't) and folded
    with the original siblings; ``verified`` tells whether that gives the root.
    """
    leaf = leaf_hash(*(F.col(c) for c in fields))
    changed = F.when(where, leaf_hash(*(tampered.get(c, F.col(c)) for c in fields)))
    found = prove(docs, leaf, carry={"changed": changed})
    folded = found.withColumn("folded_root", fold(F.coalesce("carried.changed", "leaf"), F.col("proof")))
    return folded.select("*", proof_hash(F.col("proof")).alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified"))
