"""Merkle manifest of a dataset: slot pivot.

Leaves are numbered within their tree; every ``fanout`` consecutive nodes of a level are children of one
parent. Conditional aggregates spread a parent's children into one column per slot: concatenating
the columns and hashing gives the parent, leaving out a child's own slot gives its siblings.
Levels are pivoted from the leaves up and written, each an eighth of the one below. A tree that
has come down to one node leaves the climb: that node is its subroot. The subroots, in order,
are the leaves of one more tree, whose top is the root.

The way down starts at the root: exploding a parent's slots hands every child its siblings and the
parent's own way up, so a leaf ends with its whole inclusion path. No level is joined with the
leaves: what a leaf carries lies in its slot.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.operators.shapes import dense_ordinal
from cumulus.session import materialize

FANOUT = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as unambiguous text: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    """The leaf of a row: its values as fields, one after the other, hashed."""
    return digest(*[field(v) for v in values])


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``, level by level."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def proof(path: Column) -> Column:
    """The siblings of a path in one text: level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


@dataclasses.dataclass
class _Climb:
    """The written pivots of a forest, lowest first, and its tops (tree, level, digest)."""

    pivots: list[DataFrame]
    tops: DataFrame


def _slots(fanout: int) -> list[str]:
    return [f"s{j}" for j in range(fanout)]


def _climb(leaves: DataFrame, fanout: int, name: str) -> _Climb:
    """ACTION (writes a pivot per level): ``leaves`` has tree, idx, digest and what they carry."""
    widest = leaves.agg(F.max("idx")).first()[0] or 0
    carried = [c for c in leaves.columns if c not in ("tree", "idx")]
    nodes, pivots, tops = leaves, [], None
    while widest > 0:
        slot = F.pmod("idx", F.lit(fanout))
        spread = nodes.groupBy("tree", F.expr(f"idx div {fanout}").alias("idx")).agg(
            *[F.first(F.when(slot == j, F.struct(*carried)), ignorenulls=True).alias(s) for j, s in enumerate(_slots(fanout))])
        # Slots fill from the left, so one child alone in a tree's first run is all that is left of the tree.
        pivot = materialize(spread.select(
            "tree", "idx", *_slots(fanout), ((F.col("idx") == 0) & F.col("s1").isNull()).alias("single"),
            digest(*[F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in _slots(fanout)]).alias("digest")), f"{name}-level")
        single = pivot.where("single").select("tree", F.lit(len(pivots)).alias("level"), "s0.digest")
        tops = single if tops is None else tops.union(single)
        pivots.append(pivot)
        nodes, carried = pivot.where("NOT single").select("tree", "idx", "digest"), ["digest"]
        widest //= fanout
    last = nodes.select("tree", F.lit(len(pivots)).alias("level"), "digest")
    return _Climb(pivots, last if tops is None else tops.union(last))


def _children(parents: DataFrame, fanout: int, keep: Sequence[str]) -> DataFrame:
    """A row per filled slot: tree, idx, ``node`` (what the slot carries), ``keep`` and the longer path."""
    joined = lambda names: F.concat(F.lit(""), *[F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in names])
    slots = _slots(fanout)
    spread = parents.select("tree", "idx", *keep, "path", F.posexplode(F.array(*[F.when(F.col(s).isNotNull(), F.struct(
        F.col(s).alias("node"), joined(slots[:j]).alias("left"), joined(slots[j + 1:]).alias("right")))
        for j, s in enumerate(slots)])).alias("_j", "_c")).where("_c IS NOT NULL")
    return spread.select("tree", (F.col("idx") * fanout + F.col("_j")).alias("idx"), F.col("_c.node").alias("node"), *keep,
                         F.concat(F.array(F.struct("_c.left", "_c.right")), F.col("path")).alias("path"))


def _descend(climb: _Climb, tops: DataFrame, leaves: DataFrame, fanout: int, keep: Sequence[str]) -> DataFrame:
    """(tree, node, keep, path) of every leaf; ``tops`` has tree, level, ``keep`` and the path above each top."""
    paths = None
    for level in range(len(climb.pivots), 0, -1):
        start = tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), *keep, "path")
        paths = start if paths is None else paths.select("tree", "idx", *keep, "path").union(start)
        p, a = climb.pivots[level - 1].where("NOT single").alias("p"), paths.alias("a")
        both = p.join(a, F.col("p.tree").eqNullSafe(F.col("a.tree")) & (F.col("p.idx") == F.col("a.idx"))).select(
            "p.tree", "p.idx", *[f"p.{s}" for s in _slots(fanout)], *[f"a.{c}" for c in (*keep, "path")])
        paths = _children(both, fanout, keep)
    # Trees of one leaf: nothing below their top.
    if climb.pivots:
        one = climb.pivots[0].where("single").select("tree", F.col("s0").alias("node"))
    else:
        one = leaves.select("tree", F.struct(*[c for c in leaves.columns if c not in ("tree", "idx")]).alias("node"))
    o, t = one.alias("o"), tops.where("level = 0").alias("t")
    alone = o.join(t, F.col("o.tree").eqNullSafe(F.col("t.tree"))).select("o.tree", "o.node", *[f"t.{c}" for c in (*keep, "path")])
    return alone if paths is None else paths.select("tree", "node", *keep, "path").union(alone)


def merkle_manifest(leaves: DataFrame, leaf: str = "leaf", tree: str | None = "lang", order: Sequence[str] = ("doc_id",),
                    fanout: int = FANOUT) -> DataFrame:
    """ACTION (writes the numbered leaves and every level above them): the columns of ``leaves`` with

    * ``subroot``: the top of the leaf's tree (a lone leaf itself),
    * ``root``: the top of the tree over all subroots,
    * ``path``: array of (left, right), from the leaf's level to the root's: the hex digests of the
      siblings before and after the node, concatenated (:func:`fold` and :func:`proof` use it).

    One tree per value of ``tree`` (null is a value; without ``tree``, a single one). Its leaves lie in the order
    of ``order``, nulls first, ties by ``leaf``; equal rows take places of their own. Trees are ordered
    by value, null first, UTF-8 bytewise. ``leaves`` holds what the result shall carry and no more: those columns
    travel once in the first pivot. A column called subroot, root or path gives way to the one made here.
    An empty table gives no rows. A tree that holds most of the leaves is spread
    like many small ones: every step is keyed by tree and place.
    """
    if fanout < 2:
        raise ValueError("a parent has at least two children")
    kept = [c for c in leaves.columns if c not in ("subroot", "root", "path")]
    q = lambda c: F.col(f"`{c}`")
    rows = materialize(leaves.select(
        (q(tree) if tree else F.lit(None).cast("string")).alias("tree"), q(leaf).alias("digest"),
        *[q(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[q(c) for c in kept]).alias("row")), "merkle-leaves")
    numbered = dense_ordinal(rows, "idx", order_by=[*[f"o{i}" for i in range(len(order))], "digest"], within=["tree"]).select(
        "tree", "idx", "digest", "row")
    lower = _climb(numbered, fanout, "merkle")
    tops = materialize(lower.tops, "merkle-tops")
    ranked = materialize(dense_ordinal(tops.select("tree", "level", "digest"), "idx", order_by=["tree"]).select(
        F.lit(0).alias("tree"), "idx", "digest", F.col("tree").alias("name"), "level"), "merkle-top-leaves")
    upper = _climb(ranked, fanout, "merkle-top")
    root = upper.tops.select("tree", "level", F.col("digest").alias("root"),
                             F.array().cast("array<struct<left: string, right: string>>").alias("path"))
    # The paths above the tops: as many rows as trees.
    above = materialize(_descend(upper, root, ranked, fanout, ["root"]).select(
        F.col("node.name").alias("tree"), F.col("node.level").alias("level"), F.col("node.digest").alias("subroot"), "root", "path"), "merkle-paths")
    found = _descend(lower, above, numbered, fanout, ["subroot", "root"])
    return found.select("node.row.*", "subroot", "root", "path")
