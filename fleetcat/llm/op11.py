"""Merkle dataset manifest: hash trees per group and over the groups, by slot pivots.

A row's leaf is the sha256 of its fields, each as ``bytes:value`` (``-`` if
null).  Per group the leaves are numbered in id order.  While a group has more
than one node, eight consecutive nodes become one: conditional aggregates
spread the children of a parent into the columns s0 ... s7 (the slot pivot), and
the concatenation of the columns is hashed.  The nodes that remain (subroots)
form a tree of the same kind over the groups, whose last node is the root.

Proofs go back down the same pivots: a child's siblings are the slot columns
left and right of its own, its path is that step followed by its parent's path.
A leaf is folded along its path with ``aggregate``; the result must be the root.

Every level is a written table and holds an eighth of the rows below it; a
pivot groups eight rows at most and numbering is range-partitioned, so a group
that holds most of the rows is split like any other.  Only the number of nodes
of the largest group reaches the driver (it bounds the number of levels).

Defined cases: nulls in any field are leaves of their own (``-``); null groups
come first; null ids sort first; rows that repeat an id follow each other in
leaf order, equal rows are equal leaves; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcat.llm.runtime import written
from fleetcat.operators.common import null_safe, row_number_within

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SLOTS = [f"s{i}" for i in range(FANOUT)]


def hashed(text: Column) -> Column:
    """sha256 as 32 bytes; ``as_hex`` gives the text that enters the next hash."""
    return F.unhex(F.sha2(text, 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return hashed(F.concat(*[field_text(c) for c in fields]))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (grp, digest, ...) with pos (from 0 within the group) and n (nodes of the group)."""
    nodes = written(row_number_within(nodes, ["grp"], order, "pos").withColumn("pos", F.col("pos") - 1), "merkle-nodes")
    sizes = nodes.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(sizes, null_safe([("grp", "g")])).drop("g")


def _slot_pivot(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """One row per parent: its children's ``keep`` columns as structs in the slot columns, and its own digest."""
    slot = F.col("pos") % FANOUT
    child = F.struct(*keep)
    parents = (nodes.where("n > 1").groupBy("grp", F.floor(F.col("pos") / FANOUT).alias("parent"))
               .agg(F.max("n").alias("n"), *[F.max(F.when(slot == i, child)).alias(s) for i, s in enumerate(_SLOTS)]))
    whole = F.concat_ws("", *[as_hex(F.col(f"{s}.digest")) for s in _SLOTS])
    return parents.select("grp", F.col("parent").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), hashed(whole).alias("digest"), *_SLOTS)


def _step(i: int) -> Column:
    """The path step of slot i: the digests left and right of it, as text."""
    side = [F.concat_ws("", *[as_hex(F.col(f"{s}.digest")) for s in part]) for part in (_SLOTS[:i], _SLOTS[i + 1:])]
    return F.struct(side[0].alias("left"), side[1].alias("right"))


def _down(pivot: DataFrame, paths: DataFrame) -> DataFrame:
    """Children of a pivot, each with its path: its own step, then the path of its parent (``paths``: grp, pos, path)."""
    above = paths.select(F.col("grp").alias("g"), F.col("pos").alias("p"), F.col("path").alias("above"))
    rows = pivot.join(above, null_safe([("grp", "g")]) & (F.col("pos") == F.col("p")))
    children = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(s).alias("child"),
                                  F.concat(F.array(_step(i)), F.col("above")).alias("path")) for i, s in enumerate(_SLOTS)])
    rows = rows.select("grp", F.col("pos").alias("parent"), F.explode(children).alias("c")).where("c.child is not null")
    return rows.select("grp", (F.col("parent") * FANOUT + F.col("c.slot")).alias("pos"), "c.child.*", "c.path")


def _tree(nodes: DataFrame, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(pivots from the leaves up, one row per group that remains: grp, digest) of numbered nodes."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    pivots, tops, level = [], [nodes.where("n = 1").select("grp", "digest")], nodes
    while size > 1:
        level = written(_slot_pivot(level, keep if not pivots else ["digest"]), "merkle-level")
        pivots.append(level)
        tops.append(level.where("n = 1").select("grp", "digest"))
        size = -(-size // FANOUT)
    return pivots, reduce(DataFrame.unionAll, tops)


def _paths(pivots: list[DataFrame], nodes: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """The numbered ``nodes`` with their paths; ``above`` (grp, path) holds the path of each group's remaining node."""
    at_top = above.select(F.col("grp").alias("g"), F.col("path").alias("above"))

    def top(level: DataFrame, cols: list[str]) -> DataFrame:
        rows = level.where("n = 1").join(at_top, null_safe([("grp", "g")]))
        return rows.select("grp", "pos", *cols, F.col("above").alias("path"))

    known = None
    for pivot in reversed(pivots):
        here = top(pivot, [])
        known = here if known is None else here.unionByName(known.select("grp", "pos", "path"))
        known = _down(pivot, known)
        if pivot is not pivots[0]:
            known = written(known, "merkle-paths")
    lone = top(nodes, keep)
    return lone if known is None else lone.unionByName(known.select(lone.columns))


def build(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS,
          changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (steps of left and right siblings, from the leaf up) and other_leaf.

    ``changed`` replaces fields (by columns over ``docs``) in other_leaf, the
    leaf of a row as it is found later; without it other_leaf is leaf.
    Digests are hex text; ``path`` has what ``folded`` needs.
    """
    own = [F.col(c) for c in fields]
    later = [(changed or {}).get(c, F.col(c)) for c in fields]
    # written before they are sorted: sampling for the ranges would hash all texts once more
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"),
                         leaf_digest(own).alias("digest"), leaf_digest(later).alias("other"))
    keep = ["digest", "id", "other"]
    nodes = _numbered(written(leaves, "merkle-leaves"), ["id", "digest", "other"])
    pivots, subroots = _tree(nodes, keep)
    # the groups' remaining nodes are the leaves of the tree above; its only group is the constant 0
    upper = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("lang"), "digest")
    upper = _numbered(upper, ["lang"])
    upper_pivots, root = _tree(upper, ["digest", "lang"])
    over = _paths(upper_pivots, upper, root.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path")), ["digest", "lang"])
    over = written(over.join(root.select("grp", F.col("digest").alias("root")), "grp"), "merkle-groups")
    rows = _paths(pivots, nodes, over.select(F.col("lang").alias("grp"), "path"), keep)
    marks = over.select(F.col("lang").alias("g"), F.col("digest").alias("subroot"), "root")
    rows = rows.join(marks, null_safe([("grp", "g")]))
    return rows.select(F.col("id").alias("doc_id"), as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"),
                       as_hex(F.col("root")).alias("root"), F.col("path").alias("proof"), as_hex(F.col("other")).alias("other_leaf"))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to along its proof; a step without siblings hashes the node alone."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
