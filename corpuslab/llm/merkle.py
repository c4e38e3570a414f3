"""Operator 13: a Merkle manifest of a dataset, with a proof for each row.

A leaf is the digest of a row's fields. The leaves of a group (source), in the order of their
ids, are the lowest level of the group's tree; while a level has more than one node, every run of
``arity`` nodes becomes one node of the next level. The last node of each tree is its group's
root, and these, in the order of the groups, are the leaves of the tree that gives the dataset's root.

Each level is one table of (tree, index, digest). A sibling's index is computed: ``index XOR 1``
for two, and for more the run's start plus ``(slot + k) mod arity``. So a level finds all siblings by
``arity - 1`` equijoins with itself on (tree, index), whose keys are unique, and rows of slot zero,
which then have the whole run beside them, emit the parents. The levels of all trees are one table, so there
are as many steps as the highest tree has levels, each a third (half, ...) of the one before. Paths
go down the same way: a node's path is its siblings, then the path of its parent (join on tree and parent's
index). A hot group is a tree like any other: no step gathers the rows of a group.

The digest of a row is that of its fields one after the other: ``-`` for null, else the number of
UTF-8 bytes, ``:`` and the value. Inner digests are those of their children's digests as lowercase hex text.

Defined cases: null ids come first in their group, null groups before all others; rows with the same id
lie in the order of their digests, equal rows are leaves of their own; an empty text is ``0:``, unlike null; an empty table has
no root and gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions
from ..session import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values, each as ``-`` or ``<bytes>:<value>``."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _joined(*digests: Column) -> Column:
    return F.sha2(F.concat_ws("", *digests).cast("binary"), 256)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, idx, n, h, ...) with the digests of the run's others, joined: ``left`` of the node and ``right`` of it."""
    slot, out, left, right = F.col("idx") % arity, nodes, [], []
    for k in range(1, arity):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + k) % arity
        other = nodes.select(F.col("tree").alias("_x_tree"), F.col("idx").alias("_x_idx"), F.col("h").alias(f"_x_h{k}"))
        out = out.withColumn("_x_sib", at).join(other, (F.col("tree") == F.col("_x_tree")) & (F.col("_x_sib") == F.col("_x_idx")), "left")
        out = out.drop("_x_tree", "_x_idx", "_x_sib")
        left.append(F.when(slot + k >= arity, F.col(f"_x_h{k}")))
        right.append(F.when(slot + k < arity, F.col(f"_x_h{k}")))
    out = out.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})
    return out.drop(*[f"_x_h{k}" for k in range(1, arity)])


def build(leaves: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """The levels, from the leaves (tree, idx, n, h, ...) up, each written with its siblings; ``n``: nodes of the tree there."""
    levels = [materialize(with_siblings(leaves, arity), f"{name}-0")]
    top = levels[0].agg(F.max("n")).first()[0] or 0
    while top > 1:
        parents = levels[-1].where((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
            "tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).cast("long").alias("n"), _joined(F.col("h"), F.col("right")).alias("h"))
        levels.append(materialize(with_siblings(parents, arity), f"{name}-{len(levels)}"))
        top = -(-top // arity)
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, h): the last node of each tree."""
    return reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "h") for x in levels])


#: One step of a proof: the digests on both sides of the node.
PATH = "array<struct<left:string,right:string>>"


def paths(levels: Sequence[DataFrame], above: DataFrame, arity: int, keep: Sequence[str] = ()) -> DataFrame:
    """The leaves (tree, h, ``keep``) with ``path`` to the end of ``above``, and what else ``above`` (tree, path, ...) has for their tree."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    step = F.array(F.struct("left", "right"))
    got = None
    for k in range(len(levels) - 1, -1, -1):
        own = list(keep) if k == 0 else []
        x = levels[k]
        ended = x.where("n = 1").join(above, "tree").select("tree", "idx", "h", *own, *more, "path")
        if got is not None:
            parent = got.select(F.col("tree").alias("_x_tree"), F.col("idx").alias("_x_idx"), *more, F.col("path").alias("_x_path"))
            inner = x.where("n > 1").join(parent, (F.col("tree") == F.col("_x_tree")) & (F.floor(F.col("idx") / arity) == F.col("_x_idx")))
            ended = ended.unionByName(inner.select("tree", "idx", "h", *own, *more, F.concat(step, "_x_path").alias("path")))
        got = ended
    return got


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             arity: int = ARITY, also: dict[str, Column] | None = None) -> DataFrame:
    """Per row: the id, ``leaf``, ``subroot`` (its group's), ``root`` and ``path`` (siblings up to the root).

    ``also``: more columns, computed from the row, to have in the result.
    """
    also = also or {}
    group = F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = docs.select(group.alias("tree"), F.col(id_col).alias("_x_key"), row_digest([F.col(f) for f in fields]).alias("h"),
                       *[c.alias(f"_x_also_{n}") for n, c in also.items()])
    named = {f"_x_also_{n}": n for n in also} | {"_x_key": id_col}
    leaves = positions(rows, "tree", [F.col("_x_key"), F.col("h")], "merkle-leaves")
    levels = build(leaves, arity, "merkle-level")
    tops = positions(roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h"), "tree", [F.col("of")], "merkle-groups")
    upper = build(tops, arity, "merkle-top")
    last = roots(upper).first()  # one digest
    end = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
    above = paths(upper, end, arity, ["of"]).select(F.col("of").alias("tree"), F.col("h").alias("subroot"), "path")
    out = paths(levels, materialize(above, "merkle-above"), arity, list(named))
    out = out.withColumn("root", F.lit(last["h"] if last else None).cast("string"))
    return out.select(*[F.col(a).alias(b) for a, b in named.items()], F.col("h").alias("leaf"), "subroot", "root", "path")


def nodes(levels: Sequence[DataFrame]) -> DataFrame:
    """(level, tree, idx, h): every node, as a table to store beside the dataset."""
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("level"), "tree", "idx", "h") for k, x in enumerate(levels)])
