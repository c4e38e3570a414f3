"""Operator 10: sharding by a k-d tree over metadata (law ``bytes``: sizes near equal).

Rows with equal texts are one point, whose weight is their bytes. A point heavier than
``1 / (shards * parts_per_shard)`` of all bytes is dealt by a hash of the row into parts of at most about
that weight, so a hot group spreads over neighbouring shards; there are at most
``shards * parts_per_shard`` such groups, which bounds the table that is broadcast.

The dimensions are source, language, size and id of a point's first row, each mapped to
``CODE_BITS`` bits between its smallest and largest value. Each key ends in a hash of the
point, so that any two points can be told apart and ties (a hot source) can be cut. A node
that is to give k shards is cut along its widest dimension at the weighted quantile
floor(k/2)/k. The quantile is found by narrowing: one small aggregate of weights in
2**STEP bins a node and job, until the bin holds a single key or too little weight to
matter. The driver sees only nodes x bins, never points.

Slots number the rows of a shard from 0 by a hash of the row, in two steps (counts per hash bucket, then ranks inside buckets).

Defined cases: null text has no bytes (size 16) and checksum 0, and counts as equal to the empty text; null ids and
null metadata take the smallest code; equal rows are interchangeable; an empty table gives an
empty table; fewer points than shards leave shards empty. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.splits import two_stage_rank
from ..session import materialize

SHARDS, OVERHEAD = 40, 16
CODE_BITS, TIE_BITS, STEP = 20, 40, 12
KEY_BITS = CODE_BITS + TIE_BITS


@dataclass
class Tree:
    """Cuts of a k-d tree: node -> (dimension, first key of the right half). Children of n are 2n + 1 and 2n + 2."""

    cuts: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)

    def assign(self, keys: list[np.ndarray]) -> np.ndarray:
        node = np.zeros(len(keys[0]), np.int64)
        for n in sorted(self.cuts):
            dim, cut = self.cuts[n]
            here = node == n
            node[here] = 2 * n + 1 + (keys[dim][here] >= cut)
        return node


def _ordered(value: Column, kind: str) -> Column:
    """A number in the order of the value: of a string its first six bytes."""
    if kind == "string":
        return F.conv(F.substring(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0"), 1, 12), 16, 10).cast("double")
    return value.cast("double")


def _assigned(points: DataFrame, tree: Tree, dims: int) -> DataFrame:
    cols = [f"k{i}" for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = tree.assign([b.column(c).to_numpy(zero_copy_only=False) for c in cols])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node)], names=[*b.schema.names, "node"])

    return points.mapInArrow(run, ", ".join([points.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), "node long"]))


def _cut_keys(points: DataFrame, tree: Tree, dims: int, asked: dict[int, tuple[int, float]], exact: float) -> dict[int, int]:
    """For each node (dimension, weight wanted on its left): the first key of the right half.

    ``exact``: a bin with no more than this weight is not narrowed further.
    """
    lo = dict.fromkeys(asked, 0)  # first key of the bin that holds the cut
    before = dict.fromkeys(asked, 0.0)  # weight left of that bin
    width, out = KEY_BITS, {}
    while asked:
        narrow = max(0, width - STEP)
        key = F.lit(None).cast("long")
        for n, (dim, _) in asked.items():
            k = F.col(f"k{dim}")
            inside = (F.col("node") == n) & (F.shiftright(k, width) == lo[n] >> width)
            key = F.when(inside, F.shiftright(k, narrow)).otherwise(key)
        found = (_assigned(points, tree, dims).select("node", "weight", key.alias("bin")).where("bin is not null")
                 .groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect())
        for n in list(asked):
            want, mine = asked[n][1], sorted((r for r in found if r["node"] == n), key=lambda r: r["bin"])
            at, last = before[n], None
            for r in mine:
                last = r
                if at + r["w"] > want:
                    break
                at += r["w"]
            if last is None:
                out[n] = lo[n]
            elif at + last["w"] <= want:  # all on the left
                out[n] = (last["bin"] + 1) << narrow
            elif narrow == 0 or last["n"] == 1 or last["w"] <= exact:
                # a bin that isn't cut goes to the side that leaves the smaller error
                out[n] = (last["bin"] + (at + last["w"] - want < want - at)) << narrow
            else:
                lo[n], before[n] = last["bin"] << narrow, at
                continue
            del asked[n]
        width = narrow
    return out


def build(points: DataFrame, dims: int, shards: int, exact_share: float = 0.001) -> Tree:
    """The tree over ``points`` (k0 .. k<dims-1>, weight)."""
    tree, k_of = Tree(), {0: shards}
    while k_of:
        tree.leaves.update({n: 0 for n, k in k_of.items() if k == 1})
        k_of = {n: k for n, k in k_of.items() if k > 1}
        if not k_of:
            break
        wide = [(F.max(f"k{i}") - F.min(f"k{i}")).alias(f"d{i}") for i in range(dims)]
        stats = {r["node"]: r for r in _assigned(points, tree, dims).groupBy("node")
                 .agg(F.sum("weight").alias("w"), *wide).collect()}
        asked, nxt, least = {}, {}, min((stats[n]["w"] / k for n, k in k_of.items() if n in stats), default=0)
        for n, k in k_of.items():
            nxt[2 * n + 1], nxt[2 * n + 2] = k // 2, k - k // 2
            if n in stats:
                dim = int(np.argmax([stats[n][f"d{i}"] for i in range(dims)]))
                asked[n] = (dim, stats[n]["w"] * (k // 2) / k)
            else:
                tree.cuts[n] = (0, 0)
        dim_of = {n: d for n, (d, _) in asked.items()}
        cuts = _cut_keys(points, tree, dims, dict(asked), least * exact_share)
        tree.cuts.update({n: (dim_of[n], c) for n, c in cuts.items()})
        k_of = nxt
    tree.leaves = {n: s for s, n in enumerate(_left_to_right(tree))}
    return tree


def _left_to_right(tree: Tree) -> list[int]:
    out, todo = [], [0]
    while todo:
        n = todo.pop()
        if n in tree.cuts:
            todo += [2 * n + 2, 2 * n + 1]
        else:
            out.append(n)
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = ("source", "lang"),
          shards: int = SHARDS, parts_per_shard: int = 16) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null: only for law ``key``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col), *[F.col(c) for c in meta if c != id_col],
                      (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_x_text"))
    rows = materialize(raw, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cap = max(1, total // (shards * parts_per_shard))
    heavy = (rows.groupBy("_x_text").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
             .where((F.col("w") > cap) & (F.col("n") > 1))  # at most shards * parts_per_shard + 1 groups
             .select("_x_text", F.least(F.col("n"), F.ceil(F.col("w") / cap)).cast("long").alias("_x_parts")))
    rows = rows.join(F.broadcast(heavy), "_x_text", "left").withColumn(
        "_x_part", F.coalesce(F.expr(f"pmod(xxhash64({id_col}, size), _x_parts)"), F.lit(0))).drop("_x_parts")

    dims = [*meta, "size", id_col]
    kinds = {c: ("string" if t == "string" else "number") for c, t in docs.dtypes} | {"size": "number"}
    values = F.struct(F.col(id_col).alias("i"), *[_ordered(F.col(c), kinds[c]).alias(f"v{k}") for k, c in enumerate(dims)])
    points = rows.groupBy("_x_text", "_x_part").agg(F.sum("size").alias("weight"), F.min(values).alias("m"))
    vs = [f"v{k}" for k in range(len(dims))]
    points = points.select("_x_text", "_x_part", "weight", *[F.when(F.isnan(F.col(f"m.{v}")), None).otherwise(F.col(f"m.{v}")).alias(v) for v in vs])
    points = materialize(points, "shard-values")
    span = points.agg(*[F.min(v).alias(f"a{v}") for v in vs], *[F.max(v).alias(f"b{v}") for v in vs]).first()
    keys = []
    for k, v in enumerate(vs):
        a, b = span[f"a{v}"], span[f"b{v}"]
        top = float((1 << CODE_BITS) - 1)
        code = F.lit(0) if a is None or b <= a else F.coalesce(F.floor((F.col(v) - a) / (b - a) * top), F.lit(0))
        tie = F.expr(f"shiftrightunsigned(xxhash64(_x_text, _x_part, {k}), {64 - TIE_BITS})")
        keys.append((F.shiftleft(code.cast("long"), TIE_BITS) + tie).alias(f"k{k}"))
    points = materialize(points.select("_x_text", "_x_part", "weight", *keys), "shard-points")

    tree = build(points, len(dims), shards)
    leaf = F.create_map(*[F.lit(x) for n, s in tree.leaves.items() for x in (int(n), int(s))])
    placed = _assigned(points, tree, len(dims)).select("_x_text", "_x_part", leaf[F.col("node")].cast("int").alias("shard"))
    out = rows.join(placed, ["_x_text", "_x_part"])
    out = out.withColumn("_x_key", F.md5(F.concat_ws("-", "_x_text", F.col(id_col).cast("string"))))
    out = two_stage_rank(out, ["shard"], [], "_x_key", prefix_len=3, out="slot")
    return out.select(F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
