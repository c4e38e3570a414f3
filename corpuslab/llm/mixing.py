"""Operator 6: mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. One word count per document and one row of totals per source. Sources in code point order
   (null last) weigh ``WEIGHTS`` in turn and share ``share`` of all words; a target stops at
   ``most`` times its source, and the excess is shared again by weight.
2. A source's documents stand in a seeded random order (md5 of the id). A document is a block;
   the mix takes whole passes over the source and then blocks in that order until the
   target, rounded to a word, is met. The last of them is counted in part, so that the words taken meet the target exactly, or,
   with ``whole``, taken as it is if that comes nearer to the target than leaving it out.
3. The exact number of blocks per source is split among the output shards by a binary tree:
   at each node a multivariate-hypergeometric draw says how many blocks of each source go to
   the left half. Leaves get disjoint intervals of each source's order, and what the mix takes of a document is what
   the leaves draw of it. From ``DRAWN`` blocks on, the tree draws runs of several consecutive blocks, so that every draw stays exact.
4. The mix gathers each shard (spread over partitions where it is large) and shuffles it locally by a second seeded key (``shard_order``).

Ranks and running sums within a source use two steps: totals per (source, first hex digits of
the key), their offsets, and a window inside each such bucket. A source with a third of all
rows is spread over 16**prefix buckets. The driver holds one row per source.

Defined cases: null text has no words; a null source is a source of its own; an empty document
is drawn like others and adds no words; a source without words gets target 0; documents with one
id share a key, and ties are broken by size and checksum of the text, so rows that still tie are equal; an empty table gives an empty table. Other columns pass through (``_x_`` names are reserved).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SHARDS, SEED = 1.5, 2.0, 16, 7
#: The most blocks (or runs of blocks) that one draw is made from: numpy's exact generator takes fewer than 10**9.
DRAWN = 500_000_000
#: Per-source tables of up to so many numbers are broadcast (8 MB).
BROADCAST_VALUES = 1_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words for each source, in the given order."""
    size, w = np.array(sizes, float), np.array([weights[k % len(weights)] for k in range(len(sizes))])
    cap, out = most * size, np.zeros(len(sizes))
    open_, rest = np.ones(len(sizes), bool), share * size.sum()
    while open_.any():
        want = rest * w / w[open_].sum()
        over = open_ & (want > cap)
        if not over.any():
            out[open_] = want[open_]
            break
        out[over] = cap[over]
        rest -= cap[over].sum()
        open_ &= ~over
    return out.tolist()


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn without replacement."""
    out, left, total = np.zeros_like(counts), n, int(counts.sum())
    for k, c in enumerate(counts.tolist()):
        rest = total - c
        got = int(rng.hypergeometric(c, rest, left)) if left and c else 0
        out[k], left, total = got, left - got, rest
    return out


def split_quotas(counts: list[int], shards: int, seed: int = SEED, drawn: int = DRAWN) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows); column sums are ``counts``.

    With more than ``drawn`` blocks in all, runs of so many blocks are drawn that there are no more runs than that (a source's last run may be shorter).
    """
    run = max(1, -(-sum(counts) // drawn))
    out = np.zeros((shards, len(counts)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _draw(rng, have, int(have.sum()) * (mid - lo) // (hi - lo))
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.array([-(-c // run) for c in counts], np.int64))
    ends = np.minimum(np.cumsum(out, axis=0) * run, np.array(counts, np.int64))
    return np.diff(ends, axis=0, prepend=0)


def _running(d: DataFrame, prefix: int) -> DataFrame:
    """0-based rank and words before, within each source in the order of ``_x_key``."""
    d = d.withColumn("_x_b", F.substring("_x_key", 1, prefix))
    part = d.groupBy("_x_src", "_x_b").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    w = Window.partitionBy("_x_src").orderBy("_x_b").rowsBetween(Window.unboundedPreceding, -1)
    off = part.select("_x_src", "_x_b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_x_n0"),
                      F.coalesce(F.sum("s").over(w), F.lit(0)).alias("_x_s0"))
    inner = Window.partitionBy("_x_src", "_x_b").orderBy("_x_key", "size", "_x_tie")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_x_rn": F.row_number().over(inner), "_x_ws": F.coalesce(F.sum("size").over(before), F.lit(0))})
    return d.join(off, ["_x_src", "_x_b"]).withColumns({
        "_x_rank": F.col("_x_n0") + F.col("_x_rn") - 1, "_x_before": F.col("_x_s0") + F.col("_x_ws")})


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS,
        seed: int = SEED, prefix: int = 3, whole: bool = False, carry: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, shards, shard_order.

    ``shards`` has the output shard of each drawn copy; ``taken`` counts their words, without those that the last block of a
    source has beyond the target (none with ``whole``). With ``carry`` the whole row comes along as the struct ``_x_row``.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    src = F.concat(F.when(F.col(source_col).isNull(), "n").otherwise("s"), F.coalesce(source_col, F.lit("")))
    tie = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    own = [n_words(F.col(text_col)).alias("size"), src.alias("_x_src"), key.alias("_x_key"), tie.alias("_x_tie")]
    slim = materialize(docs.select(F.col(id_col), *own), "mix-sizes")
    rows = slim.groupBy("_x_src").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: (r["_x_src"][0] == "n", r["_x_src"]))  # by code point; null last
    want = targets([r["s"] for r in rows], weights, share, most)
    quota = [min(round(t), int(most * r["s"])) for t, r in zip(want, rows)]
    passes = [q // r["s"] if r["s"] else 0 for q, r in zip(quota, rows)]
    rest = [q - p * r["s"] for q, p, r in zip(quota, passes, rows)]

    # the number of blocks that the last, partial pass draws from each source
    small = len(rows) * (shards + 8) <= BROADCAST_VALUES  # else a join that Spark may split
    sent = F.broadcast if small else (lambda d: d)
    left = sent(spark.createDataFrame([(r["_x_src"], int(x)) for r, x in zip(rows, rest)], "_x_src string, _x_rest long"))
    middle = (F.col("_x_rest") > 0) & (2 * F.col("_x_before") + F.col("size") <= 2 * F.col("_x_rest"))
    inside = middle if whole else F.col("_x_before") < F.col("_x_rest")  # the documents of the partial pass
    drawn = _running(slim, prefix).join(left, "_x_src").where(inside)
    partial = {r["_x_src"]: r["k"] for r in drawn.groupBy("_x_src").agg(F.count(F.lit(1)).alias("k")).collect()}

    blocks = [int(p) * r["n"] + partial.get(r["_x_src"], 0) for p, r in zip(passes, rows)]
    ends = np.cumsum(split_quotas(blocks, shards, seed), axis=0)
    per_source = spark.createDataFrame(
        [(r["_x_src"], r["s"], float(t), int(p), int(x), r["n"], ends[:, k].tolist())
         for k, (r, t, p, x) in enumerate(zip(rows, want, passes, rest))],
        "_x_src string, source_size long, target double, passes long, _x_rest long, _x_n long, _x_ends array<long>")
    kept = ["_x_row"] if carry else []
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_x_row")
    d = _running(docs.select(F.col(id_col), row, *own) if carry else slim, prefix).join(sent(per_source), "_x_src")
    over = F.greatest(F.lit(0), F.col("_x_before") + F.col("size") - F.col("_x_rest"))  # words of the last block beyond the target
    d = d.withColumns({"_x_in": inside, "_x_copies": F.col("passes") + inside.cast("long")})
    at = "transform(sequence(0L, _x_copies - 1), j -> cast(size(filter(_x_ends, e -> e <= j * _x_n + _x_rank)) as int))"
    d = d.withColumn("shards", F.expr(f"case when _x_copies > 0 then {at} else cast(array() as array<int>) end"))
    taken = F.size("shards") * F.col("size") - (F.lit(0) if whole else F.when(F.col("_x_in"), over).otherwise(0))
    return d.select(F.col(id_col), *kept, "size", "source_size", "target", taken.cast("long").alias("taken"), "shards", F.col("_x_key").alias("shard_order"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each drawn copy, whole, with the columns of ``docs``.

    Rows are gathered by shard, a large shard in several neighbouring partitions, and shuffled locally by ``shard_order``.
    """
    d = mix(docs, carry=True, whole=True, **options)
    d = d.select("_x_row", "shard_order", F.posexplode("shards").alias("_x_copy", "_x_shard"))
    d = d.withColumn("_x_order", F.xxhash64("shard_order", "_x_copy"))
    d = d.repartitionByRange("_x_shard", "_x_order").sortWithinPartitions("_x_shard", "_x_order")
    return d.select(*[F.col("_x_row").getField(c).alias(c) for c in docs.columns])
