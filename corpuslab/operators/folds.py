"""Stratified group folds by the balancing solver.

Groups are taken by falling spread (population std) of their class counts, and each goes to the
fold that leaves the least mean, over classes, of the std over folds of the fold's share
of the class (ties: the fold with fewer rows, then the lower number).

Groups with equal class counts are interchangeable, so the solver works on the distinct count
vectors and how often each occurs: it decides how many groups of a vector each fold gets, and the groups are dealt
by their rank under a seeded hash. A vector that occurs m times is placed in batches of
equal groups, which shrink to single groups before the last few rounds, about 2k log2(m) steps
in place of m, and the folds end level to within a group.

With N rows and c classes there are no more than about N^(c/(c+1)) distinct vectors. The ``lead``
vectors with the largest spread are solved one after the other on the driver. The rest, whose
groups are smaller still, are dealt by hash into blocks of about ``lead`` vectors, which tasks solve each
on its own from level folds; the folds are renumbered from block to block, so that the blocks' remainders don't add up in one fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import attach
from .splits import seeded_key, two_stage_rank

LEAD = 50_000


def batches(m: int, k: int) -> Iterator[int]:
    """Sizes of the batches in which m equal groups are placed: powers of two, single ones for the last 4k at least."""
    while m:
        b = 1 if m < 4 * k else 1 << ((m // (2 * k)).bit_length() - 1)
        yield b
        m -= b


def best_fold(counts: np.ndarray, group: np.ndarray, total: np.ndarray) -> int:
    """The fold (row of ``counts``) that leaves the least spread when ``group`` joins it."""
    k = len(counts)
    after = (counts[None] + np.eye(k, dtype=np.int64)[:, :, None] * group) / total
    spread = np.round(after.std(axis=1).mean(axis=1), 12)
    return min(range(k), key=lambda i: (spread[i], counts[i].sum(), i))


def solve(vectors: np.ndarray, times: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """For each vector (in the given order) how many of its groups every fold gets."""
    counts, out = np.zeros((k, len(total)), np.int64), np.zeros((len(vectors), k), np.int64)
    total = np.maximum(total, 1)
    for n, (v, m) in enumerate(zip(vectors, times)):
        for b in batches(int(m), k):
            at = best_fold(counts, v * b, total)
            counts[at] += v * b
            out[n, at] += b
    return out


def class_vectors(df: DataFrame, label_col: str, group_col: str) -> tuple[DataFrame, list[int]]:
    """(group, ``_x_v``: rows per class in the order of the classes, ``_x_n``: rows), and the rows of each class (null: a class of its own)."""
    per = materialize(df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("_x_n")), "fold-counts")
    classes = per.groupBy(label_col).agg(F.sum("_x_n").alias("n")).orderBy(label_col).collect()  # bounded: classes
    of = [F.coalesce(F.sum(F.when(F.col(label_col).eqNullSafe(F.lit(r[0])), F.col("_x_n"))), F.lit(0)) for r in classes]
    return per.groupBy(group_col).agg(F.array(*of).alias("_x_v"), F.sum("_x_n").alias("_x_n")), [r["n"] for r in classes]


def _order() -> list:
    v = F.col("_x_v")
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    size = add(lambda x: x)
    return [(F.size(v) * add(lambda x: x * x) - size * size).desc(), size.desc(), v.asc()]


def stratified_group_folds(df: DataFrame, label_col: str = "label", group_col: str = "group_id", k: int = 5,
                           seed: int = 42, out: str = "fold", lead: int = LEAD) -> DataFrame:
    """``df`` with k folds in ``out``: whole groups per fold, class shares as level as the solver gets them.

    Rows without a group form one group. An empty frame gives an empty frame.
    """
    groups, total = class_vectors(df, label_col, group_col)
    if not total:
        return df.withColumn(out, F.lit(None).cast("int"))
    groups = materialize(groups, "fold-groups")
    spark = df.sparkSession
    vectors = materialize(groups.groupBy("_x_v").agg(F.count(F.lit(1)).alias("_x_m")), "fold-vectors")
    first = vectors.orderBy(*_order()).limit(lead).collect()
    found = solve(np.array([r["_x_v"] for r in first], np.int64).reshape(len(first), len(total)), np.array([r["_x_m"] for r in first], np.int64),
                  np.array(total, np.int64), k)
    dealt = spark.createDataFrame([(r["_x_v"], int(r["_x_m"]), f.tolist()) for r, f in zip(first, found)], "_x_v array<long>, _x_m long, _x_f array<long>")
    if len(first) == lead:  # there may be more
        rest = vectors.join(dealt.select("_x_v"), "_x_v", "left_anti")
        blocks = -(-vectors.count() // lead)
        rest = rest.withColumn("_x_block", F.pmod(F.xxhash64("_x_v"), F.lit(blocks)).cast("int"))

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            v = np.array(pdf["_x_v"].tolist(), np.int64)
            keys = [tuple(x) for x in v.tolist()]
            order = sorted(range(len(v)), key=lambda i: (-(len(keys[i]) * sum(x * x for x in keys[i]) - sum(keys[i]) ** 2), -sum(keys[i]), keys[i]))
            f = solve(v[order], pdf["_x_m"].to_numpy()[order], np.array(total, np.int64), k)
            turned = np.roll(f, int(pdf["_x_block"].iloc[0]) % k, axis=1)
            return pd.DataFrame({"_x_v": v[order].tolist(), "_x_m": pdf["_x_m"].to_numpy()[order], "_x_f": turned.tolist()})

        dealt = dealt.unionByName(rest.groupBy("_x_block").applyInPandas(block, dealt.schema))
        dealt = materialize(dealt, "fold-dealt")
    keyed = groups.withColumns({"_x_key": seeded_key(F.coalesce(F.col(group_col).cast("string"), F.lit("")), seed, salt="group-"),
                                "_x_vec": F.array_join("_x_v", ",")})
    ranked = two_stage_rank(keyed, ["_x_vec"], [], "_x_key")  # a vector that very many groups share is ranked in buckets
    named = dealt.select(F.array_join("_x_v", ",").alias("_x_vec"), "_x_f", F.col("_x_m").alias("_x_c"))
    placed = attach(materialize(ranked.select(group_col, "_x_vec", "_x_n", "_rank"), "fold-ranks"), named, "_x_vec", "_x_c")
    upto = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(F.slice("_x_f", 1, i), F.lit(0).cast("long"), lambda s, x: s + x))
    fold = F.size(F.filter(upto, lambda e: e < F.col("_rank"))).cast("int")
    return attach(df, placed.select(F.col(group_col), fold.alias(out), "_x_n"), group_col)
