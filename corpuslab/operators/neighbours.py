"""M6, first half: an approximate nearest-neighbour graph and its fuzzy edge weights.

Vectors are normalised (cosine distance). Each of ``trees`` random trees sorts all points by the signs of
their centred vectors on seeded random directions, which are the turns taken at the tree's levels, and
cuts that order into blocks of at most ``block`` points, whatever the data: equal vectors, too, spread over as many
blocks as they need. Within a block all distances are computed, and each point keeps its ``k`` nearest
over all trees. Rounds of neighbour descent follow: the k neighbours of a point meet at
that point, are compared with one another, and pass on what is nearer than what they had.

So the work is trees x points x block, then rounds x points x k**2, in tasks that hold one
block of vectors or one batch of neighbourhoods. There is no cross join. Ties in distance
are broken by a hash of the pair, so equal vectors choose different neighbours among themselves.

Defined cases: rows with a null vector, or a null or NaN component, are left out; a zero vector has
distance 1 to all; up to ``k`` points have all others as neighbours; repeated ids are points of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .cleaning import valid_vectors
from .ordered import attach, positions

K, TREES, BLOCK, LEVELS, ROUNDS = 15, 8, 512, 24, 2


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number in [0, 1) from each unordered pair of indices."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = lo * np.uint64(0x9E3779B97F4A7C15) + hi * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.float64) / (1 << 24)


def nearest(points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point its ``k`` nearest others (row numbers, and cosine distances), by comparing all; ties by a hash of the pair."""
    d = np.maximum(1.0 - points @ points.T, 0.0)
    np.fill_diagonal(d, np.inf)
    order = d + 1e-10 * _mixed(ids[:, None], ids[None])
    k = min(k, len(points) - 1)
    near = np.argpartition(order, k - 1, axis=1)[:, :k] if 0 < k < len(points) else np.zeros((len(points), 0), np.int64)
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(order, near, 1), axis=1, kind="stable"), 1)
    return near, np.take_along_axis(d, near, 1)


def points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(idx, id, v): the valid rows' unit vectors, numbered in the order of their ids."""
    d = valid_vectors(df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    d = d.withColumn("v", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))).withColumn("all", F.lit(0))
    return materialize(positions(d, "all", [F.col("id"), F.col("v")], "map-ids").select("idx", "id", "v"), "map-points")


def blocks(pts: DataFrame, trees: int, block: int, seed: int, levels: int = LEVELS) -> DataFrame:
    """(tree, idx, at, block): the place of each point in the order of each tree, and the block that it is in."""
    mean = {r["j"]: r["m"] for r in pts.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).collect()}  # dimensions
    centre = np.array([mean[j] for j in sorted(mean)])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v")) - centre
            for t in range(trees):
                p = x @ np.random.default_rng([seed, t]).normal(size=(len(centre), levels + 1))
                key = ((p[:, :levels] > 0) @ (1 << np.arange(levels - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), b.column("idx"), pa.array(key), pa.array(p[:, levels])],
                                                 names=["tree", "idx", "key", "last"])

    slim = pts.select("idx", "v").mapInArrow(turns, "tree int, idx long, key long, last double")
    placed = positions(slim, "tree", [F.col("key"), F.col("last"), F.col("idx")], "map-trees", out="at")
    return placed.select("tree", "idx", "at", F.floor(F.col("at") / block).cast("long").alias("block"))


_PAIRS = "i long, j long, d double"


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(i, near): of each point the ``k`` nearest of the pairs found, as (d, tie, j)."""
    one = pairs.groupBy("i", "j").agg(F.min("d").alias("d"))
    tie = F.xxhash64(F.least("i", "j"), F.greatest("i", "j"))
    return one.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", 10).alias("d"), tie.alias("tie"), "j"))), 1, k).alias("near"))


def _listed(graph: DataFrame) -> DataFrame:
    return graph.select("i", F.explode("near").alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.d").alias("d"))


def _in_blocks(pts: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    grouped = placed.select("tree", "block", "idx").join(pts.select("idx", "v"), "idx").groupBy("tree", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("p"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                p = batch.column("p").slice(r, 1).flatten()
                ids, v = p.field("idx").to_numpy(zero_copy_only=False), _matrix(p.field("v"))
                near, d = nearest(v, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1])), pa.array(ids[near.ravel()]), pa.array(d.ravel())],
                                                 names=["i", "j", "d"])

    return grouped.select("p").mapInArrow(compare, _PAIRS)


def _descend(pts: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Pairs that meet at a common neighbour (or are neighbours in one direction) and improve a point's list."""
    edges = materialize(_listed(graph), "map-edges")
    reach = graph.select(F.col("i").alias("j"), F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"]).alias("reach"))
    at = pts.select(F.col("idx").alias("j"), "v").join(reach, "j")
    used = edges.groupBy("j").agg(F.count(F.lit(1)).alias("_x_n")).join(at, "j")  # a point that very many list is sent by broadcast
    met = attach(edges.select("i", "j"), materialize(used, "map-used"), "j").unionByName(at.select(F.col("j").alias("i"), "j", "v", "reach"))
    met = met.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v", "reach"))).alias("p"))  # k + 1 at most

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                p = batch.column("p").slice(r, 1).flatten()
                ids, v, far = p.field("j").to_numpy(zero_copy_only=False), _matrix(p.field("v")), p.field("reach").to_numpy(zero_copy_only=False)
                d = np.maximum(1.0 - v @ v.T, 0.0)
                np.fill_diagonal(d, np.inf)
                a, b = np.nonzero(d < far[:, None])
                out.append((ids[a], ids[b], d[a, b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["i", "j", "d"])

    return met.select("p").mapInArrow(compare, _PAIRS)


def neighbour_graph(pts: DataFrame, k: int = K, trees: int = TREES, block: int = BLOCK, rounds: int = ROUNDS, seed: int = 42,
                    placed: DataFrame | None = None) -> DataFrame:
    """(i, near): for each of ``points`` its k nearest others found, nearest first, as structs (d, tie, j)."""
    placed = blocks(pts, trees, block, seed) if placed is None else placed
    graph = materialize(_best(_in_blocks(pts, placed, k), k), "map-graph")
    for _ in range(rounds):
        graph = materialize(_best(_listed(graph).unionByName(_descend(pts, graph, k)), k), "map-graph")
    return graph


def fuzzy_weights(graph: DataFrame, k: int = K) -> DataFrame:
    """(i, j, d, w): edges with symmetric fuzzy weights.

    From i, an edge weighs exp(-(d - rho) / sigma): rho is the distance to the nearest neighbour, and sigma such that the
    weights of the point's edges sum up to log2(k). The two directions a, b of an edge give a + b - ab.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, n = batch.column("near"), batch.column("near").value_lengths().to_numpy(zero_copy_only=False)
            flat = near.flatten()
            start = np.concatenate([[0], np.cumsum(n)])
            d = np.full((len(n), max(int(n.max(initial=0)), 1)), np.inf)
            cell = (np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(start[:-1], n))
            d[cell] = flat.field("d").to_numpy(zero_copy_only=False)
            gap = np.maximum(d - d[:, :1], 0.0)
            gap[~np.isfinite(d)] = np.inf
            lo, hi = np.full(len(n), 1e-12), np.full(len(n), 1e3)
            for _ in range(64):  # by halves of the exponent
                mid = np.sqrt(lo * hi)
                more = np.exp(-gap / mid[:, None]).sum(1) < np.log2(k)
                lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
            w = np.exp(-gap / np.sqrt(lo * hi)[:, None])[cell]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("i").to_numpy(zero_copy_only=False), n)), flat.field("j"),
                                              flat.field("d"), pa.array(w)], names=["i", "j", "d", "w"])

    one = materialize(graph.select("i", "near").mapInArrow(weigh, "i long, j long, d double, w double"), "map-weights")
    back = one.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("b"))
    b = F.coalesce("b", F.lit(0.0))
    return one.join(back, ["i", "j"], "left").select("i", "j", "d", (F.col("w") + b - F.col("w") * b).alias("w"))
