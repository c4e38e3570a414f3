"""M6, second half: a 2-D map from the neighbour graph, by sampled edges and negative samples.

Points start at their principal components. Each point is drawn towards the ends of its edges, which are sampled by
weight, and pushed away from points drawn at random, with the gradients of the curve 1 / (1 + a d^2b).
Points lie in blocks of at most ``block`` (in the order of a random tree, so neighbours are
mostly in the same one). In a round each block runs ``epochs`` steps in one task: its own points
move, the ends of their edges in other blocks stay where the round began, and the points that
push are the block's own or those of a sample of all points. Between rounds the new places are
written and joined to the edges again. All random numbers are seeded by round and block, and a
block's rows are sorted, so reruns give the same map. A task holds block x (k + 1) rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import neighbours as nb

LAYOUT_BLOCK, STEPS, EPOCHS, SAMPLE, NEGATIVES, RATE = 16384, 10, 40, 1024, 5, 0.3


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b for which 1 / (1 + a x^2b) is nearest to 1 up to ``min_dist`` and then exp(-(x - min_dist) / spread)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):  # damped least squares
        u = p[0] * x ** (2 * p[1])
        y = 1 / (1 + u)
        jac = np.stack([-y * y * u / p[0], -y * y * u * 2 * np.log(x)], 1)
        p = p + np.linalg.solve(jac.T @ jac + 1e-6 * np.eye(2), jac.T @ (want - y))
    return float(p[0]), float(p[1])


def principal(df: DataFrame, vec_col: str = "v") -> DataFrame:
    """``df`` with x, y: the first two principal components of the unit vectors."""
    v = df.withColumn("_v", array_to_vector(F.col(vec_col)))
    n = Normalizer(p=2.0, inputCol="_v", outputCol="_n").transform(v)
    p = PCA(k=2, inputCol="_n", outputCol="_p").fit(n).transform(n)
    arr = vector_to_array("_p")
    return p.withColumn("x", arr[0]).withColumn("y", arr[1]).drop("_v", "_n", "_p")


def steps(own: np.ndarray, ends: np.ndarray, weights: np.ndarray, fixed: np.ndarray, sample: np.ndarray, share: float,
          epochs: int, alpha: tuple[float, float], ab: tuple[float, float], rng: np.random.Generator, negatives: int = NEGATIVES) -> np.ndarray:
    """The block's places after ``epochs`` steps.

    ``ends`` (points x edges) are row numbers in ``own`` followed by ``fixed``; ``share``: how much of all points the block is.
    """
    a, b = ab
    n, pos = len(own), np.vstack([own, fixed])
    edge = np.cumsum(weights, axis=1)
    whole = edge[:, -1:]
    linked = whole[:, 0] > 0
    for e in range(epochs):
        rate = alpha[0] + (alpha[1] - alpha[0]) * e / epochs
        drawn = (edge <= rng.random((n, 1)) * whole).sum(1)
        gap = pos[:n] - pos[ends[np.arange(n), np.minimum(drawn, ends.shape[1] - 1)]]
        d2 = (gap * gap).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pull = np.where(linked & (d2 > 0), -2 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b), 0.0)
        move = np.clip(pull[:, None] * gap, -4, 4)
        for _ in range(negatives):
            near = rng.random(n) < share
            other = np.where(near[:, None], pos[rng.integers(0, n, n)], sample[rng.integers(0, len(sample), n)])
            gap = pos[:n] - other
            d2 = (gap * gap).sum(1)
            push = np.where(d2 > 0, 2 * b / ((0.001 + d2) * (1 + a * d2 ** b)), 0.0)
            move += np.clip(push[:, None] * gap, -4, 4)
        pos[:n] += rate * move
    return pos[:n]


def _round(r: int, sample: np.ndarray, total: int, epochs: int, alpha: tuple[float, float], ab: tuple[float, float], seed: int):
    """What one block does in round ``r``: rows (i, home, j, w, x, y of j; j = i: the point itself) to new places."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "w", "j"], ascending=[True, False, True], kind="stable")
        mine = pdf[pdf["i"] == pdf["j"]]
        ids = mine["i"].to_numpy()
        out = pdf[pdf["i"] != pdf["j"]]
        far = out[~out["j"].isin(ids)].drop_duplicates("j")
        row = {int(x): n for n, x in enumerate(np.concatenate([ids, far["j"].to_numpy()]))}
        head = np.searchsorted(ids, out["i"].to_numpy())
        slot = out.groupby("i").cumcount().to_numpy()
        ends, w = np.zeros((len(ids), max(int(slot.max(initial=0)) + 1, 1)), np.int64), np.zeros((len(ids), max(int(slot.max(initial=0)) + 1, 1)))
        ends[head, slot] = [row[int(j)] for j in out["j"]]
        w[head, slot] = out["w"].to_numpy()
        got = steps(mine[["x", "y"]].to_numpy(), ends, w, far[["x", "y"]].to_numpy(), sample, len(ids) / total, epochs, alpha, ab,
                    np.random.default_rng([seed, r, int(pdf["home"].iloc[0])]))
        return pd.DataFrame({"idx": ids, "x": got[:, 0], "y": got[:, 1]})

    return run


def neighbour_map(df: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", k: int = nb.K, trees: int = nb.TREES,
                  block: int = nb.BLOCK, min_dist: float = 0.1, rounds: int = STEPS, epochs: int = EPOCHS, seed: int = 42,
                  layout_block: int = LAYOUT_BLOCK, graph_out: dict | None = None) -> DataFrame:
    """(id, x, y) of every row with a valid vector. ``graph_out`` receives the tables ``points`` and ``edges`` (i, j, d, w)."""
    pts = nb.points(df, id_col, vec_col)
    total = pts.count()
    if total < 3:
        return pts.select(F.col("id").alias(id_col), F.col("idx").cast("double").alias("x"), F.lit(0.0).alias("y"))
    placed = materialize(nb.blocks(pts, trees, block, seed), "map-blocks")
    edges = materialize(nb.fuzzy_weights(nb.neighbour_graph(pts, k, trees, block, seed=seed, placed=placed), k), "map-fuzzy")
    if graph_out is not None:
        graph_out |= {"points": pts, "edges": edges}
    home = placed.where("tree = 0").select(F.col("idx").alias("i"), F.floor(F.col("at") / layout_block).cast("long").alias("home"))
    own = home.select("i", "home", F.col("i").alias("j"), F.lit(0.0).alias("w"))
    links = materialize(edges.join(home, "i").select("i", "home", "j", "w").unionByName(own), "map-links")

    start = principal(pts.select("idx", "v")).select("idx", "x", "y")
    wide = start.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    jitter = [F.hash("idx", F.lit(seed + c)) / float(1 << 31) * 0.01 for c in (0, 1)]  # equal vectors part
    at = materialize(start.select("idx", (F.col("x") * (10 / wide) + jitter[0]).alias("x"), (F.col("y") * (10 / wide) + jitter[1]).alias("y")), "map-places")
    ab = curve(min_dist)
    for r in range(rounds):
        sample = np.array([[q["x"], q["y"]] for q in at.orderBy(F.xxhash64("idx", F.lit(r))).limit(SAMPLE).collect()])
        alpha = (RATE * (1 - r / rounds), RATE * (1 - (r + 1) / rounds))

        joined = links.join(at.withColumnRenamed("idx", "j"), "j")
        at = materialize(joined.groupBy("home").applyInPandas(_round(r, sample, total, epochs, alpha, ab, seed), "idx long, x double, y double"), "map-places")
    return pts.join(at, "idx").select(F.col("id").alias(id_col), "x", "y")
