"""Neighbour graph, fuzzy weights and map against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import layout, neighbours as nb


def clustered(n=900, dim=24, clusters=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return centres[np.arange(n) % clusters] + 0.5 * rng.normal(size=(n, dim))


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(int(i) * 3 - 5, [float(x) for x in v]) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>").repartition(parts)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def trustworthiness(x, y, k=10):
    """1, less a penalty for map neighbours that are not neighbours among the vectors."""
    n, dx, dy = len(x), 1 - x @ x.T, ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(dx, np.inf), np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, 1), 1) + 1
    mine = np.take_along_axis(rank, np.argsort(dy, 1)[:, :k], 1)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(mine - k, 0).sum()


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall_of_the_graph_with_small_blocks(spark, kind):
    x = clustered() if kind == "clusters" else np.random.default_rng(2).normal(size=(700, 12))
    pts = nb.points(frame(spark, x), "doc_id", "embedding")
    graph = nb.neighbour_graph(pts, k=10, trees=6, block=64)  # a block holds a tenth of the points
    got = {r["i"]: [q["j"] for q in r["near"]] for r in graph.collect()}
    u = unit(x)  # ids ascend with the rows, so idx is the row number
    want, _ = nb.nearest(u, np.arange(len(u)), 10)
    assert all(len(set(v)) == 10 and i not in v for i, v in got.items())
    assert np.mean([len(set(got[i]) & set(want[i].tolist())) / 10 for i in range(len(u))]) >= 0.9


def test_map_is_truer_than_principal_components_and_reruns_agree(spark):
    x = clustered(480)
    out = {}
    m = layout.neighbour_map(frame(spark, x), trees=4, block=128, layout_block=200, graph_out=out)
    first = {r["doc_id"]: (r["x"], r["y"]) for r in m.collect()}
    y = np.array([first[i * 3 - 5] for i in range(len(x))])
    pca = layout.principal(out["points"]).orderBy("idx").select("x", "y").toPandas().to_numpy()
    assert trustworthiness(unit(x), y) > trustworthiness(unit(x), pca) and trustworthiness(unit(x), y) > 0.93
    again = layout.neighbour_map(frame(spark, x, parts=5), trees=4, block=128, layout_block=200)
    assert {r["doc_id"]: (r["x"], r["y"]) for r in again.collect()} == first


def test_fuzzy_weights_add_up_and_are_symmetric(spark):
    x = clustered(150)
    pts = nb.points(frame(spark, x), "doc_id", "embedding")
    graph = nb.neighbour_graph(pts, k=8, trees=2, block=150, rounds=0)
    w = {(r["i"], r["j"]): r["w"] for r in nb.fuzzy_weights(graph, 8).collect()}
    near, d = nb.nearest(unit(x), np.arange(150), 8)
    one = {}
    for i in range(150):
        gap = d[i] - d[i][0]
        lo, hi = 1e-12, 1e3
        for _ in range(200):
            mid = (lo * hi) ** 0.5
            lo, hi = (mid, hi) if np.exp(-gap / mid).sum() < np.log2(8) else (lo, mid)
        one |= {(i, int(j)): float(np.exp(-g / lo)) for j, g in zip(near[i], gap)}
    assert w.keys() == one.keys()
    for (i, j), v in w.items():
        a, b = one[i, j], one.get((j, i), 0.0)
        assert v == pytest.approx(a + b - a * b, rel=1e-6) and 0 < v <= 1
        assert (j, i) not in w or w[j, i] == pytest.approx(v)


def test_equal_vectors_nulls_and_few_points(spark):
    schema = "doc_id long, embedding array<double>, x double"
    rows = [(i, [1.0, 0.0, 0.0], 9.0) for i in range(300)] + [(1000 + i, [0.0, 1.0, i / 50], 9.0) for i in range(60)]
    rows += [(1, [1.0, 0.0, 0.0], 9.0), (5000, None, 9.0), (5001, [1.0, None, 0.0], 9.0), (5002, [float("nan"), 1.0, 0.0], 9.0), (5003, [0.0, 0.0, 0.0], 9.0)]
    df = spark.createDataFrame(rows, schema)
    pts = nb.points(df, "doc_id", "embedding")
    graph = nb.neighbour_graph(pts, k=5, trees=3, block=32)
    assert graph.count() == pts.count() == 362
    used = graph.select(F.explode("near").alias("q")).groupBy("q.j").count().agg(F.max("count")).first()[0]
    assert used < 60  # ties are spread: no point is everyone's neighbour
    got = layout.neighbour_map(df, k=5, trees=3, block=32, rounds=2, epochs=5).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, v, _ in rows if i < 5000 or i == 5003)
    assert np.isfinite([[r["x"], r["y"]] for r in got]).all() and len({(r["x"], r["y"]) for r in got}) == len(got)
    for n in (0, 1, 2, 4):
        assert layout.neighbour_map(df.where(F.col("doc_id").between(1000, 999 + n)), rounds=1).count() == n
    full = nb.neighbour_graph(nb.points(df.where(F.col("doc_id").between(1000, 1003)), "doc_id", "embedding")).collect()
    assert all(len(r["near"]) == 3 for r in full)


def test_curve_of_the_usual_minimum_distance():
    assert layout.curve(0.1) == pytest.approx((1.577, 0.895), abs=1e-3)
