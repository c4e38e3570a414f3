"""The balancing fold solver: against one greedy step per group, the snake, and its own defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import folds, splits


def greedy(groups, total, k):
    """Fold of each group (class counts), one group at a time."""
    order = sorted(range(len(groups)), key=lambda i: (-(len(total) * sum(x * x for x in groups[i]) - sum(groups[i]) ** 2), -sum(groups[i]), groups[i]))
    counts, out = np.zeros((k, len(total))), {}
    for i in order:
        scores = []
        for f in range(k):
            after = counts.copy()
            after[f] += groups[i]
            scores.append((round(float(np.mean(np.std(after / total, axis=0))), 12), counts[f].sum(), f))
        out[i] = min(scores)[2]
        counts[out[i]] += groups[i]
    return out, counts


def spread(counts, total):
    return float(np.mean(np.std(counts / np.maximum(total, 1), axis=0)))


def test_batches_add_up_and_end_with_single_groups():
    for k in (2, 5):
        for m in [*range(1, 200), 12345, 10**12]:
            b = list(folds.batches(m, k))
            assert sum(b) == m and b == sorted(b, reverse=True) and len(b) < 4 * k + 2 * k * 42
            assert b.count(1) >= min(m, 2 * k)


def test_solver_equals_one_step_per_group():
    rng = random.Random(4)
    for _ in range(20):
        c = rng.choice([2, 3])
        groups = [[rng.randint(0, 30) for _ in range(c)] for _ in range(rng.randint(5, 40))]
        total = np.maximum(np.sum(groups, axis=0), 1)
        _, want = greedy(groups, total, 5)
        vectors = sorted({tuple(g) for g in groups}, key=lambda g: (-(c * sum(x * x for x in g) - sum(g) ** 2), -sum(g), g))
        times = [sum(tuple(g) == v for g in groups) for v in vectors]
        f = folds.solve(np.array(vectors), np.array(times), total, 5)
        assert f.sum(axis=1).tolist() == times
        assert (np.einsum("vk,vc->kc", f, np.array(vectors)) == want).all()


def test_equal_groups_by_the_billion():
    f = folds.solve(np.array([[500, 1], [1, 0], [0, 1]]), np.array([1, 10**9, 10**9]), np.array([10**9 + 500, 10**9 + 1]), 5)
    counts = np.einsum("vk,vc->kc", f, np.array([[500, 1], [1, 0], [0, 1]]))
    assert f.sum(axis=1).tolist() == [1, 10**9, 10**9] and np.ptp(counts, axis=0).max() <= 1


def skewed(seed):
    """Many small groups, some large ones of one class or mixed."""
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(60):
        for _ in range(int(rng.paretovariate(0.8)) % 150 + 1):
            rows.append((n, f"g{g}", "a" if rng.random() < (0.9, 0.5, 0.1)[g % 3] else "b"))
            n += 1
    return rows + [(n + i, f"s{i}", rng.choice("ab")) for i in range(90)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_are_whole_and_shares_no_worse_than_the_snake(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "doc_id long, group_id string, label string").repartition(3)
    total = np.array([sum(r[2] == c for r in rows) for c in "ab"])

    def counted(out):
        got = out.collect()
        assert sorted((r["doc_id"], r["group_id"], r["label"]) for r in got) == sorted(rows)
        fold = {}
        for r in got:
            assert fold.setdefault(r["group_id"], r["fold"]) == r["fold"]
        return np.array([[sum(r["fold"] == f and r["label"] == c for r in got) for c in "ab"] for f in range(5)]), fold

    exact, fold = counted(folds.stratified_group_folds(df))
    snake, _ = counted(splits.snake_group_folds(df))
    assert spread(exact, total) <= spread(snake, total)
    by = {}
    for _, g, c in rows:
        by.setdefault(g, [0, 0])["ab".index(c)] += 1
    _, want = greedy(list(by.values()), total, 5)
    assert (exact == want).all()  # no vector here occurs often enough for batches of two ...
    again = {r["group_id"]: r["fold"] for r in folds.stratified_group_folds(df.repartition(7)).collect()}
    assert again == fold
    blocks, _ = counted(folds.stratified_group_folds(df, lead=10))  # ... and most vectors in blocks
    assert spread(blocks, total) <= 2 * max(spread(snake, total), max(max(v) / t for v, t in zip(zip(*by.values()), total)))


def test_defined_cases_of_folds(spark):
    schema = "doc_id long, group_id string, label string"
    empty = folds.stratified_group_folds(spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "group_id", "label", "fold"] and empty.count() == 0
    rows = [(1, None, "a"), (2, None, "b"), (3, "x", None), (4, "x", None), (5, "y", "a"), (5, "y", "a")]
    got = folds.stratified_group_folds(spark.createDataFrame(rows, schema), k=3).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5, 5]
    assert len({(r["group_id"], r["fold"]) for r in got}) == len({r["group_id"] for r in got}) == 3
    assert all(0 <= r["fold"] < 3 for r in got)


def test_a_hot_group_and_many_equal_ones(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("group_id"),
                                  F.when((F.col("id") % 2 == 0) | (F.col("id") < 2000), "a").otherwise("b").alias("label"))
    per = {r["fold"]: r["count"] for r in folds.stratified_group_folds(df).groupBy("fold").count().collect()}
    assert sorted(per.values()) == [900, 900, 900, 900, 2400]
