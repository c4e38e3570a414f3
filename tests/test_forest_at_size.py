"""Forests at size: what a fit holds, how its rows are dealt out, and medians over tied values."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from corpuslab.operators import models, stats


def rows_of_two_classes(spark, n=300):
    rng = np.random.default_rng(5)
    rows = [(i, "a" if i % 2 else "b", i % 5, float(i % 2) + float(rng.normal()), None if i % 9 == 0 else float(rng.integers(0, 4))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, label string, fold long, x double, y double")


def test_cross_validation_keeps_no_forest(spark):
    preds, fitted = models.cross_validate(rows_of_two_classes(spark), models.ColumnsFeaturizer(["x", "y"]), ["a", "b"], num_trees=5, max_depth=4)
    assert not any(isinstance(m, RandomForestClassificationModel) for _, m in fitted)
    assert "UDF" not in preds._jdf.queryExecution().optimizedPlan().toString()  # written, not a forest yet to be applied
    assert preds.count() == 300 and all(len(m.featureImportances) == 2 for _, m in fitted)


def test_rows_keep_their_nodes(spark):
    df = rows_of_two_classes(spark).withColumn("_y", models.label_index("label", ["a", "b"]))
    m = models.train_forest(models.ColumnsFeaturizer(["x", "y"]).fit(df)(df), num_trees=3, max_depth=4)
    assert m.getCacheNodeIds() and m.getMaxMemoryInMB() <= 256


def test_fit_tasks_grow_with_rows_up_to_half_the_cores():
    assert [models.fit_tasks(n, 12) for n in (0, 1, 2048, 2049, 5532, 28_188, 10**9)] == [1, 1, 1, 2, 3, 6, 6]
    assert models.fit_tasks(10**6, 1) == 1


def test_quantiles_of_counted_values(spark):
    rng = np.random.default_rng(6)
    values = {f: rng.integers(0, m, 700).astype(float) / 7 for f, m in (("few", 3), ("many", 5000))}
    long = spark.createDataFrame([(f, float(v)) for f, x in values.items() for v in x], "feature string, value double")
    tied = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    got = {(r["feature"], r["p"]): r["q"] for r in stats.exact_quantiles(tied, (0.25, 0.5, 0.9), count_col="n").collect()}
    assert got == pytest.approx({(f, p): float(np.quantile(x, p)) for f, x in values.items() for p in (0.25, 0.5, 0.9)})
