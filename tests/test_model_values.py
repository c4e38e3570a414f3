"""Values behind entries that SQL can't express: compression ratios, forests, importances, nearest centres."""

import bz2

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslab.operators import models, stylistics as st
from corpuslab.plans import q_stylistics
from corpuslab.plans.registry import load_all


def test_compression_ratio_equals_the_codec(spark, sf):
    queries = load_all()
    fed = {r["doc_id"]: r["selected_text"] for r in st.compression_selection(st.sentence_text(q_stylistics.tokens(spark, sf))).collect()}
    want = {d: None if t is None else round(len(t.encode()) / len(bz2.compress(t.encode(), 9)), 6) for d, t in fed.items()}
    for name in ("compression_ratio", "compression_ratio_fused"):
        got = {r["doc_id"]: r["compression_ratio"] for r in queries[name](spark, sf).collect()}
        assert {d: v for d, v in got.items() if v is not None} == pytest.approx({d: v for d, v in want.items() if v is not None})
    table = queries["stylistics_table"](spark, sf)
    assert {r["doc_id"]: r["compression_ratio"] for r in table.where("compression_ratio IS NOT NULL").collect()} == pytest.approx(
        {d: v for d, v in want.items() if v is not None})


def separable(spark, n=200):
    rng = np.random.default_rng(1)
    rows = [(i, "a" if i % 2 else "b", i % 5, float(i % 2) * 3 + float(rng.normal()) * 0.2, float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, label string, fold long, x double, noise double")


def test_forest_is_the_mean_of_its_trees(spark):
    df = separable(spark).withColumn("_y", models.label_index("label", ["a", "b"]))
    v = models.ColumnsFeaturizer(["x", "noise"]).fit(df)(df).cache()
    m = models.train_forest(v, num_trees=7, max_depth=6)
    parts = [{r["doc_id"]: np.array(r["p"]) for r in t.transform(v).select("doc_id", vector_to_array("probability").alias("p")).collect()} for t in m.trees]
    for r in m.transform(v).select("doc_id", vector_to_array("probability").alias("p"), "prediction", "_y").collect():
        mean = sum(p[r["doc_id"]] for p in parts) / 7
        assert r["p"] == pytest.approx(mean) and r["prediction"] == float(np.argmax(mean)) == r["_y"]


def test_cross_validation_and_importances_of_separable_classes(spark):
    preds, fitted = models.cross_validate(separable(spark), models.ColumnsFeaturizer(["x", "noise"]), ["a", "b"], num_trees=10, max_depth=5)
    assert preds.where("label <> prediction").count() == 0 and preds.count() == 200
    assert {r["fold"]: r["n"] for r in preds.groupBy("fold").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(5), 40)
    imp = {r["feature"]: r["importance"] for r in models.mean_importances(spark, fitted, ["x", "noise"]).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["x"] > 0.9


def test_nearest_centres(spark):
    rng = np.random.default_rng(2)
    centres, x = rng.normal(size=(40, 6)), rng.normal(size=(300, 6))
    own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    wrong = {k for k in range(0, 300, 7)}
    rows = [(k, int((own[k] + 1) % 40 if k in wrong else own[k]), [float(v) for v in x[k]]) for k in range(300)]
    out = models.with_nearest(spark.createDataFrame(rows, "doc_id int, cluster int, e array<double>"), centres, "e").collect()
    assert {r["doc_id"] for r in out if not r["nearest"]} == wrong
