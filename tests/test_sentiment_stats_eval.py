import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluation as ev, folds as group_folds, sentiment as sn, splits, stats


def test_chunker(spark):
    df = spark.createDataFrame([("aa bbb cccc dd eeeee",)], "s string")
    got = df.select(sn.chunk_words("s", 6, "chars").alias("c")).first()["c"]
    assert got == ["aa bbb", "cccc dd", "eeeee"]
    one = spark.createDataFrame([("aa  bb",)], "s string").select(sn.chunk_words("s", 100, "chars")).first()[0]
    assert one == ["aa  bb"]  # a single chunk keeps the original text


def test_chunks_reproduce_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from corpuslab.operators import annotate
    sents = annotate.segment_sentences(docs)
    chunks = sents.select("sentence", sn.chunk_words("sentence", 40, "chars").alias("c"))
    bad = chunks.where(F.array_join("c", " ") != F.array_join(F.regexp_extract_all("sentence", F.lit(r"\S+"), 0), " "))
    assert bad.where(F.size("c") > 1).count() == 0


def test_sentiment_summary(spark):
    df = spark.createDataFrame([(1, 0, 0, "POS ", 0.9), (1, 1, 0, "neut", 0.8), (1, 2, 0, "negativ", 0.5),
                                (2, 0, 0, "pos", 0.7)], "doc_id long, sent_id int, chunk_id int, label string, score double")
    res = {r["doc_id"]: r for r in sn.sentiment_summary(sn.signed_scores(df)).collect()}
    assert res[1]["sentiment"] == pytest.approx([0.9, 0.0, -0.5])
    assert res[1]["sentiment_mean"] == pytest.approx(0.133333, abs=1e-6)
    assert res[1]["sentiment_std"] == pytest.approx(0.579272, abs=1e-6)
    assert res[1]["sentiment_abs"] == pytest.approx(0.466667, abs=1e-6)
    assert res[2]["sentiment_mean"] is None and res[2]["sentiment_std"] is None and res[2]["sentiment_abs"] is None


def test_ari_vmeasure_toy(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "u int, v int")
    assert ev.adjusted_rand_index(df, "u", "v").first()["ari"] == pytest.approx(0.571429, abs=1e-6)
    r = ev.v_measure(df, "u", "v").first()
    assert r["homogeneity"] == pytest.approx(1.0)
    assert r["completeness"] == pytest.approx(0.666667, abs=1e-6)
    assert r["v_measure"] == pytest.approx(0.8)


def test_cluster_scores_invariants(spark):
    import random
    rnd = random.Random(1)
    rows = [(rnd.randrange(5), rnd.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "u int, v int")
    same = df.select("u", F.col("u").alias("w"))
    assert ev.adjusted_rand_index(same, "u", "w").first()["ari"] == 1.0
    assert ev.v_measure(same, "u", "w").first()["v_measure"] == pytest.approx(1.0)
    perm = df.withColumn("p", (F.col("v") + 2) % 4)
    a = ev.adjusted_rand_index(df, "u", "v").first()["ari"]
    b = ev.adjusted_rand_index(perm, "u", "p").first()["ari"]
    assert a == pytest.approx(b) and a <= 1
    v = ev.v_measure(df, "u", "v").first()["v_measure"]
    assert 0 <= v <= 1


def test_class_report_toy(spark):
    df = spark.createDataFrame([(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "b", "b")],
                               "fold int, label string, prediction string")
    rep = {r["class"]: r for r in ev.class_report(df).collect()}
    assert rep["a"]["precision"] == 1.0 and rep["a"]["recall"] == 0.5
    assert rep["a"]["f1"] == pytest.approx(0.6667, abs=1e-4)
    assert rep["b"]["precision"] == pytest.approx(0.6667, abs=1e-4) and rep["b"]["recall"] == 1.0
    assert rep["b"]["f1"] == pytest.approx(0.8)
    assert ev.accuracy(df).first()["accuracy"] == 0.75


def test_pooled_t_and_p(spark):
    df = spark.createDataFrame([(i, "a", float(x)) for i, x in enumerate([1, 2, 3])] +
                               [(10 + i, "b", float(x)) for i, x in enumerate([2, 3, 4])],
                               "doc_id long, label string, f double")
    tt = stats.t_test_p_values(stats.pooled_t_test(stats.feature_stats_by_class(df, ["f"]))).first()
    assert tt["t_stat"] == pytest.approx(-1.224745, abs=1e-6)
    assert tt["df"] == 4
    assert tt["p_value"] == pytest.approx(0.287864, abs=1e-5)


def test_histogram_densities_integrate_to_one(spark, sf):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("label"),
                                  (F.col("id") * 0.37 % 11).alias("x"))
    h = stats.histogram(df, ["x"], bins=10)
    area = h.groupBy("label").agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo"))).alias("a")).collect()
    assert all(abs(r["a"] - 1.0) < 1e-9 for r in area)


def test_two_stage_rank_equals_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("part"))
    df = df.withColumn("k", splits.seeded_key("id", 7))
    ranked = splits.two_stage_rank(df, ["part"], [], "k", prefix_len=2)
    ref = df.withColumn("_ref", F.row_number().over(Window.partitionBy("part").orderBy("k")))
    j = ranked.join(ref, ["id"]).where(F.col("_rank") != F.col("_ref"))
    assert j.count() == 0


def test_balance_and_folds(spark, sf):
    from corpuslab.operators import cleaning
    from corpuslab.sources import bindings
    c = cleaning.strip_part_suffix(bindings.corpus(spark, sf, with_text=False).where("label IS NOT NULL"))
    bal = splits.balance_classes(c)
    counts = {r["label"]: r["count"] for r in bal.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1
    folds = group_folds.stratified_group_folds(cleaning.fill_surrogate_group(bal), k=5)
    assert folds.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5
    assert folds.count() == bal.count()


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    rnd = np.random.default_rng(3)
    vals = np.concatenate([rnd.normal(size=3000), np.full(2000, 0.5), rnd.integers(0, 5, 1000).astype(float)])
    rows = [("f", float(x)) for x in vals] + [("g", float(x)) for x in vals[:7]]
    df = spark.createDataFrame(rows, "feature string, value double")
    got = {(r["feature"], r["p"]): r["q"] for r in stats.exact_quantiles(df, (0.0, 0.25, 0.5, 0.75, 1.0),
                                                                             buckets=16).collect()}
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        assert got[("f", p)] == pytest.approx(np.quantile(vals, p), abs=1e-12)
        assert got[("g", p)] == pytest.approx(np.quantile(vals[:7], p), abs=1e-12)


def test_v_measure_takes_null_as_a_class(spark):
    rows = [(None, 0), (None, 0), ("a", 0), ("a", 1), ("b", 1), ("b", None)]
    got = ev.v_measure(spark.createDataFrame(rows, "u string, v int"), "u", "v").first()
    named = spark.createDataFrame([(u or "z", 9 if v is None else v) for u, v in rows], "u string, v int")
    want = ev.v_measure(named, "u", "v").first()
    assert tuple(got) == pytest.approx(tuple(want)) and 0 < got["homogeneity"] < 1


@pytest.mark.parametrize("t, dof, p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 2, 0.18350341907), (-2.0, 2, 0.18350341907),
                                       (2.570581835636314, 5, 0.05), (1.959963984540054, 1e9, 0.05), (3.0, 4, 0.03994196807),
                                       (1.0, 2, 0.42264973081), (10.0, 1, 0.06345103489), (25.0, 100, 0.0)])
def test_two_sided_p(t, dof, p):
    assert stats.t_two_sided_p(t, dof) == pytest.approx(p, abs=2e-9)


def test_nan_policy(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", None), (4, "b", 2.0), (5, "b", 4.0)], "doc_id long, label string, x double")
    s = stats.feature_stats_by_class(df, ["x"])
    assert stats.pooled_t_test(s).first()["t_stat"] is not None
    assert stats.pooled_t_test(s, nan_policy="propagate").first()["t_stat"] is None


def test_automatic_bins_cover_each_class(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i * i % 101)) for i in range(300)], "doc_id long, label string, x double")
    h = stats.histogram(df, ["x"], bins="auto")
    for r in h.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.col("density") * (F.col("hi") - F.col("lo"))).alias("area")).collect():
        assert r["n"] == 150 and r["area"] == pytest.approx(1.0)


def test_kde_reads_its_features_once(spark, sf):
    from corpuslab.plans.descriptives import distribution_frame

    for out in (stats.kde(distribution_frame(spark, sf), ["msttr"]), stats.histogram(distribution_frame(spark, sf), ["msttr"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan  # the annotator ran before, into the value table


def test_exact_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.repeat([0.5, 2.0], 700)])
    df = spark.createDataFrame([("f", float(v)) for v in x], "feature string, value double")
    got = {r["p"]: r["q"] for r in stats.exact_quantiles(df, (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    for p, q in got.items():
        assert q == pytest.approx(float(np.quantile(x, p)), abs=1e-12)
