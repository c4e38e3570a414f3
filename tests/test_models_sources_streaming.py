import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import models
from corpuslab.plans import classification, clustering
from corpuslab.sources import io
from corpuslab.streaming import incremental


def test_cross_validation_and_importances(spark, sf):
    data, featurizer, names, classes = classification.classification_input(spark, sf, "embeddings")
    preds, fitted = models.cross_validate(data, featurizer, classes, num_trees=10, max_depth=5)
    assert preds.count() == data.count()
    assert {r[0] for r in preds.select("prediction").distinct().collect()} <= set(classes)
    for _fold, m in fitted:
        assert sum(m.featureImportances.toArray()) == pytest.approx(1.0)


def test_kmeans_assigns_every_row(spark, sf):
    assign, scores = clustering.run_clustering(spark, sf)
    e = clustering.embedding_input(spark, sf)
    assert assign.count() == e.count()
    for r in scores.collect():
        assert r["n_clusters"] <= r["n_groups"] and -1 <= r["ari"] <= 1 and 0 <= r["v_measure"] <= 1


def test_tsv_round_trip(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0])], "doc_id long, lang string, s array<double>")
    path = os.path.join(tempfile.mkdtemp(), "t")
    io.write_tsv(df, path)
    back = io.read_features_tsv(spark, path, "doc_id long, lang string, s string").first()
    assert back["doc_id"] == 1 and back["s"] == "[1.0,2.0]"


def test_streaming_featurizer_matches_batch(spark, sf):
    sink = os.path.join(tempfile.mkdtemp(), "sink")
    ckpt = os.path.join(tempfile.mkdtemp(), "ckpt")
    q = incremental.start_featurizer(spark, sf, sink, glob="documents.parquet", checkpoint=ckpt,
                                     with_compression=False)
    q.awaitTermination(600)
    got = spark.read.parquet(sink)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    batch = incremental.featurize_batch(docs, with_compression=False)
    assert got.count() == batch.count()
    a = {r["doc_id"]: r["msttr"] for r in got.select("doc_id", "msttr").collect()}
    b = {r["doc_id"]: r["msttr"] for r in batch.select("doc_id", "msttr").collect()}
    assert a == b


def test_run_results_idempotent(spark):
    path = os.path.join(tempfile.mkdtemp(), "runs")
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    io.append_run_results(df, path, "r1")
    io.append_run_results(df, path, "r1")  # a retried run replaces its block
    io.append_run_results(df, path, "r2")
    got = sorted((r["run_id"], r["k"]) for r in spark.read.parquet(path).collect())
    assert got == [("r1", "a"), ("r2", "a")]


def test_bow_featurizer_fits_on_train_only(spark):
    from corpuslab.operators import bow

    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "cc cc cc")], "doc_id long, text string")
    dt = bow.doc_terms(docs)
    f = models.BowFeaturizer("mfw", 2).fit(dt.where("doc_id = 1"))
    out = {r["doc_id"]: r["features"].toArray().tolist() for r in f(dt).collect()}
    assert out[1] == pytest.approx([2 / 3, 1 / 3])
    assert out[2] == [0.0, 0.0]  # 'cc' exists only outside the training rows


def test_tsv_round_trip_of_odd_fields(spark):
    odd = ["line\nfeed", "tab\there", 'quote " here', "back\\slash \\n \\N", "", None, " padded ", "cr\r\n", "\\e", "#x", "'"]
    df = spark.createDataFrame([(i, x, i if i % 2 else None) for i, x in enumerate(odd)], "doc_id long, s string, n long")
    path = os.path.join(tempfile.mkdtemp(), "t")
    io.write_tsv(df, path)
    back = io.read_features_tsv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from corpuslab import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
    assert session.is_single_process("local[4]") and not session.is_single_process("local-cluster[2,1,1024]")


def test_training_input_keeps_its_partitions(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"),
                                   (F.col("id") % 3).alias("t"), F.lit("m").alias("model")).repartition(6)
    out = models.kmeans_by_truth(rows, "t")
    assert out.rdd.getNumPartitions() == 6
    assert out.where("not nearest").count() == 0 and out.count() == 400


def test_kmeans_with_one_group(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], "a", "m"), (2, [2.0, 1.0], "a", "m")], "doc_id long, embedding array<float>, t string, model string")
    assert [r["cluster"] for r in models.kmeans_by_truth(rows, "t").collect()] == [0, 0]


def test_imputation_by_exact_median_and_empty_column(spark):
    rows = [(1, 1.0, None), (2, 4.0, None), (3, None, None), (4, float("nan"), None), (5, 10.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, x double, y double")
    f = models.ColumnsFeaturizer(["x", "y"]).fit(df)
    out = {r["doc_id"]: r["features"].toArray().tolist() for r in f(df).collect()}
    assert out == {1: [1.0, 0.0], 2: [4.0, 0.0], 3: [4.0, 0.0], 4: [4.0, 0.0], 5: [10.0, 0.0]}


def test_holes_that_only_a_test_fold_has(spark):
    rows = [(i, "a" if i % 2 else "b", i % 5, float(i % 2), None if i % 5 == 4 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label string, fold long, x double, y double")
    preds, fitted = models.cross_validate(df, models.ColumnsFeaturizer(["x", "y"]), ["a", "b"], num_trees=5, max_depth=4)
    got = {r["doc_id"]: r["prediction"] for r in preds.collect()}
    assert len(fitted) == 5 and got == {i: lab for i, lab, *_ in rows}  # x gives the class away


def test_repeated_ids_count_once_in_classification(spark):
    rows = [(i, "a" if i % 2 else "b", f"s{i % 5}") for i in range(40)] + [(1, "a", "s1")] * 30
    c = spark.createDataFrame(rows, "doc_id long, label string, group_id string")
    out = classification.labelled_folds(c).collect()
    assert len(out) == len({r["doc_id"] for r in out}) == 40


def test_stream_checkpoints_differ_by_source_and_sink():
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs:///shared"}

    a, b, c = (incremental.stream_checkpoint(Session(), *x) for x in (("s", "t"), ("s", "u"), ("s", "t")))
    assert a == c != b and a.startswith("hdfs:///shared/")
    Session.conf = {}
    with pytest.raises(ValueError):
        incremental.stream_checkpoint(Session(), "s", "t")


def test_stage_tables_can_be_dropped(spark):
    from corpuslab import session

    t = session.materialize(spark.range(5), "stage")
    path = session._STAGE_TABLES[-1].replace("file:", "")
    assert t.count() == 5 and os.path.isdir(path)
    assert session.drop_stage_tables(spark) >= 1
    assert not os.path.exists(path) and session._STAGE_TABLES == []
