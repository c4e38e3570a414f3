import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.lexicon import lexicon_rows, suffix_rules
from corpuslab.operators import bow, cleaning


def test_lexicon_keys_unique():
    keys = [(r[0], r[1]) for r in lexicon_rows()]
    assert len(keys) == len(set(keys))
    assert len(keys) < 200
    assert all(len(r) == 4 for r in suffix_rules())


def test_vectorizer_tokens(spark):
    df = spark.createDataFrame([(1, "Æble a være_x 1 22")], "doc_id long, text string")
    got = df.select(tx.vectorizer_terms("text").alias("t")).first()["t"]
    assert got == ["æble", "være_x", "22"]


def test_tfidf_toy(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "doc_id long, text string")
    vocab = bow.top_vocabulary(bow.term_counts(docs), 10)
    w = {(r["doc_id"], r["term"]): r["weight"] for r in bow.tfidf(docs, vocab).collect()}
    assert w[(1, "aa")] == pytest.approx(0.5797, abs=1e-4)
    assert w[(1, "bb")] == pytest.approx(0.8148, abs=1e-4)
    assert w[(2, "aa")] == pytest.approx(1.0)


def test_mfw_tie_and_wide(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb")], "doc_id long, text string")
    vocab = bow.top_vocabulary(bow.term_counts(docs), 1)
    assert [r["term"] for r in vocab.collect()] == ["aa"]  # tie 2-2 broken by term
    wide = {r["doc_id"]: r["t_aa"] for r in bow.mfw_wide(docs, bow.mfw_relative(docs, vocab), ["aa"]).collect()}
    assert wide[1] == pytest.approx(2 / 3)
    assert wide[2] == 0.0


def test_tfidf_rows_unit_norm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    w = bow.tfidf(docs, bow.top_vocabulary(bow.term_counts(docs), 500))
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert norms and all(abs(r["n"] - 1.0) < 1e-9 for r in norms)


def test_mfw_row_sum_at_most_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    m = bow.mfw_relative(docs, bow.top_vocabulary(bow.term_counts(docs), 100))
    assert m.groupBy("doc_id").agg(F.sum("rel_freq").alias("s")).where("s > 1.0000001").count() == 0


def test_group_suffix_and_recode(spark):
    df = spark.createDataFrame([("x_b",), ("x_bc",), ("x",)], "g string")
    assert [r[0] for r in df.select(tx.strip_part_suffix("g")).collect()] == ["x", "x_bc", "x"]
    codes = spark.createDataFrame([(c,) for c in "y bio n essay speech anecdote poem".split()], "code string")
    got = [r["label"] for r in cleaning.recode_labels(codes).collect()]
    assert sorted(got) == ["fiction"] * 2 + ["non-fiction"] * 3


def test_valid_vectors_and_dedupe(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, None)], "id long, e array<double>")
    assert [r["id"] for r in cleaning.valid_vectors(df, "e").collect()] == [1]
    d = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), (None, 4)], "key string, v long")
    out = {r["key"]: r["v"] for r in cleaning.dedupe(d, "key", ["v"]).collect()}
    assert out == {"k": 1, None: 3}


def test_removal_report_and_missing(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, "x"), (3, "c", "y")], "id long, text string, label string")
    rep = cleaning.removal_report(df, [("has_text", F.col("text").isNotNull()),
                                       ("labelled", F.col("label").isNotNull())]).collect()
    assert [(r["n_before"], r["n_after"]) for r in rep] == [(3, 2), (2, 1)]
    miss = {r["column"]: r["n_null"] for r in cleaning.missing_profile(df).collect()}
    assert miss == {"id": 0, "text": 1, "label": 1}


def test_term_counts_plan_is_the_same_at_any_number_of_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for d in (docs, docs.union(docs), docs.unionAll(docs).unionAll(docs)):
        plan = bow.term_counts(d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan  # partial counts, then one exchange
        assert "partial_count" in plan


def test_wide_rates_from_counts_equal_those_from_texts(spark):
    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "bb"), (3, ""), (4, None)], "doc_id long, text string")
    counts = bow.term_counts(docs)
    vocab = bow.top_vocabulary(counts, 2)
    long = bow.mfw_relative(docs, vocab)
    a = bow.mfw_wide(docs, long, ["aa", "bb"]).orderBy("doc_id").collect()
    b = bow.mfw_wide(docs, long, ["aa", "bb"], counts=counts).orderBy("doc_id").collect()
    assert [r["t_aa"] for r in a] == [r["t_aa"] for r in b] == [pytest.approx(2 / 3), 0.0, None, None]
