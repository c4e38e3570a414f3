import pytest
from pyspark.sql import functions as F

from corpuslab.operators import annotate, stylistics as st

from conftest import tokens_df


def test_token_table_shape(spark):
    docs = spark.createDataFrame([(1, "en", "The dog ran. It was 12 good!")], "doc_id long, lang string, text string")
    t = annotate.token_table(docs).orderBy("token_i").collect()
    assert [r["token_text"] for r in t] == ["The", "dog", "ran", ".", "It", "was", "12", "good", "!"]
    assert [r["sent_id"] for r in t] == [0, 0, 0, 0, 1, 1, 1, 1, 1]
    assert t[3]["pos"] == "PUNCT" and t[6]["pos"] == "NUM" and t[0]["pos"] == "DET"
    # exactly one ROOT per sentence, heads point at it
    for sid in (0, 1):
        rows = [r for r in t if r["sent_id"] == sid]
        roots = [r for r in rows if r["dep"] == "ROOT"]
        assert len(roots) == 1 and all(r["head_i"] == roots[0]["token_i"] for r in rows)


def test_msttr(spark):
    words = [f"w{i}" for i in range(100)] + ["w0"]
    rows = [(1, 0, i, w, "NOUN", None, False, "dep", 0, None) for i, w in enumerate(words)]
    rows += [(2, 0, i, w, "NOUN", None, False, "dep", 0, None) for i, w in enumerate("a a b c".split())]
    got = {r["doc_id"]: r["msttr"] for r in st.msttr(tokens_df(spark, rows)).collect()}
    assert got[1] == pytest.approx(1.0)
    assert got[2] == pytest.approx(0.75)


def test_dependency_distances(spark):
    base = [(1, 0, 0, "a", "NOUN", None, False, "dep", 1, None),
            (1, 0, 1, "b", "VERB", None, False, "ROOT", 1, None),
            (1, 0, 2, "c", "NOUN", None, False, "dep", 1, None)]
    r = st.sentence_measures(tokens_df(spark, base)).first()
    assert r["avg_mdd"] == pytest.approx(0.666667, abs=1e-6)
    assert r["avg_ndd"] == pytest.approx(1.301345, abs=1e-6)
    assert r["std_mdd"] == 0 and r["std_ndd"] == 0
    punct = base + [(1, 0, 3, ".", "PUNCT", None, True, "punct", 1, None)]
    r2 = st.sentence_measures(tokens_df(spark, punct)).first()
    assert r2["avg_mdd"] == pytest.approx(r["avg_mdd"]) and r2["avg_ndd"] == pytest.approx(r["avg_ndd"])


def test_voice_and_tense(spark):
    rows = [(1, 0, i, f"v{i}", "VERB", m, False, "dep", 0, None)
            for i, m in enumerate(["Voice=Act", "Voice=Act", "Voice=Act", "Voice=Pass"])]
    r = st.pos_measures(tokens_df(spark, rows)).first()
    assert r["active_ratio"] == 0.75 and r["passive_ratio"] == 0.25
    assert r["past_tense_ratio"] is None  # no past verbs -> null
    s = st.pos_measures(tokens_df(spark, rows), legacy_swap=True).first()
    assert s["active_ratio"] == 0.25 and s["passive_ratio"] == 0.75


def test_sentence_pick(spark):
    def sents(n):
        return spark.createDataFrame([(1, i, f"s{i + 1}") for i in range(n)], "doc_id long, sent_id int, sentence string")
    long = st.compression_selection(sents(51)).first()["selected_text"].split()
    short = st.compression_selection(sents(50)).first()["selected_text"].split()
    assert long == [f"s{i}" for i in range(11, 51)]
    assert short == [f"s{i}" for i in range(1, 41)]


def test_fused_table_matches_separate_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    tok = annotate.token_table(docs)
    fused = st.stylistics_table(tok, sentiment=False).select("doc_id", "msttr", "noun_ttr", "avg_mdd",
                                                              "compression_ratio")
    sep = (st.msttr(tok).join(st.pos_measures(tok).select("doc_id", "noun_ttr"), "doc_id")
           .join(st.sentence_measures(tok).select("doc_id", "avg_mdd"), "doc_id")
           .join(st.compression_ratio(st.sentence_text(tok)), "doc_id"))
    a = {r["doc_id"]: r for r in fused.collect()}
    b = {r["doc_id"]: r for r in sep.collect()}
    assert a.keys() == b.keys() and len(a) > 100
    for k in a:
        for c in ("msttr", "noun_ttr", "avg_mdd", "compression_ratio"):
            x, y = a[k][c], b[k][c]
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12), (k, c)


def test_stylistics_plan_has_single_exchange(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    plan = st.stylistics_table(annotate.token_table(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan  # only the doc_id repartition before annotation


def test_stylistics_of_texts_has_no_exchange_and_equals_the_token_path(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    direct = st.stylistics_of(docs, with_compression=False)
    assert "Exchange" not in direct._jdf.queryExecution().executedPlan().toString()
    cols = [c for c in direct.columns if c != "sentiment"]
    a = {r["doc_id"]: r for r in direct.select(cols).collect()}
    b = {r["doc_id"]: r for r in st.stylistics_table(annotate.token_table(docs), with_compression=False).select(cols).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert [x is None for x in a[k]] == [x is None for x in b[k]]
        assert [x for x in a[k] if x is not None] == pytest.approx([x for x in b[k] if x is not None], rel=1e-9, abs=1e-12)


def test_filters_on_measures_do_not_repeat_the_annotator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    plain = st.stylistics_of(docs, with_compression=False)
    some = plain.where("avg_sentlen < 100 AND noun_ttr < 6 AND msttr > 0")
    size = [d._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(text") for d in (plain, some)]
    assert size[0] == size[1] == 1


def test_annotate_hook_keeps_the_id_type(spark):
    from corpuslab.plans.q_annotation import whitespace_annotator

    for kind, ids in (("long", (1, 2)), ("string", ("x/1", "x/2"))):
        docs = spark.createDataFrame([(ids[0], "en", "a b  c"), (ids[1], "en", None)], f"doc_id {kind}, lang string, text string")
        for how in ({"factory": whitespace_annotator}, {"fn": whitespace_annotator()}):
            t = annotate.annotate(docs, **how)
            assert t.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
            assert [(r["doc_id"], r["token_text"]) for r in t.collect()] == [(ids[0], w) for w in "abc"]


def test_scorer_hook_keeps_the_id_type(spark):
    import pandas as pd

    from corpuslab.operators import sentiment

    def predict(chunks):
        return pd.DataFrame({"label": ["POS" if "good" in c else "NEG" for c in chunks], "score": [0.5] * len(chunks)})

    chunks = spark.createDataFrame([("x", 0, 0, "good"), ("x", 1, 0, "bad")], "doc_id string, sent_id int, chunk_id int, chunk string")
    scored = sentiment.score_chunks(chunks, predict)
    assert [tuple(r) for r in sentiment.signed_scores(scored).orderBy("sent_id").collect()] == [
        ("x", 0, 0, "positive", 0.5), ("x", 1, 0, "negative", -0.5)]


def test_no_token_and_no_document_is_lost(spark):
    rows = [(1, "en", "...Hello there."), (2, "en", "!!!"), (3, "en", ""), (4, "en", None), (5, "en", "One. Two")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    tok = annotate.token_table(docs)
    got = {}
    for r in tok.orderBy("doc_id", "token_i").collect():
        got.setdefault(r["doc_id"], []).append((r["sent_id"], r["token_text"]))
    assert got == {1: [(0, t) for t in [".", ".", ".", "Hello", "there", "."]], 2: [(0, "!")] * 3,
                   5: [(0, "One"), (0, "."), (1, "Two")]}
    corpus = docs.select("doc_id", F.lit("g").alias("group_id"), F.lit("a").alias("label"))
    table = {r["doc_id"]: r for r in st.stylistics_table(tok, corpus=corpus).collect()}
    assert sorted(table) == [1, 2, 3, 4, 5]
    assert table[3]["num_sents"] is None and table[3]["label"] == "a" and table[2]["num_sents"] == 1


def test_msttr_is_linear_in_words(spark):
    import time

    words = " ".join(f"w{i % 997}" for i in range(80_000))
    docs = spark.createDataFrame([(1, "en", words)], "doc_id long, lang string, text string")
    tok = annotate.token_table(docs)
    began = time.time()
    got = st.stylistics_table(tok, sentiment=False, with_compression=False).first()["msttr"]
    assert got == pytest.approx(1.0) and time.time() - began < 60


def test_determinism_across_partitionings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    a = st.stylistics_table(annotate.token_table(docs, num_partitions=3), with_compression=False)
    b = st.stylistics_table(annotate.token_table(docs, num_partitions=7), with_compression=False)
    cols = [c for c in a.columns if c != "sentiment"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())
