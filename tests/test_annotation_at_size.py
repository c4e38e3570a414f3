"""The annotator in bounded steps with the same rows."""

from corpuslab.operators import annotate


def test_a_hook_gets_few_characters_at_a_time(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(annotate, "HOOK_CHARS", 10)
    names = [f.name for f in annotate.TOKEN_SCHEMA.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["text"].str.len().fillna(0).sum())
        rows = pdf.assign(sent_id=0, token_i=size, token_text=pdf["text"], lemma="", is_punct=False, is_stop=False, morph=None,
                          pos="X", tag="X", dep="dep", head=None, head_i=len(pdf))
        return rows[names]

    docs = spark.createDataFrame([(k, "en", None if k == 3 else "x" * (25 if k == 5 else 4)) for k in range(20)],
                                 "doc_id long, lang string, text string").coalesce(1)
    got = annotate.annotate(docs, fn=run, partition_by_doc=False).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20))  # each document once
    assert all(r["token_i"] <= 10 or r["head_i"] == 1 for r in got)  # no more characters, or one document


def test_tasks_follow_the_input(spark, sf):
    from corpuslab.session import tasks_for

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    assert tasks_for(docs) == spark.sparkContext.defaultParallelism
    assert tasks_for(docs, 10_000) > 10
    assert tasks_for(spark.sparkContext.parallelize([(1,)]).toDF(["a"])) is None  # its size isn't known
