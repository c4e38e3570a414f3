"""Tokens without tags, and chunks of short sentences."""

from corpuslab.operators import annotate, sentiment as sn
from corpuslab.plans import q_stylistics


def test_token_texts_are_the_token_table_without_tags(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(-1, "en", None), (-2, None, ""), (-3, "de", "..."), (-4, "xx", "  a\u00e9. B!? 12 ?"), (-4, "xx", "again")],
                                "doc_id long, lang string, text string")
    docs = docs.unionByName(odd)
    own = annotate.token_texts(docs)
    whole = annotate.token_table(docs).select(own.columns)
    assert own.exceptAll(whole).count() == whole.exceptAll(own).count() == 0 and own.where("doc_id < 0").count() > 5
    plan = q_stylistics.q_sentence_text(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PronType" not in plan  # no tagger where no tag is read


def test_sentences_within_the_limit_are_one_chunk(spark):
    rows = [(1, 0, "a  b"), (1, 1, ""), (1, 2, None), (1, 3, " "), (1, 4, "aaaa bbbb cccc"), (1, 5, "a" * 40)]
    s = spark.createDataFrame(rows, "doc_id long, sent_id int, sentence string")
    got = {}
    for r in sn.chunk_table(s, 6).orderBy("sent_id", "chunk_id").collect():
        got.setdefault(r["sent_id"], []).append(r["chunk"])
    assert got == {0: ["a  b"], 4: ["aaaa bbbb", "cccc"], 5: ["a" * 40]}
