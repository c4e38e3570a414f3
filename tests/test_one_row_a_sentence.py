"""Sentences put together in their texts' rows, and chunks of sentences too short to pass the limit."""

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import annotate, sentiment as sn, stylistics as st
from corpuslab.plans import q_sentiment


def test_sentences_of_texts_are_those_of_the_tokens(spark):
    rows = [(1, "One. Two three!  ..."), (2, None), (3, ""), (4, "?!"), (5, "b a. c"), (5, "a. d e f"), (5, "b"), (None, "x y"), (None, "z. w"), (6, "\u00e9t\u00e9, 12\u00a0a.\n\t.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own, old = st.sentence_text_of(docs), st.sentence_text(annotate.token_texts(docs))
    assert own.exceptAll(old).count() == old.exceptAll(own).count() == 0 and own.count() > 7
    assert [f.dataType for f in own.schema] == [f.dataType for f in old.schema]


def test_chunk_queries_group_tokens_of_shared_ids_only(spark, sf):
    plan = q_sentiment._sentences(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (n#" in plan and "collect_list" in plan and "array_join(regexp_extract_all" in plan


@pytest.mark.parametrize("cost", ["subword", "chars", "words"])
def test_short_sentences_are_one_chunk_without_a_look_at_their_words(spark, cost):
    texts = [None, "", "  ", "a", "a b c", "a b c d", "aa bb cc", "a  b c ", "aaaaaaaaa", "aaaaaaaaaaaa b", "\U0001f600 \U0001f600", "a b c d e f g h i j"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    fast = sn.chunk_words("s", 9, cost)
    slow = sn.chunk_words("s", 9, sn.word_cost(cost))
    rows = d.select("i", fast.alias("fast"), slow.alias("slow")).collect()
    assert all(r["fast"] == r["slow"] for r in rows) and any(len(r["fast"] or []) > 1 for r in rows)
    assert "CASE WHEN" in d.select(fast)._jdf.queryExecution().optimizedPlan().toString()
    assert d.select(F.count_if(F.size(fast) == 1)).first()[0] >= 5
