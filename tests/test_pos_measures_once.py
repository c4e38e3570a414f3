"""Measures by part of speech from one reading of the tokens."""

from conftest import tokens_df
from corpuslab.operators import stylistics as st
from corpuslab.plans import q_stylistics


def test_pos_measures_read_the_tokens_once(spark, sf):
    plan = st.pos_measures(q_stylistics.tokens(spark, sf))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Generate posexplode") == 1
    rows = [(1, 0, 0, "a", "NOUN", None, False, "dep", 0, "x"), (1, 0, 1, "b", "NOUN", None, False, "dep", 0, "x"),
            (1, 0, 2, "c", "VERB", None, False, "dep", 0, "x"), (2, 0, 0, "d", "ADJ", None, False, "dep", 0, "x"),
            (3, 0, 0, "e", "VERB", None, False, "dep", 0, "y"), (None, 0, 0, "f", "NOUN", None, False, "dep", 0, "z")]
    got = {r["doc_id"]: (r["noun_ttr"], r["verb_ttr"], r["avg_wordlen"]) for r in st.pos_measures(tokens_df(spark, rows)).collect()}
    assert got[1] == (0.5, 1.0, 1.0) and got[2] == (None, None, 1.0) and got[3] == (None, 1.0, 1.0)
