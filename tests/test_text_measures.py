"""Measures of texts on Arrow batches are those of the tagged arrays."""

import pytest

from corpuslab.functions import batches
from corpuslab.operators import stylistics as st, text_measures as tm

TEXTS = [(1, "en", "  .a. b"), (2, "en", ". . a. b"), (3, "de", "..."), (4, None, "..  "), (5, "xx", "a.b!?c ?! d .e"), (6, "en", None), (7, "en", ""),
         (8, "en", "  "), (9, "en", "The İx ΣΑΣ ½ 1a _ __ ٣ Good sad gİgood"), (9, "en", "Twice here. Ok"),
         (10, "de", "Das Haus.\nIst . . . gut\t!\r\n?x Traurig"), (11, "fr", "\U0001f600 . \U0001d400b ća. "), (12, "en", "a.\x0bb.\x0cc.\x1cd.\x85e. f"),
         (13, "es", "!.a"), (14, "es", " !.a"), (15, "en", ". "), (None, "en", "No id here. He walked."), (16, "en", "12 34. 56"),
         (17, "en", "good " * 400 + ". " + "Sad word" * 300 + " bad."), (18, "en", " ".join(f"w{i % 150}" for i in range(777))), (19, "fr", "De la de que. " * 60)]


def plain(r):
    return [tuple(r[c]) if isinstance(r[c], list) else r[c] for c in sorted(r.asDict())]


@pytest.mark.parametrize("options", [{}, {"max_len": 9, "cost": "chars", "legacy_swap": True, "long_doc": 3, "skip": 2, "take": 4}, {"max_len": 3, "cost": "words"}])
def test_the_same_numbers_as_the_tagged_arrays(spark, monkeypatch, options):
    docs = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string").coalesce(1)
    want = st.document_measures(st.documents_from_texts(docs), **options)
    got = st.text_measures(docs, **options)
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in want.schema}
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["num_sents"] or 0)
    a, b = (sorted(t.collect(), key=key) for t in (got, want))
    assert len(a) == len(b) == len(TEXTS) and any(len(r["sentiment"] or ()) > 2 for r in a)
    for x, y in zip(a, b):
        for v, w in zip(plain(x), plain(y)):
            assert v == w if v is None or w is None or isinstance(v, (int, str)) else v == pytest.approx(w, rel=1e-12, abs=1e-12), (x, y)


def test_no_lambda_looks_at_a_token(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")
    plan = st.stylistics_of(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_extract_all(text" in plan


def test_documents_in_small_steps():
    import numpy as np
    import pyarrow as pa

    words = pa.array([["a", ". ", "b"], [], None, ["c"] * 50, ["d"]])
    at = batches.offsets(words)
    assert list(batches.steps(at, 4)) == [(0, 3), (3, 4), (4, 5)] and list(batches.steps(at, 100)) == [(0, 5)]
    t = batches.tagged(pa.array(["en"] * 5), words, pa.array([False, None, None, False, True]))
    assert t.sentences.tolist() == [2, 0, 0, 1, 1] and t.starts.tolist() == [0, 2, 3, 53] and np.diff(t.docs).tolist() == [3, 0, 0, 50, 1]
    assert tm._polar(["good", "bad", "x", "gooḋbad"])[0].tolist() == [1, 0, 0, 1]
