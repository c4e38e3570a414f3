"""HTML extraction, toxicity, language ID, quality rules and BPE."""

import hashlib
import random
import time
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from corpuslab.llm import bpe, html_extract, langid, quality, toxicity
from corpuslab.llm.words import Words, windows

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><p>Site head line</p></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, click here.</p></div><!-- <p>hidden</p> -->
<article><h1>Head &amp; line</h1><p><b>First   para&nbsp;graph,<br>with a break.<p>Second &lt;one&gt; &copy is here.</p>
<div class="ad"><p>Buy this now.</p></div><ul><li>Item one of the list</li><li>Two</li></ul><p>Ok.</p>
<form><label>Mail</label><input value="x > y"><button>Send</button></form></article>
<aside>Side bar words</aside><section id="comments"><article class="comment"><p>I read this and liked it a lot.</p></article></section>
<footer>&copy; 2020 site</footer></body></html>"""


def test_html_page():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "Head & line", "First para graph, with a break.", "Second <one> © is here.", "Item one of the list", "Two", "Ok."]


def test_html_without_article():
    text = "This is a rather long paragraph with enough plain words in it to look like content, and it ends well."
    page = f"<body><div id=top><a href=1>Home</a> <a href=2>News</a></div><div><p>{text}</p><p>Short one.</p><p>{text}</p></div><div class='menu'><p>{text}</p></div>"
    assert html_extract.main_text(page) == f"{text}\n\nShort one.\n\n{text}"


@pytest.mark.parametrize("page", [None, "", "  \n", "<", "<p", "</p></div>", "<script>x", "<!-- x", "<a href='", "plain", "<p>" * 3000 + "deep"])
def test_html_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_html_layout_class_does_not_hide_the_page():
    body = "<p>" + "Words that make up the main text of this page, and more of them. " * 5 + "</p>"
    assert "main text" in html_extract.main_text(f"<div class='with-sidebar'>{body * 3}</div>")


ARTICLE = "<p>" + "This is the article, with many words in it that tell a story. " * 9 + "</p>"


@pytest.mark.parametrize("inside", ["<video src=a>", "<object data=a>", "<audio>", "<canvas>", "<template>", "<svg><path>", "<svg><g><svg>", "<math><mi>",
                                    "<svg><text>label</text></svg>", "<video>label</video>", "<object><p>label</p></object>", "<div class='entry-header'>"])
def test_text_after_elements_that_stand_in_for_others_stays(inside):
    got = html_extract.main_text(f"<html><body><article><h1>T</h1>{ARTICLE}{inside}{ARTICLE}</article></body></html>")
    assert got.count("tell a story") == 18 and "label" not in got


def test_icons_inside_a_paragraph_and_formulas():
    got = html_extract.main_text(f"<article>{ARTICLE}<p>One <svg><title>icon</title></svg> long <math><mi>x</mi></math> paragraph.</p>{ARTICLE}</article>")
    assert "One long x paragraph." in got


@pytest.mark.parametrize("page", ["<a" * 500_000, "<" * 1_000_000, "<!--" * 250_000, '<a "' * 200_000 + ">", "<div>word here." * 50_000, "<ul>" * 50_000 + "x",
                                  "<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "<li>x" * 20_000, "<span>" * 50_000 + "<table>x" * 5_000,
                                  "<svg><path>" * 30_000 + "<p>x</p>"])
def test_time_is_linear_in_the_page(page):
    begun = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - begun < 4


def test_min_cut_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        u = [rng.uniform(-2, 2) for _ in range(n)]
        pairs = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def energy(x):
            return sum(max(a, 0) if not y else max(-a, 0) for a, y in zip(u, x)) + sum(w for i, j, w in pairs if x[i] != x[j])

        best = min(energy([b >> k & 1 for k in range(n)]) for b in range(1 << n))
        assert energy(html_extract.min_cut(u, pairs)) == pytest.approx(best)


def test_html_table(spark):
    rows = [(1, "u", PAGE, "old"), (2, None, None, "old"), (3, "u", PAGE, "old")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), keep_html=False)
    assert out.columns == ["page_id", "url", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got[2] == "" and got[1] == got[3] == html_extract.main_text(PAGE)
    assert html_extract.extract(out.where("false").withColumn("html", F.lit(""))).count() == 0


def toxic_corpus(n=500, seed=5):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("bcdefgklmnoprstu") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(800)]
    bad = ["grobian", "lumpazi", "wurmloch"]
    docs = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 2
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 40 == 0:  # a phrase that is fine
            at = rng.randrange(len(words))
            words[at:at] = ["museum", "grobian"]
        docs.append((i, " ".join(words), int(toxic)))
    return docs


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (9000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (9001, None, 1)], "doc_id long, toxic int, score int")
    return rows, docs, labels, toxicity.learn(docs, labels)


def test_toxicity_separates(toxic_model):
    rows, _, _, model = toxic_model
    wrong = [i for i, t, y in rows if (model.score(t) >= 0.5) != y]
    assert len(wrong) <= 0.03 * len(rows)


def test_toxicity_folding_and_exceptions(toxic_model):
    model = toxic_model[3]
    plain = "some words here " * 5
    for form in ("grobian", "GROBIAN", "gr0b1an", "grоbіan", "ｇｒｏｂｉａｎ", "gro​bian", "grob!an", "gröbián"):
        assert model.score(f"{plain}{form} and {form} again") >= 0.5, form
    assert model.score(f"{plain}museum grobian") < 0.5
    for text in ("", None or "", "12 345", plain, "\U0001f600" * 10):
        assert model.score(text) < 0.5
    assert toxicity.fold("A1b 123 c@t !!") == " aib cat "
    long = "wort " * 50000
    assert model.score(long) < 0.5 <= model.score(long + "grobian " * 3000)


def test_toxicity_table(spark, toxic_model):
    _, docs, labels, model = toxic_model
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model)
    assert out.count() == docs.count() and out.schema["score"].dataType.simpleString() == "double"
    assert out.where("score is null").count() == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 9000").count() == 1
    empty = toxicity.learn(docs.where("false"), labels.where("false"))
    assert empty.lexicon.weights == {} and empty.score("grobian") < 0.5
    assert toxicity.score(docs.where("false"), empty).count() == 0


def lang_rows(n=240, seed=6):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["ção", "nho", "lhe", "ez"]}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(60)] for k, v in syllables.items()}
    return words, [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(4, 60))), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(n))]


def test_langid(spark):
    words, rows = lang_rows()
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 - 3", "bb"), (902, "", None), (None, "ka lo", "aa"), (903, words["bb"][0] + " ", None)],
                                 "doc_id long, text string, lang string")
    model = langid.learn(docs)
    out = {r.doc_id: r for r in langid.tag(docs.withColumn("score", F.lit(1)), model).collect()}
    assert len(out) == docs.count()
    right = sum(out[i].lang_pred == k for i, _, k in rows)
    assert right >= 0.98 * len(rows)
    assert [(out[i].lang_pred, out[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[903].lang_pred == "bb" and all(0 <= r.score <= 1 for r in out.values())
    mixed = " ".join(words["aa"][:12] + words["cc"][:12])
    spans = langid.tag(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().spans
    assert [s.lang for s in spans] == ["aa", "cc"] and abs(spans[0].words - 12) <= 1
    none = langid.learn(docs.where("false"))
    assert langid.tag(docs, none).agg(F.collect_set("lang_pred")).first()[0] == ["und"]
    assert langid.tag(docs.where("false"), model).count() == 0


def test_langid_sample_is_the_same_from_any_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "en").when(F.col("id") % 60 == 0, "fr").otherwise("de").alias("lang"))
    ids = sorted(df.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: r.h)
    want = {(r.doc_id, r.lang) for lang in ("en", "fr", "de") for r in [r for r in ids if r.lang == lang][:70]}
    for parts in (1, 7):
        got = langid._first_ids(df.repartition(parts), "doc_id", "lang", 70).collect()
        assert len(got) == 190 and {(r.doc_id, r.lang) for r in got} == want
    assert langid._first_ids(df.where("false"), "doc_id", "lang").count() == 0


def test_langid_learns_every_language(spark):
    rng = random.Random(4)
    alphabet = "bcdfghjklmnpqrstvwxz"
    rows, n = [], 70
    for k in range(n):  # a language's words have a pair of consonants of its own
        pair = alphabet[k // 20] + alphabet[k % 20]
        words = [pair + rng.choice("aeiou") + pair + rng.choice("aeiou") for _ in range(5)]
        for _ in range(12 if k else 60):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(8)), f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, usable=F.lit(True))
    assert len(model.langs) == n
    out = {r.doc_id: r.lang_pred for r in langid.tag(docs, model, spans=False).collect()}
    right = [out[i] == k for i, _, k in rows]
    assert sum(right) >= 0.98 * len(rows) and {out[i] for i, _, _ in rows} == {f"l{k:02d}" for k in range(n)}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    k, first = 3, np.array([0, 4, 4, 5, 8])
    e, moves = rng.normal(size=(8, k)), rng.normal(size=(k, k))
    got = langid.marginals(e, first, moves)
    for a, z in zip(first[:-1], first[1:]):
        want = np.zeros((z - a, k))
        for path in np.ndindex(*[k] * (z - a)):
            p = np.exp(sum(e[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += p
        if z > a:
            assert np.allclose(got[a:z], want / want.sum(axis=1, keepdims=True))


TEXTS = ["", " ", "one", "One two\tthree\n\nfour", "a b c a b c a b c", "x\nx\ny\n\nx ", "été # $ <a> | À & é", "tab\x0bsep\x0cform", " nbsp is a word too", "line\r\nline\r\n", "a " * 120]


def test_words_and_measures_against_regex():
    b = quality.Batch(pa.array(TEXTS))
    m = quality.measures(b)
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        got = [int(m[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        assert got == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)], t
        assert bool(m["base_failed"][i]) == (len(w) < 50 or 2 * len(inside) > len(w))
    words = Words(pa.array(TEXTS).slice(2))  # a slice: offsets that don't begin at 0
    assert [words.text(i).decode() for i in range(len(words))] == [w for t in TEXTS[2:] for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in TEXTS[2:]]
    assert len(windows(words.hashes(), words.first, 2)[0]) == sum(max(0, n - 1) for n in count)


def test_quality_cascade_is_order_free():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["word", "WORD!!", "x|", "12345678", "other", "term", "some"]) + str(rng.randint(0, 400)) for _ in range(80)) for _ in range(60)]
    texts += [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(90)) for _ in range(20)]
    b = quality.Batch(pa.array(texts))
    every = np.ones(len(texts), bool)
    for rule in quality.RULES:
        every &= ~rule.reject(b)
    for _ in range(4):
        order = rng.sample(quality.RULES, len(quality.RULES))
        assert quality.passes(b, np.arange(len(texts)), tuple(order)).tolist() == np.flatnonzero(every).tolist()


def test_quality_table(spark):
    good = "The quick brown fox sees that a lazy dog is near the old mill and then runs off to the hills " * 2
    good = " ".join(f"{w}{i}" if i % 3 == 0 else w for i, w in enumerate(good.split())) + " " + " ".join(f"term{i}" for i in range(40))
    rows = [(1, good, 1), (2, "short text", 1), (3, None, 1), (None, good, 1), (4, " ".join(w + "$$$" for w in good.split()), 1), (1, good, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = quality.judge(docs)
    assert Counter((r.doc_id, r.kept) for r in out.collect()) == Counter({(1, True): 2, (2, False): 1, (3, False): 1, (None, True): 1, (4, False): 1})
    assert quality.judge(docs.where("false")).count() == 0


BPE_TEXTS = ["", " ", "Hello world's  end", "naïve été 東京 \U0001f600", "<|endoftext|> is text", "a" * 3000, " " * 500 + "x", "tab\t\tnew\n\n line", "12 345,6", "don't'll've", "   x"]


@pytest.mark.parametrize("most", [1, 7, 100])
def test_bpe_pieces_equal_whole(most):
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        enc = bpe.encoder(f.read())
    rng = random.Random(4)
    texts = BPE_TEXTS + ["".join(rng.choice(["a", "é", " ", "  ", "1", "'s", "'", "!", "\n", "Zz", "　", "東"]) for _ in range(400)) for _ in range(60)]
    for t in texts:
        assert "".join(bpe.pieces(t, most)) == t
        assert bpe.encode_text(enc, t, most).tolist() == enc.encode_ordinary(t)
        by_match = [i for m in regex.finditer(bpe.public_tokenizers.PATTERN, t) for i in enc._encode_single_piece(m[0])]
        assert by_match == enc.encode_ordinary(t)


def test_bpe_round_trip(spark):
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        enc = bpe.encoder(f.read())
    rows = [(i, t, "x") for i, t in enumerate(BPE_TEXTS)] + [(100, None, "x"), (None, "null id", "x"), (101, "long words here " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert bytes(r.decoded) == (r.text or "").encode() and r.ids == enc.encode_ordinary(r.text or "")
    for r in bpe.digests(docs).collect():
        t = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digests(docs.where("false")).count() == 0
