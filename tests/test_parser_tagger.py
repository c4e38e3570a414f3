"""Trees and tags against enumeration; the tagger on words that the lexicon lacks."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import tokens_df
from corpuslab.operators import annotate, hmm, parser, stylistics
from corpuslab.sources import bindings


def is_tree(heads):
    roots = [k for k, h in enumerate(heads) if h == k]
    if len(roots) != 1:
        return False
    for k in range(len(heads)):
        seen = set()
        while heads[k] != k:
            if k in seen:
                return False
            seen.add(k)
            k = heads[k]
    return True


def is_projective(heads):
    arcs = [(min(k, h), max(k, h)) for k, h in enumerate(heads) if k != h]
    root = next(k for k, h in enumerate(heads) if h == k)
    return not any(a < c < b < d for a, b in arcs for c, d in arcs) and not any(a < root < b for a, b in arcs)


def value(heads, score, root):
    return sum(root[k] if h == k else score[h, k] for k, h in enumerate(heads))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_best_tree_equals_enumeration(n):
    trees = [h for h in itertools.product(range(n), repeat=n) if is_tree(h) and is_projective(h)]
    rng = np.random.default_rng(n)
    for _ in range(8):
        score, root = rng.normal(size=(n, n)), rng.normal(size=n)
        got = parser.best_tree(score, root)
        assert is_tree(got) and is_projective(got)
        assert value(got, score, root) == pytest.approx(max(value(h, score, root) for h in trees))


def test_best_tree_of_seven_tokens():
    trees = [h for h in itertools.product(range(7), repeat=7) if sum(h[k] == k for k in range(7)) == 1 and is_tree(h) and is_projective(h)]
    score, root = np.random.default_rng(9).normal(size=(7, 7)), np.zeros(7)
    assert value(parser.best_tree(score, root), score, root) == pytest.approx(max(value(h, score, root) for h in trees))


def gold_tokens(spark):
    """Sentences DET NOUN VERB DET NOUN, where determiners hang on their noun and nouns on the verb."""
    rows, rng = [], random.Random(1)
    for d in range(30):
        i = 0
        for s in range(3):
            words = [("the", "DET", 1), (f"cat{rng.randint(0, 9)}", "NOUN", 2), ("sees", "VERB", 2), ("a", "DET", 4), (f"dog{rng.randint(0, 9)}", "NOUN", 2)]
            rows += [(d, s, i + k, w, p, None, False, "ROOT" if k == h else "dep", i + h, None) for k, (w, p, h) in enumerate(words)]
            i += 5
    return tokens_df(spark, rows)


def test_learned_arcs_give_the_trees_back(spark):
    gold = gold_tokens(spark)
    scores = parser.learn(gold)
    bare = gold.withColumns({"head_i": F.lit(None).cast("int"), "dep": F.lit(None).cast("string"), "head": F.lit(None).cast("string")})
    got = parser.attach_heads(bare, scores)
    assert got.columns == gold.columns
    key = lambda r: (r["doc_id"], r["token_i"])
    assert [(r["head_i"], r["dep"]) for r in sorted(got.collect(), key=key)] == [(r["head_i"], r["dep"]) for r in sorted(gold.collect(), key=key)]
    same = ["avg_mdd", "std_mdd", "avg_ndd", "std_ndd"]
    a, b = ({r["doc_id"]: [r[c] for c in same] for r in stylistics.sentence_measures(t).collect()} for t in (got, gold))
    assert a.keys() == b.keys() and all(a[d] == pytest.approx(b[d]) for d in a)
    assert parser.attach_heads(bare.where("false"), scores).count() == 0
    counts = {(r["dep"], r["head"], r["right"], r["far"]): r["n"] for r in parser.arc_counts(gold).collect()}
    assert counts == {("DET", "NOUN", True, 0): 180, ("NOUN", "VERB", True, 0): 90, ("NOUN", "VERB", False, 1): 90, ("VERB", "ROOT", False, 0): 90}


def test_long_sentences_are_trees_of_pieces():
    scores = parser.ArcScores({("NOUN", "VERB", True, 0): 3, ("VERB", "ROOT", False, 0): 2, ("X", "VERB", False, 2): 1})
    tags = random.Random(2).choices(["NOUN", "VERB", "X", "new"], k=50)
    heads = parser.parse(tags, scores, long=12)
    assert is_tree(heads)
    for a in range(0, 50, 12):
        own = parser.best_tree(*scores.of(tags[a:a + 12]))
        inside = [(k, h) for k, h in enumerate(own) if k != h]
        assert all(heads[a + k] == a + h for k, h in inside)


def test_best_path_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, tags = rng.integers(1, 6), 3
        scores, moves = rng.normal(size=(n, tags)), rng.normal(size=(tags + 1, tags))
        total = lambda p: moves[tags, p[0]] + sum(moves[a, b] for a, b in zip(p, p[1:])) + sum(scores[k, x] for k, x in enumerate(p))
        assert total(hmm.best_path(scores, moves)) == pytest.approx(max(map(total, itertools.product(range(tags), repeat=int(n)))))


def test_word_scores_by_hand(spark):
    tokens = tokens_df(spark, [(1, 0, k, w, p, None, False, "dep", 0, None) for k, (w, p) in enumerate([("walking", "VERB"), ("king", "NOUN"), ("king", "NOUN"), ("up", "ADV")])])
    tagger = hmm.learn(tokens)
    assert tagger.tags == ["ADV", "NOUN", "VERB"]
    types = [("walking", "VERB"), ("king", "NOUN"), ("up", "ADV")]
    for word in ("king", "talking", "xx", ""):
        p = np.full(3, 1 / 3)
        for k in range(min(5, len(word)) + 1):
            c = Counter(t for w, t in types if w.endswith(word[len(word) - k:]) and len(w) >= k)
            p = np.array([c[t] + hmm.BACK * x for t, x in zip(tagger.tags, p)]) / (sum(c.values()) + hmm.BACK)
        if word == "king":
            p = np.array([0 + hmm.BACK * p[0], 2 + hmm.BACK * p[1], hmm.BACK * p[2]]) / (2 + hmm.BACK)
        got = hmm.word_scores(spark.createDataFrame([(word, 1)], "word string, _x_n long"), tagger).first()["s"]
        assert got == pytest.approx(list(np.log(p) - tagger.prior))


def grammar(seed, new):
    """Documents DET (ADJ) NOUN VERB ADP DET NOUN with made-up words; with ``new`` a third of the words are ones of their own."""
    rng = random.Random(seed)
    words = {t: [f"{t[0].lower()}{x}{e}" for x in "aeiou" for e in ("l", "rk", "nd")] for t in ("DET", "NOUN", "VERB", "ADP", "ADJ")}
    rows = []
    for d in range(40):
        i = 0
        for s in range(4):
            tags = ["DET", *(["ADJ"] if rng.random() < 0.4 else []), "NOUN", "VERB", "ADP", "DET", "NOUN"]
            for t in tags:
                w = f"new{rng.randint(0, 30)}{rng.choice(['x', 'q'])}" if new and rng.random() < 0.33 else rng.choice(words[t])
                rows.append((1000 * seed + d, s, i, w, t, None, False, "dep", 0, None))
                i += 1
    return rows


def test_words_that_no_lexicon_has_are_tagged_better_than_by_the_suffix_rules(spark):
    tagger = hmm.learn(tokens_df(spark, grammar(1, False)))
    test = tokens_df(spark, grammar(2, True)).cache()
    found = hmm.tag(test, tagger).cache()
    asked = test.where("token_text LIKE 'new%'").select("doc_id", "token_i")
    texts = test.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("token_i", "token_text"))).alias("t"))
    ruled = annotate.token_table(texts.select("doc_id", F.lit("en").alias("lang"), F.array_join(F.transform("t", lambda x: x["token_text"]), " ").alias("text")))
    of = lambda t: hmm.accuracy(t.select("doc_id", "token_i", "pos").join(asked, ["doc_id", "token_i"], "left_semi"), test)
    assert asked.count() > 200 and ruled.count() == found.count() == test.count()
    assert of(found) > of(ruled) + 0.3
    assert hmm.accuracy(found, test) > 0.9
    assert hmm.tag(test.where("false"), hmm.learn(test.where("false"))).count() == 0


def test_tagging_the_baseline_back(spark, sf):
    gold = annotate.token_table(bindings.table(spark, sf, "documents").select("doc_id", "lang", "text")).cache()
    found = hmm.tag(gold.where("doc_id % 3 = 0"), hmm.learn(gold.where("doc_id % 3 <> 0")))
    assert hmm.accuracy(found, gold) > 0.8


def test_tokens_of_frequent_words_move_as_numbers_and_rare_ones_with_scores(spark, monkeypatch):
    gold = tokens_df(spark, grammar(1, True))
    gold = gold.where("doc_id < 1012").unionByName(gold.where("doc_id = 1003"))  # repeated places
    gold = gold.withColumn("token_i", F.expr("if(doc_id = 1005 and token_i = 4, null, token_i)")).cache()
    tagger = hmm.learn(gold)
    words = gold.select(F.lower("token_text").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_x_n"))
    s = {r["word"]: r["s"] for r in hmm.word_scores(words, tagger).collect()}
    by_sentence = {}
    for r in gold.collect():
        place = -(1 << 40) if r["token_i"] is None else r["token_i"]
        by_sentence.setdefault((r["doc_id"], r["sent_id"]), []).append((place, s[r["token_text"].lower()]))
    want = Counter()
    for key, rows in by_sentence.items():
        rows.sort()
        for (i, _), k in zip(rows, hmm.best_path(np.array([x for _, x in rows]), tagger.moves)):
            want[*key, None if i < -(1 << 32) else i, tagger.tags[k]] += 1
    for most in (3, 1 << 17):
        monkeypatch.setattr(hmm, "FREQUENT", most)
        assert Counter(map(tuple, hmm.tag(gold, tagger).collect())) == want
