"""Katz scores, source mixing and sharding against brute force; the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import katz, mixing, sharding


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def zipf_rows(n=150, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weight = [1 / (k + 1) for k in range(400)]
    rows = [(i, " ".join(rng.choices(words, weight, k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "Unseen WORDS only"), (None, "w1 w2 w3"), (7, rows[7][1]), (1003, "w0 " * 30000)]


class Model:
    """Katz bigrams by dictionaries; the vocabulary is that of the operator."""

    def __init__(self, rows, vocabulary):
        train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        d = self.discounts(self.c.values())
        self.p1 = {w: d.get(c, 1) * c / self.n for w, c in self.c.items()}
        self.unknown = 1 - sum(self.p1.values())
        limit, have = None, 0
        for x, k in sorted(Counter(self.c.values()).items(), reverse=True):
            if have + k > vocabulary:
                break
            limit, have = x, have + k
        self.vocabulary = {w for w, c in self.c.items() if limit is not None and c >= limit}
        self.b = Counter((h, w) for t in train for h, w in zip(["<s>", *t], t) if (h == "<s>" or h in self.vocabulary) and w in self.vocabulary)
        self.d2 = self.discounts(self.b.values())
        kept, p1 = defaultdict(float), defaultdict(float)
        for (h, w), c in self.b.items():
            kept[h] += self.d2.get(c, 1) * c
            p1[h] += self.p1[w]
        self.total = {h: (o := len(train) if h == "<s>" else self.c[h]) + (o - kept[h] < 1e-6) for h in kept}
        self.a = {h: (self.total[h] - kept[h]) / self.total[h] / (1 - p1[h]) for h in kept}

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        rest = 6 * n[6] / n[1] if n[1] else 1
        good = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0 for r in range(1, 6)}
        return {r: g if 0 < g < 1 else (r - 0.5) / r for r, g in good.items()}

    def p(self, h, w):
        c = self.b.get((h, w), 0)
        return self.d2.get(c, 1) * c / self.total[h] if c else self.a.get(h, 1) * self.p1.get(w, self.unknown)


@pytest.mark.parametrize("vocabulary", [1 << 19, 40])
def test_katz_against_dictionaries(spark, vocabulary):
    rows = zipf_rows()
    model = Model(rows, vocabulary)
    for h in ["<s>", *list(model.a)[:5]]:  # each history sums to 1 over all types and the unknown one
        assert sum(model.p(h, w) for w in [*model.c, "never seen"]) == pytest.approx(1)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    out = katz.score(docs, vocabulary=vocabulary).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    text = dict(rows)
    for r in out:
        t = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in model.c for w in t), model.n)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((model.c[w] + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(model.p(h, w)) for h, w in zip(["<s>", *t], t)))


@pytest.mark.parametrize("head", [0, 1, 40, 200])
def test_katz_counts_bigrams_of_rare_words(spark, head):
    rows = zipf_rows()
    model = Model(rows, len(rows) * 1000)
    assert len(model.vocabulary) == len(model.c) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = katz.score(docs, head=head).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    text = dict(rows)
    for r in out:
        t = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in model.c for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((model.c[w] + 0.5) / (model.n + 0.5 * (model.v + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(model.p(h, w)) for h, w in zip(["<s>", *t], t)))


def test_katz_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = katz.score(docs, held_out=F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert katz.score(docs.where("false")).count() == 0


def mix_rows(seed=3):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "hot"]
    rows = [(i, rng.choice(sources[:5]) if i % 3 else "hot", " ".join(["w"] * rng.randint(0, 50)), 1) for i in range(400)]
    return rows + [(400, "b", None, 1), (401, "blank", "", 1), (402, "b", "w " * 3000, 1), (403, None, "w w", 1), (None, "a", "w", 1), (5, rows[5][1], rows[5][2], 1)]


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000, 1000, 0]) == pytest.approx([20, 2995 * 2 / 3, 2995 / 3, 0])


def test_splitting_tree():
    counts = [5, 0, 1000, 333]
    q = mixing.split_quotas(counts, 7)
    assert q.sum(axis=0).tolist() == counts and (q >= 0).all()
    sizes = q.sum(axis=1)
    assert sizes.max() - sizes.min() <= 3
    assert (q == mixing.split_quotas(counts, 7)).all()
    big = mixing.split_quotas([3 * 10**9, 2 * 10**9, 5], 4)
    assert big.sum(axis=0).tolist() == [3 * 10**9, 2 * 10**9, 5] and (big >= 0).all() and np.ptp(big.sum(axis=1)) <= 33
    runs = mixing.split_quotas([1000, 7, 0, 333], 5, drawn=100)  # runs of 14 blocks
    assert runs.sum(axis=0).tolist() == [1000, 7, 0, 333] and (runs >= 0).all() and np.ptp(runs.sum(axis=1)) <= 3 * 14


def test_draws_are_hypergeometric():
    """Means and variances of a node's draw over many seeds, against the distribution's."""
    counts = np.array([40, 25, 35])
    left = np.array([mixing._draw(np.random.default_rng(k), counts, 30) for k in range(4000)])
    p = counts / 100
    assert (left.sum(axis=1) == 30).all()
    assert left.mean(axis=0) == pytest.approx(30 * p, rel=0.02)
    assert left.var(axis=0) == pytest.approx(30 * p * (1 - p) * 70 / 99, rel=0.1)


@pytest.mark.parametrize("whole", [False, True])
def test_shards_hold_disjoint_blocks_by_the_leaves_quotas(spark, whole):
    """Brute force: the seeded order per source, its blocks up to the target, and the leaves' intervals of them."""
    rows = [r for r in mix_rows() if r[0] is not None and r[0] != 5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    got = {r.doc_id: r for r in mixing.mix(docs.repartition(4), shards=5, whole=whole).collect()}
    by = defaultdict(list)
    for i, s, t, _ in rows:
        by[s].append((hashlib.md5(f"7-{i}".encode()).hexdigest(), i, len((t or "").split())))
    order = sorted((s for s in by if s is not None)) + [None]
    want = mixing.targets([sum(x[2] for x in by[s]) for s in order])
    blocks = {}
    for s, w in zip(order, want):
        own, size = sorted(by[s]), sum(x[2] for x in by[s])
        quota = min(round(w), 2 * size)
        blocks[s], taken = [], 0
        while size and taken + size <= quota:
            blocks[s] += [(i, n) for _, i, n in own]
            taken += size
        for _, i, n in own if size else []:
            if taken >= quota or whole and 2 * (quota - taken) < n:
                break
            blocks[s].append((i, n if whole else min(n, quota - taken)))
            taken += n
    quotas = mixing.split_quotas([len(blocks[s]) for s in order], 5)
    shards, words = defaultdict(list), Counter()
    for k, s in enumerate(order):
        ends = np.cumsum(quotas[:, k])
        for b, (i, n) in enumerate(blocks[s]):
            shards[i].append(int(np.searchsorted(ends, b, "right")))
            words[i] += n
    for i, r in got.items():
        assert (r.shards, r.taken) == (shards[i], words[i])


def test_mix(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long")
    out = mixing.mix(docs.repartition(5), shards=5, prefix=1).collect()
    again = mixing.mix(docs.repartition(3), shards=5, prefix=1).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.taken, tuple(r.shards))
    assert sorted(map(key, out)) == sorted(map(key, again))
    size = Counter()
    for _, s, t, _ in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, mixing.targets([size[s] for s in order])))
    source = {i: s for i, s, *_ in rows}
    taken, drawn = Counter(), Counter()
    for r in out:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        assert all(0 <= x < 5 for x in r.shards) and len(r.shards) <= 2
        drawn.update(r.shards)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert max(drawn.values()) - min(drawn.values()) <= 3


def test_mixed_documents(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(i, s, t, len(t or ""), 0, 0) for i, s, t, _ in rows],
                                 "doc_id long, source string, text string, n_chars long, size int, target int")
    out = mixing.mixed_documents(docs, shards=4)
    assert out.columns == docs.columns
    mixed = mixing.mix(docs, shards=4, whole=True).collect()
    text, got, lies = {i: t for i, _, t, _ in rows}, Counter(), []
    shard_of = {r.doc_id: set(r.shards) for r in mixed}
    for r in out.collect():
        got[r.doc_id] += 1
        lies.append(shard_of[r.doc_id])
        assert r.text == text[r.doc_id] and r.n_chars == len(r.text or "")  # whole documents
    copies = Counter()
    for r in mixed:
        copies[r.doc_id] += len(r.shards)
        assert r.taken == r.size * len(r.shards)
    assert +got == +copies
    at = 0  # the rows can be read shard by shard
    for s in lies:
        at = min(x for x in s if x >= at)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed_documents(docs.where("false")).count() == 0


def shard_rows(seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["en", "de", None]), f"s{rng.randint(0, 9)}" if i % 3 else "hot", "x" * rng.randint(0, 300) + str(i)) for i in range(3000)]
    rows += [(3000 + i, "en", "hot", "copied text " * 10) for i in range(1500)]  # a hot group
    return rows + [(None, None, None, None), (5000, None, "s1", ""), (5001, "de", "s1", "é" * 500), (5, "en", "s1", "twice"), (5, "en", "s1", "twice")]


def test_sharding(spark):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(4)
    out = sharding.shard(docs).collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, _, _, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    load, slots, shards_of = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shards_of[r.text_crc32].add(r.shard)
    assert set(load) == set(range(40))
    mean = sum(load.values()) / 40
    assert max(load.values()) < 1.15 * mean and min(load.values()) > 0.85 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = zlib.crc32(("copied text " * 10).encode())
    assert sum(len(s) > 1 for c, s in shards_of.items() if c != hot) == 0  # equal texts stay together


def test_sharding_small_tables(spark):
    schema = "doc_id long, lang string, source string, text string"
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    one = sharding.shard(spark.createDataFrame([(1, None, None, None)], schema)).collect()
    assert len(one) == 1 and one[0].slot == 0 and one[0]["size"] == 16
    few = sharding.shard(spark.createDataFrame([(i, "a", "b", "same") for i in range(5)], schema)).collect()
    assert len(few) == 5


def test_tree_assigns_like_cuts():
    tree = sharding.Tree({0: (0, 10), 1: (1, 5)}, {2: 2, 3: 0, 4: 1})
    node = tree.assign([np.array([3, 3, 12]), np.array([1, 9, 0])])
    assert [tree.leaves[n] for n in node.tolist()] == [0, 1, 2]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [k for k, _ in p.STAGES] == ["toxicity", "exact dedup", "near-duplicates", "mixing", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert n * 0.5 < out.count() <= n, name
    rows = p.run(spark, sf).collect()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict()) and len(rows) > n * 0.5
    # the result is the stages one after the other
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, docs.collect()))
