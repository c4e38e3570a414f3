"""Exact and near deduplication against brute force, with ties, nulls, hot groups and clashing names."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import exact_dedup, minhash

SCHEMA = "doc_id long, text string, size long, keep_id string"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = [(i, rng.choice(base).replace(" ", rng.choice([" ", "\n", "  \t"]))) for i in range(300)]
    rows += [(1000 + i, "hot  text\n" if i % 2 else "hot text ") for i in range(400)]  # a hot group
    rows += [(None, "hot text "), (2000, None), (2001, ""), (2002, " \n"), (2003, " "), (5, "twice"), (5, "twice"), (6, "long " * 20000)]
    return [(i, t, 1, "x") for i, t in rows]


def expected_groups(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    return groups


def test_exact_groups(spark, copies):
    docs = spark.createDataFrame(copies, SCHEMA).repartition(7)
    out = exact_dedup.groups(docs).collect()
    groups = expected_groups(copies)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(out) == len(copies)
    kept = {}
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.keep_id == min(x for x in ids if x is not None) and r.group_size == len(ids)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        if r.kept:
            assert r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_groups_across_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
        out = exact_dedup.groups(docs.repartition(5))
        assert out.agg(F.countDistinct("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first()[:] == (1, 500, 1)
        assert exact_dedup.drop_copies(docs).collect()[0].doc_id == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_drop_copies_keeps_rows_whole(spark, copies):
    docs = spark.createDataFrame(copies, SCHEMA).repartition(6)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    groups = expected_groups(copies)
    assert sorted(norm(r.text) for r in rows) == sorted(groups)
    given = {(i, t) for i, t, *_ in copies}
    assert all((r.doc_id, r.text) in given for r in rows)
    assert all(r.doc_id == min(x for x in groups[norm(r.text)] if x is not None) for r in rows)


def test_exact_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.groups(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def near_rows():
    rng = random.Random(2)

    def word():
        return "".join(rng.choice("abcdefghij") for _ in range(5))

    rows, n = [], 0
    passage = " ".join(word() for _ in range(30))
    for g in range(40):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120]))]
        if g % 3 == 0:
            base = passage.split() + base
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w) if n % 2 else " ".join(w).upper()))
            n += 1
    chain = [word() for _ in range(100)]  # a chain: neighbours are close, the ends are not
    for _ in range(60):
        rows.append((n, " ".join(chain)))
        chain[rng.randrange(100)] = word()
        n += 1
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "one two"), (None, "one"), (n + 7, rows[0][1]), (n + 7, rows[0][1])]
    rng.shuffle(rows)
    return rows


def brute_components(rows, n=4):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sets, [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_components(spark, block, monkeypatch):
    rows = near_rows()
    sets, want = brute_components(rows)
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)  # 16: clusters go over a grid of blocks
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    got = {}
    for r in minhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    for (d, _), s, c in zip(rows, sets, want):
        assert (len(s), c if s else d, d == (c if s else d)) in got[d]
    assert sum(map(len, got.values())) <= len(rows)


def test_drop_near_copies(spark):
    rows = near_rows()
    sets, want = brute_components(rows, 5)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int")
    out = minhash.drop_near_copies(docs, shingle=5)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == sorted([c for c in {c for c, s in zip(want, sets) if s}] + [d for (d, _), s in zip(rows, sets) if not s])


def test_near_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0 and minhash.drop_near_copies(docs).count() == 0


def test_exact_dedup_moves_small_batches_and_each_text_once(spark, monkeypatch):
    """Tasks of ``groups`` and ``drop_copies`` get at most 8 MB at a time; an unchanged text is not carried beside its normal form."""
    seen = []
    write = exact_dedup.materialize

    def spy(df, name):
        seen.append((spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(exact_dedup, "materialize", spy)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(3, "a b", 1, "x"), (2, "a  b", 2, "y"), (4, "a b", 3, "z"), (5, None, 4, "u"), (6, "", 5, "v"), (7, "c\n", 6, "w"), (8, "d", 7, "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect())
    assert got == [rows[k] for k in (1, 3, 5, 6)]
    assert exact_dedup.groups(docs).count() == 7
    assert [x for x, _ in seen] == ["8m", "8m"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert "CASE WHEN _x_same" not in seen[0][1]  # texts are put back for the rows that stay only
