"""Vector codes, chat windows and Merkle manifests against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import chat, merkle, queries, vector_codes
from corpuslab.operators.ordered import attach, positions


# --- vector codes ----------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds, scale=4096):
    """rows (id, vector): {row number: (code, error)}, codebooks, by comparing with every entry."""
    kept = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    cut = lambda v, p: tuple(v[p * len(v) // parts:(p + 1) * len(v) // parts])
    books = [[cut(r[2], p) for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _n, _i, v in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if own[k] else e for k, e in enumerate(books[p])]
    out = {}
    for n, _i, v in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out[n] = ("".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got))
    return out, books


def test_candidates_hold_the_nearest_entry():
    rng = np.random.default_rng(3)
    for k, d, spread in ((1, 8, 9), (16, 8, 3), (16, 8, 5000), (70, 5, 40), (130, 3, 200), (4, 1, 2), (5, 0, 1)):
        book = rng.integers(-spread, spread + 1, (k, d))
        x = np.vstack([rng.integers(-2 * spread, 2 * spread + 1, (500, d)), book])
        s = vector_codes.Slices(book)
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        own, gap = s.nearest(x)
        assert (own == every.argmin(1)).all() and (gap == every.min(1)).all()
        if d == 8 and spread == 5000:  # the masks leave some entries out
            masks = s.candidates(x, s.radius(x))
            assert 1 <= np.mean([bin(int(m)).count("1") for m in masks[:, 0]]) < k


@pytest.mark.parametrize("entries", [1, 4, 16])
def test_codes_equal_brute_force(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [rng.choice([-1, 1]) * rng.randint(0, 40) / 4096 + rng.random() / 9000 for _ in range(8)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 7 + [None]), (102, [float("nan")] + [0.0] * 7), (103, [float("inf")] * 8), (None, [0.5] * 8),
             (3, rows[3][1]), (3, [0.25] * 8), (104, [0.0] * 8), (105, [0.0] * 8)]
    df = spark.createDataFrame([(n, i, v, n % 3 or None, "x") for n, (i, v) in enumerate(rows)],
                               "n int, vec_id long, embedding array<float>, label int, code string").repartition(3)
    coded, books = vector_codes.compress(df, parts=4, entries=entries, rounds=3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, want_books = brute_codes(single, 4, entries, 3)
    assert books.entries.tolist() == [[list(e) for e in b] for b in want_books]
    full = vector_codes.with_label_error(coded)
    got = {r["n"]: r for r in full.collect()}
    assert {n: (r["code"], r["error"]) for n, r in got.items()} == want
    sums = defaultdict(int)
    for n, r in got.items():
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got.values()) and None in sums
    back = {r["n"]: r["vector"] for r in vector_codes.decode(coded, books).collect()}
    assert back == {n: [x for p, b in enumerate(want_books) for x in b[int(c[2 * p:2 * p + 2], 16)]] for n, (c, _) in want.items()}


def test_codes_of_an_empty_table_and_of_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None, 2)], schema))
    assert vector_codes.with_label_error(coded).count() == 0 and books.entries.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9, 2)], schema))
    with pytest.raises(Exception, match="is 268435456"):
        vector_codes.compress(spark.createDataFrame([(1, [1e6] * 8, 2)], schema))


def test_positions_and_values_per_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randint(0, 50), n) for n in range(300)]
    df = spark.createDataFrame(rows, "g string, x int, n int").repartition(5)
    got = {r["n"]: (r["idx"], r["n_rows"]) for r in positions(df.withColumnRenamed("n", "id_"), "g", [F.col("x"), F.col("id_")], "t")
           .withColumnRenamed("n", "n_rows").withColumnRenamed("id_", "n").collect()}
    for g in "ab":
        own = sorted((x, n) for k, x, n in rows if k == g)
        assert {n: got[n] for _, n in own} == {n: (k, len(own)) for k, (_, n) in enumerate(own)}
    keyed = spark.createDataFrame([(k if k < 3000 else None, k) for k in range(3000)] + [(None, 1)] * 50, "k int, v int")
    per = keyed.groupBy("k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("_x_n"))
    out = attach(keyed, per, "k")
    assert out.columns == ["k", "v", "s"] and out.count() == 3050
    assert out.where("k is null and s <> 50 or k <> s").count() == 0


# --- chat windows ----------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[/SYS][OUT", "[ROLE]a[/ROLE]", "<", "[", "\\", "[\\END]", "<s", "s>", "", "[OUT]</s", "é[/INST]\n"]


def test_escaping_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choices(["<", "[", "\\", "/", "s>", "INST]", "SYS]", "END]", "OUT]", "ROLE]", "x"], k=rng.randint(1, 12))) for _ in range(3000)]
    for t in texts:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]"))
    assert len({chat.escape(t) for t in texts}) == len(set(texts))
    for k in range(300):
        turns = [(rng.choice(["system", "user", "assistant", "", "tool [ROLE]", "User"]), rng.choice(texts)) for _ in range(k % 7)]
        assert chat.parse(chat.START + "".join(chat.format_turn(r, t)[0] for r, t in turns)) == turns


def brute_spans(tok, size, first, front, budget, history):
    out, a = [], first
    while a < len(tok):
        h = a
        while (h > 0 and sum(tok[h - 1:a]) <= min(history, budget - front - tok[a]) and sum(size[h - 1:a]) <= history * chat.HISTORY_BYTES):
            h -= 1
        end = a + 1
        while end < len(tok) and front + sum(tok[h:end + 1]) <= budget:
            end += 1
        out.append((h, a, end))
        a = end
    return out


def test_spans_equal_a_search_turn_by_turn():
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(0, 14)
        tok, size = [rng.randint(1, 30) for _ in range(n)], [rng.randint(0, 200) for _ in range(n)]
        args = (rng.randint(0, n), rng.randint(0, 10), rng.randint(5, 60), rng.randint(0, 30))
        assert chat.spans(np.array(tok, np.int64), np.array(size, np.int64), *args) == brute_spans(tok, size, *args)


def conversations():
    rng = random.Random(7)
    rows = []
    for c in range(12):
        if c % 2:
            rows.append((c, 0, "system", f"be {c}"))
        rows += [(c, 1 + t, "user" if t % 2 else "assistant", " ".join(["word"] * rng.randint(0, 40)) + rng.choice(NASTY)) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "user" if t % 2 else "assistant", f"turn {t} " + "x y " * 30) for t in range(200)]  # most of all bytes
    rows += [(51, 0, "system", "keep me")] + [(51, t, rng.choice(["user", "assistant"]), "long talk " * 12) for t in range(1, 150)]
    return rows + [(None, 1, "user", "no id"), (None, 2, "assistant", None), (13, None, None, "last"), (13, 4, "assistant", "first"),
                   (14, 1, "assistant", "twice"), (14, 1, "assistant", "twice"), (15, 0, "system", "alone"), (16, 0, "user", "word " * 2000)]


def expected(rows):
    """Per conversation with distinct turn numbers: what reading back must give."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"budget": 120, "history": 40, "segment": 1500}, {"budget": 60, "history": 0, "segment": 400}])
def test_windows_read_back_equal_the_turns(spark, options):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk int").repartition(5)
    w = chat.windows(df, **options)
    got = w.collect()
    back = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.read_back(w).collect()}
    assert {c: v[:4] for c, v in back.items()} == expected(rows)
    assert {c: v[4] for c, v in back.items()} == {c: sum(len(r["text"]) for r in got if r["conv_id"] == c) for c in back}
    budget = options.get("budget", chat.BUDGET)
    for r in got:
        turns = chat.parse(r["text"])
        assert r["over_budget"] == (r["tokens"] > budget) and len(turns) == r["repeated"] + r["turns"]
        if r["over_budget"]:  # one new turn that doesn't fit (beside the system turn)
            assert r["turns"] - (r["chunk"] == r["window"] == 0 and turns[0][0] == "system") <= 1
        if r["conv_id"] == 51:
            assert turns[0] == ("system", "keep me")
    if options:
        assert max(r["chunks"] for r in got) > 3  # the long conversations were dealt out in chunks


def test_chunks_give_the_windows_of_one_stream(spark, monkeypatch):
    """Cut into chunks or not, a conversation has the same windows."""
    df = spark.createDataFrame([r for r in conversations() if r[0] in (50, 51)], "conv_id long, turn long, role string, text string")
    opts = {"budget": 150, "history": 60, "segment": 2000}
    key = lambda r: (r["conv_id"], r["chunk"], r["window"])
    hot = [(r["conv_id"], r["text"], r["loss"], r["repeated"]) for r in sorted(chat.windows(df, **opts).collect(), key=key)]
    monkeypatch.setattr(chat, "HOT", 1)  # no conversation has more than all bytes
    whole = sorted(chat.windows(df, **opts).collect(), key=key)
    assert {r["chunks"] for r in whole} == {1}
    assert hot == [(r["conv_id"], r["text"], r["loss"], r["repeated"]) for r in whole]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(df)).count() == 0


# --- Merkle manifest -------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def digest_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves, arity):
    """Root and, per leaf, its siblings level by level as (left, right)."""
    nodes, owners, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        nxt, nxt_owners = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a:a + arity]
            for k in range(len(run)):
                for i in owners[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            nxt.append(sha("".join(run)))
            nxt_owners.append([i for o in owners[a:a + arity] for i in o])
        nodes, owners = nxt, nxt_owners
    return nodes[0], proofs


def merkle_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "Z", None]), rng.choice(["en", None]), rng.choice([None, i]),
             rng.choice([None, "", "two\nlines", "é\n", "x" * 5000, f"text {i}"])) for i in range(97)]
    return rows + [(200, "lone", "en", 1, "t"), (5, "a", "de", 2, "same id"), (5, "a", "de", 2, "same id"), (None, "b", None, None, None)]


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_equals_brute_force(spark, arity):
    rows = merkle_rows()
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx string").repartition(4)
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(((r[0] is not None, r[0] or 0, digest_of(r)), digest_of(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: brute_tree([h for _, h in sorted(by[s])], arity) for s in order}
    root, tops = brute_tree([subs[s][0] for s in order], arity)
    want = []
    for n, s in enumerate(order):
        for k, ((_, i, h), _) in enumerate(sorted(by[s])):
            want.append((h, subs[s][0], root, [*subs[s][1][k], *tops[n]]))
    out = merkle.manifest(df, arity=arity).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    got = [(r["leaf"], r["subroot"], r["root"], [(p["left"], p["right"]) for p in r["path"]]) for r in out]
    assert sorted(got) == sorted(want) and len(got) == len(rows)
    assert all(r["folded"] == root for r in out)
    assert sorted(r["doc_id"] or -1 for r in out) == sorted(r[0] or -1 for r in rows)


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:1----") and one["path"] == []


def test_tampering_is_found(spark, sf):
    got = {r["doc_id"]: r for r in queries.op13_merkle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")
        assert got[r["doc_id"]]["verified"] == (not changed)
