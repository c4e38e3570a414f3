"""Operator 5: language-model scores by Katz backoff (word bigrams over unigrams).

Tokens are the lower-cased (A-Z) words of a text and one end; a bigram's history is the word
before, or the start. Counts come from all training texts.

* Unigrams: counts c of V types, N tokens. P1(w) = d(c) c / N; what discounting leaves goes to
  one further type, the unknown word. These V + 1 types sum to 1.
* Bigrams of all words: P(w | h) = d(c) c / c(h). All else
  backs off: P(w | h) = a(h) P1(w), where a(h) is what the seen words leave of 1, over what they leave of P1, so that
  each history sums to 1 exactly. A history whose counts are all undiscounted gets 1 added to
  its total, to leave something. A history never seen has a = 1. (``vocabulary``, if given, keeps
  the bigrams to the words above a count that at most so many words reach; others have a = 1.)
* d(r) for r <= ``CUTOFF`` is the Good-Turing discount in Katz's form from the counts of counts; where these
  give no value between 0 and 1, r - 1/2 over r is taken.

Evaluation is recursive: every token first gets log a(h) + log P1(w); those whose bigram
was seen gain the difference to log P(w | h).

Work is laid out for shuffles: words are 64-bit hashes; about the ``HEAD`` most frequent words are looked up in a
broadcast table; pairs of two of the ``HOT`` most frequent words are counted
ahead of the shuffle and broadcast. All other bigrams of two words of the table move once, as sorted arrays of
pairs and texts per bucket (one row for each bucket and about ``CHUNK`` tokens), and are
written with their counts to the shared folder, which the discount, backoff and scoring jobs read. Such a row names
its chunk once and a text by its number in the chunk; the texts' keys move once a chunk, to where the gains are added up.
Occurrences of all other words move once too, by a hash of the word and with their neighbours: a
bucket then holds all of a rare word's counts, the bigrams it begins and those it ends after a word of the table. Where
the next word is rare as well, its count comes by a join with the unigram table.

Defined cases: null text is empty: its one token is the end; without training texts N = V = 0,
base and score give the unknown type probability 1; repeated rows count and score each on its own; a null id is not held
out; an empty table gives an empty table; extra columns are ignored. Rows that come in another order when a lost task is run
again (documents straight from a shuffle; a scan keeps its order) stop the job with a message: write such documents first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_bytes, is_held_out, release, small_batches, texts_of
from .words import BASE, U, Words, mix

HEAD, HOT, CUTOFF, CHUNK, ROW = 1 << 19, 256, 5, 500_000, 250_000
END = mix(np.array([3], np.uint64) * BASE).view(np.int64)[0]
#: Counts are grouped exactly up to this and by sixteenths of a power of 2 above, to place the table's limit.
_EXACT = 1000


@dataclass
class Discounts:
    """d(r) for r = 1 .. CUTOFF; 1 above."""

    values: np.ndarray

    @classmethod
    def from_counts(cls, n: dict[int, int]) -> Discounts:
        k, d = CUTOFF, np.ones(CUTOFF + 1)
        rest = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
        for r in range(1, k + 1):
            good = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - rest) / (1 - rest) if n.get(r) and rest < 1 else 0.0
            d[r] = good if 0 < good < 1 else (r - 0.5) / r
        return cls(d)

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= CUTOFF, self.values[np.minimum(c, CUTOFF)], 1.0)


@dataclass
class Unigrams:
    """What every task needs to know: totals, and the frequent words by falling count (code 0 is the most frequent)."""

    n: int
    v: int
    texts: int  # training texts
    total: float  # what discounted counts are divided by: n, or more if no count is discounted
    discounts: Discounts
    unknown: float  # log10 P1 of the unknown word
    keys: np.ndarray  # sorted hashes
    codes: np.ndarray  # code of each key
    counts: np.ndarray  # by code

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Code of each word, or -1."""
        if not self.keys.size:
            return np.full(hashes.size, -1, np.int64)
        i = np.minimum(np.searchsorted(self.keys, hashes), self.keys.size - 1)
        return np.where(self.keys[i] == hashes, self.codes[i], -1)

    def log_p1(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        return np.where(c > 0, np.log10(np.maximum(self.discounts.of(c) * c, 1e-300) / self.total), self.unknown)

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(c) + 0.5) / (self.n + 0.5 * (self.v + 1)))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and ends of all texts, and the n + 1 places where texts begin."""
    words = Words(texts_of(batch.column("_x_text")))
    n = words.count.size
    first = words.first + np.arange(n + 1)
    out = np.empty(len(words) + n, np.int64)
    end = first[1:] - 1
    is_word = np.ones(out.size, bool)
    is_word[end] = False
    out[is_word] = words.hashes().view(np.int64)
    out[end] = END
    return out, first


def _count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(c)], names=["word", "c"])

        for b in by_bytes(batches, "_x_text"):
            held.append(_tokens(b)[0])
            size += held[-1].size
            if size >= CHUNK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.where("not held_out").select("_x_text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unigrams(table: DataFrame, head: int = HEAD) -> Unigrams:
    """Totals, discounts and the broadcast frequent words of a unigram table."""
    bucket = F.when(F.col("c") <= _EXACT, F.col("c")).otherwise(_EXACT + F.floor(F.log2(F.col("c") / _EXACT) * 16) + 1)
    rows = table.groupBy(bucket.cast("long").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.min("c").alias("least")).orderBy(F.desc("b")).collect()
    n, v = sum(r["s"] for r in rows), sum(r["n"] for r in rows)
    d = Discounts.from_counts({r["b"]: r["n"] for r in rows if r["b"] <= _EXACT})
    left = sum((1 - d.values[r["b"]]) * r["s"] for r in rows if r["b"] <= CUTOFF)
    total = float(n) if left > 0 else n + 0.5
    unknown = float(np.log10((left if left > 0 else 0.5) / total))
    limit, have = None, 0
    for r in rows:
        if have + r["n"] > head:
            break
        limit, have = r["least"], have + r["n"]
    if limit is None:
        word = c = np.empty(0, np.int64)
    else:
        t = table.where(F.col("c") >= limit).toArrow()
        word, c = (t.column(k).to_numpy() for k in ("word", "c"))
    rank = np.lexsort((word, -c))
    code = np.empty(rank.size, np.int64)
    code[rank] = np.arange(rank.size)
    by_key = np.argsort(word)
    ends = table.where(F.col("word") == int(END)).first()
    return Unigrams(n, v, ends["c"] if ends else 0, total, d, unknown, word[by_key], code[by_key], c[rank])


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, all first bytes first: in sorted arrays the high ones then compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _pairs(codes: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """History of each token (its code, ``start``, or -1), and the pair of both codes (or -1)."""
    history = np.empty(codes.size, np.int64)
    history[1:] = codes[:-1]
    history[first[:-1]] = start
    ok = (history >= 0) & (codes >= 0)
    return history, np.where(ok, history << 20 | codes, -1)


def _is_hot(pair: np.ndarray) -> np.ndarray:
    return (pair >> 20 < HOT) & ((pair & 0xFFFFF) < HOT)


#: Texts of a chunk at most (a number takes 15 bits, the one above tells whether the text is learned from).
_TEXTS = 30_000
_ENTRIES = "bucket int, chunk long, pairs binary, docs binary, counts binary, keys binary"
_BIGRAMS = ["pairs", "counts", "times", "docs", "places", "chunks", "keys"]


def _chunk_of(key: np.ndarray) -> int:
    """What names a chunk: a hash of its texts' keys in order. Equal chunks hold equal texts."""
    k = mix(key.view(np.uint64) + mix(np.arange(1, key.size + 1, dtype=np.uint64)))
    return int(mix(np.bitwise_xor.reduce(k, keepdims=True) + U(key.size)).view(np.int64)[0])


def _entries(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """Rows of one bucket and chunk: sorted pairs, for each the number of its text and whether that is learned from.

    Pairs of two frequent words come as counts over the chunk's training texts, in buckets below 0, as do the keys of all its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        start = u.counts.size
        held: list[tuple[np.ndarray, ...]] = []
        size = texts = 0

        def out() -> Iterator[pa.RecordBatch]:
            key, train = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            pair, doc = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            chunk = _chunk_of(key)
            hot = _is_hot(pair)
            word, c = np.unique(pair[hot & train[doc]], return_counts=True)
            rows = [(-1 - chunk % buckets, chunk, _planes(word), b"", _planes(c.astype(np.int64)), key.tobytes())]
            pair, doc = pair[~hot], doc[~hot]
            number = (doc | train[doc].astype(np.int32) << 15).astype(np.uint16)
            # the bigrams of a rare history share a bucket; those of a frequent one are dealt by both words
            place = np.where(pair >> 20 < 4 * HOT, pair, (pair >> 20) + (np.int64(1) << 50))
            bucket = (mix(place.view(np.uint64)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket << 40 | pair)  # fewer than 2**23 buckets
            pair, number, bucket = pair[order], number[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), pair.size]):
                rows.append((int(bucket[a]), chunk, _planes(pair[a:b]), _planes(number[a:b]), b"", b""))
            for at in range(0, len(rows), 16):
                cols = list(zip(*rows[at:at + 16]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                                                 names=["bucket", "chunk", "pairs", "docs", "counts", "keys"])

        for b in by_bytes(batches, "_x_text"):
            token, first = _tokens(b)
            _, pair = _pairs(u.lookup(token), first, start)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            ok = pair >= 0
            key = b.column("_x_key").to_numpy()
            train = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            if held and texts + b.num_rows > _TEXTS:
                yield from out()
                held, size, texts = [], 0, 0
            for a in range(0, b.num_rows, _TEXTS):
                z = min(a + _TEXTS, b.num_rows)
                mine = ok & (doc >= a) & (doc < z)
                held.append((key[a:z], train[a:z], pair[mine], (doc[mine] - a + texts).astype(np.int32)))
                size, texts = size + int(mine.sum()), texts + z - a
                if size >= CHUNK or z < b.num_rows:
                    yield from out()
                    held, size, texts = [], 0, 0
        if held:
            yield from out()
        release()

    return docs.select("_x_key", "held_out", "_x_text").mapInArrow(run, _ENTRIES)


def _counted(t: pa.Table) -> pa.Table:
    """All chunks of a bucket merged: distinct pairs, their training counts, occurrences, and the texts of these by place of the chunk and number.

    A row holds about ``ROW`` occurrences, and all those of a pair. In buckets below 0: counts of pairs, and a row with its texts' keys for each chunk.
    """
    rows = t.to_pylist()
    pair = np.concatenate([_unplanes(r["pairs"], np.int64) for r in rows])
    none = dict.fromkeys(_BIGRAMS, b"")
    if rows[0]["bucket"] < 0:
        c = np.concatenate([_unplanes(r["counts"], np.int64) for r in rows])
        word, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, c, word.size).astype(np.int64)
        out = [none | {"pairs": _planes(word), "counts": _planes(total)}]
        out += [none | {"chunks": np.array([r["chunk"]]).tobytes(), "keys": r["keys"]} for r in rows]
    else:
        number = np.concatenate([_unplanes(r["docs"], np.uint16) for r in rows])
        chunk = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(r["docs"]) // 2 for r in rows])
        chunks = np.array([r["chunk"] for r in rows], np.int64)
        order = np.argsort(pair, kind="stable")
        pair, number, chunk = pair[order], number[order], chunk[order]
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        c = np.add.reduceat((number >> 15).astype(np.int64), cut)
        end, out = np.append(cut, pair.size), []
        edges = np.unique(np.searchsorted(end, np.arange(0, pair.size, ROW)))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), cut.size]):
            own, place = np.unique(chunk[end[a]:end[b]], return_inverse=True)
            cols = (_planes(pair[cut[a:b]]), _planes(c[a:b]), _planes(np.diff(end[a:b + 1]).astype(np.int32)),
                    _planes(number[end[a]:end[b]] & np.uint16(0x7FFF)), _planes(place.astype(np.uint32)), chunks[own].tobytes(), b"")
            out.append(dict(zip(_BIGRAMS, cols)))
    return pa.table({k: pa.array([r[k] for r in out], pa.binary()) for k in _BIGRAMS})


_TAIL = "word long, key long, train boolean, prev int, next int, after long"
_RARE = ["keys", "place", "prev", "c_prev", "c_next", "c_after", "counts", "own", "own_c", "own_w", "head", "head_c", "head_w"]


def _tail(docs: DataFrame, shared) -> DataFrame:
    """Occurrences of words outside the table: the codes before (or the start's) and after them, -1 for a word
    outside the table, whose hash is ``after``, and -2 after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        for b in by_bytes(batches, "_x_text"):
            token, first = _tokens(b)
            code = u.lookup(token)
            history, _ = _pairs(code, first, u.counts.size)
            following = np.append(code[1:], -2)
            following[first[1:] - 1] = -2
            at = np.flatnonzero(code < 0)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))[at]
            train = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[at]), pa.array(b.column("_x_key").to_numpy()[doc]), pa.array(train[doc]), pa.array(history[at].astype(np.int32)),
                 pa.array(following[at].astype(np.int32)), pa.array(np.append(token[1:], 0)[at], mask=following[at] != -1)],
                names=["word", "key", "train", "prev", "next", "after"])

    return docs.select("_x_key", "held_out", "_x_text").mapInArrow(run, _TAIL)


def _rare(docs: DataFrame, words: DataFrame, shared, buckets: int, pairs: bool) -> DataFrame:
    """One row for each bucket of rare words: their occurrences with the counts of both bigrams, and the distinct bigrams.

    ``own`` are bigrams that begin with the word of this place, ``head`` those that a word of the table begins, by
    its code; with the counts of the bigram and of its second word. n1 .. n6 are counts of counts of the former.
    """
    rows = materialize(_tail(docs, shared), "katz-tail")
    counts = words.select(F.col("word").alias("after"), F.col("c").alias("c_after"))
    rows = rows.where("after is null").withColumn("c_after", F.lit(None).cast("long")).unionByName(
        rows.where("after is not null").join(counts, "after", "left"))

    def count(t: pa.Table) -> pa.Table:
        u = shared.value
        t = t.sort_by("key")
        word, key, prev, following = (t.column(k).to_numpy() for k in ("word", "key", "prev", "next"))
        train = t.column("train").to_numpy().astype(bool)
        after, c_after = (t.column(k).fill_null(0).to_numpy().copy() for k in ("after", "c_after"))
        known = following >= 0
        c_after[known] = u.counts[following[known]]
        own, place = np.unique(word, return_inverse=True)
        c = np.bincount(place, train, own.size).astype(np.int64)
        nxt = following.astype(np.int64)
        nxt[following == -1] = (1 << 20) + np.unique(after[following == -1], return_inverse=True)[1]

        def counted(other: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, ...]:
            """The count of each occurrence's pair; of the seen pairs the place, the other word, the count and an occurrence."""
            ok = np.flatnonzero(ok & pairs)
            pair, one, at = np.unique(place[ok] << 32 | other[ok], return_index=True, return_inverse=True)
            n = np.bincount(at, train[ok], pair.size).astype(np.int64)
            each = np.zeros(word.size, np.int64)
            each[ok] = n[at]
            seen = n > 0
            return each, pair[seen] >> 32, pair[seen] & 0xFFFFFFFF, n[seen], ok[one[seen]]

        c_prev, of, head, head_c, _ = counted(prev.astype(np.int64), prev >= 0)
        head_w = c[of]
        c_next, of, _, own_c, one = counted(nxt, following != -2)
        cols = dict(zip(_RARE, (key, place.astype(np.int32), prev, c_prev, c_next, c_after, c, of.astype(np.int32), own_c, c_after[one],
                                head.astype(np.int32), head_c, head_w)))
        out = {k: pa.array([_planes(x)], pa.binary()) for k, x in cols.items()}
        return pa.table(out | {f"n{r}": pa.array([int((own_c == r).sum())], pa.int64()) for r in range(1, CUTOFF + 2)})

    schema = ", ".join([*(f"{k} binary" for k in _RARE), *(f"n{r} long" for r in range(1, CUTOFF + 2))])
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda t: count(t), schema)


def _arrays(r: dict, *names: str) -> list[np.ndarray]:
    return [_unplanes(r[k], np.int32 if k in ("place", "prev", "own", "head") else np.int64) for k in names]


def _by_history(u: Unigrams, history: np.ndarray, c: np.ndarray, c_word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Histories, and for each the sums of its bigrams' counts by count, and of P1 of their words."""
    history, place = np.unique(history, return_inverse=True)
    p1 = 10.0 ** u.log_p1(c_word)
    sums = [np.bincount(place, c * (c == r), history.size) for r in range(1, CUTOFF + 2)]
    return history, [*sums, np.bincount(place, c * (c > CUTOFF + 1), history.size), np.bincount(place, p1, history.size)]


def _hot_counts(bigrams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two frequent words and their counts: at most HOT * HOT rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, counts in zip(b.column("pairs"), b.column("counts")):
                cols = [pa.array(_unplanes(x.as_py(), np.int64)) for x in (raw, counts)]
                yield pa.RecordBatch.from_arrays(cols, names=["pair", "c"])

    rows = bigrams.where((F.length("docs") == 0) & (F.length("keys") == 0)).select("pairs", "counts").mapInArrow(run, "pair long, c long")
    t = rows.groupBy("pair").agg(F.sum("c").alias("c")).toArrow().sort_by("pair")
    return t.column("pair").to_numpy(), t.column("c").to_numpy()


def _history_sums(bigrams: DataFrame, rare: DataFrame, shared) -> DataFrame:
    """For histories of the table: (history, s1 .. s6, more, p1): counts of its seen bigrams by count, and the sum of P1 of their words."""
    names = [*(f"s{r}" for r in range(1, CUTOFF + 2)), "more", "p1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        for b in batches:
            for raw, counts in zip(b.column("pairs"), b.column("counts")):
                pair, c = _unplanes(raw.as_py(), np.int64), _unplanes(counts.as_py(), np.int64)
                pair, c = pair[c > 0], c[c > 0]
                history, sums = _by_history(u, pair >> 20, c, u.counts[pair & 0xFFFFF])
                yield pa.RecordBatch.from_arrays([pa.array(history), *map(pa.array, sums)], names=["history", *names])

    def run_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = shared.value
        for b in batches:
            for r in b.to_pylist():
                history, sums = _by_history(u, *_arrays(r, "head", "head_c", "head_w"))
                yield pa.RecordBatch.from_arrays([pa.array(history.astype(np.int64)), *map(pa.array, sums)], names=["history", *names])

    schema = "history long, " + ", ".join(f"{c} double" for c in names)
    rows = bigrams.where(F.length("docs") > 0).select("pairs", "counts").mapInArrow(run, schema)
    rows = rows.unionByName(rare.select("head", "head_c", "head_w").mapInArrow(run_rare, schema))
    return rows.groupBy("history").agg(*[F.sum(c).alias(c) for c in names])


def _weights(d: Discounts, of: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the total and log10 a of histories with these counts and sums (rows s1 .. s6, more, p1)."""
    s, more, p1 = s[:CUTOFF + 1], s[-2], s[-1]
    of = np.maximum(of, s.sum(axis=0) + more)
    kept = (d.values[1:, None] * s[:CUTOFF]).sum(axis=0) + s[CUTOFF] + more
    of = of + (of - kept < 1e-6)
    return np.log10(of), np.log10((of - kept) / of) - np.log10(np.maximum(1 - p1, 1e-12))


@dataclass
class Backoff:
    """By history code (the last one is the start): log10 of the total that counts are divided by, and log10 a."""

    discounts: Discounts
    total: np.ndarray
    weight: np.ndarray
    hot_pairs: np.ndarray
    hot_counts: np.ndarray

    def gain(self, u: Unigrams, pair: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log P(w | h) of seen bigrams over the log a(h) + log P1(w) that every token has already."""
        h, w = pair >> 20, pair & 0xFFFFF
        return self.gain_of(c, self.total[h] + self.weight[h] + u.log_p1(u.counts[w]))

    def gain_of(self, c: np.ndarray, less: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.log10(np.maximum(self.discounts.of(c) * c, 1e-300)) - less, 0.0)


def backoff(bigrams: DataFrame, rare: DataFrame, u: Unigrams, shared) -> Backoff:
    """Discounts and exactly normalised backoff weights; the driver gets one row per history of the table."""
    t = _history_sums(bigrams, rare, shared).toArrow()
    own = rare.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, CUTOFF + 2)]).first()
    hot_pairs, hot_counts = _hot_counts(bigrams)
    history, sums = _by_history(u, hot_pairs >> 20, hot_counts, u.counts[hot_pairs & 0xFFFFF])
    names = [c for c in t.schema.names if c != "history"]
    h = np.concatenate([t.column("history").to_numpy(), history])
    h, place = np.unique(h, return_inverse=True)
    s = np.stack([np.bincount(place, np.concatenate([t.column(k).to_numpy(), x]), h.size) for k, x in zip(names, sums)])
    d = Discounts.from_counts({r: int(round(s[r - 1].sum() / r)) + own[r - 1] for r in range(1, CUTOFF + 2)})
    size = u.counts.size + 1
    total, weight = np.zeros(size), np.zeros(size)
    if h.size:
        # every training token but an end is followed by one; the start by as many as there are texts
        total[h], weight[h] = _weights(d, np.append(u.counts, u.texts)[h].astype(float), s)
    return Backoff(d, total, weight, hot_pairs, hot_counts)


def _text_sums(docs: DataFrame, id_col: str, model) -> DataFrame:
    """Per text what the broadcast tables know: tokens, known ones, base and score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, m = model.value
        log_p1, log_base = u.log_p1(u.counts), u.log_base(u.counts)
        for b in by_bytes(batches, "_x_text"):
            token, first = _tokens(b)
            code = u.lookup(token)
            history, pair = _pairs(code, first, u.counts.size)
            known = code >= 0
            at = np.where(known, code, 0)
            base = np.where(known, log_base[at], 0.0) if u.counts.size else np.zeros(token.size)
            value = np.where(known, log_p1[at], 0.0) if u.counts.size else np.zeros(token.size)
            value += np.where(history >= 0, m.weight[history], 0.0)
            if m.hot_pairs.size:
                i = np.minimum(np.searchsorted(m.hot_pairs, pair), m.hot_pairs.size - 1)
                hit = np.flatnonzero(m.hot_pairs[i] == pair)
                value[hit] += m.gain(u, pair[hit], m.hot_counts[i[hit]])
            sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, value)]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("held_out"), b.column("_x_key"), pa.array(np.diff(first)), *map(pa.array, sums)],
                names=[id_col, "held_out", "_x_key", "n_tokens", "known", "base", "value"])

    return docs.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, _x_key long, n_tokens long, known long, base double, value double")


def _of_rare(u: Unigrams, m: Backoff, r: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts of a row of rare words, and what these add to their scores, bases and numbers of known tokens."""
    key, place, prev, c_prev, c_next, c_after, counts, own, own_c, own_w = _arrays(r, *_RARE[:10])
    h, sums = _by_history(u, own, own_c, own_w)
    total, weight = np.zeros(counts.size), np.zeros(counts.size)
    total[h], weight[h] = _weights(m.discounts, counts[h].astype(float), np.stack(sums))
    c = counts[place]
    log_p1 = u.log_p1(c)
    value = log_p1 + weight[place]  # of the word, and of the backoff of the one after it
    value += m.gain_of(c_prev, m.total[prev] + m.weight[prev] + log_p1)
    value += m.gain_of(c_next, total[place] + weight[place] + u.log_p1(c_after))
    keys, at = np.unique(key, return_inverse=True)
    return keys, [np.bincount(at, x, keys.size) for x in (value, u.log_base(c), (c > 0).astype(float))]


def _bigram_gains(bigrams: DataFrame, model, parts: int) -> DataFrame:
    """(_x_key, value2): what the bigrams that aren't counted ahead add to each text's score.

    A task adds up what its rows give to each text of a chunk, and sends the sums as arrays, one for each of ``parts``
    of the chunks, where the keys of the chunks' texts come too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, m = model.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunks, place and number of each text, its gain
        size = 0

        def row(part: int, chunks: np.ndarray, times: bytes, docs: bytes, value2: bytes, keys: bytes) -> tuple:
            return part, chunks.tobytes(), times, docs, value2, keys

        def out() -> Iterator[pa.RecordBatch]:
            chunk, place = np.unique(np.concatenate([c for c, _, _ in held]), return_inverse=True)
            part = (mix(chunk.view(np.uint64)) % U(parts)).astype(np.int64)
            rank = np.argsort(part, kind="stable")
            to = np.empty(chunk.size, np.int64)
            to[rank] = np.arange(chunk.size)
            place = np.split(to[place], np.cumsum([c.size for c, _, _ in held])[:-1])
            text, at = np.unique(np.concatenate([p[t >> 15] << 15 | t & 0x7FFF for p, (_, t, _) in zip(place, held)]), return_inverse=True)
            gain = np.bincount(at, np.concatenate([g for _, _, g in held]), text.size)
            chunk, part = chunk[rank], part[rank]
            cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), part.size)
            span = np.searchsorted(text, cut << 15)
            times = np.bincount(text >> 15, minlength=chunk.size).astype(np.int32)
            yield from batch([row(int(part[a]), chunk[a:b], times[a:b].tobytes(), _planes((text[x:y] & 0x7FFF).astype(np.uint16)), gain[x:y].tobytes(), b"")
                              for a, b, x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), span[:-1].tolist(), span[1:].tolist())])

        def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                                 names=["part", "chunks", "times", "docs", "value2", "keys"])

        for b in batches:
            for r in b.to_pylist():  # a row at a time: its arrays go before the next one's come
                chunks = np.frombuffer(r["chunks"], np.int64)
                if r["keys"]:
                    part = int(mix(chunks.view(np.uint64))[0] % U(parts))
                    yield from batch([row(part, chunks, b"", b"", b"", r["keys"])])
                    continue
                pair, c = _unplanes(r["pairs"], np.int64), _unplanes(r["counts"], np.int64)
                gain = np.repeat(m.gain(u, pair, c), _unplanes(r["times"], np.int32))
                text = _unplanes(r["places"], np.uint32).astype(np.int64) << 15 | _unplanes(r["docs"], np.uint16)
                text, at = np.unique(text, return_inverse=True)
                held.append((chunks, text, np.bincount(at, gain, text.size)))
                size += text.size
                if size >= 2 * CHUNK:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
        release()

    def add(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        texts = {r["chunks"]: np.frombuffer(r["keys"], np.int64) for r in rows if r["keys"]}
        names = np.frombuffer(b"".join(texts), np.int64)
        key = np.concatenate([np.empty(0, np.int64), *texts.values()])
        begin = np.cumsum([0, *[k.size for k in texts.values()]])[:-1]
        order = np.argsort(names)
        text, gain = [np.empty(0, np.int64)], [np.empty(0)]
        for r in rows:
            if not r["keys"]:
                chunk = np.frombuffer(r["chunks"], np.int64)
                i = order[np.minimum(np.searchsorted(names, chunk, sorter=order), names.size - 1)] if names.size else order
                if i.size != chunk.size or (names[i] != chunk).any():
                    raise RuntimeError("a chunk's texts are missing: its rows came in another order when a lost task was run again")
                text.append(np.repeat(begin[i], np.frombuffer(r["times"], np.int32)) + _unplanes(r["docs"], np.uint16))
                gain.append(np.frombuffer(r["value2"], np.float64))
        total = np.bincount(np.concatenate(text), np.concatenate(gain), key.size).astype(float)  # integers where nothing was gained
        return pa.table({"_x_key": pa.array(key), "value2": pa.array(total)})

    rows = bigrams.where((F.length("docs") > 0) | (F.length("keys") > 0))
    sums = rows.mapInArrow(run, "part long, chunks binary, times binary, docs binary, value2 binary, keys binary")
    return sums.groupBy("part").applyInArrow(add, "_x_key long, value2 double")


def _gains(rows: DataFrame, of, names: list[str], model, parts: int) -> DataFrame:
    """(_x_key, *names): sums over texts of what ``of`` gives for each row.

    A task adds up what its rows give to each text, and sends the sums as arrays, one for each of ``parts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, m = model.value
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = [np.bincount(place, np.concatenate([g[i] for _, g in held]), key.size) for i in range(len(names))]
            part = (mix(key.view(np.uint64)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            spans = list(zip(cut.tolist(), [*cut[1:].tolist(), key.size]))
            cols = [pa.array([x[order][a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, *total)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), *cols], names=["part", "keys", *names])

        for b in batches:
            for r in b.to_pylist():  # a row at a time: its arrays go before the next one's come
                held.append(of(u, m, r))
                size += held[-1][0].size
                if size >= 2 * CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
        release()

    def add(t: pa.Table) -> pa.Table:
        key, *sums = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("keys", np.int64), *((n, np.float64) for n in names)))
        own, place = np.unique(key, return_inverse=True)
        return pa.table({"_x_key": pa.array(own)} | {n: pa.array(np.bincount(place, x, own.size)) for n, x in zip(names, sums)})

    sums = rows.mapInArrow(run, "part long, keys binary, " + ", ".join(f"{n} binary" for n in names))
    return sums.groupBy("part").applyInArrow(add, "_x_key long, " + ", ".join(f"{n} double" for n in names))


def _tables(d: DataFrame, id_col: str, vocabulary: int | None, head: int) -> tuple[Unigrams, DataFrame, DataFrame, DataFrame]:
    """The written tables: sums per text, gains per text of the bigrams that aren't counted ahead, sums of rare words."""
    spark = d.sparkSession
    words = materialize(_count_words(d), "katz-unigrams")
    u = unigrams(words, head if vocabulary is None else vocabulary)
    shared = spark.sparkContext.broadcast(u)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = _entries(d, shared, max(width, -(-u.n // CHUNK)))  # a bucket holds about CHUNK tokens
    bigrams = entries.groupBy("bucket").applyInArrow(_counted, ", ".join(f"{k} binary" for k in _BIGRAMS))
    bigrams = materialize(bigrams, "katz-bigrams")
    rare = _rare(d, words, shared, max(width, -(-(u.n - int(u.counts.sum())) // ROW)), vocabulary is None)
    rare = materialize(rare, "katz-rare")
    model = spark.sparkContext.broadcast((u, backoff(bigrams, rare, u, shared)))
    texts = materialize(_text_sums(d, id_col, model), "katz-texts")
    gains = materialize(_bigram_gains(bigrams, model, max(width, u.n // (16 * CHUNK))), "katz-gains")
    tail = materialize(_gains(rare, _of_rare, ["value2", "base2", "known2"], model, width), "katz-tail-gains")
    return u, texts, gains, tail


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
          vocabulary: int | None = None, head: int = HEAD) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows not held out are learned from.

    Every bigram counts, unless ``vocabulary`` is given. ``head`` bounds the broadcast table and changes no result.
    """
    if max(vocabulary or 0, head) > (1 << 20) - 2:
        raise ValueError("codes of words have 20 bits")
    held = is_held_out(id_col, 1) if held_out is None else F.coalesce(held_out, F.lit(False))
    # texts are told apart by a hash of id and text; sums of rows that share it are divided by their number
    d = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).alias("_x_text"),
                    F.xxhash64(F.col(id_col), F.col(text_col)).alias("_x_key"))
    spark = docs.sparkSession
    with small_batches(spark):
        u, texts, gains, tail = _tables(d, id_col, vocabulary, head)
    none = F.lit(0.0)
    one = texts.select("_x_key", F.lit(1).cast("long").alias("m"), none.alias("value2"), none.alias("base2"), none.alias("known2"))
    gains = gains.select("_x_key", F.lit(0).cast("long").alias("m"), "value2", none.alias("base2"), none.alias("known2"))
    tail = tail.select("_x_key", F.lit(0).cast("long").alias("m"), "value2", "base2", "known2")
    sums = one.unionByName(gains).unionByName(tail).groupBy("_x_key").agg(*[F.sum(k).alias(k) for k in ("m", "value2", "base2", "known2")])
    return texts.join(sums, "_x_key").select(
        F.col(id_col), "held_out", "n_tokens", (F.col("known") + F.round(F.col("known2") / F.col("m")).cast("long")).alias("n_known"),
        F.lit(u.n).cast("long").alias("train_tokens"), (F.col("base") + F.col("base2") / F.col("m")).alias("base_score"),
        (F.col("value") + F.col("value2") / F.col("m")).alias("score"))
