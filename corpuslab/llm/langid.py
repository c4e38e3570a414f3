"""Operator 3: language of words and documents by a linear-chain conditional random field.

A word's features are its byte n-grams of 2 to 4 with the gaps around it (so those with a gap
are its affixes) and the whole word (lexicon), hashed into ``2 ** BITS`` rows of weights per language.
Transitions between the languages of neighbouring words are weights too. All are learned together by
gradient steps on the conditional likelihood (forward-backward).

Training data: of at most ``DOCS`` documents per language (those with the smallest hashes of
their ids) up to ``WINDOWS`` runs of ``RUN`` words each, strung together in a seeded order into code-switched
sequences; words carry their document's language.

Prediction: forward-backward over the whole text gives each word's marginals. A document's
language is the one with the largest sum over words that hold a letter; the score is its mean. Texts of
a batch take each step of the chain together.

Defined cases: null text or text without a letter gives ``und`` with score 0; null lang isn't
learned from; without any language all predictions are ``und``; every language that occurs is learned; ties go to the first language in code point order; repeated rows
get the same answer; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, is_held_out, texts_of
from .words import BASE, IS_WS, LOWER, U, Words

BITS, DOCS, WINDOWS, RUN = 18, 400, 3, 40
SEQUENCE, STEPS, RATE, RIDGE = 96, 30, 0.25, 1e-6
#: Groups in which a language's candidates for the sample are ranked before all together.
_DEALS = 1024
_LETTER = re.compile(r"[^\W\d_]")
_SHIFT = U(64 - BITS)
_SPREAD = [U((2 * k + 1) * int(BASE) % 2**64) for k in range(4)]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # 2 ** BITS + 1 rows (the last is 0), one column per language
    moves: np.ndarray  # log weights of transitions


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0 to U+00DE in lower case."""
    x = LOWER[data]
    if x.size > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        x[latin] += 32
    return x


class Features:
    """Rows of the weight table for each byte position, for words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        # one gap before each text and at the end, so that each word has a gap on both sides
        n, texts_n = w.data.size, w.count.size
        data = np.full(n + texts_n + 1, 32, np.uint8)
        text_of = np.repeat(np.arange(texts_n), np.diff(w.off))
        data[np.arange(n) + text_of + 1] = _lowered(w.data)
        data[IS_WS[data]] = 32
        self.start = w.start + w.doc() + 1  # first byte of each word
        self.data = data
        x, gap = data.astype(np.uint64) + U(1), data == 32
        none = 1 << BITS
        self.rows = []
        h = x
        for k in (1, 2, 3):
            h = h[:-1] * BASE + x[k:]
            inner = gap[:-1] & gap[1:] if k == 1 else gap[1:-1] if k == 2 else gap[1:-2] | gap[2:-1]
            row = ((h * _SPREAD[k]) >> _SHIFT).astype(np.int32)
            row[inner] = none
            self.rows.append(row)
        self.whole = ((w.hashes() * BASE) >> _SHIFT).astype(np.int32)
        used = (data >= 128) | ((data >= 97) & (data <= 122))
        total = np.concatenate([[0], np.cumsum(used)])
        self.lettered = total[self.start + w.length] > total[self.start]

    def emissions(self, weights: np.ndarray, most: int = 1 << 19) -> np.ndarray:
        """Sums of weights per word, a slice of words at a time."""
        out = np.empty((self.start.size, weights.shape[1]), np.float32)
        most = most * 4 // max(weights.shape[1], 4)
        a = 0
        while a < self.start.size:
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + most)))
            lo = self.start[a] - 1
            hi = self.start[b] - 1 if b < self.start.size else self.data.size - 1
            value = weights[self.rows[0][lo:hi]]
            for row in self.rows[1:]:
                part = row[lo:hi]
                value[:part.size] += weights[part]
            out[a:b] = np.add.reduceat(value, self.start[a:b] - 1 - lo, axis=0)
            a = b
        return out + weights[self.whole]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, row) of every feature."""
        edge = np.append(self.start - 1, self.data.size - 1)
        of = np.full(self.data.size, -1, np.int64)
        of[edge[0]:edge[-1]] = np.repeat(np.arange(self.start.size), np.diff(edge))
        word, row = [np.arange(self.start.size)], [self.whole]
        for r in self.rows:
            ok = (r < 1 << BITS) & (of[:r.size] >= 0)
            word.append(of[:r.size][ok])
            row.append(r[ok])
        return np.concatenate(word), np.concatenate(row)


def marginals(emissions: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """P(language) of each word given its whole text, by scaled forward-backward.

    ``first[i]:first[i + 1]`` are the words of text i. ``pairs``, if given, gains the expected transitions.
    """
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if emissions.size else emissions
    a_mat = np.exp(moves).astype(e.dtype)
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    at, size = first[:-1][order], count[order]
    longest = int(size[0]) if size.size else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t words
    forward, backward = np.empty_like(e), np.ones_like(e)
    prev = None
    for t in range(longest):
        m = int(alive[t])
        now = e[at[:m] + t]
        if prev is not None:
            now = now * (prev[:m] @ a_mat)
        now /= now.sum(axis=1, keepdims=True)
        forward[at[:m] + t] = now
        prev = now
    for t in range(longest - 2, -1, -1):
        m = int(alive[t + 1])  # texts that go on after t
        nxt = e[at[:m] + t + 1] * backward[at[:m] + t + 1]
        if pairs is not None:
            left = forward[at[:m] + t]
            pairs += a_mat * ((left / ((left @ a_mat) * nxt).sum(axis=1, keepdims=True)).T @ nxt)
        now = nxt @ a_mat.T
        backward[at[:m] + t] = now / now.sum(axis=1, keepdims=True)
    out = forward * backward
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def fit(runs: list[tuple[str, list[str]]], seed: int = 3) -> Model:
    """Learn from (language, runs of words); runs are strung together in a seeded order.

    Steps go over the sequences in parts, smaller ones with more languages, so that only the weights grow with these.
    """
    langs = sorted({lang for lang, _ in runs})
    k, place = len(langs), {lang: j for j, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    words, gold = [], []
    for i in rng.permutation(len(runs)).tolist():
        lang, run = runs[i]
        words += run
        gold += [place[lang]] * len(run)
    rows, size = len(words), SEQUENCE * max(1, 8192 // max(k, 4))

    def part(a: int) -> tuple[Features, np.ndarray, np.ndarray]:
        features = Features(pa.array([" ".join(words[c:min(c + SEQUENCE, a + size)]) for c in range(a, min(a + size, rows), SEQUENCE)], pa.string()))
        return features, *features.pairs()

    first = part(0)
    weights, moves = np.zeros(((1 << BITS) + 1, k), np.float32), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    gold = np.array(gold)
    real = np.zeros((k, k))
    for c in range(0, rows, SEQUENCE):
        g = gold[c:c + SEQUENCE]
        np.add.at(real, (g[:-1], g[1:]), 1)
    for _ in range(STEPS):
        expected, grads = np.zeros((k, k)), np.zeros((k, (1 << BITS) + 1))
        for a in range(0, rows, size):
            features, word, row = part(a) if a else first
            off = marginals(features.emissions(weights), features.words.first, moves, expected)
            off[np.arange(len(off)), gold[a:a + size]] -= 1
            off /= rows
            for j in range(k):
                grads[j] += np.bincount(row, off[word, j], (1 << BITS) + 1)
        for j in range(k):
            grad = grads[j] + RIDGE * weights[:, j]
            seen_w[:, j] += grad * grad
            weights[:, j] -= (RATE * grad / np.sqrt(seen_w[:, j])).astype(np.float32)
        grad = (expected - real) / rows
        seen_m += grad * grad
        moves -= RATE * grad / np.sqrt(seen_m)
    weights[-1] = 0
    return Model(langs, weights, moves)


def _first_ids(known: DataFrame, id_col: str, lang_col: str, most: int = DOCS) -> DataFrame:
    """Of each language the ``most`` rows whose ids have the smallest hashes.

    A task sends on no more than ``most`` ids of a language; these are ranked in ``_DEALS`` groups first (by the task they come from,
    which doesn't change the result), so that no task gets those of all tasks.
    """
    rows = known.withColumn("_x_deal", F.spark_partition_id() % _DEALS)
    for keys in ([lang_col, "_x_deal"], [lang_col]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col), id_col)
        rows = rows.withColumn("_x_n", F.row_number().over(order)).where(F.col("_x_n") <= most).drop("_x_n")
    return rows.drop("_x_deal")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          usable: Column | None = None) -> Model:
    """A model from documents with a language; ``usable`` says which rows may be learned from (default: those not held out)."""
    usable = ~is_held_out(id_col, 0) if usable is None else usable
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & usable)
    picked = _first_ids(known.select(F.col(id_col), F.col(lang_col)), id_col, lang_col)
    # at most DOCS ids a language: small enough to broadcast at any size of the corpus
    sample = docs.join(F.broadcast(picked.distinct()), [id_col, lang_col]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            texts = texts_of(b.column("text"))
            w = Words(texts)
            out: list[tuple[str, list[str]]] = []
            for lang, a, z in zip(b.column("lang").to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                for at in range(a, z, max(RUN, (z - a) // WINDOWS + 1)):
                    out.append((lang, [w.text(i).decode("utf-8", "replace") for i in range(at, min(at + RUN, z))]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.string()))], names=["lang", "words"])

    found = sample.mapInArrow(runs, "lang string, words array<string>").collect()
    rows = sorted((r["lang"], r["words"]) for r in found if r["words"])
    return fit(rows) if rows else Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros((0, 0)))


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True,
        most: int = 2 << 20) -> DataFrame:
    """Per row: id, lang_pred, score and, if asked for, spans: runs of words of one language (lang, first word, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_x_text"))
    fields = [slim.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])
        fields.append(T.StructField("spans", T.ArrayType(span)))
    schema = T.StructType(fields)
    arrow_span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in by_bytes(batches, "_x_text", most * 4 // max(len(m.langs), 4)):
            texts = texts_of(b.column("_x_text"))
            has_letter = np.array([bool(_LETTER.search(t)) for t in texts.to_pylist()], bool) & bool(m.langs)
            if m.langs:
                f = Features(texts)
                p = marginals(f.emissions(m.weights), f.words.first, m.moves)
                total = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(np.where(f.lettered[:, None], p, 0), axis=0, dtype=np.float64)])
                sums = total[f.words.first[1:]] - total[f.words.first[:-1]]
                best = sums.argmax(axis=1)
                mean = sums[np.arange(len(best)), best] / np.maximum(sums.sum(axis=1), 1e-12)
            else:
                best, mean = np.zeros(len(texts), int), np.zeros(len(texts))
            names = [m.langs[j] if ok else "und" for j, ok in zip(best.tolist(), has_letter.tolist())]
            cols = [b.column(id_col), pa.array(names, pa.string()), pa.array(np.clip(np.where(has_letter, mean, 0.0), 0, 1))]
            if spans:
                label = p.argmax(axis=1) if m.langs else np.empty(0, int)
                found = []
                for a, z in zip(f.words.first[:-1].tolist(), f.words.first[1:].tolist()) if m.langs else [(0, 0)] * len(texts):
                    cut = [0, *(np.flatnonzero(np.diff(label[a:z])) + 1).tolist(), z - a] if z > a else [0]
                    found.append([{"lang": m.langs[label[a + i]], "first": i, "words": j - i} for i, j in zip(cut, cut[1:])])
                cols.append(pa.array(found, arrow_span))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return slim.mapInArrow(run, schema)
