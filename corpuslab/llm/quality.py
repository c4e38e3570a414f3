"""Operator 7: quality rules as a short-circuit cascade.

Base measures are counted for every document. Documents that pass the base rules go through a
cascade of further rules: a document that a rule rejects isn't shown to the next ones. The
order comes from a bounded sample of documents (``SAMPLE`` rows): each rule is timed on it and
its rejections counted, and rules stand by rejections per cost, the best first. A document
is kept only if no rule rejects it, so the verdict doesn't depend on the order.

Words are runs of characters other than space and 0x09-0x0D. Defined cases: null and empty
texts have no words and fail the base rules; repeated rows are judged each on its own; an empty
table gives an empty table (the rules then keep their listed order). Extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, texts_of
from .words import BASE, IS_WS, U, Words, mix, windows

MIN_WORDS, REPEAT_PERCENT, SAMPLE = 50, 50, 500
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BANG = np.zeros(256, bool)
_BANG[np.frombuffer(b"!?", np.uint8)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CHAR = np.ones(256, bool)
_CHAR[128:192] = False  # bytes that go on with a character


def _per_text(mark: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _copies(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of the same text with equal key: is it one more than the first, and is there any other."""
    own = key ^ mix(doc.astype(np.uint64) * BASE + BASE)  # equal keys of different texts differ now
    order = np.argsort(own)
    same = np.zeros(own.size, bool)
    k = own[order]
    same[1:] = k[1:] == k[:-1]
    more, shared = np.zeros(own.size, bool), np.zeros(own.size, bool)
    more[order] = same
    any_ = same.copy()
    any_[:-1] |= same[1:]
    shared[order] = any_
    return more, shared


class Batch:
    """Some texts with what the rules look at."""

    def __init__(self, texts: pa.Array, words: Words | None = None, hashes: np.ndarray | None = None):
        self.texts, self.words = texts, words or Words(texts)
        self.hashes = self.words.hashes() if hashes is None else hashes
        self.n = self.words.count.astype(np.int64)

    def take(self, rows: np.ndarray) -> Batch:
        return Batch(self.texts.take(pa.array(rows)))

    def share(self, part: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
        return part / np.maximum(self.n if whole is None else whole, 1)

    def chars(self) -> np.ndarray:
        return _per_text(_CHAR[self.words.data] & ~IS_WS[self.words.data], self.words.off)

    def symbols(self) -> np.ndarray:
        return _per_text(_SYMBOL[self.words.data], self.words.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those equal to an earlier line of the text (byte for byte)."""
        count, again = [], []
        for t in self.texts.to_pylist():
            if "\n" not in t:
                count.append(int(not _blank(t)))
                again.append(0)
                continue
            seen: set[str] = set()
            n = 0
            for line in t.split("\n"):
                if line in seen:
                    n += 1
                elif not _blank(line):
                    n += 1
                    seen.add(line)
            count.append(n)
            again.append(n - len(seen))
        return np.array(count, np.int64), np.array(again, np.int64)

    def repeated_words(self, hashes: np.ndarray | None = None) -> np.ndarray:
        """Words inside 3-word windows that occur twice or more in the text (as written, or by the given hashes)."""
        first, n = self.words.first, len(self.words)
        grams, doc = windows(self._exact() if hashes is None else hashes, first, 3)
        if not grams.size:
            return np.zeros(self.n.size, np.int64)
        at = np.flatnonzero(_window_starts(first, n, 3))
        _, shared = _copies(grams, doc)
        begin = np.zeros(n, bool)
        begin[at[shared]] = True
        hit = begin.copy()  # and the two words after a repeated window's first
        hit[1:] |= begin[:-1]
        hit[2:] |= begin[:-2]
        inside = np.concatenate([[0], np.cumsum(hit)])
        return inside[first[1:]] - inside[first[:-1]]

    def _exact(self) -> np.ndarray:
        """Hashes that tell case apart: the number of capitals and their places change the hash."""
        w = self.words
        if not len(w):
            return self.hashes
        upper = (w.data >= 65) & (w.data <= 90)
        if not upper.any():
            return self.hashes
        place = np.arange(w.data.size, dtype=np.uint64)
        start = np.repeat(w.start, np.diff(np.append(w.start, w.data.size))).astype(np.uint64)
        value = np.zeros(w.data.size, np.uint64)
        inside = np.flatnonzero(upper)
        inside = inside[inside >= w.start[0]]
        value[inside] = mix(place[inside] - start[inside - w.start[0]] + U(7))
        return mix(self.hashes ^ np.add.reduceat(value, w.start))


def _blank(line: str) -> bool:
    return not line.strip(" \t\n\r\v\f")


def _window_starts(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """True for words at which a k-word window of the same text begins."""
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + k <= end


@dataclass(frozen=True)
class Rule:
    """``reject`` says for each text of a batch whether it goes."""

    name: str
    reject: Callable[[Batch], np.ndarray]


def _mean_word(b: Batch) -> np.ndarray:
    mean = b.share(b.chars())
    return (mean < 2) | (mean > 15)


def _symbols(b: Batch) -> np.ndarray:
    return b.share(b.symbols()) > 0.15


def _bangs(b: Batch) -> np.ndarray:
    return b.share(_per_text(_BANG[b.words.data], b.words.off)) > 0.4


def _capitals(b: Batch) -> np.ndarray:
    """Capitals of Latin scripts: A-Z, and U+00C0 to U+00DE (0xC3, then 0x80 to 0x9E)."""
    x = b.words.data
    upper = (x >= 65) & (x <= 90)
    upper[1:] |= (x[:-1] == 0xC3) & (x[1:] <= 0x9E)
    return b.share(_per_text(upper, b.words.off), b.chars()) > 0.4


def _digits(b: Batch) -> np.ndarray:
    return b.share(_per_text(_DIGIT[b.words.data], b.words.off), b.chars()) > 0.3


def _repeats(b: Batch) -> np.ndarray:
    """The base rule's limit, with capitals and small letters taken as equal."""
    return 100 * b.repeated_words(b.hashes) > REPEAT_PERCENT * b.n


def _same_lines(b: Batch) -> np.ndarray:
    count, again = b.lines()
    return (again > 2) & (again / np.maximum(count, 1) > 0.3)


def _few_types(b: Batch) -> np.ndarray:
    more, _ = _copies(b.hashes, b.words.doc())
    types = b.n - np.bincount(b.words.doc(), more, b.n.size).astype(np.int64)
    return types < 0.1 * np.minimum(b.n, 1000)


RULES = (Rule("symbols", _symbols), Rule("exclamations", _bangs), Rule("capitals", _capitals), Rule("word length", _mean_word),
         Rule("digits", _digits), Rule("repeated words", _repeats), Rule("repeated lines", _same_lines), Rule("few word types", _few_types))


def measures(b: Batch) -> dict[str, np.ndarray]:
    n, repeated = b.n, b.repeated_words()
    return {"n_words": n, "word_chars": b.chars(), "n_symbols": b.symbols(), "n_dup_lines": b.lines()[1],
            "n_repeat_words": repeated, "base_failed": (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)}


def passes(b: Batch, candidates: np.ndarray, rules: tuple[Rule, ...]) -> np.ndarray:
    """The candidates (row numbers) that no rule rejects; each rule sees what the ones before it left."""
    part = b.take(candidates)
    for rule in rules:
        if not candidates.size:
            break
        stay = ~rule.reject(part)
        if not stay.all():
            candidates = candidates[stay]
            part = part.take(np.flatnonzero(stay))
    return candidates


def ordered(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules by rejections per second on at most ``sample`` rows."""
    texts = [r[0] or "" for r in docs.select(text_col).limit(sample).collect()]
    if not texts:
        return rules
    b = Batch(pa.array(texts, pa.string()))
    gain = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = int(rule.reject(b).sum())
        gain[rule.name] = (rejected + 0.5) / (time.perf_counter() - began + 1e-6)
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
          sample: int = SAMPLE) -> DataFrame:
    """Per row: id, the base measures, base_failed, kept."""
    cascade = ordered(docs, text_col, rules, sample)
    slim = docs.select(F.col(id_col), F.col(text_col).alias("_x_text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([slim.schema[id_col], *[T.StructField(c, T.LongType()) for c in longs],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "_x_text"):
            b = Batch(texts_of(part.column("_x_text")))
            m = measures(b)
            kept = np.zeros(part.num_rows, bool)
            kept[passes(b, np.flatnonzero(~m["base_failed"]), cascade)] = True
            yield pa.RecordBatch.from_arrays([part.column(id_col), *[pa.array(m[c].astype(np.int64)) for c in longs],
                                              pa.array(m["base_failed"]), pa.array(kept)], names=schema.names)

    return slim.mapInArrow(run, schema)
