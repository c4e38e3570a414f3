"""Operator 2: toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case; look-alike letters of other scripts and compatibility forms become Latin
letters; digits and signs that stand for letters become these letters inside words (numbers
alone go); invisible characters go; whatever is left between words becomes one space. A second, deeper form
also drops accents and takes ``l``, ``1`` and ``i`` for one letter; its words are set off by ``DEEP``
instead of spaces, so entries of both forms live in one automaton. The form with more matched weight counts.

Lexicon: learned from a bounded sample of labelled documents (``MAX_TOXIC`` and ``MAX_CLEAN`` rows,
those with the smallest hashes of their ids). Candidates are words and beginnings of words in both forms; how
often and in how many toxic and clean documents each occurs is counted by Spark. An entry
needs a log-likelihood ratio of documents above a limit and at least ``CONTEXTS`` different words before it in
toxic documents (a copied passage gives one); its weight is the log ratio of its rates per word.
Exception phrases are pairs of words around a match that clean documents hold and toxic ones don't; they
are keys of the same automaton, and a match inside one doesn't count.

Score: a logistic function of the matched weight per 100 words and of the matched weight,
both as log(1 + x). The limit and the function are fitted on scores from a lexicon of the other half of the sample.

Defined cases: null and empty texts score like a text without a match; null labels and ids are not learned from;
without labels of both kinds the lexicon is empty and all scores are the prior; repeated rows are scored each on
its own; an empty table gives an empty table; extra columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import by_bytes, is_held_out, n_words, texts_of

MAX_TOXIC, MAX_CLEAN = 4000, 12000
PREFIXES = (4, 5, 6, 7)
LIMITS = (8.0, 12.0, 16.0, 24.0, 40.0)
CONTEXTS, EXCEPTION_DOCS = 2, 2

#: Letters that look like Latin ones, and signs used for letters.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "һ": "h", "ь": "b", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ƒ": "f",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"


DEEP = "\x02"


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0x2100, 0x2150), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x24B6, 0x24EA)]:
        base = unicodedata.normalize("NFKD", chr(code)).lower()
        if base.isascii() and base.isalnum():
            table[code] = base
    table.update({ord(k): v for k, v in LOOK_ALIKE.items()})
    table.update({ord(c): None for c in INVISIBLE})
    return table


def _deep_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord("l"): "i", ord(" "): DEEP}
    for code in [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base != chr(code) and base.isascii() and base.isalpha():
            table[code] = base.lower().replace("l", "i")
    return table


FOLD, DEEPER = _fold_table(), _deep_table()
_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?![^\W_])")
_SIGN = re.compile(r"[@$!|]+(?=[^\W\d_])")
_DIGITS = {ord(k): v for k, v in SIGNS.items() if k.isdigit()}
_MARKS = {ord(k): v for k, v in SIGNS.items() if not k.isdigit()}
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    t = unicodedata.normalize("NFC", text) if not text.isascii() else text
    t = t.lower().translate(FOLD)
    if any(c in t for c in "@$!|"):
        t = _SIGN.sub(lambda m: m[0].translate(_MARKS), t)
    if any(c in t for c in "0123456789"):
        t = _NUMBER.sub(" ", t).translate(_DIGITS)
    t = _GAP.sub(" ", t)
    t = t.strip()
    return f" {t} " if t else " "


def forms(folded: str) -> tuple[str, str]:
    return folded, folded.translate(DEEPER)


@dataclass
class Lexicon:
    """``weights``: word with a gap on both sides, or beginning with a gap before it -> weight.

    ``exceptions``: pairs of words with gaps around and between them. Gaps are spaces, or ``DEEP`` in the deep form.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (len(k), w))
            for k in self.exceptions:
                a.add_word(k, (len(k), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Start of a matched word -> its largest weight, without those inside exception phrases."""
        a = self.automaton()
        if not len(a):
            return {}
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in a.iter(folded):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            elif w > found.get(at, 0.0):
                found[at] = w
        for a0, a1 in spared:
            for at in [x for x in found if a0 <= x < a1]:
                del found[at]
        return found

    def weight(self, folded: str) -> float:
        return max(sum(self.matches(form).values()) for form in forms(folded))


@dataclass
class Model:
    lexicon: Lexicon
    coef: tuple[float, float, float]

    def score(self, text: str) -> float:
        folded = fold(text)
        return float(_logistic(np.array([_inputs(self.lexicon.weight(folded), folded.count(" ") - 1)]) @ np.array(self.coef))[0])


def _inputs(weight: float, words: int) -> tuple[float, float, float]:
    """Constant, matched weight per 100 words, matched weight."""
    return 1.0, float(np.log1p(100 * weight / (max(words, 0) + 20))), float(np.log1p(weight))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    if y.min() == y.max():
        b[0] = 4.0 if y[0] else -4.0
        return b
    for _ in range(50):
        p = _logistic(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of a feature's documents against the sample's shares; 0 if it leans to clean ones."""
    def part(k: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(of, 1e-9)), 0)

    n, share = toxic + clean, n_toxic / max(n_toxic + n_clean, 1)
    g = 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))
    return np.where(toxic > n * share, g, 0)


def _features(docs: DataFrame, text_col: str) -> DataFrame:
    """(feature, half, toxic, before, n, o): documents with a feature and its occurrences; ``before`` is the word before the first one in a toxic document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text_col, 1 << 20):
            count: dict[tuple, list] = defaultdict(lambda: [0, 0])
            for text, toxic, half in zip(texts_of(b.column(text_col)).to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist()):
                seen: dict[str, list] = {}
                for form in forms(fold(text)):
                    gap = form[0]
                    words = form.strip(gap).split(gap)
                    for before, w in zip(["", *words], words):
                        for f in (f"{gap}{w}{gap}", *(f"{gap}{w[:k]}" for k in PREFIXES if len(w) > k)):
                            if f in seen:
                                seen[f][1] += 1
                            else:
                                seen[f] = [before, 1]
                for f, (before, times) in seen.items():
                    cell = count[f, half, toxic, before if toxic else ""]
                    cell[0] += 1
                    cell[1] += times
            keys = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.string()),
                 pa.array([count[k][0] for k in keys], pa.int64()), pa.array([count[k][1] for k in keys], pa.int64())],
                names=["feature", "half", "toxic", "before", "n", "o"])

    return docs.mapInArrow(run, "feature string, half int, toxic int, before string, n long, o long")


def _matched(docs: DataFrame, text_col: str, lexicons: dict) -> list:
    """Of each sampled document: label, half, and per lexicon the matched weight, words, and the word pairs around matches."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text_col, 1 << 20):
            rows = []
            for text, toxic, half in zip(texts_of(b.column(text_col)).to_pylist(), b.column("toxic").to_pylist(), b.column("half").to_pylist()):
                folded = fold(text)
                for (limit, learned_from), lexicon in shared.value.items():
                    if learned_from in (-1, 1 - half):
                        pairs = ()
                        if learned_from == -1:
                            pairs = {p for form in forms(folded) for at in lexicon.matches(form) for p in _around(form, at)}
                        rows.append((limit, learned_from, toxic, lexicon.weight(folded), folded.count(" ") - 1, sorted(pairs)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                             names=["limit", "learned_from", "toxic", "weight", "words", "pairs"])

    return docs.mapInArrow(run, "limit double, learned_from int, toxic int, weight double, words long, pairs array<string>").collect()


def _around(form: str, at: int) -> list[str]:
    """The pairs of the word that begins after the gap ``at`` with the words beside it."""
    gap = form[0]
    end = form.index(gap, at + 1)
    out = []
    if at > 0:
        out.append(form[form.rindex(gap, 0, at):end + 1])
    after = form.find(gap, end + 1)
    if after > 0:
        out.append(form[at:after + 1])
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          usable: Column | None = None, exceptions: tuple[str, ...] = ()) -> Model:
    """A model from labelled documents; ``usable`` says which ids may be learned from (default: those not held out)."""
    usable = ~is_held_out(id_col, 0) if usable is None else usable
    y = F.col(label_col).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & y.isin(0, 1) & usable).groupBy(id_col).agg(F.max(y).alias("toxic"))
    rank = F.xxhash64(F.col(id_col))
    picked = [known.where(F.col("toxic") == k).orderBy(rank, id_col).limit(most) for k, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = picked[0].unionByName(picked[1])
    # at most MAX_TOXIC + MAX_CLEAN ids: small enough to broadcast at any size of the corpus
    sample = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(picked), id_col)
    half = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2)).cast("int")  # copies of a text fall in one half
    sample = sample.select(text_col, "toxic", half.alias("half"))
    sample = materialize(sample, "toxicity-sample")
    totals = sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(n_words(F.col(text_col))).alias("w")).collect()
    size, words = ({(r["half"], r["toxic"]): r[k] for r in totals} for k in ("n", "w"))

    cells = [(h, t) for h in (0, 1) for t in (0, 1)]
    by_context = _features(sample, text_col).groupBy("feature", "before").agg(
        *[F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col(v)).otherwise(0)).alias(f"{v}{h}{t}") for v in "no" for h, t in cells])
    toxic_in = {"c0": F.col("n01") > 0, "c1": F.col("n11") > 0, "c": F.col("n01") + F.col("n11") > 0}
    counts = by_context.groupBy("feature").agg(*[F.sum(f"{v}{h}{t}").alias(f"{v}{h}{t}") for v in "no" for h, t in cells],
                                               *[F.count_if(v).alias(k) for k, v in toxic_in.items()])
    n1, n0 = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
    total1, total0 = max(1, size.get((0, 1), 0) + size.get((1, 1), 0)), max(1, size.get((0, 0), 0) + size.get((1, 0), 0))
    lean = (n1 + 0.5) / (n0 + 0.5) * (total0 / total1)
    rows = counts.where((F.col("c") >= CONTEXTS) & (lean > 2)).collect()  # bounded by the sampled texts

    def lexicon(limit: float, halves: tuple[int, ...]) -> Lexicon:
        """Words first, then beginnings, longest first, by what is left of them without the entries below."""
        t, c = (sum(size.get((h, y), 0) for h in halves) for y in (1, 0))
        w1, w0 = (max(1, sum(words.get((h, y), 0) for h in halves)) for y in (1, 0))
        weights: dict[str, float] = {}
        taken: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(5))
        if not t or not c:
            return Lexicon({})
        order = sorted(rows, key=lambda r: (r["feature"][-1] != r["feature"][0], -len(r["feature"]), r["feature"]))
        for r in order:
            f = r["feature"]
            have = np.array([sum(r[f"{v}{h}{y}"] for h in halves) for v in "no" for y in (1, 0)]
                            + [r["c" if len(halves) == 2 else f"c{halves[0]}"]], float)
            if f[-1] != f[0]:
                have = np.maximum(have - taken[f], 0)
            n1, n0, o1, o0, contexts = have
            if contexts < CONTEXTS or float(_ratio(np.array([n1]), np.array([n0]), t, c)[0]) < limit:
                continue
            odds = np.log((o1 + 0.5) / w1) - np.log((o0 + 0.5) / w0)
            if odds > 2:
                weights[f] = round(float(odds), 6)
                for k in range(2, len(f)):
                    taken[f[:k]] += have
        return Lexicon(weights)

    tried = {(limit, h): lexicon(limit, (h,)) for limit in LIMITS for h in (0, 1)}
    best = None
    found = defaultdict(list)
    for r in _matched(sample, text_col, tried):
        found[r["limit"]].append(r)
    for limit in LIMITS:
        if not found[limit]:
            continue
        x = np.array([_inputs(r["weight"], r["words"]) for r in found[limit]])
        label = np.array([r["toxic"] for r in found[limit]])
        b = _fit(x, label)
        p = _logistic(x @ b)
        loss = -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, limit, b)
    if best is None:
        return Model(Lexicon({}, exceptions), (-4.0, 0.0, 0.0))
    whole = lexicon(best[1], (0, 1))
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in _matched(sample, text_col, {(best[1], -1): whole}):
        for p in r["pairs"]:
            seen[p][r["toxic"]] += 1
    spared = tuple(sorted(p for p, (c, t) in seen.items() if c >= EXCEPTION_DOCS and t == 0))
    return Model(Lexicon(whole.weights, (*exceptions, *spared)), tuple(float(v) for v in best[2]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in by_bytes(batches, text_col):
            s = pa.array([m.score(t) for t in texts_of(b.column(text_col)).to_pylist()], pa.float64())
            names = [c for c in b.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), s], names=[*names, out])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all columns."""
    return score(docs, model, text_col, "_x_score").where("_x_score < 0.5").drop("_x_score")
