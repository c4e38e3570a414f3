"""F23's measures straight from texts, on Arrow batches: the same numbers as ``stylistics.document_measures``.

A batch's tokens are numbers (``functions.batches``), so measures are counts and sums over arrays: what a tag adds to which
measure stands in one table, distinct words and lemmas are distinct pairs of numbers. Sums over a document run in its order.
A batch is worked on some documents at a time (``batches.STEP`` tokens, or one document).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import Tokens, offsets, steps, tagged
from ..functions.lexicon import FUNCTION_WORD_POS, NOMINAL_POS, NON_WORD_POS, lexicon_rows, polarity_words, suffix_rules
from ..functions.tagger import tag_values

COUNTS = ("words", "noun", "verb", "adj", "adv", "nominal", "voiced", "passive", "active", "past", "present", "prs", "function", "of", "that")


@lru_cache(maxsize=None)
def _table(of_words: tuple, that_words: tuple) -> np.ndarray:
    """[number in ``tag_values``, place in ``COUNTS``]: whether a token with this number counts."""
    first, out = 5 + len(suffix_rules()), np.zeros((len(tag_values()) + 1, len(COUNTS)), np.int64)
    for k, (pos, morph, _lemma) in enumerate(tag_values(), 1):
        m, form = morph or "", lexicon_rows()[k - first][1] if k >= first else None
        verb, active, passive = pos == "VERB", "Voice=Act" in m, "Voice=Pass" in m
        has = {"words": pos not in NON_WORD_POS, "noun": pos == "NOUN", "verb": verb, "adj": pos == "ADJ", "adv": pos == "ADV",
               "nominal": pos in NOMINAL_POS, "voiced": verb and (active or passive), "passive": verb and passive, "active": verb and active,
               "past": verb and "Tense=Past" in m, "present": verb and "Tense=Pres" in m, "prs": pos == "PRON" and "PronType=Prs" in m,
               "function": pos in FUNCTION_WORD_POS, "of": pos == "ADP" and form in of_words, "that": pos == "SCONJ" and form in that_words}
        out[k] = [has[x] for x in COUNTS]
    return out


def _polar(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many positive and negative words each lower-case token has: itself, unless lower case has brought in other characters."""
    words, out = polarity_words(), np.zeros((2, len(low)), np.int64)
    for own, into in zip((set(words["positive"]), set(words["negative"])), out):
        for k, x in enumerate(low):
            if x in own:
                into[k] = 1
            elif not x.isascii() and not x.isalnum():
                into[k] = sum(r in own for r in "".join(c if c.isalnum() or c == "_" else " " for c in x).split(" "))
    return out[0], out[1]


def _cost(texts: list[str], cost: str) -> np.ndarray:
    n = np.array([len(x) for x in texts], np.int64)
    return {"subword": 2 + -(-n // 4), "chars": n, "words": np.ones_like(n)}[cost]


def _distinct(group: np.ndarray, value: np.ndarray, groups: int, values: int) -> np.ndarray:
    """How many different values each group has."""
    return np.bincount(np.unique(group * values + value) // values, minlength=groups)


def _mean_std(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(doc, minlength=n)
    mean = np.bincount(doc, values, n) / size
    return mean, np.sqrt(np.bincount(doc, (values - mean[doc]) ** 2, n) / size)


def _measures(t: Tokens, legacy_swap: bool, sentiment: bool, selected: bool, of_words, that_words, skip: int, take: int, long_doc: int,
              max_len: int, cost: str, window: int = 100) -> tuple[dict[str, np.ndarray], list]:
    """Measures of each document (not finite: null) and the text that goes into its compression ratio."""
    n, total, texts = len(t.docs) - 1, len(t.code), t.texts
    size = np.diff(t.docs)
    of = np.repeat(np.arange(n), size)
    table = _table(tuple(of_words), tuple(that_words))
    kinds = len(table)
    c = dict(zip(COUNTS, (np.bincount(of * kinds + t.number, minlength=n * kinds).reshape(n, kinds) @ table).T))
    lens = np.array([len(x) for x in texts], np.int64)

    at = np.flatnonzero(table[t.number, 0])  # words
    wof, wcode, nw = of[at], t.code[at], c["words"]
    chars = np.bincount(wof, lens[wcode], n)
    whole, parts = nw <= window, np.where(nw == 0, 0, np.where(nw <= window, 1, nw // window))
    seg = np.where(whole[wof], 0, (np.arange(len(at)) - (np.cumsum(nw) - nw)[wof]) // window)
    fits = seg < parts[wof]
    seg_doc = np.repeat(np.arange(n), parts)
    types = _distinct(((np.cumsum(parts) - parts)[wof] + seg)[fits], wcode[fits], len(seg_doc), max(1, len(texts)))
    share = np.bincount(seg_doc, types / np.where(whole, nw, float(window))[seg_doc], n)
    msttr = np.where(nw == 0, 0.0, np.where(whole, share, share / parts))

    # lemmas: an entry's, else the lower-case form
    low, first = [x.lower() for x in texts], 5 + len(suffix_rules())
    known: dict[str, int] = {}
    by_code = np.array([known.setdefault(x, len(known)) for x in low], np.int64)
    by_entry = np.array([0] * first + [known.setdefault(v[2] or "", len(known)) for v in tag_values()[first - 1:]], np.int64)

    def lemmas(kind: str) -> np.ndarray:
        own = np.flatnonzero(table[t.number, COUNTS.index(kind)])
        k = t.number[own]
        return _distinct(of[own], np.where(k >= first, by_entry[k], by_code[t.code[own]]), n, max(1, len(known)))

    # sentences
    sdoc = np.repeat(np.arange(n), t.sentences)
    ends = np.append(t.starts[1:], total)
    slen = ends - t.starts
    kept, place = t.number != 1, np.arange(total)
    if total:
        nk = np.add.reduceat(kept.astype(np.int64), t.starts)
        dd = np.add.reduceat(np.where(kept, np.abs(place - np.repeat(t.root, slen)), 0), t.starts)
        begin = np.minimum.reduceat(np.where(kept, place, total), t.starts)
    else:
        nk = dd = begin = np.zeros(0, np.int64)
    ok = nk > 0
    mdd = dd[ok] / nk[ok]
    far = (t.root - begin)[ok]
    some = (mdd > 0) & (far >= 0)
    ndd = np.abs(np.log(mdd[some] / np.sqrt((far[some] + 1.0) * nk[ok][some])))
    avg_mdd, std_mdd = _mean_std(mdd, sdoc[ok], n)
    avg_ndd, std_ndd = _mean_std(ndd, sdoc[ok][some], n)

    verbs, act, pas = c["verb"], *(("passive", "active") if legacy_swap else ("active", "passive"))
    out = {
        "nominal_verb_ratio": (c["nominal"] + c["noun"]) / verbs, "msttr": msttr, "noun_ttr": lemmas("noun") / c["noun"],
        "verb_ttr": lemmas("verb") / verbs, "personal_pronoun_ratio": c["prs"] / size, "function_word_ratio": c["function"] / size,
        "of_ratio": c["of"] / size, "that_ratio": c["that"] / size, "past_tense_ratio": np.where(c["past"] > 0, c["past"] / verbs, math.nan),
        "present_tense_ratio": np.where(c["present"] > 0, c["present"] / verbs, math.nan), "passive_ratio": c[pas] / c["voiced"],
        "active_ratio": c[act] / c["voiced"], "adjective_adverb_ratio": (c["adj"] + c["adv"]) / nw, "avg_wordlen": chars / nw,
        "avg_sentlen": np.bincount(sdoc, slen, n) / t.sentences, "num_sents": t.sentences, "avg_ndd": avg_ndd, "std_ndd": std_ndd,
        "avg_mdd": avg_mdd, "std_mdd": std_mdd,
    }
    if sentiment:
        costs = _cost(texts, cost)[t.code]
        more = []
        for s in np.flatnonzero(np.add.reduceat(costs, t.starts) > max_len) if total else ():
            run, a, done = np.cumsum(costs[t.starts[s]:ends[s]]), 0, 0
            while (a := max(a + 1, int(np.searchsorted(run, done + max_len, "right")))) < slen[s]:
                more.append(t.starts[s] + a)
                done = run[a - 1]
        chunks = np.sort(np.concatenate([t.starts, np.array(more, np.int64)]))
        p, q = (np.add.reduceat(h[t.code], chunks) for h in _polar(low)) if total else (np.zeros(0), np.zeros(0))
        score = np.where(p == q, 0.0, (p - q) / np.maximum(p + q, 1))
        cdoc = of[chunks]
        many = np.bincount(cdoc, minlength=n)
        mean, std = _mean_std(score, cdoc, n)
        single = many < 2
        out |= {"sentiment": (score, many), "sentiment_mean": np.where(single, math.nan, mean), "sentiment_std": np.where(single, math.nan, std),
                "sentiment_abs": np.where(single, math.nan, np.bincount(cdoc, np.abs(score), n) / many)}
    joined: list = [None] * n
    if selected:
        before = np.cumsum(t.sentences) - t.sentences
        bounds = np.append(t.starts, total)
        for k in np.flatnonzero(t.sentences):
            a, many_sents = (skip if t.sentences[k] > long_doc else 0), int(t.sentences[k])
            a, b = min(a, many_sents), min(a + take, many_sents)
            joined[k] = " ".join([texts[x] for x in t.code[bounds[before[k] + a]:bounds[before[k] + b]].tolist()])
    return out, joined


def schema(sentiment: bool) -> T.StructType:
    double, names = T.DoubleType(), ["nominal_verb_ratio", "msttr", "noun_ttr", "verb_ttr", "personal_pronoun_ratio", "function_word_ratio", "of_ratio",
                                     "that_ratio", "past_tense_ratio", "present_tense_ratio", "passive_ratio", "active_ratio",
                                     "adjective_adverb_ratio", "avg_wordlen", "avg_sentlen", "num_sents", "avg_ndd", "std_ndd", "avg_mdd", "std_mdd"]
    fields = [T.StructField(x, T.LongType() if x == "num_sents" else double) for x in names] + [T.StructField("selected_text", T.StringType())]
    if sentiment:
        fields += [T.StructField("sentiment", T.ArrayType(double)), *(T.StructField(f"sentiment_{x}", double) for x in ("mean", "std", "abs"))]
    return T.StructType(fields)


def measures_udf(sentiment: bool = True, **options):
    """A column function (lang, pieces, lead) -> struct of all measures; all null for a document without tokens."""
    out = schema(sentiment)

    @F.arrow_udf(out)
    def run(lang: pa.Array, words: pa.Array, leads: pa.Array) -> pa.Array:
        found, texts = [], []
        whole = offsets(words)
        with np.errstate(divide="ignore", invalid="ignore"):
            for a, b in steps(whole):
                values, own = _measures(tagged(lang.slice(a, b - a), words.slice(a, b - a), leads.slice(a, b - a)), sentiment=sentiment, **options)
                found.append(values)
                texts += own
        empty = np.diff(whole) == 0
        columns = []
        for f in out.fields:
            if f.name == "selected_text":
                columns.append(pa.array(texts, pa.string()))
            elif f.name == "sentiment":
                scores, many = (np.concatenate([x[f.name][i] for x in found]) if found else np.zeros(0) for i in range(2))
                at = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), mask=np.append(empty, False))
                columns.append(pa.ListArray.from_arrays(at, pa.array(scores, pa.float64())))
            else:
                x = np.concatenate([y[f.name] for y in found]) if found else np.zeros(0)
                kind = pa.int64() if f.name == "num_sents" else pa.float64()
                columns.append(pa.array(x, kind, mask=empty | ~np.isfinite(x)))  # x / 0: null
        return pa.StructArray.from_arrays(columns, names=out.names)

    return run
