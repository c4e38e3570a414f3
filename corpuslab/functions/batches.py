"""The baseline tagger on Arrow batches: the tokens of many texts at a time, without a row or a lambda for each.

Spark cuts a text into pieces (``pieces``: one regex over the whole text, so what a token is stays with Java's
character classes); a piece is a token, and a terminator takes the white space after it along. Distinct pieces are
tagged once a language and worker, and everything else is arithmetic on their numbers.

A sentence ends with a run of terminators (``text.SENT_RE``): at one that white space or another token follows; a run
that the text begins with belongs to the first sentence (``lead``). The tags are those of ``tagger.number_sql``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import NOUN_CAPITALISING_LANGS, lexicon_rows, suffix_rules
from .tagger import tag_values

PIECE_RE = r"[\p{L}\p{N}_]+|[.!?]\s|[^\p{L}\p{N}_\s]"
TERMINATORS = ".!?"
#: Tokens that are worked on at a time (or one document), and distinct words that a worker keeps the tags of.
STEP, KNOWN = 1 << 19, 1 << 19


def pieces(text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(PIECE_RE), F.lit(0))


def lead(text: str = "text") -> Column:
    """Whether the text begins with a terminator."""
    return F.col(text).rlike("^[.!?]")


def _is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


@lru_cache(maxsize=None)
def _rules() -> dict:
    """Per language (None: any without lexicon and rules): entries by form, suffixes with their numbers, whether nouns are capitalised."""
    first = 5 + len(suffix_rules())
    langs = dict.fromkeys([None, *(r[0] for r in lexicon_rows()), *(r[0] for r in suffix_rules()), *NOUN_CAPITALISING_LANGS])
    return {lang: ({r[1]: i for i, r in enumerate(lexicon_rows(), first) if r[0] == lang},
                   [(r[1], i) for i, r in enumerate(suffix_rules(), 5) if r[0] == lang], lang in NOUN_CAPITALISING_LANGS) for lang in langs}


def numbers(lang: str | None, token: str) -> tuple[int, int]:
    """The number in ``tag_values`` of a token that a sentence begins with, and elsewhere."""
    entries, suffixes, nouns = _rules()[lang]
    if len(token) == 1 and not _is_word(token):
        return 1, 1
    if all(unicodedata.category(c)[0] == "N" for c in token):
        return 2, 2
    low = token.lower()
    if low in entries:
        return entries[low], entries[low]
    capital = token != low and token[0] != token[0].lower()
    if capital and nouns:
        return 3, 3
    found = next((i for suffix, i in suffixes if low.endswith(suffix) and len(low) >= len(suffix) + 2), 3)
    return found, 4 if capital else found


@lru_cache(maxsize=None)
def _known() -> dict[str | None, dict[str, tuple[int, int]]]:
    """A worker's tags: by language and token."""
    return {lang: {} for lang in _rules()}


@dataclass
class Tokens:
    """The tokens of some documents, one after the other.

    ``docs``: where each document's tokens begin (and the end); ``starts``: where each sentence begins; ``sentences``: how many
    a document has; ``code``: a token's place in ``texts``, which are distinct; ``number``: its place in ``tag_values``, from 1;
    ``root``: where each sentence's root is.
    """

    docs: np.ndarray
    starts: np.ndarray
    sentences: np.ndarray
    code: np.ndarray
    texts: list[str]
    number: np.ndarray
    root: np.ndarray


def offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list's values begin in ``lists.flatten()``, and the end; null lists are empty."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)])


def steps(docs: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` tokens (or one document) together."""
    a, most = 0, most or STEP
    while a < len(docs) - 1:
        b = max(a + 1, int(np.searchsorted(docs, docs[a] + most, "right")) - 1)
        yield a, b
        a = b


def coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """The number of each value and the distinct values; null: -1."""
    d = values.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def tagged(lang: pa.Array, words: pa.ListArray, leads: pa.Array) -> Tokens:
    """The tagged tokens of documents from their languages, pieces and ``lead``."""
    docs, (code, found) = offsets(words), coded(words.flatten())
    n, total = len(docs) - 1, len(code)
    texts = [p[0] if p[0] in TERMINATORS else p for p in found]
    stop = np.fromiter((p[0] in TERMINATORS for p in found), bool, len(found))[code]
    spaced = np.fromiter((p[0] in TERMINATORS and len(p) > 1 for p in found), bool, len(found))[code]
    of = np.repeat(np.arange(n), np.diff(docs))  # a token's document
    full = np.diff(docs) > 0
    last = np.zeros(total, bool)
    last[docs[1:][full] - 1] = True
    ends = stop & (spaced | last | ~np.append(stop[1:], False))
    at = np.flatnonzero(ends)
    if len(at):
        first = at[np.unique(of[at], return_index=True)[1]]
        began = leads.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        ends[first[began[of[first]]]] = False
    begins = np.zeros(total, bool)
    begins[docs[:-1][full]] = True
    begins[1:] |= ends[:-1]
    starts = np.flatnonzero(begins)

    # tags: once for each language and distinct token
    known, langs = _known(), list(_rules())
    place = {x: i for i, x in enumerate(langs)}
    own = np.array([place.get(x, 0) for x in lang.to_pylist()], np.int64)
    d = max(1, len(texts))
    key = own[of] * d + code
    used = np.zeros(len(langs) * d, bool)
    used[key] = True
    used = np.flatnonzero(used)
    table = np.zeros((len(langs) * d, 2), np.int16)
    rows = []
    for k in used.tolist():
        memo, token = known[langs[k // d]], texts[k % d]
        got = memo.get(token)
        if got is None:
            if len(memo) >= KNOWN:
                memo.clear()
            got = memo[token] = numbers(langs[k // d], token)
        rows.append(got)
    if rows:
        table[used] = rows
    number = np.where(begins, table[key, 0], table[key, 1])

    # root: the first verb, else the first token that isn't punctuation, else the first one
    root = starts
    if total:
        verbs, any_, far = np.array([False, *(v[0] == "VERB" for v in tag_values())]), np.arange(total), total
        verb = np.minimum.reduceat(np.where(verbs[number], any_, far), starts)
        word = np.minimum.reduceat(np.where(number != 1, any_, far), starts)
        root = np.where(verb < far, verb, np.where(word < far, word, starts))
    return Tokens(docs, starts, np.bincount(of[starts], minlength=n), code, texts, number, root)
