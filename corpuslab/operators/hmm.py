"""A3: part-of-speech tags by a hidden Markov model trained on any token table.

Transitions are counted between neighbouring tags of a sentence. A word's tag probabilities are its own counts,
backed off to those of its endings: P(t | ending of k letters) = (count + BACK * P(t | ending of k - 1)) /
(total + BACK), up to ``ENDING`` letters, and the word itself as the last step; an ending counts each word once.
A sentence's tags are those of the best path (Viterbi) over log P(tag | tag before) + log P(tag | word) - log P(tag).

Words stay in tables: endings are joined to distinct words (frequent endings by broadcast), which gives each word its row of
scores. Those of the ``FREQUENT`` most frequent words are sent to all tasks, beside tag by tag tables, and their tokens move as
one number (place and word); only tokens of other words carry their scores. The bound changes no result. A sentence is decoded in
one task, token by token.

Defined cases: a null word is the empty word; a null tag counts as X; ties go to the first tag in code point order;
without training rows every tag is X.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordered import attach

ENDING, BACK, SMOOTH = 5, 2.0, 0.1
#: Words whose scores all tasks hold (8 bytes a tag each).
FREQUENT = 1 << 17
#: The place of a token whose ``token_i`` is null: before all others.
NOWHERE = -(1 << 31) - 1
START = "^"


@dataclass
class Tagger:
    """``tags`` in order, their log prior, log transitions [before, tag] (the last row: sentence start); ``words`` and ``endings`` as tables (key, total, counts)."""

    tags: list[str]
    prior: np.ndarray
    moves: np.ndarray
    words: DataFrame
    endings: DataFrame


def word_form(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _vectors(pairs: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """(key, ``c``: counts by tag, ``n``: total) from (key, pos, n)."""
    c = F.array(*[F.coalesce(F.sum(F.when(F.col("pos") == t, F.col("n"))), F.lit(0)) for t in tags])
    return pairs.groupBy(key).agg(c.alias("c"), F.sum("n").alias("n"))


def transitions(tokens: DataFrame) -> DataFrame:
    """(before, pos, n): how often each tag follows another one, or the start of a sentence (``START``)."""
    t = tokens.select("doc_id", "sent_id", "token_i", F.coalesce("pos", F.lit("X")).alias("pos"))
    before = F.lag("pos").over(Window.partitionBy("doc_id", "sent_id").orderBy("token_i"))
    return t.select(F.coalesce(before, F.lit(START)).alias("before"), "pos").groupBy("before", "pos").agg(F.count(F.lit(1)).alias("n"))


def learn(tokens: DataFrame) -> Tagger:
    """A tagger from a token table (doc_id, sent_id, token_i, token_text, pos)."""
    t = tokens.select(word_form(F.col("token_text")).alias("word"), F.coalesce("pos", F.lit("X")).alias("pos"))
    moves = transitions(tokens).collect()  # tags x tags
    tags = sorted({r["pos"] for r in moves}) or ["X"]
    at = {x: i for i, x in enumerate([*tags, START])}
    m = np.full((len(tags) + 1, len(tags)), SMOOTH)
    for r in moves:
        m[at[r["before"]], at[r["pos"]]] += r["n"]
    prior = np.maximum(m.sum(0) - SMOOTH * (len(tags) + 1), 0) + SMOOTH
    pairs = materialize(t.groupBy("word", "pos").agg(F.count(F.lit(1)).alias("n")), "hmm-words")
    ends = pairs.select("pos", F.explode(F.expr(f"transform(sequence(0, least({ENDING}, length(word))), k -> right(word, k))")).alias("ending"))
    ends = ends.groupBy("ending", "pos").agg(F.count(F.lit(1)).alias("n"))
    return Tagger(tags, np.log(prior / prior.sum()), np.log(m / m.sum(1, keepdims=True)), materialize(_vectors(pairs, "word", tags), "hmm-word-counts"),
                  materialize(_vectors(ends, "ending", tags), "hmm-endings"))


def _scores(counts: list, tags: int, prior: np.ndarray) -> np.ndarray:
    """log P(tag | word) - log P(tag) from the counts of its endings, shortest first, and of the word."""
    p = np.full(tags, 1.0 / tags)
    for c in counts:
        if c is not None:
            c = np.asarray(c, float)
            p = (c + BACK * p) / (c.sum() + BACK)
    return np.log(p) - prior


def word_scores(words: DataFrame, tagger: Tagger) -> DataFrame:
    """``words`` (word, _x_n) with ``s``: a score per tag."""
    w = materialize(words.select("word", "_x_n", F.posexplode(F.expr(f"transform(sequence(0, least({ENDING}, length(word))), k -> right(word, k))"))
                                 .alias("k", "ending")), "hmm-word-endings")
    used = w.groupBy("ending").agg(F.count(F.lit(1)).alias("_x_u")).join(tagger.endings.select("ending", "c"), "ending", "left")
    known = attach(w, materialize(used, "hmm-used"), "ending", "_x_u").groupBy("word", "_x_n").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("e"))
    known = known.join(tagger.words.select("word", F.col("c").alias("own")), "word", "left")
    tags, prior = len(tagger.tags), tagger.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("e").to_pylist(), b.column("own").to_pylist())
            s = [_scores([*(x["c"] for x in e), own], tags, prior) for e, own in rows]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("_x_n"), pa.array(s, pa.list_(pa.float64()))], names=["word", "_x_n", "s"])

    return known.mapInArrow(run, "word string, _x_n long, s array<double>")


def best_path(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Tags (numbers) of the best path; ``scores`` are words x tags."""
    n, tags = scores.shape
    at, back = moves[tags] + scores[0], np.zeros((n, tags), np.int32)
    for k in range(1, n):
        ways = at[:, None] + moves[:tags]
        back[k] = ways.argmax(0)
        at = ways.max(0) + scores[k]
    out = [int(at.argmax())]
    for k in range(n - 1, 0, -1):
        out.append(int(back[k, out[-1]]))
    return out[::-1]


def tag(tokens: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, sent_id, token_i, pos) of a token table (doc_id, sent_id, token_i, token_text)."""
    t = materialize(tokens.select("doc_id", "sent_id", "token_i", word_form(F.col("token_text")).alias("word")), "hmm-tokens")
    scored = materialize(word_scores(t.groupBy("word").agg(F.count(F.lit(1)).alias("_x_n")), tagger), "hmm-scores")
    order, most = [F.desc("_x_n"), F.asc("word")], FREQUENT
    top = scored.orderBy(*order).limit(most).withColumn("k", F.row_number().over(Window.orderBy(*order)) - 1)
    top = materialize(top.select(F.col("word").alias("_x_key"), "k", "s"), "hmm-frequent")  # at most FREQUENT rows
    names, moves = tagger.tags, tagger.moves
    table = top.orderBy("k").select("s").toArrow().column("s").combine_chunks()
    shared = tokens.sparkSession.sparkContext.broadcast(table.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)))
    place, same = F.coalesce(F.col("token_i").cast("bigint"), F.lit(NOWHERE)), F.col("word") == F.col("_x_key")
    by_number = t.join(F.broadcast(top.select("_x_key", "k")), same).select("doc_id", "sent_id", (place * most + F.col("k")).alias("at"))
    # a word that isn't among them holds at most 1 / FREQUENT of all tokens
    rest = t.join(F.broadcast(top.select("_x_key")), same, "left_anti").join(scored.select("word", "s"), "word")
    both = by_number.unionByName(rest.select("doc_id", "sent_id", F.struct(place.alias("i"), "s").alias("own")), allowMissingColumns=True)
    grouped = both.groupBy("doc_id", "sent_id").agg(F.collect_list("at").alias("at"), F.collect_list("own").alias("own"))
    schema = T.StructType([*grouped.schema.fields[:2], T.StructField("t", T.ArrayType(T.StructType.fromDDL("token_i int, pos string")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                i, k = np.divmod(b.column("at").slice(r, 1).flatten().to_numpy(zero_copy_only=False), most)
                s, own = shared.value[k], b.column("own").slice(r, 1).flatten()
                if len(own):
                    i = np.concatenate([i, own.field("i").to_numpy(zero_copy_only=False)])
                    s = np.concatenate([s, own.field("s").flatten().to_numpy(zero_copy_only=False).reshape(len(own), len(names))])
                by = np.lexsort((*s.T[::-1], i)) if len(np.unique(i)) < len(i) else np.argsort(i)  # repeated places: by their scores
                out.append([{"token_i": None if x == NOWHERE else x, "pos": names[y]} for x, y in zip(i[by].tolist(), best_path(s[by], moves))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("token_i", pa.int32()), ("pos", pa.string())])))],
                                             names=schema.names)

    return grouped.mapInArrow(run, schema).select("doc_id", "sent_id", F.explode("t").alias("x")).select("doc_id", "sent_id", "x.token_i", "x.pos")


def accuracy(found: DataFrame, tokens: DataFrame) -> float:
    """Share of tokens whose tag is that of the token table."""
    j = found.join(tokens.select("doc_id", "token_i", F.col("pos").alias("gold")), ["doc_id", "token_i"])
    return float(j.agg(F.avg((F.col("pos") == F.col("gold")).cast("int"))).first()[0] or math.nan)
