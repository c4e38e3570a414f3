"""Queries for N1–N7 (sentiment) on sentences rebuilt from the token table, and F23."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_sentiment_label
from ..operators import polarity, sentiment as sn, stylistics as st, subwords
from ..session import materialize
from ..sources import bindings
from .q_stylistics import tokens
from .registry import finish, parallelism, register


def _sentences(spark, sf):
    return st.sentence_text_of(bindings.table(spark, sf, "documents").select("doc_id", "text"))


def _signed(spark, sf):
    return sn.signed_scores(sn.score_chunks(sn.chunk_table(_sentences(spark, sf))))


@register("chunk_words")
def q_chunk_words(spark, sf):
    """Chunks of at most 512 estimated subword tokens per sentence."""
    return finish(sn.chunk_table(_sentences(spark, sf)))


@register("subword_words")
def q_subword_words(spark, sf):
    """Every distinct word of the documents, how often it occurs, and its pieces under the learned subword model put together again."""
    words = materialize(subwords.word_table(bindings.table(spark, sf, "documents")), "subword-counts")
    found = subwords.segment(words, subwords.learn(words))
    return finish(found.select("word", "n", F.array_join("pieces", "").alias("joined")))


@register("chunk_words_subword")
def q_chunk_words_subword(spark, sf):
    """N1 with learned costs, at most 64 tokens a chunk: words per sentence over its chunks, and whether each chunk of several words keeps the limit."""
    sentences = materialize(_sentences(spark, sf), "subword-sentences")
    words = materialize(subwords.word_table(sentences, "sentence"), "subword-counts")
    pieces = materialize(subwords.segment(words, subwords.learn(words)), "subword-pieces")
    chunks = materialize(subwords.chunk_table(sentences, pieces, 64), "subword-chunks")
    cost = pieces.select("word", (F.size("pieces") + subwords.SPECIAL).alias("c"))
    w = chunks.select("doc_id", "sent_id", "chunk_id", F.explode(F.regexp_extract_all("chunk", F.lit(r"\S+"), F.lit(0))).alias("word")).join(cost, "word")
    per = w.groupBy("doc_id", "sent_id", "chunk_id").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
    return finish(per.groupBy("doc_id", "sent_id").agg(F.sum("n").alias("n_words"), F.bool_and((F.col("c") <= 64) | (F.col("n") == 1)).alias("within")))


@register("cap_max_len")
def q_cap_max_len(spark, sf):
    """The model-limit cap applied to a length column."""
    d = bindings.table(spark, sf, "documents").select("doc_id", "n_chars")
    return finish(d.select("doc_id", "n_chars", sn.model_max_len("n_chars").alias("max_len")))


@register("score_chunks")
def q_score_chunks(spark, sf):
    """Built-in lexicon scorer per chunk."""
    return finish(sn.score_chunks(sn.chunk_table(_sentences(spark, sf))))


def _lexicon(spark, sf):
    graph = polarity.word_graph(bindings.table(spark, sf, "documents").select("doc_id", "text"))
    return polarity.induce(materialize(graph, "polarity-graph"), bindings.seed_words(spark, sf))


@register("induced_lexicon")
def q_induced_lexicon(spark, sf):
    """Polarity of words by random walks from seed words over the corpus's word graph."""
    return finish(_lexicon(spark, sf))


@register("score_chunks_induced")
def q_score_chunks_induced(spark, sf):
    """Chunks scored by the induced lexicon."""
    return finish(polarity.score_chunks(sn.chunk_table(_sentences(spark, sf)), materialize(_lexicon(spark, sf), "polarity-lexicon")))


@register("normalize_sentiment_label")
def q_normalize_sentiment_label(spark, sf):
    """Normalised chunk labels."""
    return finish(_signed(spark, sf).select("doc_id", "sent_id", "chunk_id", "label_norm"))


@register("normalize_sentiment_synonyms")
def q_normalize_sentiment_synonyms(spark, sf):
    """N4 on spellings that a model may give, blanks, an unknown label and null."""
    d = bindings.raw_sentiment_labels(spark, sf)
    return finish(d.select("doc_id", normalize_sentiment_label("label").alias("label_norm")))


@register("signed_score")
def q_signed_score(spark, sf):
    """Signed chunk scores."""
    return finish(_signed(spark, sf).select("doc_id", "sent_id", "chunk_id", "signed"))


@register("sentiment_series")
def q_sentiment_series(spark, sf):
    """The ordered series per document, listed as (doc_id, pos, score)."""
    s = sn.sentiment_series(_signed(spark, sf))
    return finish(s.select("doc_id", F.posexplode("sentiment").alias("pos", "score")))


@register("sentiment_summary")
def q_sentiment_summary(spark, sf):
    """Mean / population std / mean absolute score, null below two scores."""
    s = sn.sentiment_summary(_signed(spark, sf))
    return finish(s.select("doc_id", "n_scores", "sentiment_mean", "sentiment_std", "sentiment_abs"))


@register("sentiment_entropy")
def q_sentiment_entropy(spark, sf):
    """Approximate entropy of each document's sentiment series."""
    return finish(sn.sentiment_entropy(_signed(spark, sf)))


@register("stylistics_measures_from_tokens")
def q_stylistics_measures_from_tokens(spark, sf):
    """F23 from a token table (as an external annotator gives it), without compression, which SQL can't express, and the series."""
    t = st.stylistics_table(tokens(spark, sf), corpus=bindings.corpus(spark, sf, with_text=False), with_compression=False)
    return finish(t.drop("sentiment", "compression_ratio"))


@register("stylistics_measures")
def q_stylistics_measures(spark, sf):
    """F23 without compression, which SQL can't express, and the series."""
    t = st.stylistics_of(_docs(spark, sf), corpus=bindings.corpus(spark, sf, with_text=False), with_compression=False, num_partitions=parallelism(spark))
    return finish(t.drop("sentiment", "compression_ratio"))


@register("stylistics_table_from_tokens", oracle=False)
def q_stylistics_table_from_tokens(spark, sf):
    """F23 from a token table: all measures and the sentiment series."""
    return finish(st.stylistics_table(tokens(spark, sf), corpus=bindings.corpus(spark, sf, with_text=False)))


@register("stylistics_table", oracle=False)
def q_stylistics_table(spark, sf):
    """all measures, the sentiment series and summary, corpus group and label."""
    return finish(st.stylistics_of(_docs(spark, sf), corpus=bindings.corpus(spark, sf, with_text=False), num_partitions=parallelism(spark)))


def _docs(spark, sf):
    return bindings.table(spark, sf, "documents").select("doc_id", "lang", "text")
