"""Queries for P14 and F1–F23 on the annotated ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, stylistics as st
from ..sources.bindings import table
from .registry import finish, parallelism, register


def tokens(spark, sf):
    return annotate.token_table(table(spark, sf, "documents").select("doc_id", "lang", "text"))


def texts(spark, sf):
    """The tokens without their tags."""
    return annotate.token_texts(table(spark, sf, "documents").select("doc_id", "text"))


@register("token_predicates")
def q_token_predicates(spark, sf):
    """Boolean token classes."""
    return finish(st.token_predicates(tokens(spark, sf)))


def _pos_measure(name):
    def fn(spark, sf):
        return finish(st.pos_measures(tokens(spark, sf)).select("doc_id", name))
    fn.__doc__ = f"F: {name} per document."
    return fn


def _sent_measure(name):
    def fn(spark, sf):
        return finish(st.sentence_measures(tokens(spark, sf)).select("doc_id", name))
    fn.__doc__ = f"F: {name} per document."
    return fn


for _m in ["nominal_verb_ratio", "noun_ttr", "verb_ttr", "personal_pronoun_ratio", "function_word_ratio",
           "of_ratio", "that_ratio", "past_tense_ratio", "present_tense_ratio", "passive_ratio",
           "active_ratio", "adjective_adverb_ratio", "avg_wordlen"]:
    register(_m)(_pos_measure(_m))
for _m in ["avg_sentlen", "num_sents", "avg_ndd", "std_ndd", "avg_mdd", "std_mdd"]:
    register(_m)(_sent_measure(_m))


@register("msttr")
def q_msttr(spark, sf):
    """mean segmental type-token ratio."""
    return finish(st.msttr(tokens(spark, sf)))


@register("sentence_text")
def q_sentence_text(spark, sf):
    """sentence strings rebuilt from tokens."""
    return finish(st.sentence_text(texts(spark, sf)))


@register("compression_selection")
def q_compression_selection(spark, sf):
    """F21 (selection part): the sentences fed to the compressor."""
    return finish(st.compression_selection(st.sentence_text(texts(spark, sf))))


@register("compression_bytes")
def q_compression_bytes(spark, sf):
    """UTF-8 bytes fed to the compressor, and whether a ratio came out."""
    sel = st.compression_selection(st.sentence_text(texts(spark, sf)))
    ratio = st.bz2_ratio("selected_text")
    return finish(sel.select("doc_id", F.octet_length("selected_text").alias("n_bytes"), (ratio > 0).alias("has_ratio")))


@register("compression_ratio", oracle=False)
def q_compression_ratio(spark, sf):
    """the ratio itself (SQL has no such codec; pytest holds it against the codec)."""
    return finish(st.compression_ratio(st.sentence_text(texts(spark, sf))))


@register("compression_ratio_fused", oracle=False)
def q_compression_ratio_fused(spark, sf):
    """F21 through the one-pass stylistics table (pytest: equal to ``compression_ratio``)."""
    t = st.stylistics_of(table(spark, sf, "documents"), sentiment=False, num_partitions=parallelism(spark))
    return finish(t.select("doc_id", "compression_ratio"))
