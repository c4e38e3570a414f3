"""Queries for P1–P17 (cleaning) and J1–J7 (joins) on the corpus binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bow, cleaning as cl, joins as jn, stylistics as st
from ..sources import bindings
from .registry import finish, parallelism, register


def _corpus(spark, sf, with_text=True):
    return bindings.corpus(spark, sf, with_text)


@register("normalize_text")
def q_normalize_text(spark, sf):
    """P1."""
    d = bindings.table(spark, sf, "documents").select("doc_id", "text")
    return finish(cl.normalize_text(d, "text", "text_norm").select("doc_id", "text_norm"))


@register("drop_unusable")
def q_drop_unusable(spark, sf):
    """P2 on the raw annotation codes."""
    return finish(cl.drop_unusable(bindings.raw_annotations(spark, sf)))


@register("recode_labels")
def q_recode_labels(spark, sf):
    """Seven codes -> fiction / non-fiction, anecdote and poem dropped."""
    raw = cl.drop_unusable(bindings.raw_annotations(spark, sf))
    return finish(cl.recode_labels(raw))


@register("select_columns")
def q_select_columns(spark, sf):
    """Projection of the corpus (the scan reads only these columns)."""
    return finish(cl.select_columns(_corpus(spark, sf, False), keep=["doc_id", "label", "group_id"]))


@register("drop_columns_by_prefix")
def q_drop_columns_by_prefix(spark, sf):
    """P5: a written index column 'Unnamed: 0' is dropped."""
    d = bindings.table(spark, sf, "documents").select(F.col("doc_id").alias("Unnamed: 0"), "doc_id", "lang", "source")
    return finish(cl.drop_columns_by_prefix(d, "Unnamed"))


@register("word_count")
def q_word_count(spark, sf):
    """P6."""
    d = bindings.table(spark, sf, "documents").select("doc_id", "text")
    return finish(cl.with_word_count(d).select("doc_id", "n_words"))


@register("filter_min_words")
def q_filter_min_words(spark, sf):
    """At least 100 words (classifier flavour)."""
    d = bindings.table(spark, sf, "documents").select("doc_id", "text")
    return finish(cl.filter_min_words(d, 100, strict=False).select("doc_id", "n_words"))


@register("filter_min_words_strict")
def q_filter_min_words_strict(spark, sf):
    """More than 100 words (descriptives flavour)."""
    d = bindings.table(spark, sf, "documents").select("doc_id", "text")
    return finish(cl.filter_min_words(d, 100, strict=True).select("doc_id", "n_words"))


@register("dedupe")
def q_dedupe(spark, sf):
    """First document per group id (null ids form one group), ordered by doc_id."""
    c = _corpus(spark, sf, False).select("doc_id", "group_id", "lang", "label")
    return finish(cl.dedupe(c, "group_id", ["doc_id"]).select("group_id", "doc_id", "lang", "label"))


@register("valid_vectors")
def q_valid_vectors(spark, sf):
    """P9."""
    e = bindings.embeddings_with_holes(spark, sf)
    return finish(cl.valid_vectors(e).select("doc_id", F.size("embedding").alias("dim")))


@register("require_not_null")
def q_require_not_null(spark, sf):
    """P10: rows with both label and group."""
    return finish(cl.require_not_null(_corpus(spark, sf, False), ["label", "group_id"]).select("doc_id"))


@register("strip_part_suffix")
def q_strip_part_suffix(spark, sf):
    """P11."""
    c = _corpus(spark, sf, False).select("doc_id", "group_id")
    return finish(cl.strip_part_suffix(c))


@register("fill_surrogate_group")
def q_fill_surrogate_group(spark, sf):
    """P12."""
    c = _corpus(spark, sf, False).select("doc_id", "group_id")
    return finish(cl.fill_surrogate_group(c))


@register("filter_outliers")
def q_filter_outliers(spark, sf):
    """Sentence length < 100, noun TTR < 6, nominal/verb ratio < 12 on the stylistics table."""
    styl = st.stylistics_of(bindings.table(spark, sf, "documents"), sentiment=False, with_compression=False,
                            num_partitions=parallelism(spark))
    return finish(cl.filter_outliers(styl, {"avg_sentlen": 100, "noun_ttr": 6, "nominal_verb_ratio": 12})
                  .select("doc_id"))


@register("quarantine_empty")
def q_quarantine_empty(spark, sf):
    """Two frames, ok and rejected, instead of an exception."""
    ok, rejected = cl.quarantine_empty(bindings.texts_with_holes(spark, sf))
    return finish(ok.select("doc_id", F.lit("ok").alias("status"))
                  .unionByName(rejected.select("doc_id", F.lit("rejected").alias("status"))))


@register("removal_report")
def q_removal_report(spark, sf):
    """Rows removed by each cleaning step, one aggregate pass."""
    c = cl.with_word_count(_corpus(spark, sf), null_as_text=False)
    steps = [("has_text", F.col("text").isNotNull()), ("labelled", F.col("label").isNotNull()),
             ("min_words_100", F.col("n_words") >= 100)]
    return finish(cl.removal_report(c, steps))


@register("missing_profile")
def q_missing_profile(spark, sf):
    """Nulls per corpus column."""
    return finish(cl.missing_profile(_corpus(spark, sf)))


# ---------------------------------------------------------------- joins


@register("attach_text")
def q_attach_text(spark, sf):
    """Labels LEFT JOIN documents on doc_id, then word counts of the attached text."""
    labels = bindings.table(spark, sf, "labels")
    docs = bindings.table(spark, sf, "documents")
    j = cl.with_word_count(jn.attach_text(labels, docs))
    return finish(j.select("doc_id", "quality", "toxic", "n_words"))


@register("label_embeddings_left")
def q_label_embeddings_left(spark, sf):
    """J2."""
    j = jn.label_embeddings_left(bindings.embeddings(spark, sf), _corpus(spark, sf, False))
    return finish(j.select("doc_id", "label", "group_id", "emb_label"))


@register("label_embeddings")
def q_label_embeddings(spark, sf):
    """J3."""
    j = jn.label_embeddings(bindings.embeddings(spark, sf), _corpus(spark, sf, False))
    return finish(j.select("doc_id", "label", "group_id", "emb_label"))


@register("restrict_to_groups")
def q_restrict_to_groups(spark, sf):
    """Documents of groups that contain at least one 'b' document."""
    c = _corpus(spark, sf, False)
    ids = c.where(F.col("label") == "b").select("group_id")
    return finish(jn.restrict_to_groups(c, ids).select("doc_id", "group_id"))


@register("attach_metadata")
def q_attach_metadata(spark, sf):
    """MFW-100 long matrix with corpus metadata."""
    docs = bindings.table(spark, sf, "documents").select("doc_id", "text")
    vocab = bow.top_vocabulary(bow.term_counts(docs), 100)
    m = bow.mfw_relative(docs, vocab)
    return finish(jn.attach_metadata(m, _corpus(spark, sf, False)).select("doc_id", "term", "rel_freq", "label",
                                                                          "group_id"))


@register("null_safe_join")
def q_null_safe_join(spark, sf):
    """Group sizes joined back with null = null matching."""
    c = _corpus(spark, sf, False).select("doc_id", "group_id")
    sizes = c.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return finish(jn.null_safe_join(c, sizes, "group_id").select("doc_id", "group_id", "group_size"))
