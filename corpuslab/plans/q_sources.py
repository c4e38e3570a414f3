"""Queries for S1–S9: readers and writers, checked as round trips through the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import annotate
from ..session import scratch_path
from ..sources import bindings, io
from .registry import finish, register


@register("read_corpus")
def q_read_corpus(spark, sf):
    """The corpus written as parquet, read back as (doc_id, text, label, group_id)."""
    path = scratch_path(spark, "corpus")
    c = bindings.corpus(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label", "group_id")
    c.write.parquet(path)
    return finish(io.read_corpus(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                                                     "label", "group_id"))


_TSV_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                            T.StructField("n_chars", T.LongType()), T.StructField("sent_lengths", T.StringType())])


def _tsv_frame(spark, sf):
    d = bindings.table(spark, sf, "documents")
    sents = annotate.segment_sentences(d)
    lens = sents.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "sentence"))),
                                                   lambda x: F.length(x["sentence"])).alias("sent_lengths"))
    return d.select("doc_id", "lang", "n_chars").join(lens, "doc_id", "left")


@register("write_tsv")
def q_write_tsv(spark, sf):
    """A table with an array column written as TSV (array as JSON text), read back."""
    path = scratch_path(spark, "tsv")
    io.write_tsv(_tsv_frame(spark, sf), path)
    return finish(io.read_features_tsv(spark, path, _TSV_SCHEMA))


@register("read_features_tsv")
def q_read_features_tsv(spark, sf):
    """The TSV reader with an explicit schema (aggregated per language after the round trip)."""
    path = scratch_path(spark, "tsv")
    io.write_tsv(_tsv_frame(spark, sf), path)
    back = io.read_features_tsv(spark, path, _TSV_SCHEMA)
    return finish(back.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")))


def _token_round_trip(spark, sf):
    path = scratch_path(spark, "tokens")
    tok = annotate.token_table(bindings.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    io.write_tokens(tok, path)
    return io.read_tokens(spark, path)


@register("write_tokens")
def q_write_tokens(spark, sf):
    """The token table written clustered by doc_id, read back (keys and text)."""
    return finish(_token_round_trip(spark, sf).select("doc_id", "sent_id", "token_i", "token_text"))


@register("read_tokens")
def q_read_tokens(spark, sf):
    """S3: the token table read back from parquet, per-document token and sentence counts."""
    t = _token_round_trip(spark, sf)
    return finish(t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("sent_id").alias("last_sent")))


@register("read_embeddings")
def q_read_embeddings(spark, sf):
    """S4 + S8: embeddings written and read back (id, dimension, label, coordinate sum)."""
    path = scratch_path(spark, "emb")
    io.write_embeddings(bindings.embeddings(spark, sf), path)
    e = io.read_embeddings(spark, path)
    return finish(e.select("doc_id", F.size("embedding").alias("dim"), "emb_label",
                           F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")))


@register("write_embeddings")
def q_write_embeddings(spark, sf):
    """Labelled embeddings (inner join with the corpus) written as parquet and read back."""
    path = scratch_path(spark, "emb")
    e = bindings.embeddings(spark, sf).join(bindings.corpus(spark, sf, with_text=False).select("doc_id", "label"),
                                            "doc_id").where(F.col("label").isNotNull())
    io.write_embeddings(e, path)
    back = io.read_embeddings(spark, path)
    return finish(back.select("doc_id", "label", F.size("embedding").alias("dim")))


@register("read_embedding_sets")
def q_read_embedding_sets(spark, sf):
    """Four model slices written separately, read back as one (model, doc_id, embedding) table."""
    sets = bindings.embedding_sets(spark, sf)
    paths = {}
    for m in ("m0", "m1", "m2", "m3"):
        p = scratch_path(spark, f"emb_{m}")
        sets.where(F.col("model") == m).select("doc_id", "embedding").write.parquet(p)
        paths[m] = p
    e = io.read_embedding_sets(spark, paths)
    return finish(e.select("model", "doc_id", F.size("embedding").alias("dim"),
                           F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")))


@register("append_run_results")
def q_append_run_results(spark, sf):
    """Two runs appended to one results table, read back."""
    path = scratch_path(spark, "runs")
    scores = bindings.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    io.append_run_results(scores, path, "run-1")
    io.append_run_results(scores, path, "run-2")
    return finish(spark.read.parquet(path).select("run_id", "lang", "n_docs"))
