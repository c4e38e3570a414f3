"""Queries for E1–E8 on fixed labelings (so that no model fit is involved)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..sources import bindings
from .q_splits import folds
from .registry import finish, register


def predictions(spark, sf):
    """(fold, doc_id, label, prediction): B3 folds with a fixed rule prediction (toxic -> 'b')."""
    lab = bindings.table(spark, sf, "labels").select("doc_id", "toxic")
    f = folds(spark, sf).join(lab, "doc_id")
    return f.select("fold", "doc_id", "label",
                    F.when(F.col("toxic") == 1, F.lit("b")).otherwise(F.lit("a")).alias("prediction"))


def _argmax(arr):
    return F.array_position(arr, F.array_max(arr))


def model_assignments(spark, sf):
    """(model, doc_id, emb_label, cluster): per embedding slice, the index of its largest coordinate."""
    e = bindings.embedding_sets(spark, sf)
    return e.select("model", "doc_id", "emb_label", _argmax(F.col("embedding")).alias("cluster"))


@register("accuracy")
def q_accuracy(spark, sf):
    """E1."""
    return finish(ev.accuracy(predictions(spark, sf)))


@register("class_report")
def q_class_report(spark, sf):
    """E2."""
    return finish(ev.class_report(predictions(spark, sf)))


@register("cv_summary")
def q_cv_summary(spark, sf):
    """E3."""
    return finish(ev.cv_summary(predictions(spark, sf)))


def _docs(spark, sf):
    return bindings.table(spark, sf, "documents").select("doc_id", "lang", "source")


@register("contingency")
def q_contingency(spark, sf):
    """(lang, source) pair counts."""
    return finish(ev.contingency(_docs(spark, sf), "lang", "source"))


@register("adjusted_rand_index")
def q_adjusted_rand_index(spark, sf):
    """E5: ARI of source against lang."""
    return finish(ev.adjusted_rand_index(_docs(spark, sf), "lang", "source"))


@register("v_measure")
def q_v_measure(spark, sf):
    """Homogeneity / completeness / V of source against lang."""
    return finish(ev.v_measure(_docs(spark, sf), "lang", "source"))


@register("cluster_count_check")
def q_cluster_count_check(spark, sf):
    """Distinct argmax-clusters of the full embedding vs distinct labels."""
    e = bindings.embeddings(spark, sf).select("emb_label", _argmax(F.col("embedding")).alias("cluster"))
    return finish(ev.cluster_count_check(e, "cluster", "emb_label"))


@register("compare_embeddings")
def q_compare_embeddings(spark, sf):
    """One row per embedding model (argmax-slice clusters vs labels)."""
    return finish(ev.compare_clusterings(model_assignments(spark, sf), "emb_label", "cluster", ["model"]))
