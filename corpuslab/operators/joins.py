"""The equi-joins of the reference (left, inner, semi, null-safe).

Spark picks the physical join: with AQE on, a side whose runtime size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is broadcast, anything larger
stays a shuffled sort-merge join — so no side is broadcast on an unchecked size.
Explicit ``broadcast()`` hints are only used in this library for tables with a
fixed bound (vocabularies, lexicons, per-feature aggregates).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_text(features: DataFrame, corpus: DataFrame, key: str = "doc_id",
                cols: Sequence[str] = ("text",), null_safe: bool = False) -> DataFrame:
    """J1 (+J7): left join the corpus text (or other columns) onto a feature table."""
    right = corpus.select(key, *cols)
    return null_safe_join(features, right, key, "left") if null_safe else features.join(right, key, "left")


def label_embeddings_left(embs: DataFrame, corpus: DataFrame, key: str = "doc_id",
                          cols: Sequence[str] = ("label", "group_id")) -> DataFrame:
    """Left join then drop rows without label (the optimiser turns it into an inner join)."""
    return embs.join(corpus.select(key, *cols), key, "left").where(F.col("label").isNotNull())


def label_embeddings(embs: DataFrame, corpus: DataFrame, key: str = "doc_id",
                     cols: Sequence[str] = ("label", "group_id")) -> DataFrame:
    """Inner join of embeddings with corpus metadata."""
    return embs.join(corpus.select(key, *cols), key, "inner")


def restrict_to_groups(df: DataFrame, ids: DataFrame, key: str = "group_id") -> DataFrame:
    """Semi-join on an id table (no duplication, right side columns dropped)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def attach_metadata(matrix: DataFrame, corpus: DataFrame, key: str = "doc_id",
                    cols: Sequence[str] = ("label", "group_id")) -> DataFrame:
    """Equi-join metadata onto a (long) feature matrix by document id."""
    return matrix.join(corpus.select(key, *cols), key, "left")


def null_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join where a null key matches a null key (pandas merge semantics)."""
    r = right.withColumnRenamed(key, "_rk")
    j = left.join(r, left[key].eqNullSafe(r["_rk"]), how)
    return j.drop("_rk")
