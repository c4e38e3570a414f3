"""Queries for B1–B7 (sampling and splitting) on the labelled corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, folds as group_folds, splits
from ..sources import bindings
from .registry import finish, register


def labelled(spark, sf):
    """Labelled corpus rows with the part suffix stripped from group ids (as for CV groups)."""
    c = bindings.corpus(spark, sf, with_text=False).where(F.col("label").isNotNull())
    return cleaning.strip_part_suffix(c).select("doc_id", "group_id", "label")


def folds(spark, sf):
    """balance -> surrogate groups -> five stratified group folds."""
    bal = splits.balance_classes(labelled(spark, sf))
    return group_folds.stratified_group_folds(cleaning.fill_surrogate_group(bal), k=5)


@register("balance_classes")
def q_balance_classes(spark, sf):
    """B1: exact undersampling to the smallest class."""
    return finish(splits.balance_classes(labelled(spark, sf)).select("doc_id", "label"))


@register("shuffle")
def q_shuffle(spark, sf):
    """B2: seeded permutation key."""
    return finish(splits.shuffle(labelled(spark, sf)).select("doc_id", "shuffle_key"))


@register("stratified_group_folds")
def q_stratified_group_folds(spark, sf):
    """Group-disjoint fold per document by the balancing solver."""
    return finish(folds(spark, sf).select("doc_id", "group_id", "label", "fold"))


@register("snake_group_folds")
def q_snake_group_folds(spark, sf):
    """B3 without a solver: group-disjoint, class-stratified fold per document by snake dealing."""
    rows = cleaning.fill_surrogate_group(splits.balance_classes(labelled(spark, sf)))
    return finish(splits.snake_group_folds(rows, k=5).select("doc_id", "group_id", "label", "fold"))


@register("fold_balance_skewed")
def q_fold_balance_skewed(spark, sf):
    """B3 + B4 without balancing first: counts per fold and class where the classes and groups differ in size."""
    rows = cleaning.fill_surrogate_group(labelled(spark, sf))
    return finish(splits.fold_balance(group_folds.stratified_group_folds(rows, k=5)))


@register("fold_balance")
def q_fold_balance(spark, sf):
    """train/test counts per fold and class."""
    return finish(splits.fold_balance(folds(spark, sf)))


@register("sample_groups")
def q_sample_groups(spark, sf):
    """All documents of 5 seeded-sampled groups."""
    c = cleaning.strip_part_suffix(bindings.corpus(spark, sf, with_text=False)).select("doc_id", "group_id")
    return finish(splits.sample_groups(c, 5))


@register("concat_classes")
def q_concat_classes(spark, sf):
    """Class frames appended."""
    c = labelled(spark, sf)
    return finish(splits.concat_classes(c.where(F.col("label") == "a"), c.where(F.col("label") == "b"))
                  .select("doc_id", "label"))


@register("distinct_groups")
def q_distinct_groups(spark, sf):
    """Distinct group ids of the corpus."""
    return finish(splits.distinct_groups(bindings.corpus(spark, sf, with_text=False)))
