"""Cleaning, projections and predicates.

All are narrow transformations (no shuffle) except ``dedupe`` (one hash
aggregate with map-side partial aggregation, so a key holding a third of all
rows is pre-reduced inside each map task) and the one-pass reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import UNUSABLE_CODES


def normalize_text(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """Lowercase, remove digits, collapse whitespace, trim."""
    return df.withColumn(out or col, tx.normalize_text(col))


def drop_unusable(df: DataFrame, col: str = "code", bad_codes: Sequence[str] = UNUSABLE_CODES) -> DataFrame:
    """Drop missing and unusable codes."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*bad_codes))


def recode_labels(df: DataFrame, col: str = "code", out: str = "label", mapping: dict | None = None) -> DataFrame:
    """Raw code -> binary label; codes outside the mapping are dropped."""
    return df.withColumn(out, tx.recode_annotation(col, mapping)).where(F.col(out).isNotNull())


def select_columns(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Explicit projection (Catalyst prunes the scan to these columns)."""
    out = df.select(*keep) if keep else df
    return out.drop(*drop) if drop else out


def drop_columns_by_prefix(df: DataFrame, prefix: str = "Unnamed") -> DataFrame:
    """P5: drop columns whose name starts with ``prefix`` (e.g. a written index)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def with_word_count(df: DataFrame, col: str = "text", out: str = "n_words", null_as_text: bool = False) -> DataFrame:
    """Whitespace word count; ``null_as_text`` counts a missing text as one word."""
    expr = tx.word_count_nullable_as_text(col) if null_as_text else tx.word_count(col)
    return df.withColumn(out, expr)


def filter_min_words(df: DataFrame, n: int = 100, strict: bool = False, col: str = "text",
                     count_col: str = "n_words") -> DataFrame:
    """Keep texts with at least ``n`` words (``strict``: more than ``n``); null texts drop."""
    d = df if count_col in df.columns else with_word_count(df.where(F.col(col).isNotNull()), col, count_col)
    return d.where(F.col(count_col) > n) if strict else d.where(F.col(count_col) >= n)


def dedupe(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """First row per ``key`` by ``order_by``; null keys count as one key.

    One aggregate of ``min(struct(order..., rest...))``: its partial step runs
    map-side, so a hot key never gathers in one task (a ``row_number`` window would
    sort the whole key group in one task). Spark plans the minimum of a struct as a sort aggregate.
    """
    rest = [c for c in df.columns if c != key and c not in order_by]
    packed = F.struct(*[F.col(c) for c in list(order_by) + rest])
    return df.groupBy(key).agg(F.min(packed).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in df.columns
                                                            if c != key])


def valid_vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Keep rows whose vector is present and free of null/NaN."""
    return df.where(tx.valid_vector(col))


def require_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: drop rows lacking any of ``cols``."""
    return df.dropna(subset=list(cols))


def strip_part_suffix(df: DataFrame, col: str = "group_id", out: str | None = None) -> DataFrame:
    """Remove a trailing '_<letter>' part suffix."""
    return df.withColumn(out or col, tx.strip_part_suffix(col))


def fill_surrogate_group(df: DataFrame, col: str = "group_id", id_col: str = "doc_id",
                         out: str | None = None) -> DataFrame:
    """Missing group -> 'noid_<doc_id>' (deterministic, keyed by document)."""
    return df.withColumn(out or col, tx.surrogate_group(col, id_col))


def filter_outliers(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Keep rows with every ``col < limit`` (strict); null or NaN values drop too."""
    cond = None
    for c, lim in limits.items():
        one = F.col(c).isNotNull() & ~F.isnan(F.col(c)) & (F.col(c) < F.lit(lim))
        cond = one if cond is None else cond & one
    return df.where(cond)


def quarantine_empty(df: DataFrame, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Split into (ok, rejected) instead of failing the job on one empty text."""
    empty = F.col(col).isNull() | (F.col(col) == "")
    return df.where(~empty), df.where(empty)


def quarantine_status(col: str = "text") -> Column:
    """P15 as a column: 'ok' or 'rejected'."""
    return F.when(F.col(col).isNull() | (F.col(col) == ""), F.lit("rejected")).otherwise(F.lit("ok"))


def removal_report(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows before/after each sequential filter step, in one aggregate pass.

    ``steps`` are (name, keep-predicate) applied in order; step k keeps the rows
    passing predicates 1..k. Output: (step_no, step, n_before, n_after, removed).
    """
    aggs, acc = [F.count(F.lit(1)).alias("n0")], None
    for i, (_name, pred) in enumerate(steps, start=1):
        p = F.coalesce(pred, F.lit(False))
        acc = p if acc is None else acc & p
        aggs.append(F.count_if(acc).alias(f"n{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(i).cast("bigint").alias("step_no"), F.lit(name).alias("step"),
                     F.col(f"n{i - 1}").alias("n_before"), F.col(f"n{i}").alias("n_after"))
            for i, (name, _p) in enumerate(steps, start=1)]
    return (one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .withColumn("removed", F.col("n_before") - F.col("n_after")))


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null) for each column, in one pass (NaN counts as missing)."""
    cols = list(cols or df.columns)
    dtypes = dict(df.dtypes)
    aggs = []
    for c in cols:
        miss = F.col(f"`{c}`").isNull()
        if dtypes[c] in ("double", "float"):
            miss = miss | F.isnan(F.col(f"`{c}`"))
        aggs.append(F.count_if(miss).alias(c))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null"))
                                          for c in cols])).alias("r")).select("r.*")
