"""Classification metrics and clustering scores as SQL aggregates.

Predictions are one table ``(fold, doc_id, label, prediction)``; clusterings are
two label columns on one table. Every score is built from grouped counts
(contingency tables), so nothing is collected to the driver. ``by`` columns
(e.g. ``model``) score several clusterings in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ALL = "_all"


def accuracy(preds: DataFrame, fold_col: str = "fold", label_col: str = "label",
             pred_col: str = "prediction") -> DataFrame:
    """Share of correct predictions per fold."""
    return preds.groupBy(fold_col).agg(
        F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"))


def class_report(preds: DataFrame, fold_col: str = "fold", label_col: str = "label",
                 pred_col: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per fold and class (0 on an empty denominator)."""
    conf = preds.groupBy(fold_col, label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    hit = (F.col(label_col) == F.col(pred_col))
    parts = F.array(
        F.struct(F.col(label_col).alias("cls"), F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.col("n").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred")),
        F.struct(F.col(pred_col).alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("n_true"), F.col("n").alias("n_pred")))
    per = (conf.select(fold_col, F.explode(parts).alias("p")).select(fold_col, "p.*")
           .groupBy(fold_col, "cls").agg(F.sum("tp").alias("tp"), F.sum("n_true").alias("support"),
                                         F.sum("n_pred").alias("n_pred")))
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    out = per.select(fold_col, F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"),
                     F.col("support").cast("bigint").alias("support"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall")
                    / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("f1", f1)


def cv_summary(preds: DataFrame, fold_col: str = "fold", label_col: str = "label",
               pred_col: str = "prediction") -> DataFrame:
    """Mean and population std over folds of accuracy and per-class P / R / F1."""
    acc = accuracy(preds, fold_col, label_col, pred_col).select(
        fold_col, F.lit("accuracy").alias("metric"), F.lit(None).cast("string").alias("class"),
        F.col("accuracy").alias("value"))
    rep = class_report(preds, fold_col, label_col, pred_col)
    long = rep.unpivot([fold_col, "class"], ["precision", "recall", "f1"], "metric", "value") \
        .select(fold_col, "metric", "class", "value")
    allm = acc.unionByName(long)
    return allm.groupBy("metric", "class").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                               F.count(F.lit(1)).alias("n_folds"))


def contingency(df: DataFrame, u: str, v: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., u, v, n) pair counts."""
    return df.groupBy(*by, u, v).agg(F.count(F.lit(1)).alias("n"))


def _by(df: DataFrame, by: Sequence[str]):
    if by:
        return df, list(by)
    return df.withColumn(_ALL, F.lit(1)), [_ALL]


def _pair_sums(df: DataFrame, truth: str, pred: str, keys: Sequence[str]) -> DataFrame:
    """One row per key with all sums over the contingency table that the scores need.

    The cells, both margins and their sums come from one pass: grouping sets over
    the cells, no join back to them, and a null label is a class of its own.
    """
    c = df.groupBy(*keys, F.col(truth).alias("_u"), F.col(pred).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sets = [[*keys, "_u", "_v"], [*keys, "_u"], [*keys, "_v"]]
    g = c.groupingSets(sets, *keys, "_u", "_v").agg(F.sum("_c").alias("n"), F.grouping_id().alias("_g"))
    n, d = F.col("n"), F.col("n").cast("decimal(38,0)")
    cell, by_u, by_v = (F.col("_g") == k for k in (0, 1, 2))
    log = n * F.log(n.cast("double"))

    def total(which, value):
        return F.sum(F.when(which, value))

    return g.groupBy(*keys).agg(
        total(cell, d).alias("n_total"), total(cell, d * d).alias("sum_sq"), total(by_u, d * d).alias("row_sq"),
        total(by_v, d * d).alias("col_sq"), total(cell, log).alias("cell_log"), total(by_u, log).alias("row_log"),
        total(by_v, log).alias("col_log"), F.count_if(by_v & F.col("_v").isNotNull()).alias("n_clusters"),
        F.count_if(by_u & F.col("_u").isNotNull()).alias("n_groups"))


def _ari():
    """ARI from pair counts (exact sums in DECIMAL(38,0)); 1.0 when no pair disagrees."""
    nt, sq, rq, cq = (F.col(k) for k in ("n_total", "sum_sq", "row_sq", "col_sq"))
    tp, fp, fn, tn = (x.cast("double") for x in (sq - nt, cq - sq, rq - sq, nt * nt - rq - cq + sq))
    return F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))


def _homogeneity_completeness():
    """MI = (sum n ln n - sum a ln a - sum b ln b) / N + ln N over the entropies of both labelings."""
    nt = F.col("n_total").cast("double")
    mi = (F.col("cell_log") - F.col("row_log") - F.col("col_log")) / nt + F.log(nt)
    hu, hv = (F.log(nt) - F.col(k) / nt for k in ("row_log", "col_log"))
    tiny = 1e-12  # an entropy of 0 within rounding: one class
    return (F.when(hu > tiny, mi / hu).otherwise(F.lit(1.0)), F.when(hv > tiny, mi / hv).otherwise(F.lit(1.0)))


def _scores(sums: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    h, c = _homogeneity_completeness()
    out = sums.select(*keys, _ari().alias("ari"), h.alias("homogeneity"), c.alias("completeness"), "n_clusters", "n_groups")
    both = F.col("homogeneity") + F.col("completeness")
    v = F.when(both > 0, 2.0 * F.col("homogeneity") * F.col("completeness") / both).otherwise(F.lit(0.0))
    return out.withColumns({"v_measure": v, "ari_rounded": F.round("ari", digits)}).withColumn("v_rounded", F.round("v_measure", digits))


def adjusted_rand_index(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """E5: (by..., ari, ari_rounded)."""
    d, keys = _by(df, by)
    return _scores(_pair_sums(d, truth, pred, keys), keys, digits).select(*by, "ari", "ari_rounded")


def v_measure(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean (beta = 1), natural logs.

    Output: (by..., homogeneity, completeness, v_measure, v_rounded).
    """
    d, keys = _by(df, by)
    out = _scores(_pair_sums(d, truth, pred, keys), keys, digits)
    return out.select(*by, "homogeneity", "completeness", "v_measure", "v_rounded")


def cluster_count_check(df: DataFrame, cluster_col: str, group_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct clusters vs distinct groups."""
    return df.groupBy(*by).agg(F.count_distinct(cluster_col).alias("n_clusters"),
                               F.count_distinct(group_col).alias("n_groups")) \
        .withColumn("same", F.col("n_clusters") == F.col("n_groups"))


def compare_clusterings(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per clustering (e.g. per embedding model): ARI, V-measure, cluster counts, from one contingency pass."""
    d, keys = _by(df, by)
    out = _scores(_pair_sums(d, truth, pred, keys), keys, 3)
    return out.withColumn("same", F.col("n_clusters") == F.col("n_groups")).drop(_ALL)
