"""Class comparisons and descriptive statistics.

Features are unpivoted to a long ``(doc_id, label, feature, value)`` table and
aggregated per feature with conditional aggregates. Every aggregate here is
algebraic (count / sum / mean / variance) and runs with map-side partial
aggregation, so the size of a class never matters. Bin edges and per-feature
ranges are bounded by the number of features and are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def unpivot_features(df: DataFrame, features: Sequence[str], label_col: str = "label",
                     id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, feature, value) with NaN turned into null (skipped like pandas)."""
    base = df.select(id_col, label_col, *[F.col(c).cast("double").alias(c) for c in features])
    long = base.unpivot([id_col, label_col], list(features), "feature", "value")
    return long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class (a null class is its own row)."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def text_length_by_class(df: DataFrame, len_col: str = "n_words", label_col: str = "label") -> DataFrame:
    """N, mean and sample std of text length per class."""
    return df.where(F.col(label_col).isNotNull()).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(len_col).cast("double")).alias("mean_len"),
        F.stddev_samp(F.col(len_col).cast("double")).alias("std_len"))


def feature_stats_by_class(df: DataFrame, features: Sequence[str], label_col: str = "label",
                           classes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """D3 (and J5): per feature, n / mean / sample std / sample variance for two classes."""
    a, b = classes
    long = unpivot_features(df.where(F.col(label_col).isin(a, b)), features, label_col)
    ia, ib = F.col(label_col) == a, F.col(label_col) == b
    va, vb = F.when(ia, F.col("value")), F.when(ib, F.col("value"))
    return long.groupBy("feature").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count(va).alias("n_a"), F.avg(va).alias("mean_a"), F.stddev_samp(va).alias("std_a"),
        F.var_samp(va).alias("var_a"),
        F.count(vb).alias("n_b"), F.avg(vb).alias("mean_b"), F.stddev_samp(vb).alias("std_b"),
        F.var_samp(vb).alias("var_b"))


def pooled_t_test(stats: DataFrame, nan_policy: str = "omit") -> DataFrame:
    """Two-sample t with pooled variance (equal variances) per feature.

    ``nan_policy="omit"`` skips missing values; ``"propagate"`` gives a null t and
    df for a feature with a missing value in either class.
    """
    if nan_policy not in ("omit", "propagate"):
        raise ValueError(nan_policy)
    dof = F.col("n_a") + F.col("n_b") - 2
    sp2 = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(dof, F.lit(0))
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))
    t, df = (F.col("mean_a") - F.col("mean_b")) / F.nullif(se, F.lit(0.0)), dof.cast("bigint")
    if nan_policy == "propagate":
        whole = F.col("n_missing") == 0
        t, df = F.when(whole, t), F.when(whole, df)
    return stats.select("*", t.alias("t_stat"), df.alias("df"))


# --- D5: two-sided Student-t p-value

#: Points and weights of Gauss-Legendre quadrature on [-1, 1].
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| > |t|) for Student's t with ``dof`` degrees of freedom.

    With T = sqrt(dof) tan(theta) the density is proportional to
    cos(theta) ** (dof - 1) on (-pi/2, pi/2); its integral over (0, pi/2) is
    sqrt(pi)/2 gamma(dof/2) / gamma((dof+1)/2). The tail above theta(t) is summed by
    quadrature over the range in which it is not negligible.
    """
    if t is None or dof is None or not np.isfinite(t) or dof <= 0:
        return float("nan")
    at = math.atan2(abs(t), math.sqrt(dof))
    z = dof / 2
    if z < 1000:
        ratio = math.exp(math.lgamma(z) - math.lgamma(z + 0.5))
    else:  # its series in 1/z; the difference of two large logarithms would lose digits
        ratio = (1 + 1 / (8 * z) + 1 / (128 * z * z)) / math.sqrt(z)
    whole = 0.5 * math.sqrt(math.pi) * ratio
    pieces = np.unique(np.minimum(at + np.array([0.0, 2.0, 6.0, 16.0, 40.0]) / math.sqrt(dof + 1.0), math.pi / 2))
    pieces = np.append(pieces, math.pi / 2) if dof < 50 and pieces[-1] < math.pi / 2 else pieces
    tail = 0.0
    for a, b in zip(pieces, pieces[1:]):
        theta = 0.5 * (b - a) * _NODES + 0.5 * (a + b)
        tail += 0.5 * (b - a) * float(_WEIGHTS @ np.exp((dof - 1.0) * np.log(np.maximum(np.cos(theta), 1e-300))))
    return min(1.0, tail / whole)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, dof)],
                     dtype="float64")


def t_test_p_values(tt: DataFrame) -> DataFrame:
    """Add the two-sided p-value to ``pooled_t_test`` output (one row per feature)."""
    return tt.withColumn("p_value", t_p_value("t_stat", "df"))


# --- D6 / D7: histograms and smoothed densities -----------------------------------

def _ranges(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.min("value").alias("lo_all"), F.max("value").alias("hi_all"))


def _values(df: DataFrame, features, label_col: str, per_feature_max: dict | None) -> DataFrame:
    long = unpivot_features(df, features, label_col).where(F.col("value").isNotNull())
    for f, lim in (per_feature_max or {}).items():
        long = long.where(~((F.col("feature") == f) & (F.col("value") >= lim)))
    # written once: ranges, counts and densities all read it, the features behind it are computed once
    return materialize(long.select("feature", label_col, "value"), "feature-values")


def _auto_bins(long: DataFrame, label_col: str) -> DataFrame:
    """(feature, label, lo_all, width, bins): per class, the finer of two width rules.

    Sturges: range / (log2(n) + 1); Freedman-Diaconis: 2 IQR / n^(1/3), left out
    where the IQR is 0. (Only bins that hold values become rows.)
    """
    key = F.concat_ws("\u0001", "feature", label_col).alias("k")
    q = exact_quantiles(long.select(key, "value"), (0.25, 0.75), group_col="k")
    iqr = q.groupBy("k").agg((F.max(F.when(F.col("p") == 0.75, F.col("q"))) - F.max(F.when(F.col("p") == 0.25, F.col("q")))).alias("iqr"))
    s = long.groupBy("feature", label_col).agg(F.min("value").alias("lo_all"), F.max("value").alias("hi_all"), F.count("value").alias("n"))
    s = s.withColumn("k", key).join(iqr, "k")
    n, span = F.col("n").cast("double"), F.col("hi_all") - F.col("lo_all")
    rule = F.least(F.nullif(2.0 * F.col("iqr") / F.cbrt(n), F.lit(0.0)), span / (F.log2(n) + 1.0))
    bins = F.when(span > 0, F.ceil(F.round(span / rule, 9))).otherwise(F.lit(1)).cast("bigint")
    return s.select("feature", label_col, "lo_all", (span / bins).alias("width"), bins.alias("bins"))


def histogram(df: DataFrame, features: Sequence[str], bins: int | str = 10, label_col: str = "label",
              per_feature_max: dict | None = None) -> DataFrame:
    """Density histogram per feature and class.

    ``bins``: a number of bins over a common range per feature, or ``"auto"``: a
    number of its own and its own range for each feature and class (``_auto_bins``).
    Output (feature, label, bin, lo, hi, n, density) for non-empty bins; the last
    bin is closed; density = n / (class count of the feature × bin width).
    ``per_feature_max`` drops values >= the limit for that feature only.
    """
    long = _values(df, features, label_col, per_feature_max)
    if bins == "auto":
        edges = _auto_bins(long, label_col).withColumnRenamed(label_col, "_l")
        j = long.join(F.broadcast(edges.withColumnRenamed("feature", "_f")),
                      (F.col("feature") == F.col("_f")) & F.col(label_col).eqNullSafe(F.col("_l"))).drop("_f", "_l")
    else:
        rng = _ranges(long).select("feature", "lo_all", ((F.col("hi_all") - F.col("lo_all")) / F.lit(bins)).alias("width"), F.lit(bins).alias("bins"))
        j = long.join(F.broadcast(rng), "feature")
    b = F.when(F.col("width") > 0,
               F.least(F.floor((F.col("value") - F.col("lo_all")) / F.col("width")), F.col("bins") - 1)
               ).otherwise(F.lit(0)).cast("bigint")
    h = j.groupBy("feature", label_col, b.alias("bin"), "lo_all", "width").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("feature", label_col))  # rows: features × classes × bins
    return h.select("feature", label_col, "bin",
                    (F.col("lo_all") + F.col("bin") * F.col("width")).alias("lo"),
                    (F.col("lo_all") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
                    "n", (F.col("n") / (tot * F.nullif(F.col("width"), F.lit(0.0)))).alias("density"))


def kde(df: DataFrame, features: Sequence[str], grid: int = 64, kde_bins: int = 256,
        label_col: str = "label", per_feature_max: dict | None = None) -> DataFrame:
    """Gaussian kernel density per feature and class on a ``grid``-point grid.

    Linear binning: a value's weight is split between the two nearest of
    ``kde_bins`` + 1 equally spaced nodes, by its distance to them; each node then
    contributes to every grid point — cost depends on features × classes × nodes ×
    grid, not on the number of rows. With node distance w and bandwidth h the
    density's relative error is about (w / h)^2 / 8 at most. Bandwidth by Scott's rule
    (sample std × n^(-1/5)).
    """
    long = _values(df, features, label_col, per_feature_max)
    rng = _ranges(long)
    j = long.join(F.broadcast(rng), "feature").withColumn(
        "fw", (F.col("hi_all") - F.col("lo_all")) / F.lit(kde_bins))
    place = F.when(F.col("fw") > 0, (F.col("value") - F.col("lo_all")) / F.col("fw")).otherwise(F.lit(0.0))
    j = j.withColumn("place", place).withColumn("left", F.least(F.floor("place"), F.lit(kde_bins - 1)).cast("bigint"))
    share = F.col("place") - F.col("left")
    per_left = j.groupBy("feature", label_col, "lo_all", "hi_all", "fw", "left").agg(
        F.sum(1.0 - share).alias("w0"), F.sum(share).alias("w1"))
    both = F.explode(F.array(F.struct(F.col("left").alias("node"), F.col("w0").alias("w")),
                             F.struct((F.col("left") + 1).alias("node"), F.col("w1").alias("w")))).alias("x")
    binned = (per_left.select("feature", label_col, "lo_all", "hi_all", "fw", both)
              .groupBy("feature", label_col, "lo_all", "hi_all", "fw", F.col("x.node").alias("fbin"))
              .agg(F.sum("x.w").alias("cnt")))
    stats = long.groupBy("feature", label_col).agg(F.count("value").alias("n"),
                                                   F.stddev_samp("value").alias("sd"))
    stats = stats.select("feature", label_col, "n",
                         (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    bs = binned.join(stats, ["feature", label_col]).where(F.col("bw") > 0)
    center = F.col("lo_all") + F.col("fbin") * F.col("fw")
    step = (F.col("hi_all") - F.col("lo_all")) / F.lit(grid - 1)
    ex = bs.select("feature", label_col, "n", "bw", "cnt", center.alias("c"), "lo_all", step.alias("step"),
                   F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    x = F.col("lo_all") + F.col("g") * F.col("step")
    contrib = F.col("cnt") * F.exp(F.lit(-0.5) * F.pow((x - F.col("c")) / F.col("bw"), F.lit(2.0)))
    return (ex.groupBy("feature", label_col, "g", "n", "bw", "lo_all", "step")
            .agg(F.sum(contrib).alias("s"))
            .select("feature", label_col, F.col("g").cast("bigint").alias("g"),
                    (F.col("lo_all") + F.col("g") * F.col("step")).alias("x"),
                    (F.col("s") / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density")))


# --- D8 / D9: describe ------------------------------------------------------------

def exact_quantiles(long: DataFrame, probs=(0.25, 0.5, 0.75), group_col: str = "feature",
                    value_col: str = "value", buckets: int = 1024, count_col: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation, like numpy / ``quantile_cont``) per group, at any scale.

    No task ever holds all values of a group:
    1. approximate bucket edges per group (``percentile_approx``: bounded sketch);
    2. row counts per (group, bucket) and cumulative offsets on that small table;
    3. the buckets containing the needed ranks floor/ceil(p·(n−1)) are found;
    4. only rows of those buckets are counted per distinct value (ties collapse in
       the partial aggregate) and a cumulative sum picks the values at the ranks.
    ``count_col``: how many rows each row stands for (tied values counted beforehand), else one.
    Output: (group, p, q).
    """
    g, v = group_col, value_col
    d = long.where(F.col(v).isNotNull()).select(g, F.col(v).cast("double").alias("v"), (F.lit(1) if count_col is None else F.col(count_col)).cast("long").alias("m"))
    fr = [i / buckets for i in range(1, buckets)]
    edges = d.groupBy(g).agg(F.percentile_approx("v", fr, 10 * buckets).alias("edges"),
                             F.sum("m").alias("n"))  # bounded: groups × buckets
    # two levels: which 32nd edge, then the edges below it (about 64 comparisons a value)
    step = 32
    coarse = F.expr(f"filter(edges, (e, i) -> i % {step} = {step - 1})")
    db = d.join(edges.select(g, "edges", coarse.alias("coarse")), g)
    db = db.withColumn("c", F.size(F.filter("coarse", lambda e: e < F.col("v"))))
    b = (F.col("c") * step + F.size(F.filter(F.slice("edges", F.col("c") * step + 1, step), lambda e: e < F.col("v")))).alias("b")
    db = db.select(g, "v", "m", b)
    bc = db.groupBy(g, "b").agg(F.sum("m").alias("nb"))
    w = Window.partitionBy(g).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    off = bc.select(g, "b", "nb", F.coalesce(F.sum("nb").over(w), F.lit(0)).alias("start"))
    tg = edges.select(g, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    tg = tg.select(g, "p", (F.col("p") * (F.col("n") - 1)).alias("pos"))
    tg = tg.select(g, "p", "pos", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("r"))
    hit = tg.join(off, (tg[g] == off[g]) & (off["start"] <= tg["r"]) & (tg["r"] < off["start"] + off["nb"])) \
        .select(tg[g].alias(g), "p", "pos", "r", "b", "start")
    need = hit.select(g, "b").distinct()  # bounded: groups × 2·len(probs)
    vc = (db.join(need, [g, "b"]).groupBy(g, "b", "v").agg(F.sum("m").alias("c")))
    wv = Window.partitionBy(g, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    vc = vc.select(g, "b", "v", "c", F.coalesce(F.sum("c").over(wv), F.lit(0)).alias("before"))
    at = hit.join(vc, [g, "b"]).where((F.col("start") + F.col("before") <= F.col("r"))
                                      & (F.col("r") < F.col("start") + F.col("before") + F.col("c")))
    lohi = at.groupBy(g, "p", "pos").agg(F.min("v").alias("v_lo"), F.max("v").alias("v_hi"),
                                          F.min("r").alias("r_lo"))
    q = F.col("v_lo") + (F.col("pos") - F.col("r_lo")) * (F.col("v_hi") - F.col("v_lo"))
    return lohi.select(g, "p", q.alias("q"))


def describe_numeric(df: DataFrame, features: Sequence[str], exact: bool = True,
                     accuracy: int = 100000) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max per feature.

    ``exact=True`` computes the quartiles with ``exact_quantiles`` (bounded
    memory per task at any size); ``exact=False`` uses ``percentile_approx``.
    """
    long = unpivot_features(df.withColumn("_lbl", F.lit(None).cast("string")), features, "_lbl")
    v = F.col("value")
    base = long.groupBy("feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    if exact:
        # the exact algorithm reads the values several times: materialise them once
        long = materialize(long.where(v.isNotNull()), "describe-values")
        base = long.groupBy("feature").agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"))
        qs = exact_quantiles(long, (0.25, 0.5, 0.75))
        piv = qs.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                          for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
        out = base.join(piv, "feature", "left")
    else:
        q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
        out = base.join(long.groupBy("feature").agg(q.alias("_q")), "feature").select(
            "*", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"))
    return out.select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count (non-null), unique, top (most frequent; ties -> smallest value), freq."""
    base = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = base.unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    agg = vc.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                                   F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("t"))
    return agg.select("column", F.col("count").cast("bigint").alias("count"), "unique",
                      F.col("t.v").alias("top"), (-F.col("t.neg")).alias("freq"))
