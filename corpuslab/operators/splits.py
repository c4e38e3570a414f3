"""Exact balancing, seeded shuffling, snake-dealt group folds (the solver: ``folds``), group sampling.

Randomness is a seeded md5 of the row id, so results do not depend on
partitioning or executor loss (a recomputed task gives the same rows).

Ranking inside a class never uses one window over the whole class (two classes
would mean two tasks holding everything). ``two_stage_rank`` numbers rows
exactly in two steps: counts per (class, bucket) where the bucket is an
order-preserving prefix of the sort key (a small table: classes × 4096 or
16^prefix buckets), cumulative offsets over that small table, and a
``row_number`` inside each bucket (about n / 4096 rows per bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(id_col, seed: int = 42, salt: str = "") -> Column:
    """md5 hex of '<id>-<salt><seed>': a deterministic pseudo-random sort key."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f"-{salt}{seed}")))


def two_stage_rank(df: DataFrame, part: Sequence[str], order: Sequence[tuple[str, bool]], key: str,
                   prefix_len: int = 3, out: str = "_rank") -> DataFrame:
    """Exact 1-based rank within ``part`` by ``order`` columns then the hex ``key``.

    ``order`` lists (column, ascending) pairs that precede the key in the sort; the
    bucket is (order columns, first ``prefix_len`` hex digits of the key), which
    preserves the total order. Equal to ``row_number() over (partition by part
    order by order..., key)``.
    """
    part, ocols = list(part), [c for c, _ in order]
    b = "_bucket"
    d = df.withColumn(b, F.substring(F.col(key), 1, prefix_len))
    bcols = part + ocols + [b]
    counts = d.groupBy(*bcols).agg(F.count(F.lit(1)).alias("_bn"))
    sort = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order] + [F.col(b).asc()]
    w = Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*bcols, F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*bcols).orderBy(F.col(key)))
    ranked = d.withColumn("_rn", rn).join(offsets, bcols)
    return ranked.withColumn(out, F.col("_off") + F.col("_rn")).drop(b, "_rn", "_off")


def balance_classes(df: DataFrame, label_col: str = "label", id_col: str = "doc_id", seed: int = 42,
                    prefix_len: int = 3) -> DataFrame:
    """B1: exact-size undersampling of every larger class to the smallest class size.

    Rows kept in a larger class are those with the smallest seeded md5 keys. Rows
    with a null label are dropped. The minimum class size is a scalar subquery.
    A task ranks about n / 16**``prefix_len`` rows at a time.
    """
    d = df.where(F.col(label_col).isNotNull()).withColumn("_key", seeded_key(id_col, seed))
    m = d.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m"))
    ranked = two_stage_rank(d, [label_col], [], "_key", prefix_len)
    return ranked.where(F.col("_rank") <= m.scalar()).drop("_rank", "_key")


def shuffle(df: DataFrame, id_col: str = "doc_id", seed: int = 42, out: str = "shuffle_key") -> DataFrame:
    """B2: a seeded permutation key (sort by it to get the shuffled order)."""
    return df.withColumn(out, seeded_key(id_col, seed, salt="shuffle-"))


def snake_group_folds(df: DataFrame, label_col: str = "label", group_col: str = "group_id", k: int = 5,
                      seed: int = 42, out: str = "fold") -> DataFrame:
    """B3 without a solver: k folds with whole groups per fold and a similar class mix in each.

    Groups are stratified by their majority label (ties: smallest label), ordered
    by size (desc) then seeded md5, and dealt to folds in snake order
    (0..k-1, k-1..0, ...). Group disjointness is exact; class balance is
    approximate (a group larger than 1/k of a class cannot be balanced).
    """
    per = df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
    groups = per.groupBy(group_col).agg(
        F.sum("_n").alias("_size"),
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col(label_col).alias("lab"))).alias("_maj"))
    groups = groups.select(group_col, "_size", F.col("_maj.lab").alias("_stratum"),
                           seeded_key(group_col, seed, salt="group-").alias("_gkey"))
    ranked = two_stage_rank(groups, ["_stratum"], [("_size", False)], "_gkey")
    r = F.col("_rank") - 1
    fold = F.when(F.floor(r / k) % 2 == 0, r % k).otherwise(k - 1 - r % k).cast("int")
    gf = ranked.select(group_col, fold.alias(out))
    return df.join(gf, group_col)


def fold_balance(folds: DataFrame, fold_col: str = "fold", label_col: str = "label") -> DataFrame:
    """Test and train sizes per fold and class."""
    test = folds.groupBy(fold_col, label_col).agg(F.count(F.lit(1)).alias("n_test"))
    tot = F.sum("n_test").over(Window.partitionBy(label_col))  # rows: folds × classes
    return test.select(fold_col, label_col, "n_test", (tot - F.col("n_test")).alias("n_train"))


def sample_groups(df: DataFrame, n: int, group_col: str = "group_id", seed: int = 42) -> DataFrame:
    """Rows of ``n`` distinct groups drawn without replacement (seeded), via a semi-join."""
    ids = (df.where(F.col(group_col).isNotNull()).select(group_col).distinct()
           .orderBy(seeded_key(group_col, seed, salt="sample-")).limit(n))
    return df.join(ids, group_col, "left_semi")


def concat_classes(*frames: DataFrame) -> DataFrame:
    """Append class frames (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_groups(df: DataFrame, group_col: str = "group_id") -> DataFrame:
    """Number of distinct non-null groups."""
    return df.agg(F.count_distinct(group_col).alias("n_groups"))
