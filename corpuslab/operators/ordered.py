"""Positions in a sorted table, and values per key joined to rows with hot keys set apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A key with more than 1 / HOT of all rows is joined by broadcast: there are fewer than HOT of these.
HOT = 1024


def positions(rows: DataFrame, group: str, order: Sequence[Column], name: str, out: str = "idx") -> DataFrame:
    """``rows`` (written once) with 0-based positions ``out`` within ``group`` in the given order, and the group's size ``n``.

    Rows are range-partitioned and sorted by group and order, so a hot group spreads over
    partitions. A row's number inside its partition, less that of its group's first row there,
    plus the group's rows in the partitions before, is its position: only counts per
    (group, partition) are summed, at most one row a partition and group. ``group`` has no nulls.
    """
    keys = [F.col(group), *order]
    at = {"_x_part": F.spark_partition_id(), "_x_id": F.monotonically_increasing_id()}
    t = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(at), name)
    per = t.groupBy(group, "_x_part").agg(F.count(F.lit(1)).alias("_x_c"), F.min("_x_id").alias("_x_0"))
    of = Window.partitionBy(group)  # rows: the partitions that a group is in
    before = F.sum("_x_c").over(of.orderBy("_x_part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(group, "_x_part", (F.coalesce(before, F.lit(0)) - F.col("_x_0")).alias("_x_0"), F.sum("_x_c").over(of).alias("n"))
    return t.join(per, [group, "_x_part"]).withColumn(out, F.col("_x_id") + F.col("_x_0")).drop("_x_part", "_x_id", "_x_0")


def running(rows: DataFrame, group: str, order: Sequence[Column], value: str, name: str, out: str = "before", block: int = 4096) -> DataFrame:
    """``rows`` (written once) with ``out``: the sum of ``value`` over the group's rows before it.

    Blocks of ``block`` positions are summed; a row adds what comes before it in its block to the blocks before.
    """
    t = positions(rows, group, order, name, "_x_at").withColumn("_x_block", F.floor(F.col("_x_at") / block)).drop("n")
    t = t.withColumn("_x_sum", F.sum(value).over(Window.partitionBy(group, "_x_block").orderBy("_x_at")) - F.col(value))
    per = t.groupBy(group, "_x_block").agg(F.sum(value).alias("_x_c"))
    before = F.sum("_x_c").over(Window.partitionBy(group).orderBy("_x_block").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(group, "_x_block", F.coalesce(before, F.lit(0)).alias("_x_0"))
    return t.join(per, [group, "_x_block"]).withColumn(out, F.col("_x_sum") + F.col("_x_0")).drop("_x_at", "_x_block", "_x_sum", "_x_0")


def attach(rows: DataFrame, per_key: DataFrame, key: str, count: str = "_x_n") -> DataFrame:
    """``rows`` joined (null keys with null keys) to ``per_key``, which has one row a key and in ``count`` the key's rows.

    Keys that hold many rows are broadcast, which bounds their number, and so no task of the
    other join gets more than about 1 / HOT of all rows from one key. ``rows`` and ``per_key`` are read twice.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    renamed = per_key.withColumnRenamed(key, "_x_key")
    same = F.col(key).eqNullSafe(F.col("_x_key"))
    many, few = renamed.where(hot), renamed.where(~hot)
    by_hot = rows.join(F.broadcast(many), same)
    rest = rows.join(F.broadcast(many.select("_x_key")), same, "left_anti").join(few, same)
    return by_hot.unionByName(rest).drop("_x_key", count)
