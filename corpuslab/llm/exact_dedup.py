"""Operator 4: exact deduplication by content sort.

Texts are normalised (each run of space and 0x09-0x0D becomes one space; null is empty) and
range-partitioned by their first ``HEAD`` characters, a 64-bit hash and the id, with splitters
that Spark samples (so the driver gets short keys, not whole texts). Each partition is sorted
by these, with the whole normalised bytes before the id (spilling if need be): equal texts lie side by side and the
smallest id comes first. One pass compares each row with the one before it, whole text with
whole text. As the id is a part of the range key, a group of any size spreads over
partitions. Only the first and last group of a partition can go on in another one: these two
rows a partition carry their text, are grouped by it, and correct the rest.

Defined cases: a null id sorts last, so it stays only if its whole group has none; of
repeated rows with one id just one stays; an empty table gives an empty table; other columns
pass through (names with a leading ``_x_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import release, small_batches, texts_of

#: Runs of white space that aren't one space already.
NOT_NORMAL = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOT_NORMAL, " ")


#: Characters of a text in the range key.
HEAD = 16


def _by_content(docs: DataFrame, id_col: str) -> DataFrame:
    d = docs.withColumns({"_x_head": F.substring("_x_norm", 1, HEAD), "_x_hash": F.xxhash64("_x_norm")})
    last = F.col(id_col).asc_nulls_last()
    d = d.repartitionByRange("_x_head", "_x_hash", last)
    return d.sortWithinPartitions("_x_head", "_x_hash", "_x_norm", last).drop("_x_head", "_x_hash")


def _starts(texts: pa.Array, before: str | None) -> np.ndarray:
    """True where a text differs from the one before it."""
    n = len(texts)
    differs = np.ones(n, bool)
    if n > 1:
        differs[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    differs[0] = before is None or texts[0].as_py() != before
    return differs


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256."""
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col), normalized(F.col(text_col)).alias("_x_norm"))
    rows = _by_content(slim, id_col).select(id_col, "_x_norm", F.sha2("_x_norm", 256).alias("text_sha256"))
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("text_sha256", T.StringType()),
                           T.StructField("keep_id", kind), T.StructField("group_size", T.LongType()),
                           T.StructField("kept", T.BooleanType()), T.StructField("_x_part", T.IntegerType()),
                           T.StructField("_x_edge", T.IntegerType()), T.StructField("_x_text", T.StringType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # ids and digests of the group that may go on
        text, number = None, 0

        def done(last: bool) -> pa.RecordBatch:
            ids, sha = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            n, edge = len(ids), 0 if number == 0 else 1 if last else -1
            first = np.zeros(n, bool)
            first[0] = True
            return pa.RecordBatch.from_arrays(
                [ids, sha, pa.concat_arrays([ids.slice(0, 1)]).take(pa.array(np.zeros(n, np.int64))),
                 pa.array(np.full(n, n)), pa.array(first), pa.array(np.full(n, part, np.int32)),
                 pa.array(np.full(n, edge, np.int32)),
                 pa.array([text if edge >= 0 else None] + [None] * (n - 1), pa.string())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column("_x_norm"))
            light = batch.select([id_col, "text_sha256"])
            at = np.flatnonzero(_starts(texts, text))
            if at.size == 0:
                held.append(light)
                continue
            if at[0] > 0:
                held.append(light.slice(0, int(at[0])))
            if held:
                yield done(False)
                number += 1
            if at.size > 1:  # groups that begin and end here
                a, b = int(at[0]), int(at[-1])
                size = np.diff(at)
                own = np.repeat(at[:-1], size)
                edge = np.full(b - a, -1, np.int32)
                shown = [None] * (b - a)
                if number == 0:
                    edge[:size[0]] = 0
                    shown[0] = texts[a].as_py()
                yield pa.RecordBatch.from_arrays(
                    [light.column(0).slice(a, b - a), light.column(1).slice(a, b - a),
                     light.column(0).take(pa.array(own)), pa.array(np.repeat(size, size).astype(np.int64)),
                     pa.array(np.isin(np.arange(a, b), at[:-1])), pa.array(np.full(b - a, part, np.int32)),
                     pa.array(edge), pa.array(shown, pa.string())], names=schema.names)
                number += at.size - 1
            held, text = [light.slice(int(at[-1]))], texts[int(at[-1])].as_py()
        if held:
            yield done(True)
        release()

    with small_batches(docs.sparkSession):
        t = materialize(rows.mapInArrow(mark, schema), "exact-groups")
    # A group that is the first or last of a partition may have parts in others; two rows a partition.
    ends = t.where(F.col("_x_text").isNotNull())
    whole = ends.groupBy("_x_text").agg(
        F.min_by("keep_id", "_x_part").alias("_x_keep"), F.sum("group_size").alias("_x_size"),
        F.min("_x_part").alias("_x_home"), F.collect_set(F.struct("_x_part", "_x_edge")).alias("_x_at"))
    fix = whole.select("_x_keep", "_x_size", "_x_home", F.explode("_x_at").alias("_x_at")).select(
        F.col("_x_at._x_part").alias("_x_part"), F.col("_x_at._x_edge").alias("_x_edge"), "_x_keep", "_x_size", "_x_home")
    edge_rows = t.where("_x_edge >= 0").join(F.broadcast(fix), ["_x_part", "_x_edge"]).select(
        F.col(id_col), F.col("_x_keep").alias("keep_id"), F.col("_x_size").alias("group_size"),
        (F.col("kept") & (F.col("_x_part") == F.col("_x_home"))).alias("kept"), "text_sha256")
    return t.where("_x_edge < 0").select(*edge_rows.columns).unionByName(edge_rows)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The original text moves beside its normal form only where the two differ, and is put back for the rows that stay.
    """
    names = docs.columns
    same = F.col(text_col) == F.col("_x_norm")
    slim = docs.withColumn("_x_norm", normalized(F.col(text_col))).withColumn("_x_same", F.coalesce(same, F.lit(False)))
    slim = slim.withColumn(text_col, F.when(~F.col("_x_same"), F.col(text_col)))
    rows = _by_content(slim, id_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("_x_part", T.IntegerType()),
                           T.StructField("_x_text", T.StringType())])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        text, number, last = None, 0, None

        def out(rows: pa.RecordBatch, shown: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in names), pa.array([part] * rows.num_rows, pa.int32()),
                 pa.array(shown, pa.string())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column("_x_norm"))
            at = np.flatnonzero(_starts(texts, text))
            if at.size == 0:
                continue
            if last is not None:
                yield out(last, [text if number == 0 else None])
                number += 1
            found = batch.take(pa.array(at))
            whole = pc.if_else(found.column("_x_same"), found.column("_x_norm"), found.column(text_col))
            found = found.set_column(names.index(text_col), text_col, whole)
            if at.size > 1:
                yield out(found.slice(0, at.size - 1), [texts[int(at[0])].as_py() if number == 0 and k == 0 else None for k in range(at.size - 1)])
                number += at.size - 1
            last, text = found.slice(at.size - 1, 1), texts[int(at[-1])].as_py()
        if last is not None:
            yield out(last, [text])
        release()

    with small_batches(docs.sparkSession):
        t = materialize(rows.mapInArrow(firsts, schema), "exact-firsts")
    ends = t.where(F.col("_x_text").isNotNull())
    home = ends.groupBy("_x_text").agg(F.min("_x_part").alias("_x_home"))
    stay = ends.join(home, "_x_text").where(F.col("_x_part") == F.col("_x_home"))
    return t.where(F.col("_x_text").isNull()).select(*names).unionByName(stay.select(*names))
