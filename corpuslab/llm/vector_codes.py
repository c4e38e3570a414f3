"""Operator 11: compressing vectors to product codes by slicing and intersecting bit masks.

Vectors are cut into equal consecutive parts; each part position has a codebook of at most 256
entries, and a vector's code is the index of the nearest entry for each part. Components
are integers (floor of ``scale`` times the value), so every sum is exact and does not
depend on the order of rows or on how they are partitioned.

Nearest entries are found per dimension: the entries' coordinates are sorted, and beside each
place stands the mask (uint64 words, one bit an entry) of the entries before it. An initial
radius is the distance to the nearer of the two entries on both sides of the value in the
widest dimension. An entry no farther than that lies within the radius in every dimension, so
two binary searches a dimension select a range of entries, whose mask is that of the upper end
without that of the lower; the masks of all dimensions ANDed give the candidates. Distances
are computed only for these, and the nearest (ties: lower index) is exact.

Learning: each round is one pass over the written integer vectors, in which each task sums counts and
components per (part, entry), and Spark adds these up. The driver holds the codebooks and
one row of sums for each entry: entries x dimensions numbers, whatever the number of vectors.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped;
the first codebook has the smallest ids (null ids last; repeated ids in the order of their vectors), fewer where fewer
vectors are kept; an entry that no part is nearest to stays; repeated rows count as often as
they occur; equal entries: the lower index gets all; an empty table gives an empty table and empty codebooks. Vectors whose length differs or
can't be cut into the parts, and integers of 2**28 or more (their squared distances would not fit a long) stop the job with a message. Other columns pass through
``encode`` (names with a leading ``_x_`` are reserved).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import attach
from ..session import materialize
from .common import release

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers below this have exact squared distances in a long.
LARGEST = 1 << 28
#: Vectors handled at a time in a task.
ROWS = 4096


class Slices:
    """The codebook of one part, sorted by each dimension, with the masks of the entries before each place."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        k, d = self.entries.shape
        self.words = max(1, -(-k // 64))
        bit = np.zeros((k, self.words), np.uint64)
        bit[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        self.before = np.zeros((d, k + 1, self.words), np.uint64)
        for j in range(d):
            self.before[j, 1:] = np.bitwise_or.accumulate(bit[order[:, j]], axis=0)
        self.all = np.bitwise_or.reduce(bit, axis=0)
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if d else -1
        self.by_widest = order[:, self.widest] if d else np.zeros(k, np.int64)

    def _distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """For each row: the whole part of the distance to the nearer neighbour in the widest dimension."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64)
        at = np.searchsorted(self.sorted[:, self.widest], x[:, self.widest])
        last = len(self.entries) - 1
        near = np.minimum(self._distance(x, self.by_widest[np.maximum(at - 1, 0)]), self._distance(x, self.by_widest[np.minimum(at, last)]))
        r = np.sqrt(near.astype(np.float64)).astype(np.int64)
        r -= r * r > near  # the root of a double may be off by one
        return r + ((r + 1) * (r + 1) <= near)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries within the radius in every dimension."""
        mask = np.repeat(self.all[None], len(x), axis=0)
        for j in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            hi = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            mask &= self.before[j, hi] & ~self.before[j, lo]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: index of the nearest entry (ties: the lowest) and the squared distance."""
        mask = self.candidates(x, self.radius(x))
        best, found = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(mask[:, e // 64] & (np.uint64(1) << np.uint64(e % 64)))
            d = self._distance(x[rows], np.full(len(rows), e))
            closer = d < best[rows]
            best[rows[closer]], found[rows[closer]] = d[closer], e
        return found, best


@dataclass
class Codebooks:
    """``entries``: integers by part, entry and position within the part."""

    entries: np.ndarray

    def slices(self) -> list[Slices]:
        return [Slices(p) for p in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """The rows whose vector is whole and finite, with its integer components in ``_x_v``."""
    ok = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    far = F.exists("_x_v", lambda x: F.abs(x) >= LARGEST)
    told = F.raise_error(F.lit(f"a component is {LARGEST} / {scale} or more")).cast("array<int>")
    rows = vectors.where(ok).withColumn("_x_v", value)
    return rows.withColumn("_x_v", F.when(far, told).otherwise(F.col("_x_v").cast("array<int>")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} components expected, one has {lengths[lengths != width][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _learn(ints: DataFrame, id_col: str, parts: int, entries: int, rounds: int) -> Codebooks:
    first = ints.select(F.col(id_col), "_x_v").orderBy(F.col(id_col).asc_nulls_last(), "_x_v").limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    width = len(first[0]["_x_v"])
    if width % parts or any(len(r["_x_v"]) != width for r in first):
        raise ValueError(f"vectors of {sorted({len(r['_x_v']) for r in first})} components can't be cut into {parts} equal parts")
    dims = width // parts
    books = np.array([r["_x_v"] for r in first], np.int64).reshape(len(first), parts, dims).transpose(1, 0, 2).copy()
    k = len(first)
    schema = "part int, entry int, n long" + "".join(f", s{j} long" for j in range(dims))

    for _ in range(rounds):
        now = books.copy()

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            slices = [Slices(p) for p in now]
            n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, dims), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = _matrix(batch.slice(at, ROWS).column(0), width).reshape(-1, parts, dims)
                    for p, s in enumerate(slices):
                        own, _ = s.nearest(x[:, p])
                        n[p] += np.bincount(own, minlength=k)
                        order = np.argsort(own, kind="stable")
                        ends = np.searchsorted(own[order], np.arange(k + 1))
                        run = np.vstack([np.zeros((1, dims), np.int64), np.cumsum(x[order, p], axis=0)])
                        total[p] += run[ends[1:]] - run[ends[:-1]]
            part, entry = np.divmod(np.flatnonzero(n.ravel()), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
                 *(pa.array(total[part, entry, j]) for j in range(dims))], names=["part", "entry", "n", *(f"s{j}" for j in range(dims))])
            release()

        found = ints.select("_x_v").mapInArrow(sums, schema).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(dims)]).collect()  # parts x entries rows
        for r in found:
            books[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
    return Codebooks(books)


def _encoded(ints: DataFrame, books: Codebooks) -> DataFrame:
    parts, k, dims = books.entries.shape
    kept = [f for f in ints.schema.fields if f.name not in ("_x_v", "code", "error")]
    schema = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = books.slices()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch.column("_x_v"), parts * dims).reshape(-1, parts, dims)
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p, s in enumerate(slices):
                    own, gap = s.nearest(x[:, p])
                    code[:, p] = own
                    error += gap
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in kept), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                    names=schema.names)
        release()

    return ints.mapInArrow(run, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """The kept rows without the vector, with ``code`` (two hex digits a part) and ``error``; and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    ints = materialize(integers(vectors, vec_col, scale).drop(vec_col), "vector-integers")
    books = _learn(ints, id_col, parts, entries, rounds)
    return _encoded(ints, books), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` (read twice: written first) with ``label_error``, the sum of ``error`` over equal labels (nulls together)."""
    rows = materialize(coded, "vector-codes")
    per: DataFrame = rows.groupBy(label_col).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_x_n"))
    return attach(rows, per, label_col)


def decode(coded: DataFrame, books: Codebooks, out: str = "vector") -> DataFrame:
    """``coded`` with the integer components that ``code`` stands for (null for a null code)."""
    schema = T.StructType([*(f for f in coded.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if c is None else bytes.fromhex(c) for c in batch.column("code").to_pylist()]
            values = [None if c is None else np.concatenate([p[i] for p, i in zip(books.entries, c)]) for c in codes]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]),
                                              pa.array(values, pa.list_(pa.int64()))], names=schema.names)

    return coded.mapInArrow(run, schema)
