"""Operator 9: near-duplicate components from an inverted index of MinHash coordinates.

A document's set holds its distinct shingles of ``shingle`` words (default 4; 64-bit hashes of
lower-cased words); two documents are linked if their sets' Jaccard similarity is at least 80 %.

1. One pass makes each document's set, its hash (``node``: equal sets are one node) and
   ``PERMS`` MinHash coordinates. Sets aren't kept.
2. Inverted join: a node is posted under each of its coordinate-value pairs. Linked nodes agree
   on at least ``MATCH`` coordinates (at similarity 0.8 fewer than that occur with probability
   3.2e-7), so two of them share a pair even if only the ``PERMS - MATCH + 1`` first pairs of each
   (its prefix) are kept, in any order of pairs that is the same for all. The order is by the exact
   length of the posting lists, shortest first: a passage that many documents share
   stands last and makes no candidates.
3. Skip merging: each posting list gives one edge per member, to its smallest member, never
   all pairs. Components of these edges are clusters within which all links lie.
4. Each cluster's texts meet once, in blocks of bounded size; large clusters are dealt over a
   grid of block pairs. A task counts coordinate collisions, drops pairs below ``MATCH``, takes the
   others by falling count, skips those that are already connected, and confirms the rest on full sets.
5. Components of the confirmed links.

Defined cases: null texts and texts without words have size 0 and are linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; repeated rows fall together; a null
id is never the smallest unless all ids of a component are null (then component_id is null and
kept true); an empty table gives an empty table. Extra columns are ignored or passed through; ``_x_`` names are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import by_bytes, texts_of
from .components import connected
from .words import BASE, Words, mix, windows

SHINGLE, PERMS, MATCH, PERCENT = 4, 64, 34, 80
#: Most nodes and most shingles of a block.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000

U = np.uint64
_XOR = mix(np.arange(1, PERMS + 1, dtype=np.uint64) * U(0xD1B54A32D192ED03))
_MUL = mix(np.arange(1, PERMS + 1, dtype=np.uint64) * U(0x8CB92BA72F3D8DD7)) | U(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = Words(texts)
    hashes = words.hashes()
    grams, doc = windows(hashes, words.first, n)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = [np.unique(grams[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    for k in range(1, n):
        if (words.count == k).any():
            whole, doc = windows(hashes, words.first, k)
            whole = mix(whole ^ BASE * np.array([k], np.uint64))
            for i in np.flatnonzero(words.count == k).tolist():
                at = np.searchsorted(doc, i)
                out[i] = whole[at:at + 1]
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash coordinates of a nonempty set."""
    least = np.full(PERMS, ~U(0))
    for at in range(0, shingles.size, 8192):
        x = (shingles[at:at + 8192, None] ^ _XOR) * _MUL
        least = np.minimum(least, (x ^ (x >> U(29))).min(axis=0))
    return (mix(least) >> U(32)).astype(np.uint32)


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, _x_tx (hash of the text), n_shingles, node, sig for each row."""
    slim = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("_x_tx"), F.col(text_col).alias("_x_text"))
    schema = T.StructType([slim.schema[id_col], slim.schema["_x_tx"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_x_text"):
            sets = shingle_sets(texts_of(b.column("_x_text")), shingle)
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if s.size else None for s in sets]
            sig = [signature(s).tobytes() if s.size else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("_x_tx"), pa.array([s.size for s in sets], pa.int64()),
                 pa.array(node, pa.int64()), pa.array(sig, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), PERMS)


def _pairs_of(sig: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as one number each."""
    return (np.arange(PERMS, dtype=np.int64) << 32) | sig.astype(np.int64)


def _postings(nodes: DataFrame) -> DataFrame:
    """(pair, node) for every coordinate-value pair of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                pairs = _pairs_of(_matrix(b.column("sig")))
                node = np.repeat(b.column("node").to_numpy(), PERMS)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.ravel()), pa.array(node)], names=["pair", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "pair long, node long")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(pair, node): of each node the pairs in its prefix that another node has too.

    Pairs that one node alone has stand first in the order and link nothing, so of a node with
    s shared pairs the s - MATCH + 1 rarest remain; a node with fewer than MATCH is out.
    """
    postings = _postings(nodes)
    lists = postings.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = postings.join(lists, "pair")
    by_node = Window.partitionBy("node")
    rank = F.row_number().over(by_node.orderBy("n", F.xxhash64("pair"), "pair"))
    ranked = shared.withColumns({"rank": rank, "s": F.count(F.lit(1)).over(by_node)})
    return ranked.where(F.col("rank") <= F.col("s") - (MATCH - 1)).select("pair", "node")


def _confirm(key: tuple, t: pa.Table, shingle: int) -> pa.Table:
    """Confirmed links of one block, or of one pair of blocks; no link between nodes already connected."""
    left, right = key[1].as_py(), key[2].as_py()
    node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
    sets = shingle_sets(texts_of(t.column("text")), shingle)
    sig = np.stack([signature(s) for s in sets])
    size = np.array([s.size for s in sets])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        near = (sig[rest] == sig[i]).sum(axis=1)
        small, big = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        ok = (near >= MATCH) & (100 * small >= PERCENT * big)
        if left != right:
            ok &= block[rest] != block[i]
        j = np.flatnonzero(ok)
        found.append((np.full(j.size, i), j + i + 1, near[j]))
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    if found:
        a, b, near = (np.concatenate(x) for x in zip(*found))
        for k in np.argsort(-near, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = find(i), find(j)
            if x == y:
                continue
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * both >= PERCENT * (size[i] + size[j] - both):
                parent[x] = y
                links.append((int(node[i]), int(node[j])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Confirmed links (a, b) between nodes: enough of them to connect whatever is linked."""
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_x_tx").alias("t"))).alias("r"),
        F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = materialize(nodes.select("node", F.col("r.i").alias("_x_id"), F.col("r.t").alias("_x_tx"), "sig", "n"), "minhash-nodes")
    prefix = materialize(_prefixes(nodes), "minhash-prefixes")
    heads = prefix.groupBy("pair").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = prefix.join(heads, "pair").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    cluster = materialize(connected(edges, "minhash-clusters"), "minhash-cluster")

    sized = cluster.join(nodes.select("node", "_x_id", "_x_tx", "n"), "node")
    grid = sized.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = sized.join(grid, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    member = member.select("root", "node", "_x_id", "_x_tx", "block", other)
    member = member.select("root", "node", "_x_id", "_x_tx", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    texts = docs.select(F.col(id_col).alias("_y_id"), F.xxhash64(F.col(text_col)).alias("_y_tx"), F.col(text_col).alias("text"))
    wanted = sized.select("node", "_x_id", "_x_tx")
    own = texts.join(wanted, F.col("_y_tx").eqNullSafe(F.col("_x_tx")) & F.col("_y_id").eqNullSafe(F.col("_x_id")))
    own = own.groupBy("node").agg(F.first("text").alias("text"))  # repeated rows: once
    tasks = member.select("root", "node", "block", "lo", "hi").join(own, "node")
    found = tasks.groupBy("root", "lo", "hi").applyInArrow(lambda key, t: _confirm(key, t, shingle), "a long, b long")
    return materialize(found, "minhash-links")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Per row: id, _x_tx (hash of the text), n_shingles, _x_root (null without words)."""
    signed = materialize(_signed(docs, id_col, text_col, shingle), "minhash-signed")
    roots = connected(links(docs, signed, id_col, text_col, shingle), "minhash-components")
    rows = signed.drop("sig").join(roots, "node", "left")
    return rows.select(F.col(id_col), "_x_tx", "n_shingles", F.coalesce("root", "node").alias("_x_root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id of its component), kept."""
    rows = _components(docs, id_col, text_col, shingle)
    least = rows.where("_x_root is not null").groupBy("_x_root").agg(F.min(id_col).alias("_x_least"))
    rows = rows.join(least, "_x_root", "left")
    comp = F.when(F.col("_x_root").isNull(), F.col(id_col)).otherwise(F.col("_x_least"))
    return rows.select(F.col(id_col), "n_shingles", comp.alias("component_id"), F.col(id_col).eqNullSafe(comp).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one of each component, and all rows without words.

    It is the row with the smallest id (null last), then the smallest hash of its text.
    """
    names = docs.columns
    first = F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_x_tx").alias("t")))
    stay = _components(docs, id_col, text_col, shingle).where("_x_root is not null").groupBy("_x_root").agg(first.alias("r"))
    stay = stay.select(F.col("r.i").alias("_y_id"), F.col("r.t").alias("_y_tx"))
    d = docs.withColumn("_x_tx", F.xxhash64(F.col(text_col)))
    bare = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col("_x_tx").eqNullSafe(F.col("_y_tx")) & F.col(id_col).eqNullSafe(F.col("_y_id"))
    once = F.row_number().over(Window.partitionBy("_x_tx", id_col).orderBy(F.lit(0)))
    kept = d.where(~bare).join(stay, same).withColumn("_x_once", once).where("_x_once = 1")
    return kept.select(*names).unionByName(docs.where(bare))
