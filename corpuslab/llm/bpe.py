"""Operator 8: byte-level BPE encoding and decoding with tiktoken.

The rank file is a parameter. The driver reads it once and broadcasts its bytes (a fixed
file, under 1 MB); each Python worker builds one encoder from them. A text longer than
``most`` characters is encoded in pieces, cut only where every match of the split pattern
must end: after a letter or digit that is followed by a space and then by a character that
isn't white space, or between a letter and a character that is neither letter, digit,
apostrophe nor white space. The ids of the pieces are those of the whole text.

Decoding joins the bytes of the ids; the result is binary, as an id may hold a part of a character.

Defined cases: null and empty texts give no ids and empty bytes; null ids decode to empty
bytes; an id outside the vocabulary raises; repeated rows are encoded each on its own; an
empty table gives an empty table. Other columns pass through; existing columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, texts_of

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MOST = 1 << 16
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?= \S)|(?<=\p{L})(?=[^\s\p{L}\p{N}'])")

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(rank_file: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file's content, built once per process."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _encoders:
        pairs = (line.split() for line in rank_file.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encoders[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def pieces(text: str, most: int = MOST) -> Iterator[str]:
    """Cut a text at safe places into pieces of at least ``most`` characters (the last may be shorter)."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, most: int = MOST) -> np.ndarray:
    if len(text) <= most:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, most)])


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [values], names=[*kept, name])


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", rank_file: str = DEFAULT_RANKS,
           most: int = MOST, keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text_col`` (array<int>); without the text if ``keep_text`` is false."""
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = _replaced(docs.schema, out, T.ArrayType(T.IntegerType()))
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in by_bytes(batches, text_col):
            ids = [encode_text(enc, t, most) for t in texts_of(batch.column(text_col)).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            if not keep_text:
                batch = batch.drop_columns([text_col])
            yield _with(batch, out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", rank_file: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with the bytes of the ids in ``ids_col`` (binary)."""
    with open(rank_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column(ids_col)
                flat, off = ids.flatten().to_numpy(zero_copy_only=False), [0]
                for k in ids.value_lengths().to_pylist():
                    off.append(off[-1] + (k or 0))
                raw = [enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(off, off[1:])]
                yield _with(batch, out, pa.array(raw, pa.binary()))

    return df.mapInArrow(run, _replaced(df.schema, out, T.BinaryType()))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = DEFAULT_RANKS) -> DataFrame:
    """Per document: id, number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
    ids = encode(docs.select(id_col, text_col), text_col, "ids", rank_file, keep_text=False)
    both = decode(ids, "ids", "decoded", rank_file)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(F.col(id_col), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
