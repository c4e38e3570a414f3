"""A1–A5: sentence segmentation and the token table.

The token table is built per document inside one projection (arrays of
sentences -> arrays of tagged tokens -> root per sentence) followed by a single
``posexplode``. No shuffle is needed to number tokens or to find sentence
roots, because a document never leaves its row.

With ``partition_by_doc=True`` (default) the slim ``(doc_id, lang, text)``
projection is hash-partitioned by ``doc_id`` once before annotation. Generate,
Project and Filter keep that partitioning, so every later per-document or
per-sentence aggregate, window and join on ``doc_id`` runs without another
exchange (checked with ``explain``). Pass ``partition_by_doc=False`` when the
input is already bucketed by ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tagger import sql_str, tagged_sentences_sql
from ..functions.text import SENT_RE, TOKEN_RE
from ..session import once_per_worker, tasks_for

TOKEN_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("sent_id", T.IntegerType()),
    T.StructField("token_i", T.IntegerType()),
    T.StructField("token_text", T.StringType()),
    T.StructField("lemma", T.StringType()),
    T.StructField("is_punct", T.BooleanType()),
    T.StructField("is_stop", T.BooleanType()),
    T.StructField("morph", T.StringType()),
    T.StructField("pos", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("dep", T.StringType()),
    T.StructField("head", T.StringType()),
    T.StructField("head_i", T.IntegerType()),
])


#: Characters of text that an annotator hook gets at a time.
HOOK_CHARS = 1 << 20


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None,
          partition_by_doc: bool, num_partitions: int | None) -> DataFrame:
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    if partition_by_doc:
        n = num_partitions or tasks_for(base)
        base = base.repartition(n, "doc_id") if n else base.repartition("doc_id")
    return base


def _sentences_sql(text: str = "text") -> str:
    """Non-empty sentence strings of a document (array<string>), as SQL."""
    return f"filter(regexp_extract_all({text}, {sql_str(SENT_RE)}, 0), s0 -> s0 RLIKE {sql_str(chr(92) + 'S')})"


def segment_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      partition_by_doc: bool = False) -> DataFrame:
    """A1: (doc_id, sent_id, sentence) with a dense running sent_id from 0."""
    base = _slim(docs, id_col, text_col, None, partition_by_doc, None)
    # *_outer + null filter: a plain generator makes Catalyst infer size(array) > 0 and push it
    # below the exchange, which evaluates the array expression twice.
    return (base.select("doc_id", F.posexplode_outer(F.expr(_sentences_sql())).alias("sent_id", "sentence"))
            .where(F.col("sentence").isNotNull()))


def _token_array_sql() -> str:
    """All tagged tokens of a document in order, with sentence id, root and head text (SQL)."""
    sents = tagged_sentences_sql("lang", _sentences_sql(), TOKEN_RE)
    return (f"flatten(transform({sents}, (sv, i) -> transform(sv.toks, w -> named_struct("
            "'sent_id', i, 'j', w.j, 'r', sv.r, 'root_text', element_at(sv.toks, sv.r + 1).text, "
            "'text', w.text, 'lemma', w.lemma, 'pos', w.pos, 'morph', w.morph, "
            "'is_stop', w.is_stop, 'is_punct', w.is_punct))))")


def token_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partition_by_doc: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """A2 alone: (doc_id, sent_id, token_i, token_text) as in ``token_table``, without tagging anything.

    For measures of the tokens' texts: the tagger works inside higher-order functions, where
    Spark can't leave out what a query doesn't read.
    """
    base = _slim(docs, id_col, text_col, None, partition_by_doc, num_partitions)
    flat = (f"flatten(transform({_sentences_sql()}, (s, i) -> transform(regexp_extract_all(s, {sql_str(TOKEN_RE)}, 0), "
            "t -> named_struct('sent_id', i, 'text', t))))")
    ex = base.select("doc_id", F.posexplode_outer(F.expr(flat)).alias("token_i", "t")).where(F.col("t").isNotNull())
    return ex.select("doc_id", F.col("t.sent_id").alias("sent_id"), F.col("token_i").cast("int").alias("token_i"),
                     F.col("t.text").alias("token_text"))


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str | None = "lang", partition_by_doc: bool = True,
                num_partitions: int | None = None) -> DataFrame:
    """A2–A4: the token table T2 (see ``TOKEN_SCHEMA``).

    token_i runs through the document; sent_id is dense from 0; root has
    dep = 'ROOT' and head_i = token_i; other tokens attach to the root
    (dep 'punct' for punctuation, 'dep' otherwise).
    """
    base = _slim(docs, id_col, text_col, lang_col, partition_by_doc, num_partitions)
    flat = F.expr(_token_array_sql())
    ex = base.select("doc_id", F.posexplode_outer(flat).alias("token_i", "t")).where(F.col("t").isNotNull())
    is_root = F.col("t.j") == F.col("t.r")
    return ex.select(
        "doc_id",
        F.col("t.sent_id").alias("sent_id"),
        F.col("token_i").cast("int").alias("token_i"),
        F.col("t.text").alias("token_text"),
        F.col("t.lemma").alias("lemma"),
        F.col("t.is_punct").alias("is_punct"),
        F.col("t.is_stop").alias("is_stop"),
        F.col("t.morph").alias("morph"),
        F.col("t.pos").alias("pos"),
        F.col("t.pos").alias("tag"),
        F.when(is_root, F.lit("ROOT")).when(F.col("t.is_punct"), F.lit("punct")).otherwise(F.lit("dep")).alias("dep"),
        F.col("t.root_text").alias("head"),
        (F.col("token_i") - F.col("t.j") + F.col("t.r")).cast("int").alias("head_i"),
    )


def annotate(docs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
             schema: T.StructType | None = None, partition_by_doc: bool = True,
             factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]] | None = None) -> DataFrame:
    """A5: run an annotator over documents.

    Without ``fn`` and ``factory`` the built-in baseline (``token_table``) is used. ``fn``
    maps a pandas frame of ``doc_id, lang, text`` to a token frame, at most ``HOOK_CHARS``
    characters (or one document) at a time (``mapInPandas``): an Arrow batch holds 10,000
    documents, whose token frame would not fit a task. ``factory`` (an importable function) returns such an
    ``fn``; it is called once per Python worker, so a model loads once there. The
    output has the id type of the input (``schema`` overrides the whole layout).
    """
    if fn is None and factory is None:
        return token_table(docs, id_col, text_col, lang_col, partition_by_doc)
    base = _slim(docs, id_col, text_col, lang_col, partition_by_doc, None)
    if schema is None:
        schema = T.StructType([base.schema["doc_id"], *TOKEN_SCHEMA.fields[1:]])

    def run(batches):
        own = fn if factory is None else once_per_worker(factory)
        for pdf in batches:
            chars = pdf["text"].str.len().fillna(0).to_numpy(dtype=np.int64).cumsum()
            a = 0
            while a < len(pdf):
                done = chars[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(chars, done + HOOK_CHARS, "right")))
                yield own(pdf.iloc[a:b].reset_index(drop=True))
                a = b

    return base.mapInPandas(run, schema)
