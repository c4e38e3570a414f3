"""The corpus pipeline: filter, deduplicate, mix and encode ``documents``.

Near duplicates here are texts whose sets of five-word shingles have a Jaccard similarity of
0.8 or more (and what these links connect).

Each stage takes the whole table that the one before it wrote (Parquet in the session's
checkpoint folder) and acts on it: rejected documents and copies go, and the mix repeats or
leaves out documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import bpe, exact_dedup, minhash, mixing, toxicity
from corpuslab.llm.common import prepare, small_batches, table
from corpuslab.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash.drop_near_copies(docs, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near-duplicates", drop_near_copies),
          ("mixing", mix_sources), ("byte-level BPE", encode)]

#: Toxicity scores, near-duplicate links and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
