"""Incremental featurisation of arriving documents with Structured Streaming.

Per-document measures (token table -> stylistic measures, sentiment,
compression) do not depend on other documents, so new documents can be
featurised as they arrive: ``readStream`` over the document folder, and for
each micro-batch the same batch operators as the batch job (``foreachBatch``).
Each batch is written to its own ``batch_id=<n>`` folder with overwrite, so a
batch replayed after a failure replaces its own output (exactly-once output);
progress is tracked in a checkpoint named after source and sink in the shared checkpoint folder.

Corpus-level features (vocabulary, TF-IDF idf) depend on all documents and stay
batch jobs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import stylistics

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def document_stream(spark: SparkSession, source_dir: str, glob: str | None = None,
                    max_files_per_trigger: int | None = None, schema: T.StructType = DOCUMENT_SCHEMA) -> DataFrame:
    """Streaming DataFrame of documents arriving as parquet files in ``source_dir``."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def featurize_batch(batch: DataFrame, with_compression: bool = True) -> DataFrame:
    """The batch operators applied to one micro-batch of documents."""
    return stylistics.stylistics_of(batch.select("doc_id", "lang", "text"), with_compression=with_compression)


def stream_checkpoint(spark: SparkSession, source_dir: str, sink_dir: str, glob: str | None = None) -> str:
    """A folder of its own for this source and sink, the same after a restart.

    ``spark.checkpoint.dir`` itself is the parent: the session's sub-folder of it
    changes with each session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("pass checkpoint=, or set spark.checkpoint.dir to a durable folder: a restarted stream needs its log")
    own = hashlib.sha256("\n".join([source_dir, sink_dir, glob or ""]).encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/stream-featurizer-{own}"


def start_featurizer(spark: SparkSession, source_dir: str, sink_dir: str, glob: str | None = None,
                     checkpoint: str | None = None, available_now: bool = True,
                     with_compression: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    ``available_now=True`` processes everything present and stops (a scheduled
    incremental job); otherwise a continuous stream with a 1-minute trigger.
    """
    ckpt = checkpoint or stream_checkpoint(spark, source_dir, sink_dir, glob)
    stream = document_stream(spark, source_dir, glob, max_files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        (featurize_batch(batch, with_compression)
         .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
