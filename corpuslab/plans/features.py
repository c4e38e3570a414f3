"""E-1: feature extraction — bag-of-words tables, stylistics, labelled embeddings.

The document-term count table is computed once and written to the shared
checkpoint folder; MFW-100, MFW-500 and TF-IDF-5000 (and their vocabularies)
are derived from it instead of re-tokenising the corpus three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bow, cleaning, joins, stats, stylistics
from ..session import materialize
from ..sources import bindings, io


def bow_features(docs: DataFrame, mfw_sizes=(100, 500), tfidf_n: int = 5000) -> dict[str, DataFrame]:
    """{mfw_<N>: (doc_id, term, rank, rel_freq), tfidf_<N>: (doc_id, term, weight)} from one count table."""
    d = docs.select("doc_id", "text")
    counts = materialize(bow.term_counts(d), "term-counts")
    out = {f"mfw_{n}": bow.mfw_relative(d, bow.top_vocabulary(counts, n), counts=counts) for n in mfw_sizes}
    out[f"tfidf_{tfidf_n}"] = bow.tfidf(d, bow.top_vocabulary(counts, tfidf_n), counts=counts)
    return out


def stylistics_features(spark: SparkSession, sf: str, with_compression: bool = True, num_partitions: int | None = None) -> DataFrame:
    """The stylistics table of all documents, with label and group."""
    docs = bindings.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return stylistics.stylistics_of(docs, corpus=bindings.corpus(spark, sf, with_text=False),
                                    with_compression=with_compression, num_partitions=num_partitions)


def feature_profile(table: DataFrame) -> DataFrame:
    """Per numeric column: missing values (P17) and count, mean, std, quartiles, extremes."""
    cols = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name != "doc_id"]
    t = materialize(table.select("doc_id", *cols), "profile-values")
    missing = cleaning.missing_profile(t.select(*cols)).withColumnRenamed("column", "feature")
    return stats.describe_numeric(t, cols).join(missing, "feature")


def build_feature_tables(spark: SparkSession, sf: str, out_dir: str, num_partitions: int | None = None) -> dict[str, str]:
    """Write every feature table as parquet under ``out_dir``; returns {name: path}."""
    docs = bindings.table(spark, sf, "documents")
    corpus = bindings.corpus(spark, sf, with_text=False)
    paths = {}
    for name, df in bow_features(docs).items():
        p = f"{out_dir.rstrip('/')}/{name}"
        joins.attach_metadata(df, corpus).write.mode("overwrite").parquet(p)
        paths[name] = p
    paths["stylistics"] = f"{out_dir.rstrip('/')}/stylistics"
    stylistics_features(spark, sf, num_partitions=num_partitions).write.mode("overwrite").parquet(paths["stylistics"])
    paths["profile"] = f"{out_dir.rstrip('/')}/profile"
    feature_profile(spark.read.parquet(paths["stylistics"])).write.mode("overwrite").parquet(paths["profile"])
    embs = joins.label_embeddings_left(cleaning.valid_vectors(bindings.embeddings(spark, sf)), corpus)
    paths["embeddings"] = f"{out_dir.rstrip('/')}/embeddings"
    io.write_embeddings(embs.select("doc_id", "embedding", "label", "group_id"), paths["embeddings"])
    return paths
