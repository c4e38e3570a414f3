"""Readers and writers.

Parquet is the default format (column pruning and filter pushdown reach the
scan). TSV is kept for interchange with tab-separated feature tables; array
columns are written as JSON text because CSV has no array type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# TSV fields are written without quotes: control characters become two-character escapes, so a row
# is always one line and the files stay splittable. Null and the empty string have markers of their own.
NULL_FIELD, EMPTY_FIELD = r"\N", r"\e"
_ESCAPES = (("\\", r"\b"), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t"))


def _escaped(c: Column) -> Column:
    for raw, code in _ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return F.when(c == "", F.lit(EMPTY_FIELD)).otherwise(c)


def _unescaped(c: Column) -> Column:
    x = c
    for raw, code in reversed(_ESCAPES):  # the backslash itself comes last
        x = F.replace(x, F.lit(code), F.lit(raw))
    return F.when(c == EMPTY_FIELD, F.lit("")).otherwise(x)


def _tsv(options):
    return (options.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", NULL_FIELD)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", ""))


def read_corpus(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A labelled corpus as (doc_id, text, label, group_id).

    ``columns`` maps our names to the file's column names when they differ.
    """
    columns = columns or {}
    df = spark.read.parquet(path)
    return df.select(*[F.col(columns.get(c, c)).alias(c) for c in ("doc_id", "text", "label", "group_id")])


def read_features_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated feature table with a header (explicit schema, no inference).

    Reads back what ``write_tsv`` wrote: line feeds, tabs, quotes, empty strings and nulls.
    """
    r = _tsv(spark.read)
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    return df.select(*[_unescaped(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == T.StringType() else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """S3: the token table (one parquet table, not one file per document)."""
    return spark.read.parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, embedding [, ...]) from parquet."""
    return spark.read.parquet(path)


def read_embedding_sets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several embedding tables as one (model, doc_id, embedding) table."""
    out = None
    for model, p in paths.items():
        df = spark.read.parquet(p).select(F.lit(model).alias("model"), "doc_id", "embedding")
        out = df if out is None else out.unionByName(df)
    return out


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """TSV with header; arrays/structs/maps become JSON text, control characters escapes."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = _escaped(F.to_json(c))
        elif f.dataType == T.StringType():
            c = _escaped(c)
        cols.append(c.alias(f.name))
    _tsv(df.select(*cols).write.mode(mode)).csv(path)


def write_tokens(df: DataFrame, path: str, mode: str = "overwrite", num_partitions: int | None = None) -> None:
    """Token table as parquet, clustered by doc_id and sorted by position.

    The writer keeps a document's tokens in one file so that readers filtering on
    ``doc_id`` touch few row groups; no global sort is done.
    """
    out = df if num_partitions is None else df.repartition(num_partitions, "doc_id")
    out.sortWithinPartitions("doc_id", "token_i").write.mode(mode).parquet(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Embeddings parquet sink."""
    df.write.mode(mode).parquet(path)


def append_run_results(df: DataFrame, path: str, run_id: str) -> None:
    """Add one block of scores per run to a results table.

    Each run is its own ``run_id=<id>`` partition written with overwrite, so a
    retried or re-run job replaces its block instead of appending a duplicate.
    Reading ``path`` returns all runs with a ``run_id`` column.
    """
    (df.withColumn("written_at", F.current_timestamp())
     .write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}"))
