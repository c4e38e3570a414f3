"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver tables (whole tables, whole texts) and runs one
operator of SURVEY §2 through the library. Output normalisation for the engine
comparison: integers as BIGINT, floats as DOUBLE rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NO_ORACLE: set[str] = set()


def register(name: str, oracle: bool = True):
    def deco(fn):
        QUERIES[name] = fn
        if not oracle:
            NO_ORACLE.add(name)
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Cast integers to BIGINT and round doubles, so both engines agree on type and value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def parallelism(spark: SparkSession) -> int:
    """Tasks to deal a test table out to: its one row group would else be annotated by one task."""
    return spark.sparkContext.defaultParallelism


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Import every query module (registration happens at import)."""
    from . import (q_annotation, q_bow, q_cleaning, q_evaluation, q_models,  # noqa: F401
                   q_sentiment, q_sources, q_splits, q_stats, q_stylistics)
    return dict(QUERIES)
