import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslab-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def no_cached_tables(spark):
    """What a module has cached is gone with it: Spark would read it in the next one's plans, whose shapes are held."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


def tokens_df(spark, rows):
    """Hand-written token table rows: (doc_id, sent_id, token_i, text, pos, morph, is_punct, dep, head_i, lemma)."""
    from corpuslab.operators.annotate import TOKEN_SCHEMA

    full = []
    for (d, s, i, text, pos, morph, punct, dep, head_i, lemma) in rows:
        full.append((d, s, i, text, lemma or text.lower(), punct, False, morph, pos, pos, dep, None, head_i))
    return spark.createDataFrame(full, TOKEN_SCHEMA)
