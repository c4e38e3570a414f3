"""Bindings of our tables onto the driver test data (see FIXTURES.md §3).

* corpus            documents LEFT JOIN labels; label from quality (1 -> 'a', 0 -> 'b');
                    group_id from source plus a part suffix, missing for every 7th doc
* raw annotations   the seven reference codes assigned by doc_id
* embedding sets    models m0..m3 = dimensions 1–16, 17–32, 33–48, 49–64
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ANNOTATION_CODES, UNUSABLE_CODES
from ..session import sf_path

EMBEDDING_MODELS = {"m0": (1, 16), "m1": (17, 16), "m2": (33, 16), "m3": (49, 16)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def corpus(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """T1 on the test data: (doc_id, text, lang, source, label, group_id)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    label = F.when(F.col("quality") == 1, F.lit("a")).when(F.col("quality") == 0, F.lit("b"))
    part = F.substring(F.lit("abc"), (F.col("doc_id") % 3 + 1).cast("int"), 1)
    group = F.when(F.col("doc_id") % 7 != 0, F.concat(F.col("source"), F.lit("_"), part))
    cols = ["doc_id"] + (["text"] if with_text else []) + ["lang", "source"]
    return (docs.join(labels, "doc_id", "left")
            .select(*cols, label.alias("label"), group.alias("group_id")))


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 on the test data: (doc_id, code): the seven codes, the three unusable ones and null, by doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    codes = F.array(*[F.lit(c) for c in (*ANNOTATION_CODES, *UNUSABLE_CODES)])
    return docs.select("doc_id", F.get(codes, (F.col("doc_id") % (len(ANNOTATION_CODES) + len(UNUSABLE_CODES) + 1)).cast("int")).alias("code"))


def embeddings_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, some of them null (ids with remainder 5 by 13) or starting with NaN (remainder 7)."""
    hole = F.col("doc_id") % 13
    nan_first = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 2, 100_000))
    return embeddings(spark, sf_dir).withColumn(
        "embedding", F.when(hole == 5, None).when(hole == 7, nan_first).otherwise(F.col("embedding")))


def texts_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), some texts null (ids divisible by 17) or empty (remainder 1)."""
    hole = F.col("doc_id") % 17
    text = F.when(hole == 0, None).when(hole == 1, F.lit("")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


RAW_SENTIMENT_LABELS = (" Positive ", "POS", "positiv", "neutral", "Neut ", "neutr", "negative", "NEG", "negativ", "", "unknown", None)


def raw_sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label): spellings of sentiment labels, blanks, an unknown one and null, by doc_id."""
    labels = F.array(*[F.lit(x).cast("string") for x in RAW_SENTIMENT_LABELS])
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.get(labels, (F.col("doc_id") % len(RAW_SENTIMENT_LABELS)).cast("int")).alias("label"))


def seed_words(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """(word, sign): the ``n`` words with the largest difference between the shares of labelled a and b documents that hold them, and the n with the smallest."""
    c = corpus(spark, sf_dir).where(F.col("label").isNotNull())
    total = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    of = {x: F.coalesce(total.where(F.col("label") == x).agg(F.sum("n")).scalar(), F.lit(0)) for x in "ab"}
    words = c.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))).alias("word"))
    per = words.groupBy("word").agg(F.count_if(F.col("label") == "a").alias("a"), F.count_if(F.col("label") == "b").alias("b"))
    gap = per.select("word", (F.col("a") * of["b"] - F.col("b") * of["a"]).alias("gap"))
    top = gap.orderBy(F.desc("gap"), "word").limit(n).select("word", F.lit(1).alias("sign"))
    return top.unionByName(gap.orderBy("gap", "word").limit(n).select("word", F.lit(-1).alias("sign")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding array<float>, emb_label int)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("emb_label"))


def embedding_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, doc_id, embedding, emb_label) with one slice of dimensions per model."""
    e = embeddings(spark, sf_dir)
    out = None
    for model, (start, length) in EMBEDDING_MODELS.items():
        part = e.select(F.lit(model).alias("model"), "doc_id",
                        F.slice("embedding", start, length).alias("embedding"), "emb_label")
        out = part if out is None else out.unionByName(part)
    return out
