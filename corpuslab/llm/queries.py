"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, html_extract, katz, langid, merkle, minhash, mixing, quality, sharding, toxicity, vector_codes
from .common import is_held_out, table
from .oracle import ORACLE  # noqa: F401  (the entry module reads both from here)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, keep_html=False).withColumn("n_chars", F.length("text").cast("long"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", is_held_out("doc_id", 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tagged = langid.tag(docs, langid.learn(docs), spans=False)
    return tagged.select("doc_id", is_held_out("doc_id", 0).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = vector_codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.sha256()))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: A conversation whose texts are control strings of templates.
CONTROL = "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(control)))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in merkle.FIELDS]
    changed = F.when(tampers & F.contains(F.col("text"), F.lit("\n")), merkle.row_digest(tampered))
    out = merkle.manifest(docs, also={"changed": changed})
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = out.withColumns({"folded_root": folded, "proof_sha256": F.sha2(merkle.proof_text(F.col("path")), 256)})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_html, op2_toxicity, op3_langid, op4_exact_dedup, op5_katz, op6_mixing, op7_quality, op8_bpe, op9_minhash, op10_sharding, op11_vector_codes, op12_chat, op13_merkle)}
