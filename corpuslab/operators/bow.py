"""V1–V7: vectoriser tokens, term counts, top-N vocabulary, MFW rates, TF-IDF.

Long (sparse) layout throughout: ``(doc_id, term, value)``. Term counts are one
``groupBy(doc_id, term)``: its partial aggregate collapses a document's repeats
inside the map task, and one exchange brings the partial counts together, at any
number of input partitions. The vocabulary is bounded by N (100 / 500 / 5000) and is the only thing
broadcast; the document totals are computed map-side from the same arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import vectorizer_terms


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, terms array, n_terms) — the vectoriser view of each document."""
    terms = vectorizer_terms(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), terms.alias("terms")) \
        .select("doc_id", "terms", F.size("terms").cast("bigint").alias("n_terms"))


def _explode_terms(dt: DataFrame, *keep: str) -> DataFrame:
    """One row per term occurrence.

    ``explode_outer`` + a null filter: with a plain ``explode`` Catalyst infers
    ``size(terms) > 0`` and pushes it below the exchange, evaluating the regex twice.
    """
    return (dt.select("doc_id", *keep, F.explode_outer("terms").alias("term"))
            .where(F.col("term").isNotNull()))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V1: one row per (doc_id, position, term)."""
    return doc_terms(docs, id_col, text_col).select(
        "doc_id", F.posexplode_outer("terms").alias("pos", "term")).where(F.col("term").isNotNull())


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V2: (doc_id, term, n, n_terms) document-term counts.

    ``n_terms`` (all terms of the document, computed map-side from the array
    size) rides along as a grouping key — it is a function of doc_id, so it adds
    no groups — and lets MFW rates be computed from the counts alone.
    """
    return (_explode_terms(doc_terms(docs, id_col, text_col), "n_terms")
            .groupBy("doc_id", "term", "n_terms").agg(F.count(F.lit(1)).alias("n"))
            .select("doc_id", "term", "n", "n_terms"))


def top_vocabulary(counts: DataFrame, n: int) -> DataFrame:
    """V3: (term, total, rank) for the N most frequent terms; ties by term.

    ``orderBy().limit()`` plans as TakeOrderedAndProject (a per-partition top-N,
    then a merge of N rows per partition), never a global sort. The numbering
    window runs on those N rows only.
    """
    totals = counts.groupBy("term").agg(F.sum("n").cast("bigint").alias("total"))
    top = totals.orderBy(F.desc("total"), F.asc("term")).limit(n)
    return top.select("term", "total",
                      F.row_number().over(Window.orderBy(F.desc("total"), F.asc("term"))).alias("rank"))


def mfw_relative(docs: DataFrame | None, vocab: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """V4: (doc_id, term, rank, rel_freq) = count / all terms of the document.

    The denominator counts the full vocabulary, not just the top N. Only non-zero
    rates are listed (sparse); a document without terms has no rows. Pass
    ``counts`` (from ``term_counts``) to reuse one count table for several N.
    """
    c = counts if counts is not None else term_counts(docs, id_col, text_col)
    hits = c.join(F.broadcast(vocab.select("term", "rank")), "term")
    return hits.select("doc_id", "term", "rank", (F.col("n") / F.col("n_terms")).alias("rel_freq"))


def mfw_wide(docs: DataFrame, long: DataFrame, vocab_terms: list[str], id_col: str = "doc_id",
             text_col: str = "text", prefix: str = "t_", counts: DataFrame | None = None) -> DataFrame:
    """V5: one column per vocabulary term (in frequency order), prefixed ``t_``.

    ``vocab_terms`` is the bounded top-N list (N <= 500 for a wide table). A
    document with terms but no hit gets 0; a document without terms gets null
    (0/0), as in the reference. With ``counts`` (from ``term_counts``) the number
    of terms comes from there and the text isn't read again.
    """
    piv = long.groupBy("doc_id").pivot("term", vocab_terms).agg(F.first("rel_freq"))
    if counts is None:
        dt = doc_terms(docs, id_col, text_col).select("doc_id", "n_terms")
    else:
        sizes = counts.groupBy("doc_id").agg(F.max("n_terms").alias("n_terms"))
        dt = docs.select(F.col(id_col).alias("doc_id")).join(sizes, "doc_id", "left")
    j = dt.join(piv, "doc_id", "left")
    # one selectExpr instead of N Column builders (each builder call is a JVM round trip)
    cols = [f"CASE WHEN n_terms > 0 THEN coalesce(`{t}`, 0.0) END AS `{prefix}{t}`" for t in vocab_terms]
    return j.selectExpr("doc_id", *cols)


def tfidf(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          counts: DataFrame | None = None) -> DataFrame:
    """V6: (doc_id, term, weight) with raw tf × smoothed idf, L2-normalised per document.

    idf = ln((1 + n) / (1 + df)) + 1 where n counts every document (also empty
    ones). The norm is taken over the vocabulary terms only: a document's weights
    (at most the vocabulary) meet in one array, behind one exchange. The idf table
    is bounded by the vocabulary.
    """
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    c = counts if counts is not None else term_counts(docs, id_col, text_col)
    tf = c.join(F.broadcast(vocab.select("term")), "term").select("doc_id", "term", F.col("n").alias("tf"))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = dfreq.select("term", (F.log((1.0 + n_docs.scalar()) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = tf.join(F.broadcast(idf), "term").select("doc_id", F.struct("term", (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    per_doc = w.groupBy("doc_id").agg(F.collect_list("x").alias("xs"))
    norm = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return (per_doc.select("doc_id", norm.alias("norm"), F.explode("xs").alias("x"))
            .select("doc_id", F.col("x.term").alias("term"), (F.col("x.w") / F.col("norm")).alias("weight")))


def term_vectors(docs: DataFrame, vocab_terms: list[str], id_col: str = "doc_id",
                 text_col: str = "text", weighting: str = "tfidf", idf: list[float] | None = None):
    """V7: sparse ML vectors over a fixed vocabulary (JVM-side transformers only).

    ``CountVectorizerModel.from_vocabulary`` gives raw counts in vocabulary order;
    for TF-IDF the counts are scaled by (idf) with ``ElementwiseProduct`` and
    L2-normalised with ``Normalizer``. ``idf`` values come from ``tfidf``'s idf
    table (one value per vocabulary term — bounded).
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    dt = doc_terms(docs, id_col, text_col)
    cv = CountVectorizerModel.from_vocabulary(vocab_terms, inputCol="terms", outputCol="tf")
    out = cv.transform(dt)
    if weighting == "counts":
        return out.select("doc_id", F.col("tf").alias("features"))
    if idf is None:
        raise ValueError("idf values are required for tfidf weighting")
    ep = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="w")
    nz = Normalizer(p=2.0, inputCol="w", outputCol="features")
    return nz.transform(ep.transform(out)).select("doc_id", "features")


def idf_table(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              counts: DataFrame | None = None) -> DataFrame:
    """(term, rank, idf) for a vocabulary (bounded by its size), from ``counts`` if given."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    if counts is None:
        dt = doc_terms(docs, id_col, text_col)
        counts = _explode_terms(dt.select("doc_id", F.array_distinct("terms").alias("terms")))
    present = (counts.join(F.broadcast(vocab.select("term")), "term")
               .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return (vocab.select("term", "rank").join(present, "term", "left")
            .select("term", "rank",
                    (F.log((1.0 + n_docs.scalar()) / (1.0 + F.coalesce(F.col("df"), F.lit(0)))) + 1.0).alias("idf")))
