"""E-2: classification of documents with a random forest under grouped, stratified CV.

corpus -> (optional) >= 100-word filter -> repeated ids dropped -> part suffix
stripped -> (embeddings) valid vectors -> exact class balance -> surrogate groups ->
five stratified group folds -> features of the documents that are left (stylistics /
MFW-N / TF-IDF / embeddings) -> five MLlib fits, each fold's predictions written -> one predictions table
-> CV summary + mean importances.

Balance and folds need ids, labels and groups only, so they come first, and only
the documents that take part are annotated or vectorised. Vocabulary and document
frequencies are those of the whole corpus, which is tokenised once for them into a
count table. Stage tables are parquet in the session's checkpoint folder, so the
five fits do not re-run the feature extraction and the lineage stays short if an
executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bow, cleaning, evaluation, folds, models, splits, stylistics
from ..session import materialize
from ..sources import bindings

FEATURE_SETS = ("stylistics", "mfw_100", "mfw_500", "tfidf_5000", "embeddings")


def _docs(spark, sf):
    return bindings.table(spark, sf, "documents").select("doc_id", "lang", "text")


def feature_table(spark: SparkSession, sf: str, feature_set: str, ids: DataFrame, vocab_from: str = "all",
                  num_partitions: int | None = None):
    """(doc_id, feature columns or vector) of the documents in ``ids`` + (featurizer, feature names).

    ``vocab_from="train"`` (MFW / TF-IDF only): the table holds the term arrays
    and the vocabulary / idf are fitted per fold on the training rows.
    """
    docs = _docs(spark, sf)
    own = docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    kind, _, size = feature_set.partition("_")
    if vocab_from == "train" and kind in ("mfw", "tfidf"):
        return bow.doc_terms(own.select("doc_id", "text")), models.BowFeaturizer(kind, int(size)), None
    if feature_set == "stylistics":
        t = stylistics.stylistics_of(own, num_partitions=num_partitions)
        names = list(models.CLASSIFY_STYLISTICS)
        return t.select("doc_id", *names), models.ColumnsFeaturizer(names), names
    if kind in ("mfw", "tfidf"):
        d = docs.select("doc_id", "text")
        counts = materialize(bow.term_counts(d), "term-counts")  # the only pass over all texts
        vocab = bow.top_vocabulary(counts, int(size))
        if kind == "mfw":
            terms = [r["term"] for r in vocab.orderBy("rank").collect()]  # bounded: N terms
            mine = counts.join(ids.select("doc_id"), "doc_id", "left_semi")
            wide = bow.mfw_wide(own, bow.mfw_relative(None, vocab, counts=mine), terms, counts=mine)
            names = [c for c in wide.columns if c != "doc_id"]
            return wide, models.ColumnsFeaturizer(names), names
        idf = bow.idf_table(d, vocab, counts=counts).orderBy("rank").collect()  # bounded: N terms
        names = [r["term"] for r in idf]
        vec = bow.term_vectors(own, names, idf=[r["idf"] for r in idf])
        return vec, models.VectorFeaturizer("features"), names
    if feature_set == "embeddings":
        e = cleaning.valid_vectors(bindings.embeddings(spark, sf)).join(ids.select("doc_id"), "doc_id", "left_semi")
        return models.vector_from_array(e.select("doc_id", "embedding")).drop("embedding"), models.VectorFeaturizer("features"), None
    raise ValueError(feature_set)


def labelled_folds(corpus: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, label, group_id, fold) of the labelled documents: repeated ids dropped, classes balanced, folds dealt."""
    rows = cleaning.strip_part_suffix(corpus.where(F.col("label").isNotNull())).select("doc_id", "label", "group_id")
    rows = cleaning.dedupe(rows, "doc_id", ["label", "group_id"])
    return folds.stratified_group_folds(cleaning.fill_surrogate_group(splits.balance_classes(rows, seed=seed)), k=k, seed=seed)


def classification_input(spark: SparkSession, sf: str, feature_set: str, min_words: int | None = None,
                         k: int = 5, seed: int = 42, vocab_from: str = "all",
                         num_partitions: int | None = None) -> tuple[DataFrame, object, list | None, list]:
    corpus = bindings.corpus(spark, sf, with_text=min_words is not None)
    if min_words is not None:
        corpus = cleaning.filter_min_words(corpus, min_words, strict=False)
    if feature_set == "embeddings":
        valid = cleaning.valid_vectors(bindings.embeddings(spark, sf)).select("doc_id")
        corpus = corpus.join(valid, "doc_id", "left_semi")
    folded = materialize(labelled_folds(corpus, k, seed), f"folds-{feature_set}")
    feats, featurizer, names = feature_table(spark, sf, feature_set, folded, vocab_from, num_partitions)
    rows = feats.join(folded, "doc_id")
    # the partitions that the fits read again and again: by rows, as a few bytes of a row are long work for a forest
    tasks = models.fit_tasks(folded.count(), spark.sparkContext.defaultParallelism)
    data = materialize(rows.repartition(tasks, "doc_id") if tasks > 1 else rows.hint("rebalance"), f"features-{feature_set}")
    classes = sorted(r[0] for r in folded.select("label").distinct().collect())  # bounded: classes
    return data, featurizer, names, classes


def run_classification(spark: SparkSession, sf: str, feature_set: str, min_words: int | None = None,
                       k: int = 5, vocab_from: str = "all", num_partitions: int | None = None, **forest_kw):
    """Returns (predictions, cv summary, mean importances or None)."""
    data, featurizer, names, classes = classification_input(spark, sf, feature_set, min_words, k,
                                                            vocab_from=vocab_from, num_partitions=num_partitions)
    preds, fitted = models.cross_validate(data, featurizer, classes, k=k, **forest_kw)
    summary = evaluation.cv_summary(preds)
    imp = models.mean_importances(spark, fitted, names) if names is not None and feature_set != "embeddings" else None
    return preds, summary, imp
