"""E-4: class comparison of the stylistic features (the flagship report).

corpus + token table -> stylistics table (one pass) -> texts with more than 100
words -> per-feature class means / sample stds -> pooled t, df and two-sided p.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, stats, stylistics
from ..sources import bindings

# Features compared between classes (tense ratios, sentence count and MDD are left out).
DESC_FEATURES = [
    "nominal_verb_ratio", "msttr", "noun_ttr", "verb_ttr", "personal_pronoun_ratio", "function_word_ratio",
    "of_ratio", "that_ratio", "passive_ratio", "active_ratio", "adjective_adverb_ratio", "avg_wordlen",
    "avg_sentlen", "avg_ndd", "std_ndd", "sentiment_mean", "sentiment_std", "sentiment_abs",
]
# Outlier limits applied before the distribution plots (strict <; missing values drop too):
# rows with sentence length >= 100 or noun TTR >= 6 leave every plot; nominal/verb >= 12 only
# leaves that feature's plot.
ROW_OUTLIER_LIMITS = {"avg_sentlen": 100, "noun_ttr": 6}
FEATURE_OUTLIER_LIMITS = {"nominal_verb_ratio": 12}


def distribution_frame(spark: SparkSession, sf_dir: str, with_compression: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Labelled rows of the descriptive frame after the row-level outlier limits."""
    df = descriptive_frame(spark, sf_dir, with_compression=with_compression, num_partitions=num_partitions)
    return cleaning.filter_outliers(df.where(F.col("label").isNotNull()), ROW_OUTLIER_LIMITS)


def descriptive_frame(spark: SparkSession, sf_dir: str, with_compression: bool = True,
                      min_words: int = 100, num_partitions: int | None = None) -> DataFrame:
    """Stylistics joined with label and word count, restricted to texts with > ``min_words`` words."""
    docs = bindings.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    corpus = bindings.corpus(spark, sf_dir, with_text=False)
    styl = stylistics.stylistics_of(docs, corpus=corpus, with_compression=with_compression, num_partitions=num_partitions)
    lengths = cleaning.with_word_count(docs.select("doc_id", "text"), null_as_text=True).select("doc_id", "n_words")
    return styl.join(lengths, "doc_id").where(F.col("n_words") > min_words)


def class_comparison_report(spark: SparkSession, sf_dir: str, classes=("a", "b"), num_partitions: int | None = None) -> DataFrame:
    """(feature, n_a, mean_a, std_a, n_b, mean_b, std_b, t_stat, df, p_value)."""
    df = descriptive_frame(spark, sf_dir, num_partitions=num_partitions)
    feats = DESC_FEATURES + ["compression_ratio"]
    tt = stats.t_test_p_values(stats.pooled_t_test(stats.feature_stats_by_class(df, feats, classes=classes)))
    return tt.select("feature", "n_a", "mean_a", "std_a", "n_b", "mean_b", "std_b", "t_stat", "df", "p_value")
