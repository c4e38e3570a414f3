"""Column expressions for text: regexes, normalisation, counts, label recodes.

All are built-in Spark SQL expressions (JVM side, no Python per row). The regex
patterns are written so that Java regex (Spark) and RE2 (the DuckDB oracle) agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ANNOTATION_RECODE, SENTIMENT_LABEL_SYNONYMS

# Vectoriser terms: runs of >= 2 Unicode word characters (not \w: ASCII-only in Java).
TERM_RE = r"[\p{L}\p{N}_]{2,}"
# Sentences: a run of non-terminators with the terminators after it; terminators before any other
# character belong to the first sentence, and a text of terminators only is one sentence.
SENT_RE = r"^[.!?]+\z|[.!?]*[^.!?]+[.!?]*"
# Annotator tokens: a word run, or one character that is neither word nor space.
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD_CHAR_RE = r"[\p{L}\p{N}_]"
NUMBER_RE = r"^\p{N}+$"
# Whitespace-separated words (Python's str.split()).
NONSPACE_RE = r"\S+"
# Trailing part suffix of a series id, e.g. "_b".
PART_SUFFIX_RE = r"_[a-z]$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(col_(c), F.lit(pattern), 0)


def normalize_text(c) -> Column:
    """Lowercase, drop digits, collapse whitespace, trim."""
    x = F.lower(col_(c))
    x = F.regexp_replace(x, r"[0-9]+", "")
    x = F.regexp_replace(x, r"\s+", " ")
    return F.trim(x)


def word_count(c) -> Column:
    """Number of whitespace-separated words (BIGINT)."""
    return F.size(extract_all(c, NONSPACE_RE)).cast("bigint")


def word_count_nullable_as_text(c) -> Column:
    """P6, descriptives flavour: a missing text counts as the one word 'nan'."""
    return F.when(col_(c).isNull(), F.lit(1).cast("bigint")).otherwise(word_count(c))


def vectorizer_terms(c) -> Column:
    """V1: lowercase terms as a vectoriser would produce them (array<string>)."""
    return extract_all(F.lower(col_(c)), TERM_RE)


def strip_part_suffix(c) -> Column:
    """P11: 'x_b' -> 'x' so that the parts of a series share one group."""
    return F.regexp_replace(col_(c), PART_SUFFIX_RE, "")


def surrogate_group(group, doc_id) -> Column:
    """A missing group becomes a unique id keyed by the document."""
    return F.coalesce(col_(group), F.concat(F.lit("noid_"), col_(doc_id).cast("string")))


def valid_vector(c) -> Column:
    """The array exists and holds no null / NaN element."""
    v = col_(c)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def recode_annotation(c, mapping: dict | None = None) -> Column:
    """Raw annotation code -> binary label (null = dropped code)."""
    mapping = mapping or ANNOTATION_RECODE
    expr = None
    for code, label in mapping.items():
        cond = col_(c) == F.lit(code)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def normalize_sentiment_label(c, strict: bool = False) -> Column:
    """Trim + lowercase, then map synonyms to positive/neutral/negative.

    Unknown labels give null (and can be counted); ``strict=True`` raises inside
    the job as the reference does.
    """
    x = F.lower(F.trim(col_(c)))
    expr = None
    for std, variants in SENTIMENT_LABEL_SYNONYMS.items():
        cond = x.isin(*variants)
        expr = F.when(cond, F.lit(std)) if expr is None else expr.when(cond, F.lit(std))
    if strict:
        return expr.otherwise(F.raise_error(F.concat(F.lit("Unrecognized sentiment label: "), x)))
    return expr.otherwise(F.lit(None).cast("string"))


def signed_score(label, score) -> Column:
    """Positive -> +score, neutral -> 0, negative -> -score (label normalised first)."""
    std = normalize_sentiment_label(label)
    s = col_(score).cast("double")
    return (F.when(std == "positive", s)
            .when(std == "neutral", F.lit(0.0))
            .when(std == "negative", -s))


def cap_max_len(n) -> Column:
    """Model limits above 2000 are placeholders; use 512 instead."""
    return F.when(col_(n) > 2000, F.lit(512)).otherwise(col_(n))
