"""Per-document stylistic and syntactic measures from a token table.

Input is a token table in the T2 layout (``annotate.TOKEN_SCHEMA``). All measures
are grouped aggregates keyed by ``doc_id`` (or ``doc_id, sent_id`` first); when
the token table is hash-partitioned by ``doc_id`` (the annotator's default) none
of them adds an exchange. The whole table (F23) is computed from one array of
sentences per document, made from a token table or straight from the text. Only the
compression ratio calls Python (bz2, Arrow-batched).
"""

from __future__ import annotations

import bz2

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import lead, pieces
from ..functions.lexicon import (FUNCTION_WORD_POS, NOMINAL_POS, NON_WORD_POS, OF_WORDS,
                                 THAT_WORDS)
from ..functions.tagger import sql_str, tagged_sentences_sql
from ..functions.text import TOKEN_RE
from ..session import ship_package
from .annotate import _sentences_sql, _slim, token_texts
from .text_measures import measures_udf

MEASURES = [
    "nominal_verb_ratio", "msttr", "noun_ttr", "verb_ttr", "personal_pronoun_ratio",
    "function_word_ratio", "of_ratio", "that_ratio", "past_tense_ratio", "present_tense_ratio",
    "passive_ratio", "active_ratio", "adjective_adverb_ratio", "avg_wordlen", "avg_sentlen",
    "num_sents", "avg_ndd", "std_ndd", "avg_mdd", "std_mdd", "compression_ratio",
]


# --- P14: token predicates -------------------------------------------------

def _morph() -> Column:
    return F.coalesce(F.col("morph"), F.lit(""))


def is_word() -> Column:
    return ~F.col("pos").isin(*NON_WORD_POS)


def is_verb() -> Column:
    return F.col("pos") == "VERB"


def is_nominal() -> Column:
    return F.col("pos").isin(*NOMINAL_POS)


def is_function_word() -> Column:
    return F.col("pos").isin(*FUNCTION_WORD_POS)


def is_personal_pronoun() -> Column:
    return (F.col("pos") == "PRON") & _morph().contains("PronType=Prs")


def verb_with(feature: str) -> Column:
    return is_verb() & _morph().contains(feature)


def is_of_like(words=OF_WORDS) -> Column:
    return (F.col("pos") == "ADP") & F.lower(F.col("token_text")).isin(*words)


def is_that_like(words=THAT_WORDS) -> Column:
    return (F.col("pos") == "SCONJ") & F.lower(F.col("token_text")).isin(*words)


def token_predicates(tokens: DataFrame, of_words=OF_WORDS, that_words=THAT_WORDS) -> DataFrame:
    """P14 as boolean columns next to the token keys."""
    return tokens.select(
        "doc_id", "sent_id", "token_i",
        is_word().alias("is_word"), is_nominal().alias("is_nominal"),
        is_function_word().alias("is_function_word"), is_personal_pronoun().alias("is_personal_pronoun"),
        verb_with("Tense=Past").alias("is_past"), verb_with("Tense=Pres").alias("is_present"),
        verb_with("Voice=Act").alias("is_active"), verb_with("Voice=Pass").alias("is_passive"),
        is_of_like(of_words).alias("is_of_like"), is_that_like(that_words).alias("is_that_like"),
    )


# --- F1, F3–F14: one aggregate over all tokens -------------------------------

def _ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def pos_measures(tokens: DataFrame, of_words=OF_WORDS, that_words=THAT_WORDS,
                 legacy_swap: bool = False) -> DataFrame:
    """F1, F3–F14 in one pass: sums per (document, lemma of a NOUN or VERB), then per document.

    ``legacy_swap=True`` reproduces the reference's swapped passive/active names.
    """
    c = F.count_if
    sums = {
        "n_tokens": F.count(F.lit(1)),
        "n_words": c(is_word()),
        "n_noun": c(F.col("pos") == "NOUN"),
        "n_verb": c(is_verb()),
        "n_adj": c(F.col("pos") == "ADJ"),
        "n_adv": c(F.col("pos") == "ADV"),
        "n_nominal": c(is_nominal()),
        "n_voiced": c(is_verb() & (_morph().contains("Voice=Act") | _morph().contains("Voice=Pass"))),
        "n_passive": c(verb_with("Voice=Pass")),
        "n_active": c(verb_with("Voice=Act")),
        "n_past": c(verb_with("Tense=Past")),
        "n_present": c(verb_with("Tense=Pres")),
        "n_prs": c(is_personal_pronoun()),
        "n_function": c(is_function_word()),
        "n_of": c(is_of_like(of_words)),
        "n_that": c(is_that_like(that_words)),
        "word_chars": F.sum(F.when(is_word(), F.length("token_text"))),
    }
    # one row per lemma of a NOUN or VERB and one for all other tokens, so the tokens are read once
    kind = F.when(F.col("pos").isin("NOUN", "VERB"), F.col("pos"))
    per_lemma = (tokens.groupBy("doc_id", kind.alias("kind"), F.when(kind.isNotNull(), F.col("lemma")).alias("lemma"))
                 .agg(*[v.alias(k) for k, v in sums.items()]))
    j = per_lemma.groupBy("doc_id").agg(
        *[F.sum(k).alias(k) for k in sums],
        F.when(c(F.col("kind").isNotNull()) > 0, c(F.col("kind") == "NOUN")).alias("noun_lemmas"),
        F.when(c(F.col("kind").isNotNull()) > 0, c(F.col("kind") == "VERB")).alias("verb_lemmas"))
    act, pas = ("n_passive", "n_active") if legacy_swap else ("n_active", "n_passive")
    return j.select(
        "doc_id",
        _ratio(F.col("n_nominal") + F.col("n_noun"), F.col("n_verb")).alias("nominal_verb_ratio"),
        _ratio(F.col("noun_lemmas"), F.col("n_noun")).alias("noun_ttr"),
        _ratio(F.col("verb_lemmas"), F.col("n_verb")).alias("verb_ttr"),
        _ratio(F.col("n_prs"), F.col("n_tokens")).alias("personal_pronoun_ratio"),
        _ratio(F.col("n_function"), F.col("n_tokens")).alias("function_word_ratio"),
        _ratio(F.col("n_of"), F.col("n_tokens")).alias("of_ratio"),
        _ratio(F.col("n_that"), F.col("n_tokens")).alias("that_ratio"),
        F.when(F.col("n_past") > 0, _ratio(F.col("n_past"), F.col("n_verb"))).alias("past_tense_ratio"),
        F.when(F.col("n_present") > 0, _ratio(F.col("n_present"), F.col("n_verb"))).alias("present_tense_ratio"),
        _ratio(F.col(pas), F.col("n_voiced")).alias("passive_ratio"),
        _ratio(F.col(act), F.col("n_voiced")).alias("active_ratio"),
        _ratio(F.col("n_adj") + F.col("n_adv"), F.col("n_words")).alias("adjective_adverb_ratio"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("avg_wordlen"),
    )


# --- F2: MSTTR ---------------------------------------------------------------

def msttr(tokens: DataFrame, window: int = 100) -> DataFrame:
    """mean TTR over consecutive full ``window``-word segments (case-sensitive).

    Documents with at most ``window`` words use the whole-text TTR; a document
    without words gets 0. Word order comes from ``token_i``; the numbering window
    is partitioned by ``doc_id`` (no exchange when tokens are partitioned by it).
    """
    w = Window.partitionBy("doc_id").orderBy("token_i")
    words = (tokens.where(is_word())
             .select("doc_id", "token_text", (F.row_number().over(w) - 1).alias("word_i")))
    seg = (words.groupBy("doc_id", F.floor(F.col("word_i") / window).alias("seg"))
           .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token_text").alias("types")))
    per_doc = seg.groupBy("doc_id").agg(
        F.sum("n").alias("n_words"),
        F.max(F.when(F.col("seg") == 0, F.col("types") / F.col("n"))).alias("ttr0"),
        F.avg(F.when(F.col("n") == window, F.col("types") / F.col("n"))).alias("seg_ttr"),
    )
    docs = tokens.select("doc_id").distinct()
    return (docs.join(per_doc, "doc_id", "left")
            .select("doc_id", F.coalesce(F.when(F.col("n_words") <= window, F.col("ttr0"))
                                         .otherwise(F.col("seg_ttr")), F.lit(0.0)).alias("msttr")))


# --- F15–F20: sentence-level then document-level -------------------------------

def sentence_measures(tokens: DataFrame) -> DataFrame:
    """F15–F20. Sentences without a kept ROOT are skipped for MDD/NDD."""
    kept = ~F.col("is_punct") & (F.col("pos") != "SPACE")
    per_sent = tokens.groupBy("doc_id", "sent_id").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(kept).alias("n_kept"),
        F.sum(F.when(kept, F.abs(F.col("token_i") - F.col("head_i")))).alias("dd_sum"),
        F.min(F.when(kept & (F.col("dep") == "ROOT"), F.col("token_i"))).alias("root_i"),
        F.min(F.when(kept, F.col("token_i"))).alias("start_i"),
    )
    valid = (F.col("n_kept") > 0) & F.col("root_i").isNotNull()
    mdd = F.when(valid, F.col("dd_sum") / F.col("n_kept"))
    s = per_sent.select("doc_id", "n_all", "n_kept", (F.col("root_i") - F.col("start_i")).alias("root_dist"),
                        mdd.alias("mdd"))
    ndd = F.when((F.col("mdd") > 0) & (F.col("root_dist") >= 0),
                 F.abs(F.log(F.col("mdd") / F.sqrt((F.col("root_dist") + 1) * F.col("n_kept")))))
    return s.groupBy("doc_id").agg(
        F.avg(F.col("n_all").cast("double")).alias("avg_sentlen"),
        F.count(F.lit(1)).alias("num_sents"),
        F.avg(ndd).alias("avg_ndd"),
        F.stddev_pop(ndd).alias("std_ndd"),
        F.avg("mdd").alias("avg_mdd"),
        F.stddev_pop("mdd").alias("std_mdd"),
    )


# --- F22, F21: sentence text and compression ratio --------------------------------

def sentence_text(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, sentence) rebuilt from tokens joined by single spaces."""
    return tokens.groupBy("doc_id", "sent_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_i", "token_text"))),
                                 lambda x: x["token_text"]), " ").alias("sentence"))


def sentence_text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num_partitions: int | None = None) -> DataFrame:
    """F22 from (doc_id, text): the rows of ``sentence_text(annotate.token_texts(docs))`` with one row a sentence on the way, not one a token.

    A sentence is put together in its text's row. Only texts that share an id go through rows of tokens,
    where tokens of sentences with the same number are sorted together.
    """
    base = _slim(docs, id_col, text_col, None, True, num_partitions)
    base = base.select("doc_id", "text", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"))
    joined = f"transform({_sentences_sql()}, s -> array_join(regexp_extract_all(s, {sql_str(TOKEN_RE)}, 0), ' '))"
    own = (base.where("n = 1").select("doc_id", F.posexplode_outer(F.expr(joined)).alias("sent_id", "sentence"))
           .where(F.col("sentence") != F.lit("")))
    shared = sentence_text(token_texts(base.where("n > 1"), partition_by_doc=False))
    return own.unionByName(shared)


def compression_selection(sentences: DataFrame, skip: int = 10, take: int = 40,
                          long_doc: int = 50) -> DataFrame:
    """F21, selection: the text fed to the compressor per document.

    With more than ``long_doc`` sentences: sentences ``skip+1 .. skip+take``,
    otherwise the first ``take``; joined by single spaces in sentence order.
    """
    w = Window.partitionBy("doc_id").orderBy("sent_id")
    ranked = sentences.select("doc_id", "sent_id", "sentence",
                              F.row_number().over(w).alias("rn"),
                              F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"))
    keep = F.when(F.col("n") > long_doc, (F.col("rn") > skip) & (F.col("rn") <= skip + take)) \
        .otherwise(F.col("rn") <= take)
    return (ranked.where(keep).groupBy("doc_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "sentence"))),
                                          lambda x: x["sentence"]), " ").alias("selected_text")))


@F.pandas_udf(T.DoubleType())
def bz2_ratio(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes / bz2 (level 9) bytes, per row of an Arrow batch."""
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        raw = t.encode("utf-8")
        comp = bz2.compress(raw, compresslevel=9)
        out.append(len(raw) / len(comp) if comp else None)
    return pd.Series(out, dtype="float64")


def compression_ratio(sentences: DataFrame, **kw) -> DataFrame:
    """(doc_id, compression_ratio)."""
    sel = compression_selection(sentences, **kw)
    return sel.select("doc_id", bz2_ratio("selected_text").alias("compression_ratio"))


# --- F23: the stylistics table, from an array of sentences (arrays of tokens) per document
# A token is (i: place, text, lemma, pos, morph, is_punct, d: distance to its head, is_root).

def _signed_chunk_scores_sql(sentence: str, max_len: int, cost: str) -> str:
    """Signed lexicon scores of the chunks of one sentence (array<double>), as SQL.

    Same definition as ``sentiment.chunk_words`` -> ``lexicon_score`` ->
    ``signed_score`` (checked against the oracle through the stylistics table).
    """
    from ..functions.lexicon import polarity_words
    from ..functions.tagger import sql_list, sql_str

    costs = {"subword": "CAST(2 + ceil(length(w) / 4) AS BIGINT)", "chars": "CAST(length(w) AS BIGINT)",
             "words": "CAST(1 AS BIGINT)"}
    c = costs[cost]
    fold = (f"aggregate(regexp_extract_all({sentence}, {sql_str(chr(92) + 'S+')}, 0), "
            "named_struct('done', CAST(array() AS ARRAY<STRING>), 'cur', '', 'cost_sum', CAST(0 AS BIGINT), "
            "'nw', CAST(0 AS BIGINT)), "
            f"(acc, w) -> CASE WHEN acc.cost_sum + {c} > {int(max_len)} "
            f"THEN named_struct('done', array_append(acc.done, acc.cur), 'cur', w, 'cost_sum', {c}, "
            "'nw', CAST(1 AS BIGINT)) "
            "ELSE named_struct('done', acc.done, 'cur', CASE WHEN acc.nw = 0 THEN w ELSE concat(acc.cur, ' ', w) END, "
            f"'cost_sum', acc.cost_sum + {c}, 'nw', acc.nw + 1) END, "
            "acc -> filter(CASE WHEN acc.nw > 0 THEN array_append(acc.done, acc.cur) ELSE acc.done END, "
            "x -> x <> ''))")
    # bind the fold to a lambda variable so it is evaluated once per sentence
    chunks = f"element_at(transform(array({fold}), f -> CASE WHEN size(f) = 1 THEN array({sentence}) ELSE f END), 1)"
    pw = polarity_words()
    toks = "regexp_extract_all(lower(ch), " + sql_str("[" + chr(92) + "p{L}" + chr(92) + "p{N}_]+") + ", 0)"
    pn = (f"transform({chunks}, ch -> named_struct('p', size(filter({toks}, t -> t IN {sql_list(pw['positive'])})), "
          f"'n', size(filter({toks}, t -> t IN {sql_list(pw['negative'])}))))")
    return (f"transform({pn}, q -> CASE WHEN q.p > q.n THEN abs(q.p - q.n) / (q.p + q.n) "
            "WHEN q.n > q.p THEN -(abs(q.p - q.n) / (q.p + q.n)) ELSE CAST(0.0 AS DOUBLE) END)")


def _sql_in(items) -> str:
    from ..functions.tagger import sql_list

    return sql_list(items)


def documents_from_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, sents): the token table as one array of sentences per document.

    Two aggregates by ``doc_id``; no exchange if the tokens are partitioned by it.
    """
    token = ("named_struct('i', token_i, 'text', token_text, 'lemma', lemma, 'pos', pos, 'morph', morph, 'is_punct', is_punct, "
             "'d', CAST(abs(token_i - head_i) AS BIGINT), 'is_root', dep = 'ROOT')")
    per_sent = tokens.groupBy("doc_id", "sent_id").agg(F.expr(f"array_sort(collect_list({token})) AS toks"))
    per_doc = per_sent.groupBy("doc_id").agg(F.expr("array_sort(collect_list(named_struct('sent_id', sent_id, 'toks', toks))) AS sents"))
    return per_doc.selectExpr("doc_id", "transform(sents, s -> s.toks) AS sents")


def documents_from_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                         num_partitions: int | None = None) -> DataFrame:
    """(doc_id, sents): the baseline annotator's tokens, made in one projection of the text.

    A document never leaves its row, so there is no exchange. ``num_partitions``
    deals the rows out first, for a table whose files give too few tasks.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    if num_partitions:
        base = base.repartition(num_partitions)
    tagged = tagged_sentences_sql("lang", f"coalesce({_sentences_sql()}, array())", TOKEN_RE)
    token = ("named_struct('i', w.j, 'text', w.text, 'lemma', w.lemma, 'pos', w.pos, 'morph', w.morph, 'is_punct', w.is_punct, "
             "'d', CAST(abs(w.j - s.r) AS BIGINT), 'is_root', w.j = s.r)")
    return base.selectExpr("doc_id", f"transform({tagged}, s -> transform(s.toks, w -> {token})) AS sents")


def _msttr_sql(words: str, window: int = 100) -> str:
    n = f"size({words})"
    nseg = f"CAST(floor({n} / {window}) AS INT)"
    seg_sum = (f"aggregate(sequence(0, greatest({nseg} - 1, 0)), CAST(0.0 AS DOUBLE), "
               f"(acc, k) -> acc + size(array_distinct(slice({words}, k * {window} + 1, {window}))) / {float(window)})")
    return (f"CASE WHEN {n} = 0 THEN CAST(0.0 AS DOUBLE) WHEN {n} <= {window} "
            f"THEN size(array_distinct({words})) / {n} ELSE {seg_sum} / {nseg} END")


def _ratio_sql(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE)"


def _mean_sql(xs: str) -> str:
    return f"aggregate({xs}, CAST(0.0 AS DOUBLE), (a, x) -> a + x) / nullif(size({xs}), 0)"


def _std_sql(xs: str, mean: str) -> str:
    return f"sqrt(aggregate({xs}, CAST(0.0 AS DOUBLE), (a, x) -> a + (x - {mean}) * (x - {mean})) / nullif(size({xs}), 0))"


#: A token's bits: the classes that measures count, then those that need a look at its morph or text.
_FLAGS = {x: 1 << i for i, x in enumerate(("words", "noun", "verb", "adj", "adv", "nominal", "function", "voiced", "passive", "active",
                                           "past", "present", "prs", "of", "that", "pron", "adp", "sconj"))}


def _flags_sql(toks: str, of_words, that_words) -> str:
    """The bits of each token (array<int>): those of its part of speech from a table, the others where that calls for them."""
    known = list(dict.fromkeys([*NON_WORD_POS, *NOMINAL_POS, *FUNCTION_WORD_POS, "NOUN", "VERB", "ADJ", "ADV", "PRON", "ADP", "SCONJ"]))
    single = {"NOUN": "noun", "VERB": "verb", "ADJ": "adj", "ADV": "adv", "PRON": "pron", "ADP": "adp", "SCONJ": "sconj"}

    def of_pos(pos: str) -> int:
        has = {"words": pos not in NON_WORD_POS, "nominal": pos in NOMINAL_POS, "function": pos in FUNCTION_WORD_POS, single.get(pos): True}
        return sum(_FLAGS[k] for k, v in has.items() if k and v)

    # place 0: another part of speech, which is a word's; null: none of the classes
    table = f"array({', '.join(str(x) for x in (_FLAGS['words'], *map(of_pos, known)))})"
    base = f"transform({toks}, t -> coalesce({table}[CAST(array_position(array{_sql_in(known)}, t.pos) AS INT)], 0))"
    m, low = "coalesce(t.morph, '')", "lower(t.text)"

    def bit(cond: str, name: str) -> str:
        return f"CASE WHEN {cond} THEN {_FLAGS[name]} ELSE 0 END"

    verb = " + ".join([bit(f"contains({m}, 'Voice=Act') OR contains({m}, 'Voice=Pass')", "voiced"), bit(f"contains({m}, 'Voice=Pass')", "passive"),
                       bit(f"contains({m}, 'Voice=Act')", "active"), bit(f"contains({m}, 'Tense=Past')", "past"),
                       bit(f"contains({m}, 'Tense=Pres')", "present")])
    more = {"verb": verb, "pron": bit(f"contains({m}, 'PronType=Prs')", "prs"), "adp": bit(f"{low} IN {_sql_in(of_words)}", "of"),
            "sconj": bit(f"{low} IN {_sql_in(that_words)}", "that")}
    whens = " ".join(f"WHEN b & {_FLAGS[k]} <> 0 THEN {v}" for k, v in more.items())
    look = sum(_FLAGS[k] for k in more)
    return f"zip_with({base}, {toks}, (b, t) -> CASE WHEN b & {look} = 0 THEN b ELSE b + CASE {whens} END END)"


def document_measures(docs: DataFrame, legacy_swap: bool = False, sentiment: bool = True, of_words=OF_WORDS,
                      that_words=THAT_WORDS, skip: int = 10, take: int = 40, long_doc: int = 50,
                      max_len: int = 512, cost: str = "subword") -> DataFrame:
    """All per-document measures from (doc_id, sents), projections only; null for a document without tokens.

    Each step binds the arrays that the next one reads more than once.
    """
    def n(bit: str) -> str:
        return f"CAST(size(filter(flags, f -> f & {_FLAGS[bit]} <> 0)) AS BIGINT)"

    def those(bit: str) -> str:
        return f"filter(toks, (t, i) -> flags[i] & {_FLAGS[bit]} <> 0)"

    kept = "filter(s, t -> NOT t.is_punct AND t.pos <> 'SPACE')"
    per_sentence = (f"transform(sents, s -> element_at(transform(array({kept}), k -> named_struct('n', size(s), 'nk', size(k), "
                    "'dd', aggregate(k, CAST(0 AS BIGINT), (a, t) -> a + t.d), "
                    "'root', array_min(transform(filter(k, t -> t.is_root), t -> t.i)), "
                    "'start', array_min(transform(k, t -> t.i)))), 1))")
    d = docs.selectExpr("doc_id", "flatten(sents) AS toks", f"{per_sentence} AS per",
                        "transform(sents, s -> array_join(transform(s, t -> t.text), ' ')) AS texts")
    d = d.selectExpr("*", f"{_flags_sql('toks', of_words, that_words)} AS flags")
    counts = {f"n_{x}": n(x) for x in ("words", "noun", "verb", "adj", "adv", "nominal", "voiced", "passive", "active", "past", "present",
                                       "prs", "function", "of", "that")}
    counts |= {f"{x}_lemmas": f"size(array_distinct(transform({those(x)}, t -> t.lemma)))" for x in ("noun", "verb")}
    valid = "filter(per, p -> p.nk > 0 AND p.root IS NOT NULL)"
    d = d.selectExpr("doc_id", "per", "texts", "CAST(size(toks) AS BIGINT) AS n_tokens", *[f"{v} AS {k}" for k, v in counts.items()],
                     f"transform({those('words')}, t -> t.text) AS words",
                     f"transform({valid}, p -> named_struct('m', p.dd / p.nk, 'far', p.root - p.start, 'nk', p.nk)) AS dist",
                     *(["flatten(transform(texts, x -> " + _signed_chunk_scores_sql("x", max_len, cost) + ")) AS sentiment"] if sentiment else []))
    own = [c for c in d.columns if c not in ("per", "dist")]
    d = d.selectExpr(*own, "size(texts) AS n_sents", "aggregate(words, CAST(0 AS BIGINT), (a, w) -> a + length(w)) AS word_chars", "transform(per, p -> CAST(p.n AS DOUBLE)) AS lens", "transform(dist, x -> x.m) AS mdds",
                     "transform(filter(dist, x -> x.m > 0 AND x.far >= 0), x -> abs(ln(x.m / sqrt((x.far + 1) * x.nk)))) AS ndds")
    d = d.selectExpr("*", f"{_mean_sql('mdds')} AS avg_mdd", f"{_mean_sql('ndds')} AS avg_ndd",
                     *([f"CASE WHEN size(sentiment) > 1 THEN {_mean_sql('sentiment')} END AS sentiment_mean"] if sentiment else []))
    act, pas = ("n_passive", "n_active") if legacy_swap else ("n_active", "n_passive")
    measures = {
        "nominal_verb_ratio": _ratio_sql("n_nominal + n_noun", "n_verb"), "msttr": _msttr_sql("words"),
        "noun_ttr": _ratio_sql("noun_lemmas", "n_noun"), "verb_ttr": _ratio_sql("verb_lemmas", "n_verb"),
        "personal_pronoun_ratio": _ratio_sql("n_prs", "n_tokens"), "function_word_ratio": _ratio_sql("n_function", "n_tokens"),
        "of_ratio": _ratio_sql("n_of", "n_tokens"), "that_ratio": _ratio_sql("n_that", "n_tokens"),
        "past_tense_ratio": f"CASE WHEN n_past > 0 THEN {_ratio_sql('n_past', 'n_verb')} END",
        "present_tense_ratio": f"CASE WHEN n_present > 0 THEN {_ratio_sql('n_present', 'n_verb')} END",
        "passive_ratio": _ratio_sql(pas, "n_voiced"), "active_ratio": _ratio_sql(act, "n_voiced"),
        "adjective_adverb_ratio": _ratio_sql("n_adj + n_adv", "n_words"), "avg_wordlen": _ratio_sql("word_chars", "n_words"),
        "avg_sentlen": _mean_sql("lens"), "num_sents": "CAST(n_sents AS BIGINT)", "avg_ndd": "avg_ndd", "std_ndd": _std_sql("ndds", "avg_ndd"),
        "avg_mdd": "avg_mdd", "std_mdd": _std_sql("mdds", "avg_mdd"),
        "selected_text": (f"array_join(CASE WHEN n_sents > {long_doc} THEN slice(texts, {skip + 1}, {take}) "
                          f"ELSE slice(texts, 1, {take}) END, ' ')"),
    }
    if sentiment:
        many = "CASE WHEN size(sentiment) > 1 THEN {} END"
        measures |= {"sentiment": "sentiment", "sentiment_mean": "sentiment_mean",
                     "sentiment_std": many.format(_std_sql("sentiment", "sentiment_mean")),
                     "sentiment_abs": many.format("aggregate(sentiment, CAST(0.0 AS DOUBLE), (a, x) -> a + abs(x)) / size(sentiment)")}
    # one struct through a generator: a filter on a measure stays above it, where it would else be pushed
    # down as the whole expression, annotator included, once for each condition
    row = ", ".join(f"'{k}', CASE WHEN n_sents > 0 THEN {v} END" for k, v in measures.items())
    return d.selectExpr("doc_id", f"explode_outer(array(named_struct({row}))) AS m").selectExpr("doc_id", "m.*")


def text_measures(docs: DataFrame, legacy_swap: bool = False, sentiment: bool = True, of_words=OF_WORDS, that_words=THAT_WORDS, skip: int = 10,
                  take: int = 40, long_doc: int = 50, max_len: int = 512, cost: str = "subword", selected: bool = True,
                  num_partitions: int | None = None) -> DataFrame:
    """``document_measures`` of ``documents_from_texts(docs)`` for (doc_id, lang, text), on Arrow batches (see ``operators.text_measures``).

    Spark cuts the texts into pieces and gets a row of numbers a document back; without ``selected`` the text for the compression ratio is null.
    """
    ship_package(docs.sparkSession)
    base = docs.select("doc_id", "lang", "text")
    if num_partitions:
        base = base.repartition(num_partitions)
    measures = measures_udf(sentiment, legacy_swap=legacy_swap, selected=selected, of_words=of_words, that_words=that_words, skip=skip,
                            take=take, long_doc=long_doc, max_len=max_len, cost=cost)
    d = base.select("doc_id", "lang", pieces().alias("w"), lead().alias("lead")).select("doc_id", measures("lang", "w", "lead").alias("m"))
    # through a generator, so that a filter on a measure stays above it and the annotator isn't run for each condition
    return d.select("doc_id", F.explode_outer(F.array("m")).alias("m")).selectExpr("doc_id", "m.*")


def _table(out: DataFrame, corpus: DataFrame | None, sentiment: bool, with_compression: bool) -> DataFrame:
    ratio = bz2_ratio("selected_text") if with_compression else F.lit(None).cast("double")
    cols = ["doc_id"] + MEASURES
    if sentiment:
        cols += ["sentiment", "sentiment_mean", "sentiment_std", "sentiment_abs"]
    out = out.withColumn("compression_ratio", ratio).select(*cols)
    if corpus is not None:
        # from the corpus, so that each of its documents keeps its row (measures null without tokens)
        meta = corpus.select("doc_id", "group_id", "label")
        out = meta.join(out, "doc_id", "left").select(*cols, "group_id", "label")
    return out


def stylistics_table(tokens: DataFrame, corpus: DataFrame | None = None, sentiment: bool = True,
                     legacy_swap: bool = False, with_compression: bool = True,
                     max_len: int = 512, cost: str = "subword") -> DataFrame:
    """F23 from a token table: all measures per document, the sentiment series/summary and corpus metadata.

    With ``corpus`` each of its documents has a row, also one without tokens.
    """
    out = document_measures(documents_from_tokens(tokens), sentiment=sentiment, legacy_swap=legacy_swap, max_len=max_len, cost=cost)
    return _table(out, corpus, sentiment, with_compression)


def stylistics_of(docs: DataFrame, corpus: DataFrame | None = None, sentiment: bool = True, legacy_swap: bool = False,
                  with_compression: bool = True, max_len: int = 512, cost: str = "subword",
                  num_partitions: int | None = None) -> DataFrame:
    """F23 from (doc_id, lang, text) with the baseline annotator: one projection of the text, no exchange.

    One row per document (measures null without tokens). ``num_partitions``: see ``documents_from_texts``.
    """
    out = text_measures(docs, sentiment=sentiment, legacy_swap=legacy_swap, max_len=max_len, cost=cost, selected=with_compression,
                        num_partitions=num_partitions)
    return _table(out, corpus, sentiment, with_compression)
