"""DuckDB oracle SQL for the registered queries.

Each statement is an independent relational formulation (joins, windows,
list functions) of the operator's definition over the same driver tables. Shared
fixed tables (lexicon, suffix rules, polarity words) are inlined as VALUES lists
generated from ``functions.lexicon``, so both engines use the same data.
"""

from __future__ import annotations

from ..functions.lexicon import (ANNOTATION_CODES, ANNOTATION_RECODE, FUNCTION_WORD_POS, NOMINAL_POS,
                                 NON_WORD_POS, NOUN_CAPITALISING_LANGS, OF_WORDS, THAT_WORDS,
                                 SENTIMENT_LABEL_SYNONYMS, lexicon_rows, polarity_words, suffix_rules)
from ..functions.text import NUMBER_RE, TERM_RE, TOKEN_RE, WORD_CHAR_RE
from ..operators.models import CLASSIFY_STYLISTICS
from .descriptives import DESC_FEATURES

ORACLE: dict[str, str] = {}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def values(rows) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, (int, float)):
            return str(x)
        return q(x)
    return ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)


# --------------------------------------------------------------------------
# Bag of words
# --------------------------------------------------------------------------

TERMS = f"regexp_extract_all(lower(text), {q(TERM_RE)})"
D_TERMS = f"d AS (SELECT doc_id, {TERMS} AS terms FROM documents), t AS (SELECT doc_id, unnest(terms) AS term FROM d)"


def vocab_cte(n: int) -> str:
    return (f"tot AS (SELECT term, count(*) AS total FROM t GROUP BY term), "
            f"v AS (SELECT term, total, row_number() OVER (ORDER BY total DESC, term) AS rank FROM tot "
            f"QUALIFY rank <= {n})")


ORACLE["tokenize"] = f"""
WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents)
SELECT doc_id, generate_subscripts(terms, 1) - 1 AS pos, unnest(terms) AS term FROM d
"""

ORACLE["term_counts"] = f"""
WITH {D_TERMS}
SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term
"""

ORACLE["top_vocabulary"] = f"""
WITH {D_TERMS}, {vocab_cte(5000)}
SELECT term, total, rank FROM v
"""

for _name, _n in (("mfw_relative", 100), ("mfw_relative_500", 500)):
    ORACLE[_name] = f"""
WITH {D_TERMS}, {vocab_cte(_n)},
h AS (SELECT doc_id, term, count(*) AS n FROM t JOIN v USING (term) GROUP BY doc_id, term)
SELECT h.doc_id, h.term, v.rank, round(h.n / len(d.terms), 6) AS rel_freq
FROM h JOIN v USING (term) JOIN d USING (doc_id)
"""

ORACLE["mfw_wide"] = f"""
WITH {D_TERMS}, {vocab_cte(100)},
h AS (SELECT doc_id, term, count(*) AS n FROM t JOIN v USING (term) GROUP BY doc_id, term)
SELECT d.doc_id, v.rank, round(CASE WHEN len(d.terms) > 0 THEN coalesce(h.n, 0) / len(d.terms) END, 6) AS rate
FROM d CROSS JOIN v LEFT JOIN h ON h.doc_id = d.doc_id AND h.term = v.term
"""

ORACLE["tfidf"] = f"""
WITH {D_TERMS}, {vocab_cte(5000)},
tf AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN v USING (term) GROUP BY doc_id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
"""

ORACLE["term_vectors"] = ORACLE["tfidf"]


# --------------------------------------------------------------------------
# Annotation (A1–A5) and stylistics
# --------------------------------------------------------------------------

# a text of terminators only is one sentence; else terminators close the run before them, or open the first one
_SENTS = """list_filter(CASE WHEN regexp_full_match(text, '[.!?]+') THEN [text]
            ELSE regexp_extract_all(text, '[.!?]*[^.!?]+[.!?]*') END, lambda s: regexp_matches(s, '\\S'))"""
_LEX = values(lexicon_rows())
_RULES = values([(i, *r) for i, r in enumerate(suffix_rules(), start=1)])
_NOUN_CAP = lst(NOUN_CAPITALISING_LANGS)

TOKENS_CTE = f"""
lex(lang, form, lpos, llemma, lmorph) AS (VALUES {_LEX}),
rules(idx, rlang, suffix, rpos, rmorph) AS (VALUES {_RULES}),
s0 AS (SELECT doc_id, lang, {_SENTS} AS sl
       FROM documents),
s1 AS (SELECT doc_id, lang, unnest(sl) AS sentence, generate_subscripts(sl, 1) - 1 AS sent_id FROM s0),
s2 AS (SELECT doc_id, lang, sent_id, regexp_extract_all(sentence, {q(TOKEN_RE)}) AS toks FROM s1),
s3 AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY doc_id ORDER BY sent_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s2),
t0 AS (SELECT doc_id, lang, sent_id, off, unnest(toks) AS text, generate_subscripts(toks, 1) - 1 AS j FROM s3),
t1 AS (SELECT *, lower(text) AS low, NOT regexp_matches(text, {q(WORD_CHAR_RE)}) AS is_punct,
              regexp_matches(text, {q(NUMBER_RE)}) AS is_num,
              substr(text, 1, 1) <> lower(substr(text, 1, 1)) AS is_cap FROM t0),
t2 AS (SELECT t1.*, lex.lpos, lex.llemma, lex.lmorph, lex.form IS NOT NULL AS has_lex
       FROM t1 LEFT JOIN lex ON lex.lang = t1.lang AND lex.form = t1.low),
t3 AS (SELECT t2.*, (SELECT min(idx) FROM rules WHERE rlang = t2.lang AND ends_with(t2.low, suffix)
                     AND length(t2.low) >= length(suffix) + 2) AS rule FROM t2),
t4 AS (SELECT t3.*, rules.rpos, rules.rmorph FROM t3 LEFT JOIN rules ON rules.idx = t3.rule),
t5 AS (SELECT doc_id, sent_id, CAST(off + j AS BIGINT) AS token_i, j, text AS token_text,
              coalesce(llemma, low) AS lemma, is_punct, has_lex AS is_stop,
              CASE WHEN is_punct THEN 'PUNCT' WHEN is_num THEN 'NUM' WHEN has_lex THEN lpos
                   WHEN is_cap AND lang IN {_NOUN_CAP} THEN 'NOUN' WHEN is_cap AND j > 0 THEN 'PROPN'
                   WHEN rule IS NOT NULL THEN rpos ELSE 'NOUN' END AS pos,
              CASE WHEN is_punct OR is_num THEN NULL WHEN has_lex THEN lmorph
                   WHEN is_cap AND (lang IN {_NOUN_CAP} OR j > 0) THEN NULL
                   WHEN rule IS NOT NULL THEN rmorph ELSE NULL END AS morph
       FROM t4),
t6 AS (SELECT *, coalesce(min(CASE WHEN pos = 'VERB' THEN j END) OVER w,
                          min(CASE WHEN NOT is_punct THEN j END) OVER w, 0) AS r
       FROM t5 WINDOW w AS (PARTITION BY doc_id, sent_id)),
tokens AS (SELECT doc_id, sent_id, token_i, token_text, lemma, is_punct, is_stop, morph, pos, pos AS tag,
                  CASE WHEN j = r THEN 'ROOT' WHEN is_punct THEN 'punct' ELSE 'dep' END AS dep,
                  max(CASE WHEN j = r THEN token_text END) OVER (PARTITION BY doc_id, sent_id) AS head,
                  CAST(token_i - j + r AS BIGINT) AS head_i
           FROM t6),
tk AS (SELECT *, coalesce(morph, '') AS m, pos NOT IN {lst(NON_WORD_POS)} AS is_word FROM tokens)
"""

ORACLE["segment_sentences"] = f"WITH {TOKENS_CTE} SELECT doc_id, sent_id, sentence FROM s1"
ORACLE["token_table"] = f"WITH {TOKENS_CTE} SELECT doc_id, sent_id, token_i, token_text, is_punct FROM tokens"
ORACLE["tag_tokens"] = f"WITH {TOKENS_CTE} SELECT doc_id, token_i, pos, tag, lemma, morph, is_stop FROM tokens"
ORACLE["attach_heads"] = f"WITH {TOKENS_CTE} SELECT doc_id, token_i, dep, head, head_i FROM tokens"
ORACLE["attach_heads_parsed"] = f"""
WITH {TOKENS_CTE} SELECT doc_id, sent_id, count(*) AS n_tokens, CAST(1 AS BIGINT) AS n_roots, true AS heads_inside FROM tokens GROUP BY doc_id, sent_id
"""
ORACLE["arc_counts"] = f"""WITH {TOKENS_CTE},
a AS (SELECT d.pos AS dep, h.pos AS head, d.head_i = d.token_i AS root, d.head_i > d.token_i AS "right", abs(d.head_i - d.token_i) AS gap
      FROM tokens d JOIN tokens h ON h.doc_id = d.doc_id AND h.token_i = d.head_i)
SELECT dep, CASE WHEN root THEN 'ROOT' ELSE head END AS head, "right",
       CAST(CASE WHEN root OR gap <= 1 THEN 0 WHEN gap <= 2 THEN 1 WHEN gap <= 3 THEN 2 WHEN gap <= 6 THEN 3 WHEN gap <= 10 THEN 4 ELSE 5 END AS BIGINT) AS far,
       count(*) AS n FROM a GROUP BY ALL
"""
ORACLE["tag_transitions"] = f"""WITH {TOKENS_CTE},
b AS (SELECT coalesce(lag(pos) OVER (PARTITION BY doc_id, sent_id ORDER BY token_i), '^') AS before, pos FROM tokens)
SELECT before, pos, count(*) AS n FROM b GROUP BY ALL
"""
ORACLE["annotate"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, {q(r"\S+")}) AS ws FROM documents)
SELECT doc_id, generate_subscripts(ws, 1) - 1 AS token_i, unnest(ws) AS token_text, lower(unnest(ws)) AS lemma FROM w
"""

ORACLE["token_predicates"] = f"""
WITH {TOKENS_CTE}
SELECT doc_id, sent_id, token_i, is_word, pos IN {lst(NOMINAL_POS)} AS is_nominal,
       pos IN {lst(FUNCTION_WORD_POS)} AS is_function_word,
       pos = 'PRON' AND contains(m, 'PronType=Prs') AS is_personal_pronoun,
       pos = 'VERB' AND contains(m, 'Tense=Past') AS is_past, pos = 'VERB' AND contains(m, 'Tense=Pres') AS is_present,
       pos = 'VERB' AND contains(m, 'Voice=Act') AS is_active, pos = 'VERB' AND contains(m, 'Voice=Pass') AS is_passive,
       pos = 'ADP' AND lower(token_text) IN {lst(OF_WORDS)} AS is_of_like,
       pos = 'SCONJ' AND lower(token_text) IN {lst(THAT_WORDS)} AS is_that_like
FROM tk
"""

STYL_CTE = f"""
pm AS (SELECT doc_id, count(*) AS n_tokens, count_if(is_word) AS n_words, count_if(pos = 'NOUN') AS n_noun,
              count_if(pos = 'VERB') AS n_verb, count_if(pos = 'ADJ') AS n_adj, count_if(pos = 'ADV') AS n_adv,
              count_if(pos IN {lst(NOMINAL_POS)}) AS n_nominal,
              count_if(pos = 'VERB' AND (contains(m, 'Voice=Act') OR contains(m, 'Voice=Pass'))) AS n_voiced,
              count_if(pos = 'VERB' AND contains(m, 'Voice=Pass')) AS n_passive,
              count_if(pos = 'VERB' AND contains(m, 'Voice=Act')) AS n_active,
              count_if(pos = 'VERB' AND contains(m, 'Tense=Past')) AS n_past,
              count_if(pos = 'VERB' AND contains(m, 'Tense=Pres')) AS n_present,
              count_if(pos = 'PRON' AND contains(m, 'PronType=Prs')) AS n_prs,
              count_if(pos IN {lst(FUNCTION_WORD_POS)}) AS n_function,
              count_if(pos = 'ADP' AND lower(token_text) IN {lst(OF_WORDS)}) AS n_of,
              count_if(pos = 'SCONJ' AND lower(token_text) IN {lst(THAT_WORDS)}) AS n_that,
              sum(CASE WHEN is_word THEN length(token_text) END) AS word_chars,
              count(DISTINCT CASE WHEN pos = 'NOUN' THEN lemma END) AS noun_lemmas,
              count(DISTINCT CASE WHEN pos = 'VERB' THEN lemma END) AS verb_lemmas
       FROM tk GROUP BY doc_id),
pmx AS (SELECT doc_id,
              (n_nominal + n_noun) / nullif(n_verb, 0) AS nominal_verb_ratio,
              noun_lemmas / nullif(n_noun, 0) AS noun_ttr,
              verb_lemmas / nullif(n_verb, 0) AS verb_ttr,
              n_prs / nullif(n_tokens, 0) AS personal_pronoun_ratio,
              n_function / nullif(n_tokens, 0) AS function_word_ratio,
              n_of / nullif(n_tokens, 0) AS of_ratio,
              n_that / nullif(n_tokens, 0) AS that_ratio,
              CASE WHEN n_past > 0 THEN n_past / n_verb END AS past_tense_ratio,
              CASE WHEN n_present > 0 THEN n_present / n_verb END AS present_tense_ratio,
              n_passive / nullif(n_voiced, 0) AS passive_ratio,
              n_active / nullif(n_voiced, 0) AS active_ratio,
              (n_adj + n_adv) / nullif(n_words, 0) AS adjective_adverb_ratio,
              word_chars / nullif(n_words, 0) AS avg_wordlen
       FROM pm),
wd AS (SELECT doc_id, token_text, row_number() OVER (PARTITION BY doc_id ORDER BY token_i) - 1 AS word_i
       FROM tk WHERE is_word),
sg AS (SELECT doc_id, floor(word_i / 100) AS seg, count(*) AS n, count(DISTINCT token_text) AS types
       FROM wd GROUP BY doc_id, floor(word_i / 100)),
ms0 AS (SELECT doc_id, CASE WHEN sum(n) <= 100 THEN max(CASE WHEN seg = 0 THEN types / n END)
                            ELSE avg(CASE WHEN n = 100 THEN types / n END) END AS msttr FROM sg GROUP BY doc_id),
ms AS (SELECT d.doc_id, coalesce(ms0.msttr, 0.0) AS msttr FROM (SELECT DISTINCT doc_id FROM tokens) d
       LEFT JOIN ms0 USING (doc_id)),
ps AS (SELECT doc_id, sent_id, count(*) AS n_all, count_if(NOT is_punct AND pos <> 'SPACE') AS n_kept,
              sum(CASE WHEN NOT is_punct AND pos <> 'SPACE' THEN abs(token_i - head_i) END) AS dd_sum,
              min(CASE WHEN NOT is_punct AND pos <> 'SPACE' AND dep = 'ROOT' THEN token_i END) AS root_i,
              min(CASE WHEN NOT is_punct AND pos <> 'SPACE' THEN token_i END) AS start_i
       FROM tokens GROUP BY doc_id, sent_id),
ps2 AS (SELECT doc_id, n_all, n_kept, root_i - start_i AS root_dist,
               CASE WHEN n_kept > 0 AND root_i IS NOT NULL THEN dd_sum / n_kept END AS mdd FROM ps),
ps3 AS (SELECT *, CASE WHEN mdd > 0 AND root_dist >= 0 THEN abs(ln(mdd / sqrt((root_dist + 1) * n_kept))) END AS ndd
        FROM ps2),
sm AS (SELECT doc_id, avg(n_all) AS avg_sentlen, count(*) AS num_sents, avg(ndd) AS avg_ndd,
              stddev_pop(ndd) AS std_ndd, avg(mdd) AS avg_mdd, stddev_pop(mdd) AS std_mdd FROM ps3 GROUP BY doc_id),
st AS (SELECT doc_id, sent_id, string_agg(token_text, ' ' ORDER BY token_i) AS sentence FROM tokens GROUP BY doc_id, sent_id),
styl AS (SELECT * FROM pmx JOIN ms USING (doc_id) JOIN sm USING (doc_id))
"""

POS_MEASURES = ["nominal_verb_ratio", "noun_ttr", "verb_ttr", "personal_pronoun_ratio", "function_word_ratio",
                "of_ratio", "that_ratio", "past_tense_ratio", "present_tense_ratio", "passive_ratio",
                "active_ratio", "adjective_adverb_ratio", "avg_wordlen"]
SENT_MEASURES = ["avg_sentlen", "avg_ndd", "std_ndd", "avg_mdd", "std_mdd"]
for _m in POS_MEASURES + ["msttr"] + SENT_MEASURES:
    ORACLE[_m] = f"WITH {TOKENS_CTE}, {STYL_CTE} SELECT doc_id, round({_m}, 6) AS {_m} FROM styl"
ORACLE["num_sents"] = f"WITH {TOKENS_CTE}, {STYL_CTE} SELECT doc_id, num_sents FROM styl"
ORACLE["sentence_text"] = f"WITH {TOKENS_CTE}, {STYL_CTE} SELECT doc_id, sent_id, sentence FROM st"
ORACLE["compression_selection"] = f"""
WITH {TOKENS_CTE}, {STYL_CTE},
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS rn,
              count(*) OVER (PARTITION BY doc_id) AS n FROM st)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS selected_text FROM rk
WHERE CASE WHEN n > 50 THEN rn > 10 AND rn <= 50 ELSE rn <= 40 END GROUP BY doc_id
"""


# --------------------------------------------------------------------------
# Corpus binding, cleaning (P1–P17), joins
# --------------------------------------------------------------------------

CORPUS_CTE = """
corpus AS (SELECT d.doc_id, d.text, d.lang, d.source,
                  CASE l.quality WHEN 1 THEN 'a' WHEN 0 THEN 'b' END AS label,
                  CASE WHEN d.doc_id % 7 <> 0
                       THEN d.source || '_' || substr('abc', CAST(d.doc_id % 3 + 1 AS INTEGER), 1) END AS group_id
           FROM documents d LEFT JOIN labels l USING (doc_id))
"""
_CODES = "[" + ", ".join(q(c) for c in ANNOTATION_CODES) + "]"
RAW_CTE = (f"raw AS (SELECT doc_id, list_concat({_CODES}, ['NA', 'mixed', 'usikker'])[CAST(doc_id % 11 + 1 AS INTEGER)] AS code "
           "FROM documents)")
_RECODE = "CASE " + " ".join(f"WHEN code = {q(k)} THEN {q(v)}" for k, v in ANNOTATION_RECODE.items()) + " END"
WORDS = f"len(regexp_extract_all(text, {q(r'\S+')}))"

ORACLE["normalize_text"] = f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), {q(r'\s+')}, ' ', 'g')) AS text_norm
FROM documents
"""
ORACLE["drop_unusable"] = f"WITH {RAW_CTE} SELECT doc_id, code FROM raw WHERE code IS NOT NULL AND code NOT IN ('NA', 'mixed', 'usikker')"
ORACLE["recode_labels"] = f"""
WITH {RAW_CTE}, r AS (SELECT doc_id, code, {_RECODE} AS label FROM raw WHERE code IS NOT NULL AND code NOT IN ('NA', 'mixed', 'usikker'))
SELECT * FROM r WHERE label IS NOT NULL
"""
ORACLE["select_columns"] = f"WITH {CORPUS_CTE} SELECT doc_id, label, group_id FROM corpus"
ORACLE["drop_columns_by_prefix"] = "SELECT doc_id, lang, source FROM documents"
ORACLE["word_count"] = f"SELECT doc_id, {WORDS} AS n_words FROM documents"
ORACLE["filter_min_words"] = f"SELECT doc_id, {WORDS} AS n_words FROM documents WHERE text IS NOT NULL AND {WORDS} >= 100"
ORACLE["filter_min_words_strict"] = f"SELECT doc_id, {WORDS} AS n_words FROM documents WHERE text IS NOT NULL AND {WORDS} > 100"
ORACLE["dedupe"] = f"""
WITH {CORPUS_CTE}
SELECT group_id, doc_id, lang, label FROM corpus
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY doc_id) = 1
"""
ORACLE["valid_vectors"] = """
SELECT vec_id AS doc_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings
WHERE vec_id % 13 NOT IN (5, 7) AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
"""
ORACLE["require_not_null"] = f"WITH {CORPUS_CTE} SELECT doc_id FROM corpus WHERE label IS NOT NULL AND group_id IS NOT NULL"
ORACLE["strip_part_suffix"] = f"WITH {CORPUS_CTE} SELECT doc_id, regexp_replace(group_id, '_[a-z]$', '') AS group_id FROM corpus"
ORACLE["fill_surrogate_group"] = f"WITH {CORPUS_CTE} SELECT doc_id, coalesce(group_id, 'noid_' || doc_id) AS group_id FROM corpus"
ORACLE["filter_outliers"] = f"""
WITH {TOKENS_CTE}, {STYL_CTE}
SELECT doc_id FROM styl WHERE avg_sentlen < 100 AND noun_ttr < 6 AND nominal_verb_ratio < 12
"""
ORACLE["quarantine_empty"] = "SELECT doc_id, CASE WHEN doc_id % 17 < 2 OR text = '' THEN 'rejected' ELSE 'ok' END AS status FROM documents"
ORACLE["removal_report"] = f"""
WITH {CORPUS_CTE}, c AS (SELECT *, {WORDS} AS n_words FROM corpus),
n AS (SELECT count(*) AS n0, count_if(text IS NOT NULL) AS n1,
             count_if(text IS NOT NULL AND label IS NOT NULL) AS n2,
             count_if(text IS NOT NULL AND label IS NOT NULL AND n_words >= 100) AS n3 FROM c)
SELECT 1::BIGINT AS step_no, 'has_text' AS step, n0 AS n_before, n1 AS n_after, n0 - n1 AS removed FROM n
UNION ALL SELECT 2, 'labelled', n1, n2, n1 - n2 FROM n
UNION ALL SELECT 3, 'min_words_100', n2, n3, n2 - n3 FROM n
"""
ORACLE["missing_profile"] = f"""
WITH {CORPUS_CTE}
SELECT 'doc_id' AS "column", count_if(doc_id IS NULL) AS n_null FROM corpus
UNION ALL SELECT 'text', count_if(text IS NULL) FROM corpus
UNION ALL SELECT 'lang', count_if(lang IS NULL) FROM corpus
UNION ALL SELECT 'source', count_if(source IS NULL) FROM corpus
UNION ALL SELECT 'label', count_if(label IS NULL) FROM corpus
UNION ALL SELECT 'group_id', count_if(group_id IS NULL) FROM corpus
"""
ORACLE["attach_text"] = f"SELECT l.doc_id, l.quality, l.toxic, {WORDS} AS n_words FROM labels l LEFT JOIN documents d USING (doc_id)"
ORACLE["label_embeddings_left"] = f"""
WITH {CORPUS_CTE}
SELECT e.vec_id AS doc_id, c.label, c.group_id, e.label AS emb_label FROM embeddings e
LEFT JOIN corpus c ON c.doc_id = e.vec_id WHERE c.label IS NOT NULL
"""
ORACLE["label_embeddings"] = f"""
WITH {CORPUS_CTE}
SELECT e.vec_id AS doc_id, c.label, c.group_id, e.label AS emb_label FROM embeddings e JOIN corpus c ON c.doc_id = e.vec_id
"""
ORACLE["restrict_to_groups"] = f"""
WITH {CORPUS_CTE}
SELECT doc_id, group_id FROM corpus WHERE group_id IN (SELECT group_id FROM corpus WHERE label = 'b')
"""
ORACLE["attach_metadata"] = f"""
WITH {D_TERMS}, {vocab_cte(100)}, {CORPUS_CTE},
h AS (SELECT doc_id, term, count(*) AS n FROM t JOIN v USING (term) GROUP BY doc_id, term)
SELECT h.doc_id, h.term, round(h.n / len(d.terms), 6) AS rel_freq, c.label, c.group_id
FROM h JOIN d USING (doc_id) LEFT JOIN corpus c ON c.doc_id = h.doc_id
"""
ORACLE["null_safe_join"] = f"""
WITH {CORPUS_CTE}, s AS (SELECT group_id, count(*) AS group_size FROM corpus GROUP BY group_id)
SELECT c.doc_id, c.group_id, s.group_size FROM corpus c JOIN s ON c.group_id IS NOT DISTINCT FROM s.group_id
"""


# --------------------------------------------------------------------------
# Sentiment (N1–N7) and the stylistics table
# --------------------------------------------------------------------------

_COST = "CAST(2 + ceil(length(w) / 4) AS BIGINT)"
_PW = polarity_words()
_LABEL_NORM = ("CASE " + " ".join(f"WHEN lower(trim(label)) IN {lst(v)} THEN {q(k)}"
                                  for k, v in SENTIMENT_LABEL_SYNONYMS.items()) + " END")
SENTI_CTE = f"""
ch AS (SELECT doc_id, sent_id, sentence, regexp_extract_all(sentence, {q(r'\S+')}) AS ws FROM st),
ch1 AS (SELECT doc_id, sent_id, sentence,
               list_reduce(ws, lambda acc, w: CASE WHEN acc.cost_sum + {_COST} > 512
                   THEN {{'done': list_append(acc.done, acc.cur), 'cur': w, 'cost_sum': {_COST}, 'nw': CAST(1 AS BIGINT)}}
                   ELSE {{'done': acc.done, 'cur': CASE WHEN acc.nw = 0 THEN w ELSE acc.cur || ' ' || w END,
                          'cost_sum': acc.cost_sum + {_COST}, 'nw': acc.nw + 1}} END,
                   {{'done': CAST([] AS VARCHAR[]), 'cur': '', 'cost_sum': CAST(0 AS BIGINT), 'nw': CAST(0 AS BIGINT)}}) AS acc
        FROM ch),
ch2 AS (SELECT doc_id, sent_id, sentence,
               list_filter(CASE WHEN acc.nw > 0 THEN list_append(acc.done, acc.cur) ELSE acc.done END, lambda x: x <> '') AS cl
        FROM ch1),
ch3 AS (SELECT doc_id, sent_id, CASE WHEN len(cl) = 1 THEN [sentence] ELSE cl END AS cl FROM ch2),
chunks AS (SELECT doc_id, sent_id, generate_subscripts(cl, 1) - 1 AS chunk_id, unnest(cl) AS chunk FROM ch3),
sc AS (SELECT doc_id, sent_id, chunk_id, regexp_extract_all(lower(chunk), {q(r'[\p{L}\p{N}_]+')}) AS toks FROM chunks),
sc1 AS (SELECT doc_id, sent_id, chunk_id, len(list_filter(toks, lambda w: w IN {lst(_PW['positive'])})) AS p,
               len(list_filter(toks, lambda w: w IN {lst(_PW['negative'])})) AS n FROM sc),
scored AS (SELECT doc_id, sent_id, chunk_id,
                  CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label,
                  CASE WHEN p + n > 0 THEN abs(p - n) / (p + n) ELSE 0.0 END AS score FROM sc1),
signed AS (SELECT doc_id, sent_id, chunk_id, {_LABEL_NORM} AS label_norm,
                  CASE {_LABEL_NORM} WHEN 'positive' THEN score WHEN 'neutral' THEN 0.0 WHEN 'negative' THEN -score END AS signed
           FROM scored),
summ AS (SELECT doc_id, count(signed) AS n_scores,
                CASE WHEN count(signed) > 1 THEN avg(signed) END AS sentiment_mean,
                CASE WHEN count(signed) > 1 THEN stddev_pop(signed) END AS sentiment_std,
                CASE WHEN count(signed) > 1 THEN avg(abs(signed)) END AS sentiment_abs
         FROM signed GROUP BY doc_id)
"""
_S = f"WITH {TOKENS_CTE}, {STYL_CTE}, {SENTI_CTE}"
ORACLE["chunk_words"] = f"{_S} SELECT doc_id, sent_id, chunk_id, chunk FROM chunks"
ORACLE["cap_max_len"] = "SELECT doc_id, n_chars, CASE WHEN n_chars > 2000 THEN 512 ELSE n_chars END AS max_len FROM documents"
ORACLE["subword_words"] = f"""
SELECT word, count(*) AS n, word AS joined FROM (SELECT unnest(regexp_extract_all(text, {q(r'\S+')})) AS word FROM documents) GROUP BY word
"""
ORACLE["chunk_words_subword"] = f"{_S} SELECT doc_id, sent_id, CAST(len(ws) AS BIGINT) AS n_words, true AS within FROM ch WHERE len(ws) > 0"
ORACLE["score_chunks"] = f"{_S} SELECT doc_id, sent_id, chunk_id, label, round(score, 6) AS score FROM scored"


def _walks(steps: int = 6, restart: float = 0.3, window: int = 4, least: int = 5, seeds: int = 40) -> str:
    """CTEs up to lex (word, score): co-occurrence graph, seeds, ``steps`` steps of both walks."""
    word = q(r"[\p{L}\p{N}_]+")
    step = """,
r{n} AS (SELECT word, sum(p) AS p, sum(n) AS n FROM (
    SELECT e.b AS word, {keep} * e.p * r.p AS p, {keep} * e.p * r.n AS n FROM e JOIN r{k} r ON r.word = e.a
    UNION ALL SELECT word, {restart} * p, {restart} * n FROM r0) GROUP BY word)"""
    return f"""
pw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {word}) AS w FROM documents),
pt AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM pw),
kn AS (SELECT w FROM pt GROUP BY w HAVING count(*) >= {least}),
pr AS (SELECT least(x.w, y.w) AS a, greatest(x.w, y.w) AS b, count(*) AS n FROM pt x JOIN pt y ON y.doc_id = x.doc_id AND y.i > x.i AND y.i <= x.i + {window}
       WHERE x.w <> y.w AND x.w IN (SELECT w FROM kn) AND y.w IN (SELECT w FROM kn) GROUP BY ALL),
bp AS (SELECT a, b, n FROM pr UNION ALL SELECT b, a, n FROM pr),
dg AS (SELECT a, sum(n) AS d FROM bp GROUP BY a),
mi AS (SELECT bp.a, bp.b, ln(bp.n * (SELECT sum(d) FROM dg)::DOUBLE / (x.d::DOUBLE * y.d)) AS w FROM bp JOIN dg x ON x.a = bp.a JOIN dg y ON y.a = bp.b),
e AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM mi WHERE w > 1e-12),
lc AS (SELECT CASE quality WHEN 1 THEN 'a' WHEN 0 THEN 'b' END AS label, list_distinct(w) AS ws FROM pw JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
nc AS (SELECT count_if(label = 'a') AS na, count_if(label = 'b') AS nb FROM lc),
gp AS (SELECT word, count_if(label = 'a') * any_value(nb) - count_if(label = 'b') * any_value(na) AS gap FROM (SELECT label, unnest(ws) AS word FROM lc) CROSS JOIN nc GROUP BY word),
sd AS (SELECT * FROM (SELECT word, 1 AS sign FROM gp ORDER BY gap DESC, word LIMIT {seeds}) UNION ALL SELECT * FROM (SELECT word, -1 FROM gp ORDER BY gap, word LIMIT {seeds})),
si AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY sign) AS s FROM (SELECT DISTINCT word, sign FROM sd) WHERE word IN (SELECT a FROM e)),
r0 AS (SELECT word, max(CASE WHEN sign > 0 THEN s ELSE 0 END) AS p, max(CASE WHEN sign < 0 THEN s ELSE 0 END) AS n FROM si GROUP BY word){"".join(step.format(k=k, n=k + 1, keep=1 - restart, restart=restart) for k in range(steps))},
plx AS (SELECT word, (p - n) / (p + n) AS score FROM r{steps} WHERE p + n > 0)"""


ORACLE["induced_lexicon"] = f"WITH {_walks().strip()} SELECT word, round(score, 6) AS score FROM plx"
ORACLE["score_chunks_induced"] = f"""{_S}, {_walks().strip()},
pcw AS (SELECT doc_id, sent_id, chunk_id, unnest(toks) AS word FROM sc),
pch AS (SELECT doc_id, sent_id, chunk_id, avg(score) AS m FROM pcw JOIN plx USING (word) GROUP BY ALL)
SELECT sc.doc_id, sc.sent_id, sc.chunk_id, CASE WHEN m > 1e-9 THEN 'positive' WHEN m < -1e-9 THEN 'negative' ELSE 'neutral' END AS label,
       round(abs(coalesce(m, 0)), 6) AS score FROM sc LEFT JOIN pch USING (doc_id, sent_id, chunk_id)
"""
ORACLE["normalize_sentiment_label"] = f"{_S} SELECT doc_id, sent_id, chunk_id, label_norm FROM signed"
ORACLE["normalize_sentiment_synonyms"] = """
SELECT doc_id, CASE WHEN doc_id % 12 < 3 THEN 'positive' WHEN doc_id % 12 < 6 THEN 'neutral'
                    WHEN doc_id % 12 < 9 THEN 'negative' END AS label_norm FROM documents
"""
ORACLE["signed_score"] = f"{_S} SELECT doc_id, sent_id, chunk_id, round(signed, 6) AS signed FROM signed"
ORACLE["sentiment_entropy"] = f"""{_S},
se AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, chunk_id) AS i, signed AS x, count(*) OVER (PARTITION BY doc_id) AS n,
              0.2 * stddev_pop(signed) OVER (PARTITION BY doc_id) + 1e-9 AS near FROM signed WHERE signed IS NOT NULL),
r1 AS (SELECT *, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM se WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r2 AS (SELECT doc_id, x, y, NULL AS z, any_value(near) AS near, count(*) AS c, 2 AS k FROM r1 WHERE y IS NOT NULL GROUP BY doc_id, x, y
       UNION ALL SELECT doc_id, x, y, z, any_value(near), count(*), 3 FROM r1 WHERE z IS NOT NULL GROUP BY doc_id, x, y, z),
rc AS (SELECT a.doc_id, a.k, a.c, sum(b.c) AS same FROM r2 a JOIN r2 b ON b.doc_id = a.doc_id AND b.k = a.k AND abs(a.x - b.x) <= a.near AND abs(a.y - b.y) <= a.near
              AND (a.k = 2 OR abs(a.z - b.z) <= a.near) GROUP BY a.doc_id, a.k, a.c, a.x, a.y, a.z),
rp AS (SELECT doc_id, k, sum(c * ln(same / total)) / any_value(total) AS phi FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id, k)::DOUBLE AS total FROM rc) GROUP BY doc_id, k)
SELECT d.doc_id, CASE WHEN any_value(n) >= 4 THEN round(sum(CASE k WHEN 2 THEN phi ELSE -phi END), 6) END AS sentiment_entropy
FROM (SELECT DISTINCT doc_id FROM signed) d LEFT JOIN rp USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, n FROM se) USING (doc_id) GROUP BY d.doc_id
"""
ORACLE["sentiment_series"] = f"""{_S}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, chunk_id) - 1 AS pos, round(signed, 6) AS score
FROM signed
"""
ORACLE["sentiment_summary"] = f"""{_S}
SELECT doc_id, n_scores, round(sentiment_mean, 6) AS sentiment_mean, round(sentiment_std, 6) AS sentiment_std,
       round(sentiment_abs, 6) AS sentiment_abs FROM summ
"""
_F23 = ["nominal_verb_ratio", "msttr", "noun_ttr", "verb_ttr", "personal_pronoun_ratio", "function_word_ratio",
        "of_ratio", "that_ratio", "past_tense_ratio", "present_tense_ratio", "passive_ratio", "active_ratio",
        "adjective_adverb_ratio", "avg_wordlen", "avg_sentlen", "avg_ndd", "std_ndd", "avg_mdd", "std_mdd",
        "sentiment_mean", "sentiment_std", "sentiment_abs"]
STYLISTICS_TABLE_SQL = f"""{_S}, {CORPUS_CTE}
SELECT c.doc_id, {", ".join(f"round({c}, 6) AS {c}" for c in _F23)}, s.num_sents, c.group_id, c.label
FROM corpus c LEFT JOIN styl s ON s.doc_id = c.doc_id LEFT JOIN summ ON summ.doc_id = c.doc_id
"""
ORACLE["stylistics_measures"] = ORACLE["stylistics_measures_from_tokens"] = STYLISTICS_TABLE_SQL


# --------------------------------------------------------------------------
# Descriptive statistics
# --------------------------------------------------------------------------

_UNPIVOT = " UNION ALL ".join(
    f"SELECT doc_id, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM dsc" for f in DESC_FEATURES)
DESC_CTE = f"""{TOKENS_CTE}, {STYL_CTE}, {SENTI_CTE}, {CORPUS_CTE},
dsc AS (SELECT s.*, summ.sentiment_mean, summ.sentiment_std, summ.sentiment_abs, c.label
        FROM styl s LEFT JOIN summ USING (doc_id) LEFT JOIN corpus c ON c.doc_id = s.doc_id
        JOIN documents d ON d.doc_id = s.doc_id
        WHERE CASE WHEN d.text IS NULL THEN 1 ELSE {WORDS.replace('text', 'd.text')} END > 100),
lg AS ({_UNPIVOT}),
cs AS (SELECT feature,
              count(CASE WHEN label = 'a' THEN value END) AS n_a, avg(CASE WHEN label = 'a' THEN value END) AS mean_a,
              stddev_samp(CASE WHEN label = 'a' THEN value END) AS std_a, var_samp(CASE WHEN label = 'a' THEN value END) AS var_a,
              count(CASE WHEN label = 'b' THEN value END) AS n_b, avg(CASE WHEN label = 'b' THEN value END) AS mean_b,
              stddev_samp(CASE WHEN label = 'b' THEN value END) AS std_b, var_samp(CASE WHEN label = 'b' THEN value END) AS var_b
       FROM lg WHERE label IN ('a', 'b') GROUP BY feature)
"""
ORACLE["rank_correlation"] = f"""WITH {DESC_CTE},
rv AS (SELECT feature, label, round(value, 9) AS v FROM lg WHERE label IN ('a', 'b') AND value IS NOT NULL),
rr AS (SELECT feature, CASE WHEN label = 'a' THEN 1 ELSE 0 END AS y,
              rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM rv)
SELECT feature, count(*) AS n, CASE WHEN stddev_pop(r) > 0 AND stddev_pop(y) > 0 THEN round(corr(r, y), 6) END AS rho FROM rr GROUP BY feature
"""
ORACLE["mutual_information"] = f"""WITH {DESC_CTE},
rv AS (SELECT feature, label, round(value, 9) AS v FROM lg WHERE label IN ('a', 'b') AND value IS NOT NULL),
rs AS (SELECT *, min(v) OVER (PARTITION BY feature) AS lo, (max(v) OVER (PARTITION BY feature) - min(v) OVER (PARTITION BY feature)) / 10 AS w FROM rv),
rb AS (SELECT feature, label, CASE WHEN w > 0 THEN least(floor((v - lo) / w), 9) ELSE 0 END AS bin, count(*)::DOUBLE AS n FROM rs GROUP BY ALL),
rt AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS c FROM rb)
SELECT feature, round(greatest(sum(n / t * ln(n * t / (b * c))), 0), 6) AS mutual_information FROM rt GROUP BY feature
"""
ORACLE["class_counts"] = f"WITH {CORPUS_CTE} SELECT label, count(*) AS n FROM corpus GROUP BY label"
ORACLE["text_length_by_class"] = f"""
WITH {CORPUS_CTE}, c AS (SELECT label, CASE WHEN text IS NULL THEN 1 ELSE {WORDS} END AS n_words FROM corpus)
SELECT label, count(*) AS n, round(avg(n_words), 6) AS mean_len, round(stddev_samp(n_words), 6) AS std_len
FROM c WHERE n_words > 100 AND label IS NOT NULL GROUP BY label
"""
ORACLE["feature_stats_by_class"] = f"""WITH {DESC_CTE}
SELECT feature, n_a, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, n_b, round(mean_b, 6) AS mean_b,
       round(std_b, 6) AS std_b FROM cs
"""
ORACLE["join_stat_frames"] = f"""WITH {DESC_CTE}
SELECT feature, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(std_a, 6) AS std_a,
       round(std_b, 6) AS std_b FROM cs
"""
ORACLE["pooled_t_test"] = f"""WITH {DESC_CTE}
SELECT feature, round((mean_a - mean_b) / nullif(sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / nullif(n_a + n_b - 2, 0)
                       * (1.0 / n_a + 1.0 / n_b)), 0), 6) AS t_stat,
       CAST(n_a + n_b - 2 AS BIGINT) AS df FROM cs
"""
_DIST = """l2 AS (SELECT lg.* FROM lg JOIN dsc USING (doc_id)
       WHERE lg.value IS NOT NULL AND NOT isnan(lg.value) AND lg.label IS NOT NULL
         AND dsc.avg_sentlen < 100 AND dsc.noun_ttr < 6
         AND NOT (lg.feature = 'nominal_verb_ratio' AND lg.value >= 12)),"""
ORACLE["histogram"] = f"""WITH {DESC_CTE},
{_DIST}
rng AS (SELECT feature, min(value) AS lo_all, max(value) AS hi_all FROM l2 GROUP BY feature),
j AS (SELECT l2.*, rng.lo_all, (rng.hi_all - rng.lo_all) / 10 AS width FROM l2 JOIN rng USING (feature)),
b AS (SELECT feature, label, lo_all, width,
             CAST(CASE WHEN width > 0 THEN least(floor((value - lo_all) / width), 9) ELSE 0 END AS BIGINT) AS bin FROM j),
h AS (SELECT feature, label, bin, lo_all, width, count(*) AS n FROM b GROUP BY ALL)
SELECT feature, label, bin, round(lo_all + bin * width, 6) AS lo, round(lo_all + (bin + 1) * width, 6) AS hi, n,
       round(n / (sum(n) OVER (PARTITION BY feature, label) * nullif(width, 0)), 6) AS density FROM h
"""
ORACLE["histogram_auto"] = f"""WITH {DESC_CTE},
{_DIST}
s AS (SELECT feature, label, min(value) AS lo_all, max(value) - min(value) AS span, count(*) AS n,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM l2 GROUP BY feature, label),
r AS (SELECT *, least(CASE WHEN iqr > 0 THEN 2 * iqr / cbrt(n) END, span / (log2(n) + 1)) AS rule FROM s),
e AS (SELECT *, CASE WHEN span > 0 THEN ceil(round(span / rule, 9)) ELSE 1 END AS bins FROM r),
j AS (SELECT l2.feature, l2.label, e.lo_all, e.span / e.bins AS width,
             CAST(CASE WHEN span > 0 THEN least(floor((value - lo_all) / (span / bins)), bins - 1) ELSE 0 END AS BIGINT) AS bin
      FROM l2 JOIN e USING (feature, label)),
h AS (SELECT feature, label, bin, lo_all, width, count(*) AS n FROM j GROUP BY ALL)
SELECT feature, label, bin, round(lo_all + bin * width, 6) AS lo, round(lo_all + (bin + 1) * width, 6) AS hi, n,
       round(n / (sum(n) OVER (PARTITION BY feature, label) * nullif(width, 0)), 6) AS density FROM h
"""
ORACLE["kde"] = f"""WITH {DESC_CTE},
{_DIST}
rng AS (SELECT feature, min(value) AS lo_all, max(value) AS hi_all FROM l2 GROUP BY feature),
j AS (SELECT l2.*, rng.lo_all, rng.hi_all, (rng.hi_all - rng.lo_all) / 256 AS fw FROM l2 JOIN rng USING (feature)),
pl AS (SELECT *, CASE WHEN fw > 0 THEN (value - lo_all) / fw ELSE 0.0 END AS place FROM j),
pk AS (SELECT *, CAST(least(floor(place), 255) AS BIGINT) AS k FROM pl),
nodes AS (SELECT feature, label, lo_all, hi_all, fw, k AS fbin, 1 - (place - k) AS w FROM pk
          UNION ALL SELECT feature, label, lo_all, hi_all, fw, k + 1, place - k FROM pk),
binned AS (SELECT feature, label, fbin, lo_all, hi_all, fw, sum(w) AS cnt FROM nodes GROUP BY ALL),
kst AS (SELECT feature, label, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS bw FROM l2 GROUP BY ALL),
bs AS (SELECT b.*, kst.n, kst.bw, b.lo_all + b.fbin * b.fw AS c, (b.hi_all - b.lo_all) / 63 AS step
       FROM binned b JOIN kst USING (feature, label) WHERE kst.bw > 0),
ex AS (SELECT bs.*, g.g FROM bs, range(0, 64) AS g(g))
SELECT feature, label, g, round(lo_all + g * step, 6) AS x,
       round(sum(cnt * exp(-0.5 * pow((lo_all + g * step - c) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM ex GROUP BY feature, label, g, n, bw, lo_all, step
"""
ORACLE["describe_numeric"] = f"""WITH {DESC_CTE},
l2 AS (SELECT feature, CASE WHEN NOT isnan(value) THEN value END AS value FROM lg)
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM l2 GROUP BY feature
"""
ORACLE["describe_categorical"] = f"""WITH {CORPUS_CTE},
lg AS (SELECT 'lang' AS "column", lang AS value FROM corpus UNION ALL SELECT 'source', source FROM corpus
       UNION ALL SELECT 'label', label FROM corpus UNION ALL SELECT 'group_id', group_id FROM corpus),
vc AS (SELECT "column", value, count(*) AS n FROM lg WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM vc GROUP BY "column"
"""


# --------------------------------------------------------------------------
# Splits (B1–B7) and evaluation
# --------------------------------------------------------------------------

#: The balancing solver over distinct class counts (classes a and b, five folds): batches of equal groups, each to the best fold.
_BATCH = "CASE WHEN {0} < 20 THEN 1 ELSE CAST(1 << CAST(floor(log2({0} // 10)) AS BIGINT) AS BIGINT) END"


def _solver(rows: str) -> str:
    """CTEs from ``rows`` (group_id, label) to gf (group_id, fold)."""
    def spread(f, v, t):
        return (f"list_aggregate(list_transform(range(1, 6), lambda j: (st.{f}[j] + CASE WHEN i = j THEN s.{v} ELSE 0 END) / s.{t}::DOUBLE), 'stddev_pop')")

    def joined(f, v):
        return f"list_transform(range(1, 6), lambda j: st.{f}[j] + CASE WHEN j = best THEN st.{v} ELSE 0 END)"

    return f"""
gv AS (SELECT group_id, count_if(label = 'a') AS va, count_if(label = 'b') AS vb FROM {rows} GROUP BY group_id),
tot AS (SELECT CAST(greatest(sum(va), 1) AS BIGINT) AS ta, CAST(greatest(sum(vb), 1) AS BIGINT) AS tb FROM gv),
vec AS (SELECT va, vb, count(*) AS m, row_number() OVER (ORDER BY 2 * (va * va + vb * vb) - (va + vb) * (va + vb) DESC, va + vb DESC, va, vb) AS vid FROM gv GROUP BY va, vb),
bt AS (SELECT vid, m AS rem, 1 AS o FROM vec UNION ALL SELECT vid, rem - {_BATCH.format('rem')}, o + 1 FROM bt WHERE rem > {_BATCH.format('rem')}),
steps AS (SELECT row_number() OVER (ORDER BY vid, o) AS n, vid, va * b AS va, vb * b AS vb, b, ta, tb
          FROM (SELECT vid, o, {_BATCH.format('rem')} AS b FROM bt) JOIN vec USING (vid) CROSS JOIN tot),
sol AS (SELECT CAST(0 AS BIGINT) AS n, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS fa, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS fb, CAST(0 AS BIGINT) AS best
        UNION ALL
        SELECT n, {joined('fa', 'va')}, {joined('fb', 'vb')}, best FROM (
            SELECT s.n, st.fa, st.fb, s.va, s.vb, list_min(list_transform(range(1, 6), lambda i: (
                       round(({spread('fa', 'va', 'ta')} + {spread('fb', 'vb', 'tb')}) / 2, 12), st.fa[i] + st.fb[i], i)))[3] AS best
            FROM sol st JOIN steps s ON s.n = st.n + 1) st),
given AS (SELECT vid, best - 1 AS fold, sum(b) AS c FROM sol JOIN steps USING (n) GROUP BY vid, best),
upto AS (SELECT vid, fold, sum(c) OVER (PARTITION BY vid ORDER BY fold) AS last, sum(c) OVER (PARTITION BY vid ORDER BY fold) - c AS first FROM given),
rk AS (SELECT group_id, vid, row_number() OVER (PARTITION BY vid ORDER BY md5(group_id || '-group-42')) AS r FROM gv JOIN vec USING (va, vb)),
gf AS (SELECT group_id, fold FROM rk JOIN upto ON upto.vid = rk.vid AND r > first AND r <= last),
"""


SPLITS_CTE = f"""{CORPUS_CTE},
c0 AS (SELECT doc_id, regexp_replace(group_id, '_[a-z]$', '') AS group_id, label FROM corpus WHERE label IS NOT NULL),
bal AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'))
        <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c0 GROUP BY label))),
sgr AS (SELECT doc_id, coalesce(group_id, 'noid_' || doc_id) AS group_id, label FROM bal),{_solver("sgr")}folds AS (SELECT sgr.doc_id, sgr.group_id, sgr.label, gf.fold FROM sgr JOIN gf USING (group_id)),
preds AS (SELECT f.fold, f.doc_id, f.label, CASE WHEN l.toxic = 1 THEN 'b' ELSE 'a' END AS prediction
          FROM folds f JOIN labels l USING (doc_id))
"""
ORACLE["balance_classes"] = f"WITH RECURSIVE {SPLITS_CTE} SELECT doc_id, label FROM bal"
ORACLE["shuffle"] = f"WITH RECURSIVE {SPLITS_CTE} SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '-shuffle-42') AS shuffle_key FROM c0"
ORACLE["stratified_group_folds"] = f"WITH RECURSIVE {SPLITS_CTE} SELECT doc_id, group_id, label, fold FROM folds"
ORACLE["snake_group_folds"] = f"""WITH RECURSIVE {SPLITS_CTE},
per AS (SELECT group_id, label, count(*) AS n FROM sgr GROUP BY ALL),
grp AS (SELECT group_id, sum(n) AS size, arg_min(label, (-n, label)) AS stratum FROM per GROUP BY group_id),
sr AS (SELECT group_id, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5(group_id || '-group-42')) - 1 AS r FROM grp)
SELECT doc_id, group_id, label, CAST(CASE WHEN floor(r / 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS BIGINT) AS fold FROM sgr JOIN sr USING (group_id)
"""
ORACLE["fold_balance_skewed"] = f"""WITH RECURSIVE {SPLITS_CTE.replace("sgr AS (SELECT doc_id, coalesce(group_id, 'noid_' || doc_id) AS group_id, label FROM bal)", "sgr AS (SELECT doc_id, coalesce(group_id, 'noid_' || doc_id) AS group_id, label FROM c0)")},
t AS (SELECT fold, label, count(*) AS n_test FROM folds GROUP BY ALL)
SELECT fold, label, n_test, CAST(sum(n_test) OVER (PARTITION BY label) - n_test AS BIGINT) AS n_train FROM t
"""
ORACLE["fold_balance"] = f"""WITH RECURSIVE {SPLITS_CTE}, t AS (SELECT fold, label, count(*) AS n_test FROM folds GROUP BY ALL)
SELECT fold, label, n_test, CAST(sum(n_test) OVER (PARTITION BY label) - n_test AS BIGINT) AS n_train FROM t
"""
ORACLE["sample_groups"] = f"""WITH {CORPUS_CTE},
c AS (SELECT doc_id, regexp_replace(group_id, '_[a-z]$', '') AS group_id FROM corpus),
ids AS (SELECT group_id FROM (SELECT DISTINCT group_id FROM c WHERE group_id IS NOT NULL)
        ORDER BY md5(group_id || '-sample-42') LIMIT 5)
SELECT doc_id, group_id FROM c WHERE group_id IN (SELECT group_id FROM ids)
"""
ORACLE["concat_classes"] = f"WITH RECURSIVE {SPLITS_CTE} SELECT doc_id, label FROM c0 WHERE label IN ('a', 'b')"
ORACLE["distinct_groups"] = f"WITH {CORPUS_CTE} SELECT count(DISTINCT group_id) AS n_groups FROM corpus"
ORACLE["accuracy"] = f"""WITH RECURSIVE {SPLITS_CTE}
SELECT fold, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM preds GROUP BY fold
"""
CLASS_REPORT_CTE = f"""{SPLITS_CTE},
conf AS (SELECT fold, label, prediction, count(*) AS n FROM preds GROUP BY ALL),
parts AS (SELECT fold, label AS cls, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, n AS n_true, 0 AS n_pred FROM conf
          UNION ALL SELECT fold, prediction, 0, 0, n FROM conf),
perc AS (SELECT fold, cls, sum(tp) AS tp, sum(n_true) AS support, sum(n_pred) AS n_pred FROM parts GROUP BY ALL),
rep AS (SELECT fold, cls AS class, coalesce(tp / nullif(n_pred, 0), 0.0) AS precision,
               coalesce(tp / nullif(support, 0), 0.0) AS recall, CAST(support AS BIGINT) AS support FROM perc),
rep2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM rep)
"""
ORACLE["class_report"] = f"""WITH RECURSIVE {CLASS_REPORT_CTE}
SELECT fold, class, round(precision, 6) AS precision, round(recall, 6) AS recall, support, round(f1, 6) AS f1 FROM rep2
"""
ORACLE["cv_summary"] = f"""WITH RECURSIVE {CLASS_REPORT_CTE},
acc AS (SELECT fold, 'accuracy' AS metric, CAST(NULL AS VARCHAR) AS class,
               avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM preds GROUP BY fold),
lg AS (SELECT fold, 'precision' AS metric, class, precision AS value FROM rep2
       UNION ALL SELECT fold, 'recall', class, recall FROM rep2 UNION ALL SELECT fold, 'f1', class, f1 FROM rep2
       UNION ALL SELECT * FROM acc)
SELECT metric, class, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n_folds
FROM lg GROUP BY metric, class
"""
ORACLE["contingency"] = "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source"


def _ari_sql(src: str, u: str, v: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    return f"""
c AS (SELECT {g}{u} AS u, {v} AS v, count(*) AS n FROM {src} GROUP BY ALL),
s AS (SELECT {g}CAST(sum(n) AS DOUBLE) AS N, CAST(sum(n * n) AS DOUBLE) AS S FROM c {gb}),
a AS (SELECT {g}CAST(sum(x * x) AS DOUBLE) AS A FROM (SELECT {g}sum(n) AS x FROM c GROUP BY {g}u) {gb}),
b AS (SELECT {g}CAST(sum(x * x) AS DOUBLE) AS B FROM (SELECT {g}sum(n) AS x FROM c GROUP BY {g}v) {gb}),
t AS (SELECT {g}S - N AS tp, B - S AS fp, A - S AS fn, N * N - A - B + S AS tn FROM s JOIN a {j} JOIN b {j}),
ari AS (SELECT {g}CASE WHEN fn = 0 AND fp = 0 THEN 1.0
                  ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari FROM t),
rows_ AS (SELECT {g}u, sum(n) AS a FROM c GROUP BY {g}u),
cols_ AS (SELECT {g}v, sum(n) AS b FROM c GROUP BY {g}v),
tot AS (SELECT {g}sum(n) AS nt FROM c {gb}),
mi AS (SELECT {g}sum(n / nt * ln(nt * n / (a * b))) AS mi FROM c JOIN rows_ USING ({g}u) JOIN cols_ USING ({g}v)
       JOIN tot {j} {gb}),
hu AS (SELECT {g}-sum(a / nt * ln(a / nt)) AS hu FROM rows_ JOIN tot {j} {gb}),
hv AS (SELECT {g}-sum(b / nt * ln(b / nt)) AS hv FROM cols_ JOIN tot {j} {gb}),
hc AS (SELECT {g}CASE WHEN hu > 0 THEN mi / hu ELSE 1.0 END AS homogeneity,
              CASE WHEN hv > 0 THEN mi / hv ELSE 1.0 END AS completeness FROM mi JOIN hu {j} JOIN hv {j}),
vm AS (SELECT *, CASE WHEN homogeneity + completeness > 0
                      THEN 2.0 * homogeneity * completeness / (homogeneity + completeness) ELSE 0.0 END AS v_measure FROM hc),
cnt AS (SELECT {g}count(DISTINCT {v}) AS n_clusters, count(DISTINCT {u}) AS n_groups FROM {src} {gb})
"""


ORACLE["adjusted_rand_index"] = f"""WITH {_ari_sql('documents', 'lang', 'source')}
SELECT round(ari, 6) AS ari, round(ari, 3) AS ari_rounded FROM ari
"""
ORACLE["v_measure"] = f"""WITH {_ari_sql('documents', 'lang', 'source')}
SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness,
       round(v_measure, 6) AS v_measure, round(v_measure, 3) AS v_rounded FROM vm
"""
ORACLE["cluster_count_check"] = """
WITH e AS (SELECT label, list_position(embedding, list_max(embedding)) AS cluster FROM embeddings)
SELECT count(DISTINCT cluster) AS n_clusters, count(DISTINCT label) AS n_groups,
       count(DISTINCT cluster) = count(DISTINCT label) AS same FROM e
"""
_MODELS = """
ms AS (SELECT * FROM (VALUES ('m0', 1), ('m1', 17), ('m2', 33), ('m3', 49)) AS m(model, start)),
asg AS (SELECT ms.model, e.vec_id AS doc_id, e.label AS emb_label,
               list_position(e.embedding[ms.start:ms.start + 15], list_max(e.embedding[ms.start:ms.start + 15])) AS cluster
        FROM embeddings e, ms)
"""
ORACLE["compare_embeddings"] = f"""WITH {_MODELS}, {_ari_sql('asg', 'emb_label', 'cluster', 'model')}
SELECT model, round(ari, 6) AS ari, round(ari, 3) AS ari_rounded, round(homogeneity, 6) AS homogeneity,
       round(completeness, 6) AS completeness, round(v_measure, 6) AS v_measure, round(v_measure, 3) AS v_rounded,
       n_clusters, n_groups, n_clusters = n_groups AS same
FROM ari JOIN vm USING (model) JOIN cnt USING (model)
"""


# --------------------------------------------------------------------------
# Sources and sinks (S1–S8): round trips compared with the direct computation
# --------------------------------------------------------------------------

ORACLE["read_corpus"] = f"WITH {CORPUS_CTE} SELECT doc_id, text, label, group_id FROM corpus"
_SENT_LENS = f"""
sl AS (SELECT doc_id, {_SENTS} AS ss
       FROM documents),
ln AS (SELECT doc_id, CASE WHEN len(ss) > 0 THEN to_json(list_transform(ss, lambda s: length(s)))::VARCHAR END AS sent_lengths
       FROM sl)
"""
ORACLE["write_tsv"] = f"""WITH {_SENT_LENS}
SELECT d.doc_id, d.lang, d.n_chars, ln.sent_lengths FROM documents d LEFT JOIN ln USING (doc_id)
"""
ORACLE["read_features_tsv"] = "SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang"
ORACLE["write_tokens"] = f"WITH {TOKENS_CTE} SELECT doc_id, sent_id, token_i, token_text FROM tokens"
ORACLE["read_tokens"] = f"""WITH {TOKENS_CTE}
SELECT doc_id, count(*) AS n_tokens, max(sent_id) AS last_sent FROM tokens GROUP BY doc_id
"""
ORACLE["read_embeddings"] = """
SELECT vec_id AS doc_id, CAST(len(embedding) AS BIGINT) AS dim, label AS emb_label,
       round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0), 6) AS total
FROM embeddings
"""
ORACLE["write_embeddings"] = f"""WITH {CORPUS_CTE}
SELECT e.vec_id AS doc_id, c.label, CAST(len(e.embedding) AS BIGINT) AS dim FROM embeddings e
JOIN corpus c ON c.doc_id = e.vec_id WHERE c.label IS NOT NULL
"""
ORACLE["read_embedding_sets"] = """
WITH ms AS (SELECT * FROM (VALUES ('m0', 1), ('m1', 17), ('m2', 33), ('m3', 49)) AS m(model, start))
SELECT ms.model, e.vec_id AS doc_id, CAST(len(e.embedding[ms.start:ms.start + 15]) AS BIGINT) AS dim,
       round(list_reduce(list_transform(e.embedding[ms.start:ms.start + 15], lambda x: CAST(x AS DOUBLE)),
                         lambda a, b: a + b, 0.0), 6) AS total
FROM embeddings e, ms
"""
ORACLE["append_run_results"] = """
SELECT r.run_id, lang, count(*) AS n_docs FROM documents, (VALUES ('run-1'), ('run-2')) AS r(run_id) GROUP BY r.run_id, lang
"""


# --------------------------------------------------------------------------
# Jobs with fitted models: the rows they must cover and what must hold for them
# --------------------------------------------------------------------------

_M1 = [c for c in _F23 if c in CLASSIFY_STYLISTICS]
_M1_LONG = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM rowsm" for f in _M1)
ORACLE["feature_vector_measures"] = f"""WITH RECURSIVE {TOKENS_CTE}, {STYL_CTE}, {SENTI_CTE}, {SPLITS_CTE},
rowsm AS (SELECT bal.doc_id, {", ".join(_M1)} FROM bal LEFT JOIN styl USING (doc_id) LEFT JOIN summ USING (doc_id)),
lgm AS ({_M1_LONG}),
med AS (SELECT feature, coalesce(quantile_cont(value, 0.5), 0) AS m FROM lgm GROUP BY feature)
SELECT doc_id, feature, round(coalesce(value, m), 6) AS value FROM lgm JOIN med USING (feature)
"""
ORACLE["kmeans_by_truth"] = f"WITH {_MODELS} SELECT model, doc_id, emb_label, true AS nearest, true AS within_k FROM asg"
ORACLE["cluster_scores"] = f"""WITH {_MODELS}
SELECT model, count(DISTINCT emb_label) AS n_groups, true AS within_k, true AS in_bounds FROM asg GROUP BY model
"""
_SAMPLE = "g AS (SELECT label FROM (SELECT DISTINCT label FROM embeddings) ORDER BY md5(CAST(label AS VARCHAR) || '-sample-42') LIMIT 100)"
ORACLE["project_2d"] = f"""
WITH {_SAMPLE} SELECT vec_id AS doc_id, label AS emb_label, true AS more_near_than_pca, true AS placed FROM embeddings WHERE label IN (SELECT label FROM g)
"""
ORACLE["project_pca"] = f"""
WITH {_SAMPLE} SELECT vec_id AS doc_id, label AS emb_label, true AS ordered, true AS placed FROM embeddings WHERE label IN (SELECT label FROM g)
"""
#: All pairs: the graph finds every neighbour as long as one block holds all points.
ORACLE["neighbour_graph"] = f"""
WITH {_SAMPLE},
v AS (SELECT vec_id AS doc_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings WHERE label IN (SELECT label FROM g)),
u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v),
d AS (SELECT a.doc_id, greatest(1 - list_dot_product(a.u, b.u), 0) AS d FROM u a JOIN u b ON a.doc_id <> b.doc_id),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS rank, d FROM d)
SELECT doc_id, rank, round(d, 6) AS distance FROM r WHERE rank <= 15
"""


def _cv_rows(condition: str = "") -> str:
    cte = SPLITS_CTE.replace("FROM corpus WHERE label IS NOT NULL)", f"FROM corpus WHERE label IS NOT NULL{condition})")
    return f"""WITH RECURSIVE {cte}
SELECT 'accuracy' AS metric, CAST(NULL AS VARCHAR) AS class, count(DISTINCT fold) AS n_folds, true AS in_bounds FROM folds
UNION ALL SELECT m.metric, label, count(DISTINCT fold), true FROM folds, (VALUES ('precision'), ('recall'), ('f1')) AS m(metric)
GROUP BY m.metric, label
"""


_LONG_TEXT, _HAS_VECTOR = f" AND {WORDS} >= 100", " AND doc_id IN (SELECT vec_id FROM embeddings)"
for _fs in ("stylistics", "mfw_100", "mfw_500", "tfidf_5000", "embeddings"):
    _vec = _HAS_VECTOR if _fs == "embeddings" else ""
    ORACLE[f"classify_{_fs}"] = ORACLE[f"classify_{_fs}_train_vocab"] = _cv_rows(_vec)
    ORACLE[f"classify_{_fs}_min100"] = _cv_rows(_LONG_TEXT + _vec)

ORACLE["feature_tables"] = f"""WITH {TOKENS_CTE}, {STYL_CTE}, {CORPUS_CTE}, {D_TERMS},
tot AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS rank FROM t GROUP BY term),
cnt AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term),
hit AS (SELECT cnt.doc_id, cnt.term, n, rank, n / len(d.terms) AS rate FROM cnt JOIN tot USING (term) JOIN d USING (doc_id) WHERE rank <= 5000),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM hit GROUP BY term),
w AS (SELECT doc_id, n * idf AS w FROM hit JOIN idf USING (term)),
wn AS (SELECT w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT 'mfw_100' AS "table", count(*) AS n_rows, round(sum(rate), 4) AS total FROM hit WHERE rank <= 100
UNION ALL SELECT 'mfw_500', count(*), round(sum(rate), 4) FROM hit WHERE rank <= 500
UNION ALL SELECT 'tfidf_5000', count(*), round(sum(weight), 4) FROM wn
UNION ALL SELECT 'stylistics', count(*), round(sum(msttr), 4) FROM corpus LEFT JOIN styl USING (doc_id)
UNION ALL SELECT 'embeddings', count(*), round(sum(CAST(e.embedding[1] AS DOUBLE)), 4) FROM embeddings e JOIN corpus c ON c.doc_id = e.vec_id
          WHERE c.label IS NOT NULL
"""
_PROFILE = [*[c for c in _F23], "num_sents"]
_PROFILE_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM allrows" for f in _PROFILE)
ORACLE["feature_profile_measures"] = f"""{_S}, {CORPUS_CTE},
allrows AS (SELECT s.*, summ.sentiment_mean, summ.sentiment_std, summ.sentiment_abs FROM corpus c
            LEFT JOIN styl s ON s.doc_id = c.doc_id LEFT JOIN summ ON summ.doc_id = c.doc_id),
lgp AS ({_PROFILE_LONG})
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max, count(*) - count(value) AS n_null
FROM lgp GROUP BY feature
"""
ORACLE["compression_bytes"] = f"""
WITH {TOKENS_CTE}, {STYL_CTE},
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS rn,
              count(*) OVER (PARTITION BY doc_id) AS n FROM st)
SELECT doc_id, CAST(strlen(string_agg(sentence, ' ' ORDER BY sent_id)) AS BIGINT) AS n_bytes, true AS has_ratio FROM rk
WHERE CASE WHEN n > 50 THEN rn > 10 AND rn <= 50 ELSE rn <= 40 END GROUP BY doc_id
"""

# two-sided p: the tail of cos(x) ** (df - 1) above atan(t / sqrt(df)) over its whole, by Simpson's rule on
# 2000 steps each (the tail is cut where it has vanished)
_TT = f"""{DESC_CTE},
tt AS (SELECT *, (mean_a - mean_b) / nullif(sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / nullif(n_a + n_b - 2, 0)
                       * (1.0 / n_a + 1.0 / n_b)), 0) AS t_stat, CAST(n_a + n_b - 2 AS BIGINT) AS df FROM cs),
ends AS (SELECT feature, df, atan(abs(t_stat) / sqrt(df)) AS lo FROM tt WHERE t_stat IS NOT NULL AND df > 0),
parts AS (SELECT feature, df, 'tail' AS part, lo, least(lo + 14 / sqrt(df), pi() / 2) AS hi FROM ends
          UNION ALL SELECT feature, df, 'whole', 0.0, least(14 / sqrt(df), pi() / 2) FROM ends),
pts AS (SELECT feature, part, (hi - lo) / 2000 AS h, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w,
               pow(greatest(cos(lo + i * (hi - lo) / 2000), 0), df - 1) AS y FROM parts, range(0, 2001) AS r(i)),
area AS (SELECT feature, part, sum(w * y) * max(h) / 3 AS a FROM pts GROUP BY feature, part),
pv AS (SELECT feature, max(CASE WHEN part = 'tail' THEN a END) / max(CASE WHEN part = 'whole' THEN a END) AS p FROM area GROUP BY feature)"""
ORACLE["t_test_p_values"] = f"""WITH {_TT}
SELECT tt.feature, round(t_stat, 6) AS t_stat, df, round(p, 6) AS p_value FROM tt LEFT JOIN pv USING (feature)
"""
ORACLE["class_comparison_measures"] = f"""WITH {_TT}
SELECT tt.feature, n_a, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, n_b, round(mean_b, 6) AS mean_b,
       round(std_b, 6) AS std_b, round(t_stat, 6) AS t_stat, df, round(p, 6) AS p_value FROM tt LEFT JOIN pv USING (feature)
"""
