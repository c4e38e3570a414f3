"""Baseline part-of-speech tagger as Spark SQL expressions.

The tagger runs inside the annotator's higher-order functions (one projection
per document). The expression is generated as Spark SQL text from the fixed
tables in ``lexicon`` and handed to ``F.expr`` once: building the same tree
through the Column API costs thousands of Py4J round trips per query plan.

Stages per sentence (each binds what the next one reads more than once):
0. token texts;
1. their lower-case forms;
2. one number per token, its place in ``tag_values``: punctuation or number, else the entry
   of the closed classes in its language, else by capitalisation, else the first
   matching suffix rule, default NOUN. The language is looked at once per sentence;
3. the token's struct, its values read from literal arrays at that number, and the root.
   What a stage hands on is copied value by value, so strings that a number can stand for come last.

This is a structural baseline (closed-class lexicon + suffix rules), not a
statistical tagger; measures computed from it are exact for the token table it
produces, not linguistically validated.
"""

from __future__ import annotations

from .lexicon import NOUN_CAPITALISING_LANGS, lexicon_rows, suffix_rules
from .text import NUMBER_RE, WORD_CHAR_RE


def sql_str(s: str | None) -> str:
    """Spark SQL string literal (backslash escapes on, the default parser mode)."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t") + "'"


def sql_list(items) -> str:
    return "(" + ", ".join(sql_str(x) for x in items) + ")"


def tag_values() -> list[tuple[str, str | None, str | None]]:
    """(pos, morph, lemma) by number, from 1: punctuation, number, noun, proper noun, the suffix rules, the lexicon's entries.

    A null lemma stands for the lower-case form.
    """
    return ([("PUNCT", None, None), ("NUM", None, None), ("NOUN", None, None), ("PROPN", None, None)]
            + [(pos, morph, None) for _lang, _suf, pos, morph in suffix_rules()]
            + [(pos, morph, lemma) for _lang, _form, pos, lemma, morph in lexicon_rows()])


def number_sql(lang: str | None, token: str, low: str, j: str) -> str:
    """The number in ``tag_values`` of a token of this language (None: one without lexicon and rules)."""
    rules = [(i, suf) for i, (rl, suf, _pos, _morph) in enumerate(suffix_rules(), start=5) if rl == lang]
    entries = [(i, form) for i, (ll, form, *_rest) in enumerate(lexicon_rows(), start=5 + len(suffix_rules())) if ll == lang]
    # an upper-case first character differs from its lower-case form, so the whole token does
    cap = f"{token} <> {low} AND substring({token}, 1, 1) <> lower(substring({token}, 1, 1))"
    whens = [f"WHEN NOT ({token} RLIKE {sql_str(WORD_CHAR_RE)}) THEN 1", f"WHEN {token} RLIKE {sql_str(NUMBER_RE)} THEN 2"]
    if entries:
        numbers = ", ".join(f"{sql_str(form)}, {i}" for i, form in entries)
        whens.append(f"WHEN {low} IN {sql_list(form for _, form in entries)} THEN try_element_at(map({numbers}), {low})")
    whens.append(f"WHEN {cap} THEN 3" if lang in NOUN_CAPITALISING_LANGS else f"WHEN {j} > 0 AND {cap} THEN 4")
    whens += [f"WHEN endswith({low}, {sql_str(suf)}) AND length({low}) >= {len(suf) + 2} THEN {i}" for i, suf in rules]
    return f"CASE {' '.join(whens)} ELSE 3 END"


def tagged_sentences_sql(lang: str, sentences: str, token_re: str) -> str:
    """array<struct<toks: array<tagged token>, r: root index>> for an array of sentence strings."""
    values = tag_values()
    first_entry = 5 + len(suffix_rules())
    s0 = f"transform({sentences}, s -> regexp_extract_all(s, {sql_str(token_re)}, 0))"
    s1 = f"transform({s0}, a0 -> named_struct('t', a0, 'l', transform(a0, t -> lower(t))))"

    def numbers(of: str | None) -> str:
        return f"transform(a1.l, (l, j) -> {number_sql(of, 'a1.t[j]', 'l', 'j')})"

    langs = dict.fromkeys([*(r[0] for r in lexicon_rows()), *(r[0] for r in suffix_rules()), *NOUN_CAPITALISING_LANGS])
    k = f"CASE {' '.join(f'WHEN {lang} = {sql_str(x)} THEN {numbers(x)}' for x in langs)} ELSE {numbers(None)} END"
    s2 = f"transform({s1}, a1 -> named_struct('t', a1.t, 'l', a1.l, 'k', {k}))"
    pos, morph, lemma = ("array(" + ", ".join(sql_str(v[i]) for v in values) + ")" for i in range(3))
    tok = (f"named_struct('text', a2.t[j], 'j', j, 'lemma', CASE WHEN k >= {first_entry} THEN {lemma}[k - 1] ELSE a2.l[j] END, "
           f"'pos', {pos}[k - 1], 'morph', {morph}[k - 1], 'is_stop', k >= {first_entry}, 'is_punct', k = 1)")
    verbs = ", ".join(str(i) for i, v in enumerate(values, start=1) if v[0] == "VERB")
    # root: first VERB, else first non-punctuation token, else the first token (0-based)
    root = (f"CAST(coalesce(nullif(array_position(transform(a2.k, z -> z IN ({verbs})), true), 0), "
            "nullif(array_position(transform(a2.k, z -> z <> 1), true), 0), 1) - 1 AS INT)")
    return f"transform({s2}, a2 -> named_struct('toks', transform(a2.k, (k, j) -> {tok}), 'r', {root}))"
