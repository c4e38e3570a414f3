"""DuckDB SQL for the operators' queries that SQL can express (written apart from the operators)."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of an id as text: bit by bit over its bytes (digits).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""

_EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""

#: The targets are least(2 x source, level x weight): the level is the one at which they add up.
_MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST(rn % 3 AS INTEGER) + 1]::DOUBLE AS w, 2.0::DOUBLE * s AS cap FROM src),
o AS (SELECT *, cap / w AS own,
             (1.5 * sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lv AS (SELECT min(own) FILTER (own >= level) AS at_own FROM o),
lvl AS (SELECT coalesce(max(level), 1e300) AS level FROM o, lv WHERE own = at_own),
t AS (SELECT o.source, s, least(cap, lvl.level * w) AS target FROM o, lvl),
q AS (SELECT *, CAST(least(round(target), 2 * s) AS BIGINT) AS quota FROM t),
p AS (SELECT *, CASE WHEN s > 0 THEN quota // s ELSE 0 END AS passes FROM q),
b AS (SELECT d.*, p.s, p.target, p.passes, p.quota - p.passes * p.s AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('7-' || d.doc_id), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, round(target, 6) AS target,
       CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM b
"""

#: Every rule of the cascade as one condition; the order in which they are applied can't matter.
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls,
             length(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(regexp_extract_all(text, '[!?]')) AS bangs, len(regexp_extract_all(text, '[0-9]')) AS digits,
             len(regexp_extract_all(text, '[A-ZÀ-Þ]')) AS capitals FROM d),
u AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM m),
l AS (SELECT *, {_LOWER.format('w')} AS lw FROM u),
g AS (SELECT *, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN [w, lead(w) OVER o, lead(w, 2) OVER o] END AS g,
             CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN [lw, lead(lw) OVER o, lead(lw, 2) OVER o] END AS lg
      FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT *, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS f,
             CASE WHEN lg IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, lg) > 1 THEN 1 ELSE 0 END AS lf FROM g),
n AS (SELECT doc_id, lw, max(f) OVER o AS inside, max(lf) OVER o AS linside FROM f
      WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
r AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS rep, CAST(sum(linside) AS BIGINT) AS lrep, count(DISTINCT lw) AS types FROM n GROUP BY doc_id),
a AS (SELECT m.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
             len(ls) AS lines, bangs, digits, capitals, coalesce(lrep, 0) AS lrep, coalesce(types, 0) AS types FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols / greatest(n_words, 1) <= 0.15 AND bangs / greatest(n_words, 1) <= 0.4
       AND capitals / greatest(word_chars, 1) <= 0.4 AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15
       AND digits / greatest(word_chars, 1) <= 0.3 AND 100 * lrep <= 50 * n_words
       AND NOT (n_dup_lines > 2 AND n_dup_lines / greatest(lines, 1) > 0.3) AND types >= 0.1 * least(n_words, 1000) AS kept FROM b
"""

_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_.y, r.root FROM r JOIN both_ ON both_.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def _discounts(counts: str, name: str) -> str:
    """CTE <name>(r, d): Good-Turing discounts for r = 1 .. 5 from the counts in the column c of ``counts``."""
    return f"""
{name}_n AS (SELECT r, (SELECT count(*) FROM {counts} WHERE c = r)::DOUBLE AS n FROM range(1, 7) AS x(r)),
{name}_w AS (SELECT r, n, lead(n) OVER (ORDER BY r) AS n2, 6 * max(CASE WHEN r = 6 THEN n END) OVER () / nullif(max(CASE WHEN r = 1 THEN n END) OVER (), 0) AS rest FROM {name}_n),
{name}_g AS (SELECT r, CASE WHEN rest < 1 AND n > 0 THEN ((r + 1) * n2 / (r * n) - rest) / (1 - rest) ELSE 0 END AS g FROM {name}_w WHERE r <= 5),
{name} AS (SELECT r, CASE WHEN g > 0 AND g < 1 THEN g ELSE (r - 0.5) / r END::DOUBLE AS d FROM {name}_g)"""


#: All words are in the vocabulary as long as there are no more than 2**19 of them, as at the sizes this SQL is for.
_KATZ = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out,
                  list_append(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}'), '') AS ts FROM documents),
t AS (SELECT doc_id, held_out, generate_subscripts(ts, 1) AS i, unnest(ts) AS w FROM d),
h AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' ') AS h FROM t),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
tot AS (SELECT sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v FROM u),
b AS (SELECT h, w, count(*) AS c FROM h WHERE NOT held_out GROUP BY h, w),
{_discounts("u", "d1")}, {_discounts("b", "d2")},
p1 AS (SELECT w, c, coalesce(d, 1) * c / n AS p FROM u CROSS JOIN tot LEFT JOIN d1 ON r = c),
unk AS (SELECT 1 - sum(p) AS p FROM p1),
hc AS (SELECT w AS h, c FROM u WHERE w <> '' UNION ALL SELECT ' ', c FROM u WHERE w = ''),
bd AS (SELECT b.h, b.w, coalesce(d, 1) * b.c AS kept, p1.p FROM b JOIN p1 USING (w) LEFT JOIN d2 ON r = b.c),
hs AS (SELECT h, hc.c + CASE WHEN hc.c - sum(kept) < 1e-6 THEN 1 ELSE 0 END AS of, sum(kept) AS kept, sum(p) AS p FROM bd JOIN hc USING (h) GROUP BY h, hc.c),
al AS (SELECT h, of, ((of - kept) / of) / (1 - p) AS a FROM hs),
sc AS (SELECT h.doc_id, h.held_out, coalesce(p1.c, 0) AS c,
              CASE WHEN bd.kept IS NOT NULL THEN bd.kept / al.of ELSE coalesce(al.a, 1) * coalesce(p1.p, unk.p) END AS p
       FROM h CROSS JOIN unk LEFT JOIN p1 USING (w) LEFT JOIN bd ON bd.h = h.h AND bd.w = h.w LEFT JOIN al ON al.h = h.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count_if(c > 0) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens,
       round(sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score, round(sum(log10(p)), 6) AS score
FROM sc CROSS JOIN tot GROUP BY doc_id, held_out
"""

def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignments and means written out round by round, each over all parts and entries."""
    near = """
a{k} AS (SELECT vec_id, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.part, b.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d
    FROM x JOIN b{k} b ON b.part = x.part) GROUP BY vec_id, part)"""
    mean = """
m{k} AS (SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT x.part, a.e, i, sum(x.v[i])::DOUBLE AS s, count(*) AS n FROM x JOIN a{k} a USING (vec_id, part), range(1, (SELECT max(len(v)) + 1 FROM x)) AS r(i)
    GROUP BY ALL) GROUP BY part, e),
b{n} AS (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, e))"""
    steps = ",".join(near.format(k=k) + "," + mean.format(k=k, n=k + 1) for k in range(rounds))
    return f"""
WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda z: CAST(floor(4096 * CAST(z AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS (SELECT vec_id, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM w, range({parts}) AS r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM w ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT part, e, v FROM x JOIN f USING (vec_id)),{steps},{near.format(k=rounds)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN w USING (vec_id) CROSS JOIN s
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _merkle(levels: int = 11, top: int = 5) -> str:
    """Trees of up to 3 ** levels leaves a source and 3 ** top sources, level by level."""
    leaf = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    other = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")) + ")"
    out = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS t, {leaf} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {other} ELSE {leaf} END AS f FROM documents),
p0 AS (SELECT doc_id, t, leaf, f, '' AS proof, row_number() OVER (PARTITION BY t ORDER BY doc_id, leaf) - 1 AS i FROM d),
n0 AS (SELECT t, i, leaf AS h FROM p0)"""
    step = """,
r{k} AS (SELECT t, i // 3 AS i, list(h ORDER BY i) AS hs, sum(count(*)) OVER (PARTITION BY t) AS c FROM n{k} GROUP BY t, i // 3),
n{n} AS (SELECT t, i, CASE WHEN c > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{k}),
p{n} AS (SELECT p.* REPLACE (p.i // 3 AS i,
             CASE WHEN c > 1 THEN sha256(array_to_string(hs[1:p.i % 3], '') || f || array_to_string(hs[p.i % 3 + 2:], '')) ELSE f END AS f,
             CASE WHEN c > 1 THEN proof || array_to_string(hs[1:p.i % 3], '') || array_to_string(hs[p.i % 3 + 2:], '') ELSE proof END AS proof)
         FROM p{k} p JOIN r{k} r ON r.t = p.t AND r.i = p.i // 3)"""
    out += "".join(step.format(k=k, n=k + 1) for k in range(levels))
    a = levels + 1
    out += f""",
g AS (SELECT t, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS i FROM n{levels}),
n{a} AS (SELECT '' AS t, i, subroot AS h FROM g),
p{a} AS (SELECT doc_id, '' AS t, leaf, f, proof, g.i, subroot FROM p{levels} JOIN g USING (t))"""
    out += "".join(step.format(k=k, n=k + 1) for k in range(a, a + top))
    return out + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{a + top} JOIN n{a + top} USING (t)
"""


ORACLE = {"op11_vector_codes": _codes(), "op13_merkle": _merkle(), "op4_exact_dedup": _EXACT, "op5_katz": _KATZ, "op6_mixing": _MIXING, "op7_quality": _QUALITY, "op9_minhash": _NEAR}
