"""SQL for DuckDB that states the rows of queries whose results SQL can express."""

from __future__ import annotations

from glossweave.llm.license_scan import BLOCK, PHRASES, STEP, TEMPLATES, THRESHOLD
from glossweave.llm.lm_score import LEAST, MOST

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Lists of words: runs of letters, digits and characters that are not ASCII; runs of what is not white space.
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOLID = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, CASE WHEN len(ws) <= 10 THEN ws ELSE list_slice(ws, k, k + 9) END AS g FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(k) WHERE len(ws) > 0),
heads AS (SELECT DISTINCT g[1] AS head, len(g) AS n FROM win),
places AS (SELECT doc_id, k, ws[k] AS w, ws FROM d, unnest(range(1, len(ws) + 1)) AS t(k) WHERE ws[k] IN (SELECT head FROM heads)),
grams AS (SELECT doc_id, k, n, list_slice(ws, k, k + n - 1) AS g FROM places JOIN heads ON head = w WHERE k + n - 1 <= len(ws)),
found AS (SELECT doc_id, k, n, item FROM grams JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: crc32 of short ASCII texts: one step a byte, over a table of 256 numbers made by eight steps each.
_CRC = """
bits AS (SELECT v, v AS x, 0 AS k FROM range(256) AS t(v)
    UNION ALL SELECT v, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY v) AS t FROM bits WHERE k = 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, CAST(4294967295 AS BIGINT) AS c, 1 AS k FROM documents
    UNION ALL SELECT doc_id, s, xor(c >> 8, t[xor(c, ascii(substr(s, k, 1))) % 256 + 1]), k + 1 FROM crc, crc_table WHERE k <= length(s)),
fold AS (SELECT doc_id, xor(c, 4294967295) AS c FROM crc WHERE k = length(s) + 1)"""

_DISCOUNT = f"(SELECT CASE WHEN count(*) FILTER (WHERE n < 3) = 0 THEN {MOST} ELSE least({MOST}, greatest({LEAST}, count(*) FILTER (WHERE n = 1) / (count(*) FILTER (WHERE n = 1) + 2.0 * count(*) FILTER (WHERE n = 2)))) END FROM {{}})"

OP3 = f"""
WITH RECURSIVE {_CRC.strip()},
d AS (SELECT doc_id, c % 7 = 2 AS held_out, list_concat([' <'], {_SOLID}, [' >']) AS ws FROM documents JOIN fold USING (doc_id)),
t AS (SELECT doc_id, held_out, k, ws[k] AS w, ws[k - 1] AS b, CASE WHEN k > 2 THEN ws[k - 2] END AS a FROM d, unnest(range(2, len(ws) + 1)) AS u(k)),
one AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
two AS (SELECT b, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY b, w),
three AS (SELECT a, b, w, count(*) AS n FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, w),
state1 AS (SELECT b, sum(n) AS n, count(*) AS follow FROM two GROUP BY b),
state2 AS (SELECT a, b, sum(n) AS n, count(*) AS follow FROM three GROUP BY a, b),
told AS (SELECT coalesce(sum(n), 0) AS total, count(*) AS types FROM one),
d2 AS (SELECT {_DISCOUNT.format('two')} AS d), d3 AS (SELECT {_DISCOUNT.format('three')} AS d),
p1 AS (SELECT t.*, coalesce(one.n, 0) AS c, (coalesce(one.n, 0) + 1.0) / (total + types + 1) AS root FROM t CROSS JOIN told LEFT JOIN one USING (w)),
p2 AS (SELECT p1.*, CASE WHEN s.n IS NULL THEN root ELSE greatest(coalesce(two.n, 0) - d, 0) / s.n + d * s.follow / s.n * root END AS lower FROM p1 CROSS JOIN d2 LEFT JOIN state1 s USING (b) LEFT JOIN two ON two.b = p1.b AND two.w = p1.w),
p3 AS (SELECT p2.*, CASE WHEN s.n IS NULL THEN lower ELSE greatest(coalesce(three.n, 0) - d, 0) / s.n + d * s.follow / s.n * lower END AS p FROM p2 CROSS JOIN d3 LEFT JOIN state2 s ON s.a = p2.a AND s.b = p2.b LEFT JOIN three ON three.a = p2.a AND three.b = p2.b AND three.w = p2.w)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, CAST((SELECT total FROM told) AS BIGINT) AS train_tokens,
    round(fsum(log10(root)), 6) AS base_score, round(fsum(log10(p)), 6) AS score FROM p3 GROUP BY doc_id
"""

OP4 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, hex(e) AS h FROM documents),
strings AS (SELECT doc_id, k, array_slice(e, k + 1, k + 50) AS s FROM d, unnest(range(0, octet_length(e) - 49)) AS t(k) WHERE octet_length(e) >= 50),
least_doc AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
gone AS (SELECT doc_id, k FROM strings JOIN least_doc USING (s) WHERE m < doc_id),
marked AS (SELECT *, coalesce(k - lag(k) OVER w > 50, true) AS fresh FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
numbered AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
spans AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS z FROM numbered GROUP BY doc_id, run),
pieces AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, coalesce(max(z), 0), NULL FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, coalesce(2 * (z - a), length(h))), '' ORDER BY a) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

_T = ", ".join(f"({k}, '{label}', '{text}')" for k, (text, label) in enumerate(TEMPLATES.items()))
_P = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in PHRASES.items())

OP7 = f"""
WITH lines AS (SELECT doc_id, line, {_ALNUM.replace("coalesce(text, '')", 'part')} AS ws FROM
    (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)),
spread AS (SELECT doc_id, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM lines),
words AS (SELECT doc_id, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS i FROM spread),
d AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM words GROUP BY doc_id),
phrases(label, p) AS (VALUES {_P}),
heads AS (SELECT doc_id, i, label, p FROM words JOIN phrases ON w = p[1]),
base AS (SELECT doc_id, i, label FROM heads JOIN d USING (doc_id) WHERE list_slice(ws, i + 1, i + len(p)) = p),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS z FROM words GROUP BY doc_id, line UNION SELECT doc_id, 0, len(ws) FROM d),
blocks AS (SELECT DISTINCT doc_id, a + k * {STEP} AS a, least(a + k * {STEP} + {BLOCK}, z) AS z FROM runs, unnest(range(0, greatest(1, CAST(ceil((z - a - {BLOCK}) / {STEP}.0) AS BIGINT) + 1))) AS t(k)),
templates(id, label, t) AS (VALUES {_T}),
parts AS (SELECT DISTINCT id, label, unnest(string_split(t, ' ')) AS w FROM templates),
sizes AS (SELECT id, count(*) AS size FROM parts GROUP BY id),
shares AS (SELECT b.doc_id, b.a, b.z, id, label, count(DISTINCT w) AS n FROM words JOIN parts USING (w) JOIN blocks b ON b.doc_id = words.doc_id AND i >= b.a AND i < b.z GROUP BY ALL),
notices AS (SELECT doc_id, label, n / size AS share FROM shares JOIN sizes USING (id) WHERE n >= ceil({THRESHOLD} * size - 1e-9)),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM notices) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS score FROM notices GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP8 = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SOLID} AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE list_slice(ws, k, k + 2) END, ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(k) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * shared >= 90 * (m.n + n.n - shared)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, arcs.b FROM reach JOIN arcs ON arcs.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_doc AS component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_doc FROM reach GROUP BY a) USING (doc_id)
"""

ORACLES = {"op2_decontamination": OP2, "op3_lm_score": OP3, "op4_suffix_dedup": OP4, "op7_license_scan": OP7, "op8_exact_topk": OP8, "op9_ngram_jaccard": OP9}
