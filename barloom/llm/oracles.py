"""DuckDB SQL for the training-data queries that SQL can express."""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PLAIN = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"translate(coalesce({text}, ''), {_AZ})" if lower else f"coalesce({text}, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


NEAR_DEDUP = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words("text", _PLAIN, True)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, least(i + 4, len(w))), ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id"""

SUBSTRING_DEDUP = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text", _PLAIN, False)} AS w FROM documents),
v AS MATERIALIZED (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
h AS MATERIALIZED (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)),
x AS (SELECT d.r, d.doc_id, len(d.w) AS n, d.p, d.w[d.p] AS word, h.p IS NOT NULL AS gone FROM (SELECT *, unnest(generate_series(1, len(w))) AS p FROM d) d LEFT JOIN h ON h.r = d.r AND h.p = d.p),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM x GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r"""

CHAT_COLLAPSE = """
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, list({'r': role, 't': text} ORDER BY k) AS turns, count(*) AS n FROM t GROUP BY conv_id),
u AS MATERIALIZED (SELECT min(conv_id) AS conv_id, turns, n FROM c GROUP BY turns, n),
p AS MATERIALIZED (SELECT DISTINCT list_slice(turns, 1, i) AS turns FROM (SELECT turns, unnest(generate_series(1, n - 1)) AS i FROM u WHERE n > 1)),
m AS (SELECT conv_id FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = u.turns))
SELECT t.conv_id, CAST((t.k - 1) // 512 AS BIGINT) AS part, count(*) AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY k) AS text
FROM t JOIN m USING (conv_id) GROUP BY 1, 2"""

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text", _LETTERS, True)} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_words("text", _LETTERS, True)} AS w FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item_id, list_slice(w, i, least(i + 9, len(w))) AS k FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(k) AS n FROM g),
v AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS k FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, z WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT v.r, v.i, v.n, g.item_id FROM v JOIN g ON g.k = v.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM f) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(q.n_items, 0)::BIGINT AS n_items, sha256(coalesce(q.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN q ON q.r = d.r"""


def licence_scan() -> str:
    from .licences import RARE, SHARE, _entries

    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    rows = ", ".join(f"({e['entry']}, '{e['label']}', {str(e['base']).upper()}, {listed(e['words'])}, {listed(e['key'])}, {e['key_at']})" for e in _entries())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text", _LETTERS, True)} AS w FROM documents),
e(entry, label, base, words, key, key_at) AS (VALUES {rows}),
t AS MATERIALIZED (SELECT entry, label, base, key, key_at, i - 1 AS off, words[i] AS word FROM (SELECT *, unnest(generate_series(1, len(words))) AS i FROM e)),
f AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS word FROM d) WHERE word IN (SELECT word FROM t) GROUP BY word),
k AS (SELECT t.*, coalesce(ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (f.n + 1.0::DOUBLE)), 0) AS idf FROM t LEFT JOIN f USING (word)),
b AS MATERIALIZED (SELECT *, sum(idf) OVER (PARTITION BY entry) AS total, count(*) OVER (PARTITION BY entry) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY idf DESC, word, off) AS rk FROM k) WHERE rk <= CASE WHEN base THEN 1 ELSE {RARE} END),
x AS MATERIALIZED (SELECT d.r, d.i - 1 AS place, d.w, b.* FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM d) d JOIN b ON b.word = d.w[d.i]),
m AS (SELECT r, entry, label, base, place - off AS start, off, max(CASE WHEN total > 0 THEN idf / total ELSE 1.0::DOUBLE / parts END) AS part FROM x WHERE place - off + key_at >= 0 AND list_slice(w, place - off + key_at + 1, place - off + key_at + len(key)) = key GROUP BY ALL),
a AS (SELECT r, entry, label, base, start, round(sum(part), 9) AS share FROM m GROUP BY ALL HAVING base OR round(sum(part), 9) >= {SHARE}),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(least(share, 1.0::DOUBLE)) AS score FROM a GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_base, 0)::BIGINT AS n_base, g.first_word::BIGINT AS first_word, g.last_word::BIGINT AS last_word, coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, 0)::DOUBLE AS score
FROM d LEFT JOIN g ON g.r = d.r"""
