"""SQL of operators 11 to 13, for DuckDB."""

from __future__ import annotations

from lexispan.llm.licenses import GAP, LONG, LOWER, SHARE, UPPER, templates


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def licenses_sql() -> str:
    """Operator 13: the same votes, merged diagonals and verified spans."""
    rows = ", ".join(f"({t}, {_text(label)}, {str(base).lower()}, {len(w)}, {4 if len(w) >= LONG else 2}, [{', '.join(map(_text, w))}])" for t, label, base, w in templates())
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
templates (template, label, base, m, k, t) AS (VALUES {rows}),
grams AS (SELECT template, label, base, m, k, place, t[place + 1] AS t0, t[place + 2] AS t1, t[place + 3] AS t2, t[place + 4] AS t3 FROM (SELECT *, unnest(range(m - k + 1)) AS place FROM templates)),
rolled AS (SELECT r, i, w[i + 1] AS w0, w[i + 2] AS w1, w[i + 3] AS w2, w[i + 4] AS w3 FROM (SELECT r, w, unnest(range(len(w))) AS i FROM texts)),
hits AS (SELECT r, template, label, base, m, k, place, i - place AS diagonal FROM rolled JOIN grams ON w0 = t0 AND w1 = t1 AND (k = 2 OR (w2 = t2 AND w3 = t3))),
covered AS (SELECT DISTINCT r, template, label, base, m, diagonal, place + x AS place FROM (SELECT *, unnest(range(k)) AS x FROM hits)),
diagonals AS (SELECT DISTINCT r, template, m, diagonal FROM covered),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER d > CASE WHEN m >= {LONG} THEN {GAP} ELSE 0 END THEN 1 ELSE 0 END AS fresh FROM diagonals WINDOW d AS (PARTITION BY r, template ORDER BY diagonal)),
clusters AS (SELECT r, template, diagonal, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS cluster FROM fresh),
merged AS (SELECT r, template, label, base, m, cluster, count(DISTINCT place) AS tw, count(DISTINCT place + diagonal) AS dw, min(place + diagonal) AS first, max(place + diagonal) AS last
  FROM covered JOIN clusters USING (r, template, diagonal) GROUP BY r, template, label, base, m, cluster),
scored AS (SELECT *, CAST(tw AS DOUBLE) / m AS cover, CAST(dw AS DOUBLE) / (last - first + 1) AS alike FROM merged),
spans AS (SELECT *, cover * alike AS score FROM scored WHERE CASE WHEN m >= {LONG} THEN cover >= CAST({SHARE} AS DOUBLE) AND alike >= CAST({SHARE} AS DOUBLE) ELSE tw = m AND dw = m END),
best AS (SELECT * FROM spans a WHERE base OR NOT EXISTS (SELECT 1 FROM spans b WHERE a.r = b.r AND b.score > a.score AND b.first <= a.last AND a.first <= b.last AND a.label <> b.label)),
each AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM best GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM texts LEFT JOIN each USING (r)
"""


def divergence_sql(least: int = 30, top: int = 50) -> str:
    """Operator 12: shares of all groups and kept terms, written out."""
    p = lambda n, total: f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 5)) // ({total} + 5 * v) AS BIGINT)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occurring AS (SELECT r, lang, source, unnest(w) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM occurring GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
langs AS (SELECT lang, sum(n) AS lang_total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "total")} AS p, {p("k.n", "lang_total")} AS q
  FROM totals t JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {top}
"""


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def spelling_sql(min_length: int = 5, min_count: int = 3, every: int = 97) -> str:
    """Operator 11: neighbours are words that are equal once a code point is left out of one of them, or of both at
    one place; the checksum goes through the bytes of a text's digits."""
    step = f"xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    return f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
of_text AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda k: 16 * (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1), lambda c, b: {step}, 4294967295)) AS h FROM of_text),
changed AS (SELECT CASE WHEN h % {every} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
ranked AS (SELECT word, near, n AS near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS nth FROM near),
judged AS (SELECT word, n, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n, coalesce(n_near, 0) AS n_near FROM words LEFT JOIN (SELECT * FROM ranked WHERE nth = 1) USING (word)),
walk AS (SELECT word, form AS goes FROM judged WHERE form IS NOT NULL UNION ALL SELECT w.word, j.form FROM walk w JOIN judged j ON j.word = w.goes WHERE j.form IS NOT NULL),
ends AS (SELECT w.word, w.goes FROM walk w JOIN judged j ON j.word = w.goes WHERE j.form IS NULL)
SELECT word, form, coalesce(goes, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM judged LEFT JOIN ends USING (word)
"""
