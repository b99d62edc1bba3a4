"""SQL twins of the queries that SQL can express, over whole tables. They share constants with the operators, not logic."""

from tidelog.llm.quality_rules import RULES, STOP_FORMS

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    """CTE words(doc_id, i, w): the words of each text, counted from 1."""
    return f"words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all({text}, {_WORD}) AS ws FROM documents))"


SUBSTRING_DEDUP = f"""WITH {_words("coalesce(text, '')")},
  windows AS (SELECT doc_id, i, w, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM words),
  repeats AS (SELECT doc_id, i, w, len(run) = 20 AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM windows),
  marked AS (SELECT doc_id, i, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM repeats),
  kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

_KEPT = " AND ".join(f"({r.value}) {op} {v:g}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)

QUALITY_RULES = f"""WITH {_words("coalesce(text, '')")},
  grams AS (SELECT doc_id, i, w, lead(w, 1) OVER d AS b, lead(w, 2) OVER d AS c FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  twice AS (SELECT doc_id, i, w, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, b, c) > 1 AS again FROM grams),
  covered AS (SELECT doc_id, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM twice),
  per_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (hit) AS n_repeat_words,
    count(*) FILTER (w IN ({", ".join(f"'{w}'" for w in STOP_FORMS)})) AS n_stop_words FROM covered GROUP BY doc_id),
  per_line AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {_WORD})) AS ls FROM documents),
  signals AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words
    FROM documents d JOIN per_line USING (doc_id) LEFT JOIN per_word USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_KEPT} AS kept, n_lines, n_stop_words FROM signals"""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  o AS (SELECT payload_digest, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < owner THEN owner END AS refers_to
  FROM p LEFT JOIN o USING (payload_digest)"""

NGRAM_JOIN = f"""WITH RECURSIVE {_words(_LOWER)},
  grams AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d AS g FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  sets AS (SELECT DISTINCT doc_id, g FROM grams WHERE g IS NOT NULL UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM words GROUP BY doc_id HAVING count(*) < 3),
  sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y, k = p.n AND k = q.n AS same FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
  reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
  lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
  partners AS (SELECT x, count(*) AS n_links, min(y) FILTER (same) AS twin FROM links GROUP BY x)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links, least(d.doc_id, coalesce(twin, d.doc_id)) AS class_id
  FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id LEFT JOIN partners p ON p.x = d.doc_id"""

#: For pages whose article is marked and holds only h1, p, b and br, as those of the table do.
HTML_EXTRACT = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
  b AS (SELECT page_id, url, string_split_regex(replace(regexp_replace(body, '</?b>', '', 'g'), '<br>', ' '), '</?(?:p|h1)>') AS blocks FROM a),
  c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM b),
  d AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), ' ') AS text FROM c)
  SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM d"""
