"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from codeloom.llm.ledger import BASE, ISSUED

SQL: dict[str, str] = {}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The shingle sets as they are, all pairs that share one, and the components by spreading along the links.
SQL["op3_ngram_jaccard"] = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[s:s + 4], ' ') AS shingle
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT r, doc_id, count(*) AS n FROM shingles GROUP BY r, doc_id
), links AS (
  SELECT a.r AS x, b.r AS y FROM shingles a JOIN shingles b USING (shingle)
  JOIN sizes m ON m.r = a.r JOIN sizes n ON n.r = b.r
  WHERE a.r <> b.r GROUP BY a.r, b.r, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reached(x, y) AS (
  SELECT r, r FROM sizes UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y
), named AS (
  SELECT x AS r, min(sizes.doc_id) AS component_id FROM reached JOIN sizes ON sizes.r = reached.y GROUP BY x
)
SELECT docs.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, docs.doc_id) AS component_id
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN named USING (r)
"""

_MATCHES = " UNION ALL ".join(
    f"""SELECT r, {i} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{rule.pattern.replace("'", "''")}') AS gaps,
    regexp_extract_all(t, '{rule.pattern.replace("'", "''")}', 0) AS hits, regexp_extract_all(t, '{rule.pattern.replace("'", "''")}', {rule.group}) AS checked FROM texts"""
    for i, rule in enumerate([*BASE, *ISSUED])
)

SQL["op8_secret_ledger"] = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), matches AS ({_MATCHES}), spans AS (
  SELECT r, place, kind, length(hits[i]) AS size, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM matches) WHERE length(checked[i]) >= least
), told AS (
  SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + size AS BIGINT) AS VARCHAR), ',' ORDER BY start, place) AS spans,
    string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + size AS BIGINT) AS VARCHAR), ',' ORDER BY start, place)
      FILTER (place < {len(BASE)}) AS base
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM texts LEFT JOIN told USING (r)
"""

SQL["op12_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k
  FROM documents
), drawn AS (
  SELECT *, len(k) AS n,
    CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
    CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(list_slice(k, 1, CAST(lo AS BIGINT)), ''), '') AS a,
    coalesce(array_to_string(list_slice(k, CAST(lo AS BIGINT) + 1, CAST(hi AS BIGINT)), ''), '') AS b,
    coalesce(array_to_string(list_slice(k, CAST(hi AS BIGINT) + 1, n), ''), '') AS c
  FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
    ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

_PHRASE_WORDS = r"""regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# Starts are looked for where a window's rarest word stands, up to two places off, and held against all its words.
SQL["op13_decontamination"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_PHRASE_WORDS.format(text="text")} AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_PHRASE_WORDS.format(text="text")} AS w FROM benchmark
), windows AS (
  SELECT words, row_number() OVER () AS wid, len(words) AS size FROM (
    SELECT DISTINCT list_slice(w, s, s + 9) AS words
    FROM (SELECT w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0))
), owners AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), asked AS (
  SELECT wid, size, unnest(range(0, size)) AS j, unnest(words) AS word FROM windows
), said AS MATERIALIZED (
  SELECT r, p, word FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs)
  WHERE word IN (SELECT word FROM asked)
), frequent AS (
  SELECT word, count(*) AS n FROM said GROUP BY word
), rarest AS (
  SELECT wid, min_by(j, n * 100 + j) AS j, min_by(word, n * 100 + j) AS word
  FROM asked JOIN frequent USING (word) GROUP BY wid, size HAVING count(*) = size
), off AS (
  SELECT unnest([-2, -1, 0, 1, 2]) AS play
), starts AS (
  SELECT DISTINCT wid, r, p - j + play AS s FROM rarest JOIN said USING (word), off WHERE j > 0 OR play = 0
), met AS (
  SELECT wid, r, s, size, count(DISTINCT j) AS near, count(DISTINCT j) FILTER (play = 0) AS exact
  FROM (
    SELECT wid, r, s, size, j, play, word, s + j + play AS p FROM starts JOIN asked USING (wid), off WHERE j > 0 OR play = 0
  ) JOIN said USING (r, p, word)
  GROUP BY wid, r, s, size HAVING count(DISTINCT j) = size
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM met WHERE exact = size) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) FILTER (exact = size) AS n_items, count(DISTINCT item) AS n_near,
    array_to_string(list_sort(list(DISTINCT item) FILTER (exact = size)), ',') AS told
  FROM met JOIN windows USING (wid, size) JOIN owners USING (words) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(told, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
