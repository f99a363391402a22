"""The registered queries as SQL, for comparison on the same tables.

Scores are compared at nine digits, as the search does, and shown at six.
"""

from __future__ import annotations

from codeloom.plans.workload import CHUNK, VOCABULARY

VOCABULARY_SQL = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"

# Any text column as cleaned text; the tables hold no text that NFKC would change.
CLEAN = r"trim(regexp_replace(regexp_replace({}, '[\x00-\x1F\x7F-\x9F]', '', 'g'), '\s+', ' ', 'g'))"

PREFIX = (
    "coalesce({lo}[1:coalesce(list_max(list_filter(range(1, least(length({lo}), length({hi})) + 1), "
    "lambda i: {lo}[1:i] = {hi}[1:i])), 0)], '')"
)

UNITS = """
vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS vec, vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
         CAST(vec_id % 3 AS VARCHAR) || CAST(vec_id % 2 AS VARCHAR) || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS code
  FROM embeddings
),
norms AS (
  SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS norm FROM vectors
),
units AS (SELECT *, list_transform(v, lambda x: x / norm) AS unit FROM norms)"""


def ranked(code: str, order: str = "doc_id, doc_row", same: str = "TRUE", by: str = "") -> str:
    """CTEs up to ``ranked``: every query vector's catalogue rows in rank order."""
    return f"""WITH {UNITS},
scored AS (
  SELECT {by} q.vec AS query_id, q.vec_id AS query_vec, d.{code} AS doc_id, d.vec AS doc_row, d.label AS doc_label,
         'vector ' || d.vec AS doc_text, round(list_inner_product(q.unit, d.v), 9) AS score
  FROM units q, units d WHERE {same}
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}) AS INTEGER) AS rank
  FROM scored
)"""


# Tie order is id, text, uuid; the text starts alike everywhere, so it orders as the row key.
BY_VEC = ranked("vec")
BY_CODE = ranked("code")
BY_LABEL = ranked("CAST(label AS VARCHAR)").replace("d.CAST(label AS VARCHAR)", "CAST(d.label AS VARCHAR)")

CONSENSUS = f"""{BY_CODE},
groups AS (
  SELECT query_id, count(*) AS n_codes, min(doc_id) AS lo, max(doc_id) AS hi,
         max(CASE WHEN rank = 1 THEN doc_id END) AS top_code,
         max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2
  FROM ranked WHERE rank <= 3 GROUP BY query_id
),
flags AS (
  SELECT *, coalesce((s1 - s2) / (s1 + 1e-9) < 0.05, FALSE) AS is_ambiguous,
         {PREFIX.format(lo="lo", hi="hi")} AS common_prefix
  FROM groups
),
roots AS (
  SELECT *, CASE WHEN (is_ambiguous OR n_codes > 1)
                  AND NOT (length(common_prefix) > 0 AND length(common_prefix) >= length(top_code))
            THEN common_prefix END AS suggested_root
  FROM flags
)"""

NESTED = f"""{CONSENSUS},
lists AS (
  SELECT query_id, string_agg(CAST(rank AS VARCHAR) || ':' || doc_id || ':' || CAST(CAST(score AS DECIMAL(12,4)) AS VARCHAR),
                              '|' ORDER BY rank) AS response
  FROM ranked WHERE rank <= 3 GROUP BY query_id
)
SELECT roots.query_id AS input_id, response, is_ambiguous, suggested_root
FROM roots JOIN lists ON roots.query_id = lists.query_id"""

BRANDS = """WITH asked AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Brand#' || CAST(s_nationkey + 1 AS VARCHAR) AS code FROM supplier
),
found AS (
  SELECT a.id, p.p_brand AS doc_id, p.p_name AS doc_text, p.p_partkey,
         row_number() OVER (PARTITION BY a.id ORDER BY p.p_brand, p.p_name, CAST(p.p_partkey AS VARCHAR)) AS place
  FROM asked a JOIN part p ON {match}
)
SELECT id, doc_id, doc_text, p_partkey FROM found WHERE {limit}"""
EXACT, STARTS = "p.p_brand = a.code", "starts_with(p.p_brand, a.code)"

GAPS = """WITH raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang,
         CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || ' ' WHEN 2 THEN '' ELSE text END AS text
  FROM documents
)"""

PRESENCE = (
    "array_to_string(list_transform({vocabulary}, lambda w: "
    "CASE WHEN list_contains(words, w) THEN '1' ELSE '0' END), '')"
).format(vocabulary=VOCABULARY_SQL)
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"

DICTIONARY = """entries AS (
  SELECT lang, 'c' || CAST(doc_id % 50 AS VARCHAR) AS code, arg_max(text, doc_id) AS text FROM documents GROUP BY 1, 2
),
folded AS (
  SELECT code, coalesce(max(CASE WHEN lang = 'es' THEN text END), arg_min(text, lang)) AS other FROM entries GROUP BY code
)"""

WIDE = ", ".join(
    f"max(CASE WHEN rank = {k} THEN doc_id END) AS codigo_{k}, max(CASE WHEN rank = {k} THEN description END) AS descripcion_{k}, "
    f"round(max(CASE WHEN rank = {k} THEN score END), 4) AS prob_{k}"
    for k in (1, 2, 3)
)
NO_PUNCTUATION = r"""translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')"""


def text_ranked(code: str, asked: str) -> str:
    """CTEs up to ``ranked``: every conversation text's documents in rank order."""
    vector = f"list_transform({VOCABULARY_SQL}, lambda w: CASE WHEN list_contains(words, w) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"""WITH docs AS (
  SELECT {code} AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS uuid, {CLEAN.format("text")} AS text FROM documents
),
doc_words AS (SELECT *, {WORDS.format("text")} AS words FROM docs),
doc_vectors AS (SELECT id, uuid, text, {vector} AS v FROM doc_words),
asked AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, {asked} AS text FROM conversations),
asked_words AS (SELECT *, {WORDS.format("text")} AS words FROM asked),
asked_vectors AS (SELECT id, text, {vector} AS v FROM asked_words),
norms AS (SELECT *, greatest(sqrt(list_sum(v)), 1e-12) AS norm FROM asked_vectors),
units AS (SELECT id, text, list_transform(v, lambda x: x / norm) AS unit FROM norms),
places AS (SELECT *, row_number() OVER (ORDER BY id, text, uuid) AS place FROM doc_vectors),
scored AS (
  SELECT q.id AS query_id, q.text AS query_text, d.place, round(list_inner_product(q.unit, d.v), 9) AS score
  FROM units q, places d
),
best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM scored
),
ranked AS (
  SELECT query_id, query_text, rank, score, d.id AS doc_id, d.text AS doc_text
  FROM best JOIN places d ON best.place = d.place WHERE rank <= 10
)"""


SURVEY = f"""{BY_CODE},
dictionary AS (
  SELECT lower(code) AS code, CASE label % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'pt' END AS lang, label, vec
  FROM vectors WHERE label <> 5
),
texts AS (SELECT code, lang, CASE WHEN label = 4 THEN '' ELSE lang || ' ' || vec END AS text FROM dictionary),
translated AS (
  SELECT r.*, coalesce(nullif(coalesce(a.text, b.text, c.text), ''), r.doc_text) AS description
  FROM (SELECT * FROM ranked WHERE rank <= 3) r
  LEFT JOIN texts a ON a.code = lower(r.doc_id) AND a.lang = 'en'
  LEFT JOIN texts b ON b.code = lower(r.doc_id) AND b.lang = 'es'
  LEFT JOIN (SELECT code, arg_min(text, lang) AS text FROM texts GROUP BY code) c ON c.code = lower(r.doc_id)
),
wide AS (
  SELECT query_vec AS vec_id, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi,
         {WIDE}
  FROM translated GROUP BY query_vec
),
flags AS (
  SELECT *, coalesce((prob_1 - prob_2) / (prob_1 + 1e-9) < 0.05, FALSE) AS es_ambiguo,
         {PREFIX.format(lo="lo", hi="hi")} AS prefix
  FROM wide
)
SELECT vec_id, codigo_1, descripcion_1, prob_1, codigo_2, descripcion_2, prob_2, codigo_3, descripcion_3, prob_3,
       es_ambiguo,
       CASE WHEN (es_ambiguo OR n > 1) AND NOT (length(prefix) > 0 AND length(prefix) >= length(codigo_1))
            THEN prefix ELSE '' END AS raiz_comun
FROM flags"""


def judged(truth: str) -> str:
    return f"""{BY_LABEL},
others AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
  FROM ranked WHERE rank <= 4 AND doc_row <> query_id
),
codes AS (
  SELECT query_id, list(doc_id ORDER BY place) AS codes, max(CASE WHEN place = 1 THEN score END) AS best
  FROM others GROUP BY query_id
),
judged AS (
  SELECT v.vec AS query_id, v.label, {truth} AS truths, coalesce(c.codes[1], '') AS top1_code,
         round(coalesce(c.best, 0.0), 4) AS top1_score,
         coalesce(list_contains({truth}, c.codes[1]), FALSE) AS hit_top1,
         coalesce(list_has_any({truth}, c.codes[1:3]), FALSE) AS hit_top3
  FROM vectors v LEFT JOIN codes c ON c.query_id = v.vec
),
groups AS (
  SELECT label, count(*) AS total_cases, avg(CAST(hit_top1 AS DOUBLE)) AS top1_acc,
         avg(CAST(hit_top3 AS DOUBLE)) AS top3_acc, avg(top1_score) AS mean_score
  FROM judged GROUP BY label
)"""


ONE_TRUTH = judged("[CAST(v.label AS VARCHAR)]")
TWO_TRUTHS = judged("[CAST(v.label AS VARCHAR), CAST(v.label + 1 AS VARCHAR)]")

DEDUP = f"""{BY_LABEL},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS place FROM ranked WHERE rank <= 10
)"""
RERANK = f"""{DEDUP}
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INTEGER) AS rank,
       round(score, 6) AS score
FROM firsts WHERE place = 1"""

TOP10 = f"{BY_VEC} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"



def long_vectors(doc: str) -> str:
    return f"""WITH {UNITS},
longer AS (
  SELECT vec, CAST(list_transform(v, lambda x: CAST(x * (label + 1) AS FLOAT)) AS DOUBLE[]) AS v FROM vectors
),
lengths AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM longer),
scored AS (
  SELECT q.vec AS query_id, d.vec AS doc_id, round(list_inner_product(q.unit, {doc}), 9) AS score FROM units q, lengths d
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"""


SQL: dict[str, str] = {
    "search_topk": TOP10,
    "search_topk_blocks": TOP10,
    "search_scaled_documents": f"SELECT plan, query_id, doc_id, rank, score FROM ({TOP10}) CROSS JOIN (VALUES ('broadcast'), ('blocks')) plans(plan)",
    "search_mixed_lengths": f"""WITH {UNITS},
scored AS (
  SELECT CAST(q.vec_id % 2 AS VARCHAR) AS classifier, q.vec AS query_id, d.vec AS doc_id, list_inner_product(q.unit, d.v) AS part,
         list_inner_product(q.unit, d.v) * CASE WHEN d.vec_id = 0 OR d.vec_id % 2 = 1 THEN 1e11 ELSE 1.0 END AS score
  FROM units q, units d WHERE q.vec_id % 2 = d.vec_id % 2
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
)
SELECT plan, classifier, query_id, doc_id, rank, round(round(part, 9), 6) AS score
FROM ranked CROSS JOIN (VALUES ('broadcast'), ('blocks'), ('joined')) plans(plan) WHERE rank <= 10""",
    "search_with_metadata": f"""{BY_VEC}
SELECT query_id, doc_id, doc_text, rank, round(score, 6) AS score, doc_label AS label FROM ranked WHERE rank <= 10""",
    "search_long_documents": long_vectors("d.v"),
    "search_unit_documents": long_vectors("list_transform(d.v, lambda x: x / greatest(d.norm, 1e-12))"),
    "search_by_catalogue": ranked("vec", same="q.label % 2 = d.label % 2", by="CAST(q.label % 2 AS VARCHAR) AS classifier,")
    + " SELECT classifier, query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "classify_texts": f"""{text_ranked("CAST(doc_id AS VARCHAR)", CLEAN.format("text"))},
groups AS (
  SELECT query_id, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, max(CASE WHEN rank = 1 THEN doc_id END) AS top_code,
         max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2,
         string_agg(CAST(rank AS VARCHAR) || ':' || doc_id || ':' || CAST(CAST(score AS DECIMAL(12,4)) AS VARCHAR), '|' ORDER BY rank) AS response
  FROM ranked WHERE rank <= 3 AND query_text <> '' GROUP BY query_id
),
flags AS (
  SELECT *, coalesce((s1 - s2) / (s1 + 1e-9) < 0.05, FALSE) AS is_ambiguous, {PREFIX.format(lo="lo", hi="hi")} AS prefix
  FROM groups
)
SELECT query_id AS input_id, response, is_ambiguous,
       CASE WHEN (is_ambiguous OR n > 1) AND NOT (length(prefix) > 0 AND length(prefix) >= length(top_code)) THEN prefix END AS suggested_root
FROM flags""",
    "classify_with_hooks": f"""{text_ranked("CAST(doc_id AS VARCHAR)", CLEAN.format("text"))},
placed AS (
  SELECT *, split_part(query_id, '-', 1) AS input_id,
         row_number() OVER (PARTITION BY split_part(query_id, '-', 1) ORDER BY rank, doc_id, doc_text, score) AS place
  FROM ranked WHERE rank <= 3 AND query_text <> ''
),
groups AS (
  SELECT input_id, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, max(CASE WHEN place = 1 THEN doc_id END) AS top_code,
         max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN score END) AS s2,
         string_agg(CAST(rank AS VARCHAR) || ':' || doc_id || ':' || CAST(CAST(score AS DECIMAL(12,4)) AS VARCHAR)
                    || ':' || CAST(length(doc_text) AS VARCHAR), '|' ORDER BY place) AS response
  FROM placed WHERE place <= 3 GROUP BY input_id
),
flags AS (
  SELECT *, coalesce((s1 - s2) / (s1 + 1e-9) < 0.05, FALSE) AS is_ambiguous, {PREFIX.format(lo="lo", hi="hi")} AS prefix
  FROM groups
)
SELECT input_id, response, is_ambiguous,
       CASE WHEN (is_ambiguous OR n > 1) AND NOT (length(prefix) > 0 AND length(prefix) >= length(top_code)) THEN prefix END AS suggested_root
FROM flags""",
    "search_with_hooks": f"""{text_ranked("source", NO_PUNCTUATION)},
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS place FROM ranked WHERE rank <= 10
)
SELECT query_id, query_text, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INTEGER) AS rank,
       round(score, 6) AS score, r_name AS id_definition
FROM firsts LEFT JOIN region ON doc_id = 'src' || CAST(r_regionkey AS VARCHAR) WHERE place = 1""",
    "embed_texts": f"""WITH tokens AS (SELECT CAST(item_id AS VARCHAR) AS id, text, {WORDS.format("text")} AS words FROM benchmark)
SELECT id, text, {PRESENCE} AS presence FROM tokens""",
    "embed_with_hooks": f"""WITH plain AS (SELECT CAST(item_id AS VARCHAR) AS id, {NO_PUNCTUATION} AS text FROM benchmark),
tokens AS (SELECT id, text, {WORDS.format("text")} AS words FROM plain),
marked AS (SELECT id, text, {PRESENCE} AS presence FROM tokens)
SELECT id, text, presence, CAST(length(replace(presence, '0', '')) AS INTEGER) AS n_words FROM marked""",
    "embed_texts_in_batches": f"""WITH tokens AS (SELECT CAST(doc_id AS VARCHAR) AS id, {WORDS.format("text")} AS words FROM documents)
SELECT id, {PRESENCE} AS presence FROM tokens""",
    "embed_texts_once": f"""WITH tokens AS (SELECT CAST(doc_id AS VARCHAR) AS id, {WORDS.format("text")} AS words FROM documents)
SELECT id, {PRESENCE} AS presence FROM tokens""",
    "code_survey_file": f"""{text_ranked("CAST(doc_id AS VARCHAR)", CLEAN.format("text"))},
described AS (
  SELECT r.*, CASE WHEN d.lang <> 'en' THEN d.lang || '/' || d.source ELSE r.doc_text END AS description
  FROM ranked r JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.doc_id WHERE r.rank <= 3
),
wide AS (
  SELECT query_id, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, {WIDE}
  FROM described GROUP BY query_id
),
flags AS (
  SELECT *, coalesce((prob_1 - prob_2) / (prob_1 + 1e-9) < 0.05, FALSE) AS es_ambiguo, {PREFIX.format(lo="lo", hi="hi")} AS prefix
  FROM wide
)
SELECT query_id AS id_registro, role, text AS literal,
       codigo_1, descripcion_1, prob_1, codigo_2, descripcion_2, prob_2, codigo_3, descripcion_3, prob_3, es_ambiguo,
       CASE WHEN (es_ambiguo OR n > 1) AND NOT (length(prefix) > 0 AND length(prefix) >= length(codigo_1))
            THEN prefix ELSE '' END AS raiz_comun
FROM flags JOIN conversations ON query_id = CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)""",
    "accuracy_by_difficulty": f"""{text_ranked("source", CLEAN.format("text"))},
codes AS (
  SELECT query_id, list(doc_id ORDER BY rank) AS codes, max(CASE WHEN rank = 1 THEN score END) AS best
  FROM ranked WHERE rank <= 3 GROUP BY query_id
),
judged AS (
  SELECT substr(role, 1, 1) AS difficulty, codes[1] = 'src' || CAST(conv_id % 20 AS VARCHAR) AS hit_top1,
         list_contains(codes, 'src' || CAST(conv_id % 20 AS VARCHAR)) AS hit_top3, round(best, 4) AS top1_score
  FROM conversations JOIN codes ON query_id = CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)
)
SELECT difficulty, count(*) AS total_cases, round(avg(CAST(hit_top1 AS DOUBLE)), 6) AS top1_acc,
       round(avg(CAST(hit_top3 AS DOUBLE)), 6) AS top3_acc, round(avg(top1_score), 6) AS mean_score
FROM judged GROUP BY difficulty""",
    "stream_progress": """SELECT 'coding' AS job_id, CAST(1 AS BIGINT) AS processed_chunks, CAST(1 AS BIGINT) AS total_chunks, 100.0::DOUBLE AS progress,
       count(*) AS processed_rows,
       count(*) AS total_rows FROM embeddings""",
    "latest_job_status": """WITH log AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, value, props, ts,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
              ELSE 'PROCESSING' END AS status
  FROM events
),
latest AS (
  SELECT job_id, arg_max(status, ts) AS status, arg_max(value, ts) AS progress,
         arg_max(props, ts) FILTER (WHERE status = 'FAILED') AS error, min(ts) AS created_at,
         max(ts) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) AS completed_at
  FROM log GROUP BY job_id
)
SELECT job_id, status, CASE WHEN status = 'COMPLETED' THEN 100.0 ELSE progress END AS progress, error,
       epoch_us(created_at) AS created_at, epoch_us(completed_at) AS completed_at
FROM latest""",
    "l2_normalise_vectors": """WITH scaled AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings
),
norms AS (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS norm FROM scaled),
cells AS (SELECT vec_id, norm, unnest(v) AS x, unnest(range(len(v))) AS dim FROM norms)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, CASE WHEN round(x / norm, 6) = 0 THEN 0.0 ELSE round(x / norm, 6) END AS value
FROM cells""",
    "mean_pool_tokens": """WITH cells AS (
  SELECT label, CASE WHEN vec_id % 3 > 0 THEN 1 ELSE 0 END AS mask, unnest(CAST(embedding AS DOUBLE[])) AS x,
         unnest(range(len(embedding))) AS dim
  FROM embeddings
),
means AS (SELECT label, dim, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS value FROM cells GROUP BY label, dim)
SELECT label, CAST(dim AS INTEGER) AS dim, CASE WHEN value = 0 THEN 0.0 ELSE value END AS value FROM means""",
    "onehot_presence": f"""WITH tokens AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents)
SELECT doc_id, {PRESENCE} AS presence FROM tokens""",
    "index_statistics": """SELECT label, CAST(max(len(embedding)) AS INTEGER) AS vector_shape, count(*) AS num_vectors
FROM embeddings GROUP BY label""",
    "index_round_trip": f"""WITH cleaned AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, {CLEAN.format("text")} AS text, lang FROM documents
),
tokens AS (SELECT *, {WORDS.format("text")} AS words FROM cleaned WHERE text <> '')
SELECT id, text, lang, {PRESENCE} AS presence FROM tokens""",
    "reverse_exact": BRANDS.format(match=EXACT, limit="place <= 100"),
    "reverse_exact_all": BRANDS.format(match=EXACT, limit="TRUE"),
    "reverse_exact_shuffled": BRANDS.format(match=EXACT, limit="place <= 100"),
    "reverse_prefix": BRANDS.format(match=STARTS, limit="place <= 100"),
    "reverse_prefix_all": BRANDS.format(match=STARTS, limit="TRUE"),
    "reverse_prefix_shuffled": BRANDS.format(match=STARTS, limit="place <= 100"),
    "reverse_prefix_2000": BRANDS.format(match=STARTS, limit="place <= 2000"),
    "reverse_empty_prefix": BRANDS.format(match="a.id = '1'", limit="place <= 1500"),
    "reverse_with_hooks": "SELECT *, upper(doc_text) AS upper_text FROM ("
    + BRANDS.format(match=EXACT + " AND a.code NOT IN ('Brand#1', 'Brand#7')", limit="place <= 100") + ")",
    "reverse_by_catalogue": """WITH asked AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, 'Brand#' || CAST(s_nationkey + 1 AS VARCHAR) AS code,
         ['ECONOMY', 'SMALL', 'STANDARD', 'MEDIUM', 'LARGE', 'PROMO'][s_suppkey % 6 + 1] AS classifier
  FROM supplier
),
found AS (
  SELECT a.id, p.p_brand AS doc_id, p.p_name AS doc_text, a.classifier, p.p_partkey,
         row_number() OVER (PARTITION BY a.id ORDER BY p.p_brand, p.p_name, CAST(p.p_partkey AS VARCHAR)) AS place
  FROM asked a JOIN part p ON starts_with(p.p_brand, a.code) AND p.p_type = a.classifier
)
SELECT id, doc_id, doc_text, classifier, p_partkey FROM found WHERE place <= 100""",
    "reverse_without_secrets": BRANDS.format(match=EXACT + " AND a.code NOT IN ('Brand#1', 'Brand#7')", limit="place <= 100"),
    "reverse_nested": f"""SELECT id AS input_id,
       string_agg(doc_id || ':' || doc_text || ':' || CAST(p_partkey AS VARCHAR), '|' ORDER BY doc_id, doc_text, p_partkey) AS response
FROM ({BRANDS.format(match=STARTS, limit="place <= 20")}) GROUP BY id""",
    "clean_documents": f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents",
    "clean_wide_letters": f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents",
    "sanitize_report": f"""{GAPS},
flags AS (
  SELECT lang, text IS NULL AS missing, text IS NOT NULL AND {CLEAN.format("coalesce(text, '')")} = '' AS blank FROM raw
)
SELECT lang, count(*) AS total_rows, count(*) FILTER (WHERE missing) AS missing_rows,
       count(*) FILTER (WHERE blank) AS blank_rows, count(*) FILTER (WHERE NOT missing AND NOT blank) AS kept_rows,
       count(*) FILTER (WHERE missing OR blank) AS removed_rows
FROM flags GROUP BY lang""",
    "clean_catalogue": f"{GAPS} SELECT id, text FROM raw WHERE text IS NOT NULL AND text <> ''",
    "auto_ids": """SELECT doc_id, source, 'r_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS row_id
FROM documents""",
    "job_progress": f"""WITH numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS total FROM documents
)
SELECT ordinal // {CHUNK} AS chunk, count(*) AS chunk_rows, CAST(ceil(max(total) / {CHUNK}.0) AS BIGINT) AS total_chunks,
       round(least(100.0, (ordinal // {CHUNK} + 1) * {CHUNK} / CAST(max(total) AS DOUBLE) * 100.0), 6) AS progress
FROM numbered GROUP BY ordinal // {CHUNK}""",
    "strip_punctuation": r"""SELECT conv_id, turn, translate(text, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '') AS query FROM conversations""",
    "drop_blank_queries": f"""WITH turns AS (
  SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' || chr(9) || chr(10) || ' ' ELSE text END AS text FROM conversations
),
cleaned AS (SELECT conv_id, turn, {CLEAN.format("text")} AS query FROM turns)
SELECT conv_id, turn, query FROM cleaned WHERE query <> ''""",
    "common_prefix": f"""WITH groups AS (
  SELECT vec_id // 7 AS grp, min(lpad(CAST(vec_id AS VARCHAR), 6, '0')) AS lo, max(lpad(CAST(vec_id AS VARCHAR), 6, '0')) AS hi
  FROM embeddings GROUP BY vec_id // 7
)
SELECT grp, {PREFIX.format(lo="lo", hi="hi")} AS common_prefix FROM groups""",
    "ambiguity": f"""{CONSENSUS}
SELECT query_id, round(s1, 6) AS first_score, round(s2, 6) AS second_score, is_ambiguous FROM roots""",
    "suggested_root": f"{CONSENSUS} SELECT query_id, n_codes, top_code, common_prefix, suggested_root FROM roots",
    "nested_results": NESTED,
    "nested_flat_results": NESTED,
    "dictionary_last_wins": """SELECT source AS classifier, lang, CAST(doc_id % 50 AS VARCHAR) AS code, arg_max(text, doc_id) AS text
FROM documents GROUP BY 1, 2, 3""",
    "dictionary_files": """SELECT 'es' AS lang, 'd' || CAST(doc_id AS VARCHAR) AS code, '/' || lang || '/' || source AS text FROM documents""",
    "lookup_with_fallback": f"""WITH {DICTIONARY},
asked AS (
  SELECT doc_id, 'c' || CAST(doc_id % 60 AS VARCHAR) AS code, CASE WHEN quality = 1 THEN 'fr' ELSE 'pt' END AS lang FROM labels
)
SELECT a.doc_id, a.lang, coalesce(e.text, f.other) AS description
FROM asked a LEFT JOIN entries e ON e.code = a.code AND e.lang = a.lang LEFT JOIN folded f ON f.code = a.code""",
    "lookup_one_language": f"""WITH {DICTIONARY},
asked AS (SELECT doc_id, 'c' || CAST(doc_id % 60 AS VARCHAR) AS code FROM labels)
SELECT a.doc_id, coalesce(e.text, f.other) AS description
FROM asked a LEFT JOIN entries e ON e.code = a.code AND e.lang = 'de' LEFT JOIN folded f ON f.code = a.code""",
    "code_survey_wide": SURVEY,
    "stream_code_files": SURVEY,
    "stream_mixed_files": r"""WITH arrived AS (
  SELECT doc_id AS id, nullif(regexp_replace(
    CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x00-\x7F\x{A0}-\x{FF}]', '?', 'g') END, '\r\n?', chr(10), 'g'), '') AS literal
  FROM documents
)
SELECT id, CAST(length(literal) AS BIGINT) AS n_chars, md5(literal) AS digest FROM arrived""",
    "accuracy_by_group": f"""{ONE_TRUTH}
SELECT label, total_cases, round(top1_acc, 6) AS top1_acc, round(top3_acc, 6) AS top3_acc, round(mean_score, 6) AS mean_score
FROM groups""",
    "accuracy_case_file": f"""{ONE_TRUTH}
SELECT query_id, array_to_string(truths, '|') AS label, array_to_string(truths, '|') AS correct_code, top1_code,
       CAST(top1_score AS VARCHAR) AS top1_score, CAST(hit_top1 AS VARCHAR) AS hit_top1, CAST(hit_top3 AS VARCHAR) AS hit_top3 FROM judged""",
    "accuracy_multi_truth": f"""{TWO_TRUTHS}
SELECT query_id, array_to_string(truths, '|') AS correct_code, top1_code, top1_score, hit_top1, hit_top3 FROM judged""",
    "accuracy_macro": f"""{ONE_TRUTH}
SELECT CAST(sum(total_cases) AS BIGINT) AS total_cases, round(avg(top1_acc), 6) AS top1_acc, round(avg(top3_acc), 6) AS top3_acc,
       CASE WHEN avg(top3_acc) >= 0.70 THEN 'viable' WHEN avg(top3_acc) >= 0.50 THEN 'borderline' ELSE 'not viable' END AS verdict
FROM groups""",
    "dedup_results": f"{DEDUP} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM firsts WHERE place = 1",
    "dedup_rerank": RERANK,
    "dedup_rerank_hits": RERANK,
    "inject_definitions": f"""{BY_LABEL}
SELECT query_id, doc_id, rank, round(score, 6) AS score, r_name AS id_definition
FROM ranked LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = doc_id WHERE rank <= 5""",
    "block_documents": f"""{BY_VEC}
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked
WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND CAST(l.doc_id AS VARCHAR) = ranked.doc_id)""",
}
