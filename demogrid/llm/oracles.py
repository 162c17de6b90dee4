"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"

OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
         length(replace(role, '\', '\\')) + length(replace(text, '\', '\\')) + length('<|im_start|><|im_sep|><|im_end|>')
         + 2 * (SELECT sum((length(t) - length(replace(t, c, ''))) // length(c))
                FROM unnest(['<|im_start|>', '<|im_sep|>', '<|im_end|>', '<|endoftext|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>']) u(c),
                     unnest([role, text]) v(t)) AS chars
  FROM turns
), moved AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked
), judged AS (
  SELECT *, NOT coalesce(CASE WHEN i = 0 THEN role IN ('system', 'user')
                              WHEN before IN ('system', 'assistant') THEN role = 'user'
                              WHEN before = 'user' THEN role = 'assistant' END, false) AS bad FROM moved
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(NOT bad) AND arg_max(role, i) IN ('user', 'assistant') AS valid,
       (min(i) FILTER (bad))::INT AS error_turn
FROM judged GROUP BY conv_id
"""

OP5 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents
), toks AS (
  SELECT k, generate_subscripts(a, 1) AS i, unnest(a) AS w FROM (SELECT k, regexp_extract_all(text, '{_WORD}') AS a FROM docs)
), tri AS (
  SELECT k, i, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM toks WINDOW x AS (PARTITION BY k ORDER BY i)
), rep AS (
  SELECT k, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY k, w, w2, w3) > 1 AS r FROM tri
), cov AS (
  SELECT k, bool_or(r) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM rep
), repeated AS (
  SELECT k, count(*) AS n_words, count(*) FILTER (c) AS n_repeat_words FROM cov GROUP BY k
), lines AS (
  SELECT k, source, i, line, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[0-9]+', '0', 'g'), '{_GAP}', ' ', 'g')) AS norm
  FROM (SELECT k, source, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT k, source, string_split(text, chr(10)) AS a FROM docs))
), worded AS (
  SELECT * FROM lines WHERE norm <> ''
), dups AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY k
), doc AS (
  SELECT k, string_agg(norm, chr(10) ORDER BY i) AS doc FROM worded GROUP BY k
), seen AS (
  SELECT source, norm, count(DISTINCT doc) AS n FROM worded JOIN doc USING (k) GROUP BY source, norm
), hosts AS (
  SELECT source, count(DISTINCT doc) AS every FROM worded JOIN doc USING (k) GROUP BY source
), often AS (
  SELECT s.source, norm FROM seen s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE n > 5 AND n > 0.1 * every
), removed AS (
  SELECT k, coalesce(sum(words) FILTER (o.norm IS NOT NULL), 0) / sum(words) AS share
  FROM (SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS words FROM worded) w
  LEFT JOIN often o ON w.norm = o.norm AND w.source IS NOT DISTINCT FROM o.source GROUP BY k
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '{_GAP}', '', 'g')) AS word_chars,
       length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       coalesce(n_words, 0) < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (coalesce(n_words, 0) < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(share, 0) <= 0.7 AS kept,
       round(coalesce(share, 0), 6) AS removed_share
FROM docs LEFT JOIN repeated USING (k) LEFT JOIN dups USING (k) LEFT JOIN removed USING (k)
"""

OP12 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, v.id, v.label = a.label AS same, list_dot_product(a.q, v.q)::BIGINT AS score
  FROM v a JOIN v ON v.id <> a.id WHERE a.id % 50 = 0
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1, "op5_quality_rules": OP5, "op12_hard_negatives": OP12}
