"""DuckDB SQL for the operators that SQL can express."""
from __future__ import annotations

from stockhealth.llm import licenses

OP3 = r"""
WITH whole AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), said AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS masked,
         length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '#', ''))
         + length(text) - length(replace(text, '<', '')) + length('### : </turn>') + 1 + length(role) AS chars
  FROM whole
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(masked)) AS BIGINT) AS loss_chars, sha256(string_agg(masked, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

OP8 = """
WITH fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), edge AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM edge UNION SELECT r.x, e.y FROM r JOIN edge e ON r.y = e.x)
  SELECT x, min(y) AS low FROM r GROUP BY x
), degree AS (SELECT x, count(*) AS n FROM edge GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       coalesce(vec_id = least(vec_id, coalesce(low, vec_id)), false) AS kept
FROM embeddings LEFT JOIN reach r ON vec_id = r.x LEFT JOIN degree d ON vec_id = d.x
"""

OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents
), ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sized GROUP BY source
), capped AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM ranked
), filled AS (
  SELECT *, most / weight AS fills_at FROM capped
), levelled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled
), water AS (
  SELECT *, max(CASE WHEN fills_at > level THEN level END) OVER () AS water FROM levelled
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR fills_at <= water THEN CAST(most AS DOUBLE) ELSE water * weight END AS target FROM water
), budgets AS (
  SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS budget FROM targets
), placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _licenses() -> str:
    half = licenses.BLOCK // 2
    phrases = " UNION ALL ".join(f"SELECT {_quoted(p.split())} AS words, '{label}' AS label" for p, label in licenses.PHRASES)
    notices = " UNION ALL ".join(f"SELECT {_quoted(sorted(set(t.split())))} AS words, '{label}' AS label" for t, label in licenses.NOTICES)
    return rf"""
WITH phrase AS ({phrases}), notice AS ({notices}), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), word AS (
  SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM numbered
), place AS (
  SELECT n.r, w.pos, p.label FROM word w JOIN phrase p ON w.w = p.words[1] JOIN numbered n ON n.r = w.r
  WHERE n.words[w.pos + 1 : w.pos + len(p.words)] = p.words
), base AS (
  SELECT r, count(*) AS n, min(pos) AS low, max(pos) AS high, list(DISTINCT label) AS labels FROM place GROUP BY r
), block AS (
  SELECT r, w, unnest([pos // {half}, pos // {half} - 1]) AS b FROM word
), shared AS (
  SELECT r, b, words, label, count(DISTINCT w) / len(words) AS share, count(DISTINCT w) AS n
  FROM block JOIN notice ON list_contains(words, w) GROUP BY r, b, words, label
), more AS (
  SELECT r, list(DISTINCT label) AS labels, max(share) AS score FROM shared WHERE n >= ceil(len(words) * {licenses.THRESHOLD} - 1e-9) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM numbered LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


OP13 = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[k + 1 : k + least(len(words), 10)], ' ') AS said
  FROM item, unnest(range(greatest(len(words) - 9, 1))) AS t(k) WHERE len(words) > 0
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), place AS (
  SELECT r, k, size, words[k + 1 : k + size] AS said FROM doc, unnest(range(len(words))) AS t(k), (SELECT DISTINCT size FROM win)
  WHERE k + size <= len(words)
), found AS (
  SELECT r, k, p.size, item_id FROM (SELECT r, k, size, array_to_string(said, ' ') AS said FROM place) p JOIN win USING (size, said)
), hit AS (
  SELECT r, count(DISTINCT w) AS n FROM found, unnest(range(k, k + size)) AS u(w) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


ORACLES: dict[str, str] = {"op3_chat": OP3, "op8_pstable": OP8, "op9_mixing": OP9, "op10_licenses": _licenses(), "op13_decontaminate": OP13}
