"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import TEMPLATES

_REACH = """
reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
comps AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""

OP1 = (
    r"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
nodes AS (SELECT doc_id AS id FROM documents),"""
    + _REACH
    + " SELECT s.doc_id, len(s.s) AS n_shingles, component AS component_id, component = s.doc_id AS kept FROM sets s JOIN comps ON comps.id = s.doc_id"
)

OP2 = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars,
  length(regexp_replace(replace(replace(role, '~', '~0'), chr(10), '~1'), '<(\\*)\|', '<\1\\|', 'g')) AS role_chars,
  role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS same FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN same THEN 11 ELSE 24 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP9 = (
    """WITH RECURSIVE
v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
nodes AS (SELECT id FROM v),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),"""
    + _REACH
    + " SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, component = v.id AS kept FROM v JOIN comps USING (id) LEFT JOIN degree ON degree.a = v.id"
)


_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))

# Cosines of pieces to templates by their definition, then the nearest folder above whose NOTICE has a licence.
OP8 = rf"""WITH RECURSIVE
files AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 8 = 0 AS is_file,
  printf('%x', doc_id // 8) || '/' || CASE WHEN doc_id % 8 = 0 THEN 'NOTICE.' || doc_id ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id END AS path FROM documents),
templates(t, licence, body) AS (VALUES {_TEMPLATES}),
template_words AS (SELECT t, licence, unnest(list_filter(string_split_regex(lower(body), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM templates),
vocabulary AS (SELECT DISTINCT w FROM template_words),
held AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS w FROM files) JOIN vocabulary USING (w) GROUP BY w),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN held USING (w)),
vectors AS (SELECT t, licence, w, x / sqrt(sum(x * x) OVER (PARTITION BY t)) AS x FROM (SELECT t, licence, w, count(*) * any_value(idf) AS x FROM template_words JOIN idf USING (w) GROUP BY t, licence, w)),
pieces AS (SELECT doc_id, unnest(list_distinct(string_split(regexp_replace(text, '([.!?]) ', '' || chr(10), 'g'), chr(10)) || string_split_regex(text, '
[ 	]*
') || CASE WHEN is_file THEN [text] ELSE [] END)) AS piece FROM files),
numbered AS (SELECT *, row_number() OVER () AS p FROM pieces WHERE regexp_matches(piece, '[A-Za-z0-9]')),
counted AS (SELECT p, doc_id, w, count(*) * any_value(idf) AS x FROM (SELECT p, doc_id, unnest(string_split_regex(lower(piece), '[^a-z0-9]+')) AS w FROM numbered) JOIN idf USING (w) GROUP BY p, doc_id, w),
norms AS (SELECT p, sqrt(sum(x * x)) AS norm FROM counted GROUP BY p),
scores AS (SELECT doc_id, licence, round(sum(c.x * v.x) / any_value(norm), 9) AS score FROM counted c JOIN vectors v USING (w) JOIN norms USING (p) GROUP BY doc_id, p, t, licence),
own AS (SELECT doc_id, score, licence FROM scores WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
judged AS (SELECT f.doc_id, path, is_file, score, licence, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files f LEFT JOIN own USING (doc_id)),
folders AS (SELECT dir, score, licence, path FROM judged WHERE is_file AND licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence, path) = 1),
climb(asks, dir) AS (SELECT DISTINCT dir, dir FROM judged WHERE licence IS NULL UNION SELECT asks, regexp_replace(dir, '/?[^/]*$', '') FROM climb WHERE dir <> ''),
given AS (SELECT asks, f.score, f.licence, f.path FROM climb c JOIN folders f ON f.dir = c.dir QUALIFY row_number() OVER (PARTITION BY asks ORDER BY length(c.dir) DESC) = 1)
SELECT doc_id, j.path, coalesce(j.licence, g.licence) AS licence, coalesce(j.score, g.score, 0.0) AS score,
  CASE WHEN j.licence IS NOT NULL THEN 'own' WHEN g.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS scope, CASE WHEN j.licence IS NOT NULL THEN j.path ELSE g.path END AS from_path
FROM judged j LEFT JOIN given g ON j.licence IS NULL AND g.asks = j.dir"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op2_chat_format": OP2, "op8_license_scan": OP8, "op9_embedding_dedup": OP9}
