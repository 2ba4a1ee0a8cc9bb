"""SQL for DuckDB that gives the registered queries' rows from the same tables."""

from __future__ import annotations

from .queries import BAD_ITEMS, FILE_CATEGORIES, LEXICON, MAIN

WORD = "[0-9A-Za-z_\\u00c0-\\u024f\\u0370-\\u04ff]".encode().decode("unicode_escape")
LOWER = "lower(text)"


def _values(terms) -> str:
    return ", ".join(f"({i}, '{t}', '{c}', '{s}', {('low', 'medium', 'high').index(s) + 1})" for i, (t, c, s) in enumerate(terms))


def _hits(terms=MAIN, text: str = LOWER, bounded: bool = True, exact: bool = False, categories=None, source: str = "SELECT doc_id AS id, text FROM documents", extra: str = "") -> str:
    """CTEs up to h (id, term_index, term, category, severity, rank, s, e): one hit for each form and place.

    Places come from the lengths between occurrences, which is exact for forms that don't overlap themselves.
    """
    form = "term" if exact else "lower(term)"
    where = f"WHERE category IN ({', '.join(repr(c) for c in categories)})" if categories else ""
    test = (
        f"WHERE NOT (regexp_matches(left(form, 1), '{WORD}') AND s > 0 AND regexp_matches(substr(t, s, 1), '{WORD}'))"
        f" AND NOT (regexp_matches(right(form, 1), '{WORD}') AND e < length(t) AND regexp_matches(substr(t, e + 1, 1), '{WORD}'))"
        if bounded else ""
    )
    return f"""
lex(term_index, term, category, severity, rank) AS (VALUES {_values(terms)}),
picked AS (SELECT * FROM (SELECT *, {form} AS form, row_number() OVER (PARTITION BY {form} ORDER BY rank DESC, term_index) AS nth FROM lex {where}) WHERE nth = 1),
src AS (SELECT id, text, {text} AS t FROM ({source})),
cut AS (SELECT id, t, p.*, string_split(t, form) AS parts FROM src, picked p WHERE contains(t, form)),
pieces AS (SELECT id, t, term_index, term, category, severity, rank, form, len(parts) AS n, unnest(parts) AS piece, generate_subscripts(parts, 1) AS k FROM cut),
places AS (SELECT *, sum(length(piece) + length(form)) OVER (PARTITION BY id, term_index ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM pieces),
spans AS (SELECT id, t, term_index, term, category, severity, rank, form, CAST(e - length(form) AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM places WHERE k < n),
h AS (SELECT id, term_index, term, category, severity, rank, s, e FROM spans {test}){extra}"""


REDUCED = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, e DESC, term_index) AS rn FROM {hits}),
steps(id, rn, e) AS (
  SELECT id, rn, e FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.id, r.rn, r.e FROM (SELECT k.id, min(r.rn) AS rn FROM steps k JOIN ranked r ON r.id = k.id AND r.rn > k.rn AND r.s >= k.e GROUP BY k.id) m
  JOIN ranked r ON r.id = m.id AND r.rn = m.rn
),
m AS (SELECT r.* FROM ranked r JOIN steps k USING (id, rn))"""


def _matches(reduce: bool = True, hits: str = "h", **o) -> str:
    tail = REDUCED.format(hits=hits) if reduce else f", m AS (SELECT * FROM {hits})"
    return "WITH RECURSIVE " + _hits(**o) + tail


ROWS = " SELECT id AS doc_id, CAST(term_index AS INTEGER) AS term_index, term, category, severity, s, e FROM m"
DECIDE = "CASE WHEN count(m.id) = 0 THEN 'allow' WHEN count(*) FILTER (rank = 3) > 0 THEN 'block' ELSE 'review' END"
RISK = "CASE coalesce(max(rank), 0) WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END"


def _per_doc(columns: str, ctes: str | None = None, rows: str = "documents", key: str = "doc_id") -> str:
    return f"{ctes or _matches()} SELECT d.{key}, {columns} FROM {rows} d LEFT JOIN m ON m.id = d.{key} GROUP BY d.{key}"


def _policy(blocking: str, allowed: str = "false", least: int = 1) -> str:
    return (
        f"CASE WHEN count(m.id) FILTER (NOT ({allowed})) = 0 THEN 'allow'"
        f" WHEN count(m.id) FILTER (NOT ({allowed}) AND ({blocking})) >= {least} AND count(m.id) FILTER (NOT ({allowed}) AND ({blocking})) > 0 THEN 'block' ELSE 'review' END"
    )


FIRST = ", m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS nth FROM m0) WHERE nth <= {n})"


def _limited(n: int) -> str:
    return _matches().replace("\nm AS (", "\nm0 AS (") + FIRST.format(n=n)


ALLOWED = """,
covers AS (
  SELECT id, CAST(sum(length(piece) + length(a)) OVER (PARTITION BY id, a ORDER BY k ROWS UNBOUNDED PRECEDING) - length(a) AS INTEGER) AS cs,
    CAST(sum(length(piece) + length(a)) OVER (PARTITION BY id, a ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS ce, k, n
  FROM (SELECT id, a, len(string_split(t, a)) AS n, unnest(string_split(t, a)) AS piece, generate_subscripts(string_split(t, a), 1) AS k
    FROM src, (VALUES ('the mit license'), ('der')) v(a))
),
free AS (SELECT * FROM h WHERE lower(term) NOT IN ('the mit license', 'der')
  AND NOT EXISTS (SELECT 1 FROM covers c WHERE c.id = h.id AND c.k < c.n AND c.cs <= h.s AND c.ce >= h.e))"""


def _disguised() -> str:
    """Hits of the plain texts, moved by the characters that the disguise puts in before them."""
    shift = "SELECT id, unnest(string_split(text, 'License')) AS a, generate_subscripts(string_split(text, 'License'), 1) AS k, len(string_split(text, 'License')) AS n FROM src"
    return (
        _matches()
        + f""",
lic AS (SELECT id, k, CAST(sum(length(a) + 7) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM ({shift}) QUALIFY k < n),
com AS (SELECT id, k, CAST(sum(length(a) + 11) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM ({shift.replace('License', 'example.com')}) QUALIFY k < n),
put AS (SELECT id, e - 4 AS pos FROM lic UNION ALL SELECT id, e - 9 FROM com)
SELECT m.id AS doc_id, term, CAST(s + (SELECT count(*) FROM put WHERE put.id = m.id AND put.pos <= m.s) AS INTEGER) AS s,
  CAST(e + (SELECT count(*) FROM put WHERE put.id = m.id AND put.pos < m.e) AS INTEGER) AS e, 'normalized' AS match_type
FROM m WHERE category IN ('compliance', 'url')"""
    )


def _folded(inside: str, length: int) -> str:
    """Where License stands as a word, its replacement is found."""
    cuts = "SELECT doc_id, text, unnest(string_split(text, 'License')) AS a, generate_subscripts(string_split(text, 'License'), 1) AS k, len(string_split(text, 'License')) AS n FROM documents WHERE contains(text, 'License')"
    return f"""
WITH p AS (SELECT *, sum(length(a)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM ({cuts}))
SELECT doc_id, CAST(before + {length} * (k - 1) AS INTEGER) AS s, CAST(before + {length} * k AS INTEGER) AS e, '{inside}' AS matched_text FROM p
WHERE k < n AND NOT regexp_matches(right(a, 1), '{WORD}') AND NOT regexp_matches(left(nxt, 1), '{WORD}')"""


INSPECT = r"""array_to_string(list_filter([
  CASE WHEN length(line) = 1 THEN 'single-character' END, CASE WHEN length(line) > 128 THEN 'too-long' END,
  CASE WHEN regexp_matches(line, '[\t\n\r\x0B\f]| {2,}') THEN 'contains-whitespace' END,
  CASE WHEN regexp_matches(line, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control-character' END,
  CASE WHEN regexp_matches(line, '^[0-9]+$') THEN 'digits-only' END, CASE WHEN regexp_matches(line, '^[\p{P}\p{S}]+$') THEN 'punctuation-only' END,
  CASE WHEN regexp_matches(line, '(?i)<[^>]{1,20}>|&[a-z]{2,10};') THEN 'html-like' END], lambda x: x IS NOT NULL), ',')"""

# Terms and their owners over every word of every document, with all issues and languages.
WHOLE_LINES = r"""
docs AS (SELECT doc_id, text, coalesce(source, 'unsourced') AS source FROM documents),
files AS (SELECT source AS source_path, row_number() OVER (ORDER BY source) - 1 AS file_seq FROM (SELECT DISTINCT source FROM docs)),
words AS (SELECT source AS source_path, doc_id, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM docs),
lines AS (SELECT w.source_path, file_seq, doc_id * 100000 + pos AS line_no, term FROM words w JOIN files USING (source_path) WHERE term <> ''),
known AS (SELECT term, string_split_regex(nullif(issues, ''), ',') AS issues, language FROM (SELECT term, {inspect} AS issues, {language} AS language FROM (SELECT DISTINCT term FROM lines))),
sound AS (SELECT * FROM known WHERE NOT list_has_any(coalesce(issues, []), ['control-character', 'punctuation-only', 'too-long'])),
config AS (SELECT *, TRY_CAST(substr(source_path, 4) AS INTEGER) AS i FROM files),
mapped AS (SELECT *, CASE WHEN i BETWEEN 0 AND 19 THEN 'c' || (i % 7) ELSE source_path END AS category FROM config),
cats AS (SELECT category, ['low', 'medium', 'high'][rank] AS severity, rank FROM (SELECT category, coalesce(arg_min(i, file_seq) % 3, 0) + 1 AS rank FROM mapped GROUP BY category)),
owners AS (SELECT file_seq, source_path, m.category, severity, rank FROM mapped m JOIN cats USING (category)),
per_file AS (SELECT term, l.file_seq, min(line_no) AS line_no, count(*) AS n FROM lines l GROUP BY ALL),
placed AS (SELECT p.*, o.source_path, o.category, o.severity, o.rank, row_number() OVER w AS nth, max(rank) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM per_file p JOIN owners o USING (file_seq) WINDOW w AS (PARTITION BY term ORDER BY p.file_seq)),
top AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank DESC, file_seq) = 1),
terms AS (SELECT p.term, t.category, t.severity, t.source_path, arg_min(p.source_path, p.nth) AS first_path, count(*) AS files, sum(p.n) AS lines,
  count(*) FILTER (p.nth > 1 AND p.rank > p.before) AS reassigned, any_value(s.issues) IS NOT NULL AS needs_review, any_value(s.language) AS language
  FROM placed p JOIN top t ON t.term = p.term JOIN sound s ON s.term = p.term GROUP BY p.term, t.category, t.severity, t.source_path)"""

LANGUAGE = r"""CASE WHEN regexp_matches(term, '[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') THEN 'zh'
  WHEN regexp_matches(term, '[A-Za-z\x{c0}-\x{24f}]') AND NOT regexp_matches(term, '[^\x00-\x7F\x{c0}-\x{24f}]') THEN 'en' ELSE 'other' END"""


_FILE_CATEGORIES = ", ".join(f"({i}, '{c}', '{v}', {('low', 'medium', 'high').index(v) + 1}, {e})" for i, (c, v, e) in enumerate(FILE_CATEGORIES))

# The lexicon of the benchmark's words: e (term_index, term, form, category, severity, language, needs_review, others).
WORD_LEXICON = r"""
lines AS (SELECT item_id AS file_seq, unnest(string_split(replace(text, ' ', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, ' ', chr(10)), chr(10)), 1) AS line_no FROM benchmark),
cleaned AS (SELECT file_seq, line_no, trim(line, chr(9) || chr(11) || chr(12) || chr(13)) AS term FROM lines),
kept AS (SELECT * FROM cleaned WHERE term <> '' AND NOT starts_with(term, '#')),
known AS (SELECT term, string_split_regex(nullif(issues, ''), ',') AS issues, language FROM (SELECT term, {inspect} AS issues, {language} AS language FROM (SELECT DISTINCT term FROM kept))),
cats(i, category, severity, rank, enabled) AS (VALUES {categories}),
per_file AS (SELECT term, file_seq, min(line_no) AS line_no, any_value(category) AS category, any_value(severity) AS severity, any_value(rank) AS rank FROM kept JOIN cats ON i = file_seq % {n} GROUP BY term, file_seq),
owned AS (SELECT term, arg_max(category, rank * 1000000 - file_seq) AS category, arg_max(severity, rank * 1000000 - file_seq) AS severity, min(file_seq * 1000000 + line_no) AS place, count(*) - 1 AS others FROM per_file GROUP BY term),
e AS (SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS term_index, term, lower(term) AS form, category, severity, language, issues IS NOT NULL AS needs_review, CAST(others AS INTEGER) AS others
  FROM owned JOIN known USING (term) WHERE NOT list_has_any(coalesce(issues, []), ['control-character', 'punctuation-only', 'too-long']))"""


SNAP = "SELECT path, list_sort(list_distinct(list(term))) AS terms FROM ({rows}) GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    inspect = INSPECT.replace("line)", "term)").replace("line,", "term,")
    whole = WHOLE_LINES.replace("{inspect}", inspect).replace("{language}", LANGUAGE)
    words = "WITH " + WORD_LEXICON.replace("{inspect}", inspect).replace("{language}", LANGUAGE).replace("{categories}", _FILE_CATEGORIES).replace("{n}", str(len(FILE_CATEGORIES)))
    bad = ", ".join(f"('{i}', {'NULL' if t is None else 'repeat(' + repr('x') + ', 20001)' if len(t) > 99 else 'chr(32) || chr(10)' if t.strip() != t else repr(t)})" for i, t in BAD_ITEMS)
    items = f"SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents UNION ALL SELECT id, NULL, text FROM (VALUES {bad}) v(id, text)"
    batch = r"""CASE WHEN text IS NULL THEN 'TEXT_REQUIRED' WHEN text = '' THEN 'TEXT_EMPTY' WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'TEXT_BLANK'
      WHEN length(text) > 20000 THEN 'TEXT_TOO_LONG' ELSE 'OK' END"""
    off = ", ".join(f"'{c}'" for c, _, enabled in FILE_CATEGORIES if not enabled)
    select = "SELECT term_index, term, category, severity FROM e WHERE {where}"
    conversations = _matches(source="SELECT conv_id * 1000 + turn AS id, text FROM conversations")
    return {
        "moderate_documents": _per_doc(
            f"count(m.id) > 0 AS matched, {DECIDE} AS decision, {RISK} AS risk_level, count(m.id) AS hit_count, count(DISTINCT term) AS unique_term_count,"
            " coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (category IS NOT NULL))), ','), '') AS categories"
        ),
        "find_all_exact": _matches(text="text", exact=True) + ROWS,
        "find_all_normalized": _matches() + ROWS,
        "find_all_overlap_all": _matches(reduce=False) + ROWS,
        "find_all_without_boundaries": _matches(bounded=False) + ROWS,
        "same_form_terms": _matches(terms=LEXICON) + ROWS,
        "category_filtered_hits": _matches(terms=LEXICON, categories=("common-en", "compliance")) + ROWS,
        "allowlist_hits": _matches(hits="free", extra=ALLOWED) + ROWS,
        "max_matches_decision": _per_doc(f"{DECIDE} AS decision, {RISK} AS risk_level, count(m.id) AS hit_count", _limited(2)),
        "find_first": _limited(1) + " SELECT m.id AS doc_id, term, s, e, substr(src.text, s + 1, e - s) AS matched_text FROM m JOIN src USING (id)",
        "contains": _per_doc("count(m.id) > 0 AS contains"),
        "unique_terms": _matches() + """, u AS (SELECT id, term, min(s) AS s FROM m GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(term, '|' ORDER BY s), '') AS unique_terms FROM documents d LEFT JOIN u ON u.id = d.doc_id GROUP BY d.doc_id""",
        "disguised_hits": _disguised(),
        "match_type_labels": _matches() + """ SELECT term, CASE WHEN substr(src.text, s + 1, e - s) = term THEN 'exact' ELSE 'normalized' END AS match_type, count(*) AS n
FROM m JOIN src USING (id) GROUP BY ALL""",
        "fuzzy_separator_hits": _folded("L-i.c\u00b7ense", 10),
        "fuzzy_leet_hits": _folded("L1c3n$e", 7),
        "normalize_text": "SELECT doc_id, length(text) AS n, md5(replace(lower(text), chr(10), ' ')) AS digest FROM documents",
        "fuzzy_fold_text": r"""SELECT item_id, regexp_replace(translate(lower(text), '0134578@$!+', 'oieastbasit'), '[\s"''()*,\-./:;<>\[\]\\_`{}|~#%&^]', '', 'g') AS folded FROM benchmark""",
        "moderate_conversations": f"""{conversations},
t AS (SELECT c.conv_id, c.turn, count(m.id) AS hits, CASE {DECIDE} WHEN 'block' THEN 2 WHEN 'review' THEN 1 ELSE 0 END AS w
  FROM conversations c LEFT JOIN m ON m.id = c.conv_id * 1000 + c.turn GROUP BY ALL)
SELECT conv_id, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (hits > 0) AS matched_turns, max(w) AS worst FROM t GROUP BY conv_id""",
        "moderate_pages": _per_doc(f"{DECIDE} AS decision, count(m.id) AS hit_count", _matches(source="SELECT page_id AS id, html AS text FROM pages"), "pages", "page_id"),
        "risk_level": f"{_matches()}, r AS (SELECT d.doc_id, {RISK} AS risk_level, count(m.id) AS k FROM documents d LEFT JOIN m ON m.id = d.doc_id GROUP BY d.doc_id) SELECT risk_level, count(*) AS n, CAST(sum(k) AS BIGINT) AS hits FROM r GROUP BY risk_level",
        "decision_policy_variants": _per_doc(
            f"""{_policy('rank >= 2')} AS medium, {_policy('false')} AS never, {_policy("category = 'common-de'")} AS german,
{_policy('rank = 3', "category IN ('common-en', 'common-de')")} AS english, {_policy('true', least=5)} AS five"""
        ),
        "mask_documents": _matches() + """, parts AS (SELECT id, s, e, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS pos FROM m),
joined AS (SELECT p.id, string_agg(substr(src.text, pos + 1, s - pos) || repeat('#', e - s), '' ORDER BY s) AS head, max(e) AS last FROM parts p JOIN src USING (id) GROUP BY p.id)
SELECT d.doc_id, coalesce(j.head || substr(d.text, j.last + 1), d.text) AS masked_text FROM documents d LEFT JOIN joined j ON j.id = d.doc_id""",
        "merge_ranges": _matches(reduce=False) + """, wide AS (SELECT id, s - 5 AS s, e + 5 AS e FROM m),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM wide),
isles AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked)
SELECT id AS doc_id, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e FROM isles GROUP BY id, g""",
        "batch_validate": f"SELECT id, {batch} AS code FROM ({items})",
        "batch_summary": f"""{_matches()}, c AS (SELECT doc_id, {batch} AS code FROM ({items}))
SELECT count(*) AS total, count(*) FILTER (code = 'OK') AS succeeded, count(*) FILTER (code <> 'OK') AS failed,
  count(*) FILTER (code = 'OK' AND EXISTS (SELECT 1 FROM m WHERE m.id = c.doc_id)) AS matched FROM c""",
        "batch_default_ids": f"SELECT count(*) AS items, count(*) AS ids, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) FILTER ({batch} = 'OK') AS good FROM documents",
        "traditional_hits": f"""WITH p AS (
  SELECT doc_id, unnest(string_split(text, w)) AS a, generate_subscripts(string_split(text, w), 1) AS k, len(string_split(text, w)) AS n, term, w
  FROM (SELECT doc_id, replace(replace(text, 'License', chr(1) || chr(1)), 'license', chr(2) || chr(2)) AS text FROM documents), (VALUES (chr(1) || chr(1), '\u7535\u8bdd'), (chr(2) || chr(2), '\u94f6\u836f')) v(w, term) WHERE contains(text, w)),
q AS (SELECT *, CAST(sum(length(a) + 2) OVER (PARTITION BY doc_id, term ORDER BY k ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM p)
SELECT doc_id, term, CAST(e - 2 AS INTEGER) AS s, e, 'normalized' AS match_type FROM q WHERE k < n""",
        "pattern_groups": f"{words} SELECT form, count(*) AS terms, arg_max(term, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * 1000000 - term_index) AS picked FROM e WHERE NOT needs_review AND length(term) >= 2 GROUP BY form",
        "automaton_stats": f"""{words}, f AS (SELECT DISTINCT form FROM e WHERE NOT needs_review AND length(term) >= 2), p AS (SELECT DISTINCT left(form, k) AS prefix FROM (SELECT form, unnest(range(1, length(form) + 1)) AS k FROM f))
SELECT (SELECT count(*) FROM f) AS pattern_count, count(*) + 1 AS node_count, count(*) AS edge_count, CAST(0 AS BIGINT) AS skipped_terms FROM p""",
        "detect_language": """WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents)
SELECT CASE WHEN regexp_matches(w, '[A-Za-z\u00c0-\u024f]') AND NOT regexp_matches(w, '[^\\x00-\\x7F\u00c0-\u024f]') THEN 'en' ELSE 'other' END AS language, count(*) AS n FROM w WHERE w <> '' GROUP BY 1""",
        "inspect_term": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents),
i AS (SELECT doc_id, pos, CASE WHEN line = '' THEN 'empty' ELSE {INSPECT} END AS issues FROM l) SELECT * FROM i WHERE issues <> ''""",
        "derive_category_id": r"""WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages),
s AS (SELECT page_id, regexp_replace(lower(regexp_replace(name, '(.)\.[^.]*$', '\1')), '[\s_]+', '-', 'g') AS t FROM b),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}-]+', '', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g') AS slug FROM s)
SELECT page_id, CASE WHEN slug = '' THEN 'uncategorized' ELSE slug END AS category FROM c""",
        "dedupe_attribution": f"WITH {whole} SELECT term, category, severity, source_path, first_path, files - 1 AS others, needs_review, language FROM terms",
        "build_report_counters": f"""WITH {whole} SELECT CAST(sum(lines) AS BIGINT) AS lines, count(*) AS terms, CAST(sum(files - 1) AS BIGINT) AS cross_source, CAST(sum(reassigned) AS BIGINT) AS reassigned,
count(*) - count(DISTINCT replace(lower(term), chr(10), ' ')) AS collisions, count(*) FILTER (needs_review) AS needs_review FROM terms""",
        "issue_counts": f"WITH {whole} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM lines JOIN known USING (term)) GROUP BY 1",
        "per_category": f"WITH {whole} SELECT c.category, c.severity, count(t.term) AS n FROM cats c LEFT JOIN terms t USING (category) GROUP BY ALL",
        "per_source": f"WITH {whole} SELECT first_path, count(*) AS n FROM terms GROUP BY 1",
        "snapshot_diff": f"""WITH b AS ({SNAP.format(rows="SELECT 'f' || (doc_id % 50) AS path, source AS term FROM documents")}),
a AS ({SNAP.format(rows="SELECT CASE WHEN turn = 0 THEN 'n' || (conv_id % 5) ELSE 'f' || (conv_id % 40) END AS path, 'src' || turn AS term FROM conversations")})
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CAST(len(list_filter(coalesce(a.terms, []), lambda x: NOT list_contains(coalesce(b.terms, []), x))) AS BIGINT) AS added,
  CAST(len(list_filter(coalesce(b.terms, []), lambda x: NOT list_contains(coalesce(a.terms, []), x))) AS BIGINT) AS removed
FROM b FULL JOIN a ON a.path = b.path WHERE a.terms IS DISTINCT FROM b.terms""",
        "artifact_round_trip": f"{words} SELECT term_index, category || ':' || term_index AS id, term, form AS normalized, language, category, severity, needs_review, others FROM e",
        "artifact_validation": f"""{words}, n AS (SELECT count(*) AS n, count(*) FILTER (category = (SELECT max(category) FROM e)) AS last FROM e)
SELECT 'error' AS level, unnest(['termCount is ' || n || ' but the artifact contains ' || 2 * n || ' terms', 'column "categoryIndex" has ' || n || ' values but there are ' || 2 * n || ' terms',
  'column "severityIndex" has ' || n || ' values but there are ' || 2 * n || ' terms', 'column "languageIndex" has ' || n || ' values but there are ' || 2 * n || ' terms',
  'column "flags" has ' || (n + 1) || ' values but there are ' || 2 * n || ' terms', n || ' duplicated term(s) in the artifact', (n + last) || ' term(s) reference an unknown category index']) AS message FROM n""",
        "lexicon_categories": f"""{words} SELECT c.category AS id, c.severity, count(e.term) FILTER (enabled AND NOT needs_review AND length(term) >= 2) AS term_count, any_value(enabled) AS default_enabled
FROM cats c LEFT JOIN e USING (category) GROUP BY c.category, c.severity""",
        "category_by_source_rollup": _matches() + " SELECT d.source, category, count(*) AS hits, count(DISTINCT m.id) AS docs FROM m JOIN documents d ON d.doc_id = m.id GROUP BY ALL",
        "toxic_label_confusion": f"{_matches()}, r AS (SELECT d.doc_id, {DECIDE} AS decision FROM documents d LEFT JOIN m ON m.id = d.doc_id GROUP BY d.doc_id) SELECT toxic, decision, count(*) AS n FROM r JOIN labels USING (doc_id) GROUP BY ALL",
        "lexicon_select_default": f"{words} {select.format(where=f'category NOT IN ({off}) AND NOT needs_review AND length(term) >= 4')}",
        "lexicon_select_all": f"{words} {select.format(where='true')}",
        "lexicon_select_explicit": f"""{words} {select.format(where="category IN ('beta', 'gamma') AND NOT needs_review AND length(term) >= 4")}""",
    }
