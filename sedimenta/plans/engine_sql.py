"""SQL counterparts of the engine's queries."""

from __future__ import annotations

from sedimenta.functions.text import analyze
from sedimenta.operators.context import COMPARATORS
from sedimenta.plans.engine import EVENTS_NOW, NOW, TOPICS

CURRENT = """current AS (
  SELECT caseid, primaryid, quarter, caseversion, fda_dt_raw, fda_dt, n_versions, n_versions - 1 AS superseded,
    EXISTS (SELECT 1 FROM faers_deleted_case d WHERE d.caseid = r.caseid) AS is_deleted
  FROM (SELECT *, count(*) OVER (PARTITION BY caseid) AS n_versions,
      row_number() OVER (PARTITION BY caseid ORDER BY fda_dt DESC NULLS LAST, fda_dt_raw DESC NULLS LAST, primaryid DESC NULLS LAST, quarter DESC NULLS LAST, caseversion DESC NULLS LAST) AS rn
    FROM faers_demo WHERE caseid IS NOT NULL) r
  WHERE rn = 1)"""


def _grain(table: str, key: tuple[str, ...], unique: bool, source: str | None = None) -> str:
    cols = ", ".join(key)
    return f"""
SELECT '{table}' AS "table", '{" + ".join(key)}' AS key, {str(unique).lower()} AS "unique", sum(n)::BIGINT AS rows, count(*)::BIGINT AS distinct_keys,
  count(*) FILTER (WHERE n > 1)::BIGINT AS repeated_keys, sum(n - 1)::BIGINT AS excess_rows, count(*) FILTER (WHERE d > 1)::BIGINT AS conflicting_keys,
  sum(n - d)::BIGINT AS identical_rows, max(n)::BIGINT AS worst_group, round(sum(n) / count(*), 6) AS fan_out
FROM (SELECT {cols}, sum(m) AS n, count(*) AS d FROM (SELECT {cols}, md5(t::VARCHAR) AS h, count(*) AS m FROM {source or table} t GROUP BY ALL) GROUP BY {cols})"""


GRAIN = f"WITH {CURRENT} " + " UNION ALL ".join(
    [
        _grain("faers_demo", ("quarter", "primaryid"), True),
        _grain("faers_deleted_case", ("quarter", "caseid"), True),
        _grain("faers_case_current", ("caseid",), True, "current"),
        _grain("faers_drug", ("quarter", "primaryid", "drug_seq"), False),
        _grain("faers_reac", ("quarter", "primaryid", "pt"), False),
        _grain("aact_studies", ("snapshot", "nct_id"), True),
    ]
)

LATEST = "latest AS (SELECT * FROM load_run WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY source, partition, table_name ORDER BY id DESC) = 1)"


def _counts(names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS t, count(*)::BIGINT AS n FROM {n}" for n in names)


def _orphans(child: str) -> str:
    return f"""
SELECT '{child}' AS child, 'faers_demo' AS parent, partition, orphan_rows, orphan_keys, explained_rows, explained_keys, orphan_rows - explained_rows AS unexplained_rows FROM (
  SELECT c.quarter AS partition, count(*)::BIGINT AS orphan_rows, count(DISTINCT c.primaryid)::BIGINT AS orphan_keys,
    count(*) FILTER (WHERE r.key_hint IS NOT NULL)::BIGINT AS explained_rows, count(DISTINCT c.primaryid) FILTER (WHERE r.key_hint IS NOT NULL)::BIGINT AS explained_keys
  FROM {child} c LEFT JOIN (SELECT DISTINCT partition, key_hint FROM load_reject WHERE table_name = 'faers_demo' AND key_hint IS NOT NULL) r ON r.key_hint = c.primaryid::VARCHAR AND r.partition = c.quarter
  WHERE NOT EXISTS (SELECT 1 FROM faers_demo p WHERE p.quarter = c.quarter AND p.primaryid = c.primaryid) GROUP BY 1)"""


def _profile(child: str, key: str, parent: str, parent_key: str) -> str:
    """Rows and keys of one reference; none of these tables has orphans of its own to hand down."""
    return f"""SELECT '{child}' AS child_table, '{parent}' AS parent_table, count(*)::BIGINT AS child_rows, (count(DISTINCT {key}) + coalesce(max(({key} IS NULL)::INT), 0))::BIGINT AS child_keys,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{key}))::BIGINT AS direct_rows, 0::BIGINT AS inherited_rows FROM {child} c"""


INTEGRITY_ORDERS = " UNION ALL ".join(
    [
        _profile("nation", "n_regionkey", "region", "r_regionkey"),
        _profile("customer", "c_nationkey", "nation", "n_nationkey"),
        _profile("supplier", "s_nationkey", "nation", "n_nationkey"),
        _profile("orders", "o_custkey", "customer", "c_custkey"),
        _profile("lineitem", "l_orderkey", "orders", "o_orderkey"),
        _profile("lineitem", "l_partkey", "part", "p_partkey"),
        _profile("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ]
)


def _precision(table: str, column: str) -> str:
    f = lambda v: f"count(*) FILTER (WHERE {column}_prec = '{v}')::BIGINT AS \"{v}\""
    return f"""SELECT '{table}' AS "table", '{column}' AS "column", *, rows - absent AS present, "month" + "year" + invalid AS partial_or_invalid,
  CASE WHEN rows > absent THEN round(("month" + "year" + invalid) / (rows - absent), 6) ELSE 0.0 END AS partial_share
  FROM (SELECT count(*)::BIGINT AS rows, {f('day')}, {f('month')}, {f('year')}, {f('invalid')}, count(*) FILTER (WHERE {column}_prec IS NULL)::BIGINT AS absent FROM {table})"""


def _inventory(table: str, partition: str) -> str:
    return f"SELECT '{table}' AS \"table\", count(*)::BIGINT AS rows, array_to_string(list_sort(list(DISTINCT {partition}::VARCHAR) FILTER (WHERE {partition} IS NOT NULL)), ',') AS partitions FROM {table}"


def _dates(column: str) -> str:
    raw = f"nullif(trim({column}_raw, ' \t'), '')"
    year = "substr(raw, 1, 4)::INT BETWEEN 1900 AND 2100"
    return f"""
SELECT field, raw, prec, exact, sum(n)::BIGINT AS n FROM (
  SELECT field, raw, n, CASE WHEN raw IS NULL THEN NULL WHEN good THEN 'day' WHEN NOT regexp_full_match(raw, '[0-9]+') THEN 'invalid'
      WHEN length(raw) = 6 AND {year} AND substr(raw, 5, 2)::INT BETWEEN 1 AND 12 THEN 'month' WHEN length(raw) = 4 AND {year} THEN 'year' ELSE 'invalid' END AS prec,
    CASE WHEN good THEN strftime(try_strptime(raw, '%Y%m%d'), '%Y-%m-%d') END AS exact
  FROM (SELECT *, CASE WHEN regexp_full_match(raw, '[0-9]{{8}}') THEN try_strptime(raw, '%Y%m%d') IS NOT NULL AND {year} ELSE false END AS good
    FROM (SELECT '{column}' AS field, {raw} AS raw, count(*) AS n FROM faers_demo GROUP BY 2)))
GROUP BY ALL"""


PARSE_NUMBERS = """
SELECT age, wt, e_sub, coalesce(CASE WHEN regexp_full_match(trim(age), '[+-]?[0-9]+') THEN try_cast(trim(age) AS BIGINT) END, trunc(try_cast(trim(age) AS DOUBLE))::BIGINT) AS age_int,
  try_cast(trim(wt) AS DOUBLE) AS wt_num, CASE WHEN lower(trim(e_sub)) IN ('t', 'true', 'y', 'yes', '1') THEN true WHEN lower(trim(e_sub)) IN ('f', 'false', 'n', 'no', '0') THEN false END AS e_sub_flag, count(*)::BIGINT AS n
FROM faers_demo GROUP BY age, wt, e_sub
"""

DELIMITED_SPLIT = r"""
WITH lines AS (SELECT load_id::VARCHAR AS archive, table_name AS member, line_no, regexp_replace(regexp_replace(raw_line, '\r$', ''), '^\x{FEFF}', '') AS line FROM raw_member_line),
shown AS (SELECT *, CASE WHEN starts_with(member, 'aact_') THEN '|' ELSE '$' END AS d FROM lines WHERE line IS NOT NULL AND NOT regexp_full_match(line, '[\s\x0B]*')),
heads AS (SELECT archive, member, min(line_no) AS no, list_transform(string_split(arg_min(line, line_no), any_value(d)), lambda x: lower(trim(x, ' ' || chr(9)))) AS names FROM shown GROUP BY 1, 2),
cells AS (SELECT s.archive, s.member, s.line_no, h.names, list_transform(string_split(line, d), lambda x: nullif(trim(x, ' ' || chr(9)), '')) AS f FROM shown s JOIN heads h ON s.archive = h.archive AND s.member = h.member AND s.line_no > no),
told AS (SELECT archive, member, len(names) AS want, len(f) AS got, CASE WHEN starts_with(member, 'aact_') THEN 'id' ELSE 'primaryid' END AS k, f[list_position(names, CASE WHEN starts_with(member, 'aact_') THEN 'id' ELSE 'primaryid' END)] AS v FROM cells)
SELECT archive, member, CASE WHEN want <> got THEN 'expected ' || want || ' fields, got ' || got
  WHEN try_cast(v AS DOUBLE) IS NULL OR NOT isfinite(try_cast(v AS DOUBLE)) THEN k || '=' || CASE WHEN v IS NULL THEN 'None' ELSE '''' || v || '''' END || ' is not an integer' END AS reason, count(*)::BIGINT AS n
FROM told GROUP BY ALL
"""

PART_LINES = """
SELECT p_partkey AS line_no, CASE WHEN p_partkey % 7 = 0 THEN 'expected 4 fields, got 5' END AS reason, p_partkey::VARCHAR AS key_hint,
  CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size FROM part
"""

NORMALIZE_APPLICATIONS = r"""
WITH a AS (
  SELECT coalesce(application_number, '') AS n, coalesce(sponsor_name, '') AS s, openfda AS o, list_filter(coalesce(products, []), lambda p: p IS NOT NULL) AS p, list_filter(coalesce(submissions, []), lambda p: p IS NOT NULL) AS u FROM openfda_drugsfda),
b AS (
  SELECT *, list_filter(list_transform(p, lambda x: x.brand_name), lambda x: x IS NOT NULL AND x <> '') AS brands,
    list_filter(flatten(list_transform(p, lambda x: list_transform(list_filter(coalesce(x.active_ingredients, []), lambda i: i IS NOT NULL), lambda i: i.name))), lambda x: x IS NOT NULL AND x <> '') AS ing,
    list_max(list_filter(list_transform(u, lambda x: x.submission_status_date), lambda x: x IS NOT NULL AND regexp_full_match(x, '[0-9]+'))) AS latest,
    upper(regexp_extract(n, '^[A-Za-z]+')) AS prefix, regexp_extract(n, '[0-9]+') AS digits,
    list_sort(list_distinct(list_filter(list_transform(p, lambda x: x.marketing_status), lambda x: x IS NOT NULL AND x <> ''))) AS ms FROM a)
SELECT n AS doc_id, coalesce(brands[1], nullif(o.brand_name[1], ''), nullif(o.generic_name[1], ''), nullif(n, ''), '(unnamed application)') AS title,
  coalesce(nullif(array_to_string(list_filter(list_transform(list_concat(brands, coalesce(o.generic_name, []), ing, [s]), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> ''), ' '), ''), coalesce(brands[1], nullif(o.brand_name[1], ''), nullif(o.generic_name[1], ''), nullif(n, ''), '(unnamed application)')) AS embed_text,
  CASE WHEN digits <> '' THEN 'https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?event=overview.process&ApplNo=' || digits ELSE '' END AS url,
  CASE prefix WHEN '' THEN '(unknown)' WHEN 'ANDA' THEN 'ANDA (generic)' WHEN 'NDA' THEN 'NDA (brand)' WHEN 'BLA' THEN 'BLA (biologic)' ELSE prefix END AS application_type,
  CASE WHEN len(list_filter(u, lambda x: x.submission_status = 'AP')) > 0 THEN 'true' ELSE 'false' END AS is_approved,
  '[' || array_to_string(list_transform(ms, lambda x: '"' || x || '"'), ',') || ']' AS marketing_statuses, latest AS latest_submission_status_date,
  CASE WHEN len(p) > 0 THEN 'true' ELSE 'false' END AS has_products, coalesce(strftime(try_strptime(CASE WHEN length(latest) = 8 THEN latest END, '%Y%m%d'), '%Y-%m-%d'), '2025-06-30') AS updated
FROM b
"""

def _payloads(source: str) -> str:
    return f"d AS (SELECT *, json(structured) AS j FROM documents WHERE source = '{source}' AND json_valid(structured))"


def _opened(name: str) -> str:
    """A member of a payload; JSON written inside a string counts as what it says."""
    return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' AND json_valid(j ->> '$.{name}') THEN json(j ->> '$.{name}') ELSE json_extract(j, '$.{name}') END"


_UPDATED = f"coalesce(strftime(updated_at, '%Y-%m-%d'), '{NOW[:10]}')"
_TITLE = "coalesce(nullif(title, ''), '(no title)')"

NORMALIZE_TRIALS = f"""
WITH {_payloads("clinical")}
SELECT coalesce(j ->> '$.nct_id', '') AS doc_id, {_TITLE} AS title, CASE WHEN coalesce(j ->> '$.nct_id', '') <> '' THEN 'https://clinicaltrials.gov/study/' || (j ->> '$.nct_id') ELSE '' END AS url, {_UPDATED} AS updated,
  j ->> '$.status' AS status, j ->> '$.phase' AS phase, coalesce(CASE WHEN json_type(j, '$.conditions') = 'ARRAY' THEN json_array_length(j, '$.conditions') END, 0)::INT AS conditions,
  coalesce(CASE WHEN json_type(j, '$.interventions') = 'ARRAY' THEN len(list_filter(CAST(json_extract(j, '$.interventions') AS VARCHAR[]), lambda x: x IS NOT NULL AND x <> '')) END, 0)::INT AS interventions FROM d
"""

NORMALIZE_LABELS = f"""
WITH {_payloads("openfda_label")}
SELECT coalesce(native_id, '') AS doc_id, coalesce(nullif(j ->> '$.brand_name[0]', ''), nullif(j ->> '$.generic_name[0]', ''), nullif(title, ''), '(unnamed label)') AS title,
  CASE WHEN coalesce(j ->> '$.set_id', '') <> '' THEN 'https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid=' || (j ->> '$.set_id') ELSE '' END AS url, {_UPDATED} AS updated, j ->> '$.version' AS version,
  CASE WHEN (j ->> '$.has_boxed_warning') = 'true' THEN 'true' ELSE 'false' END AS boxed FROM d WHERE json_array_length(j, '$.brand_name') > 0
"""

NORMALIZE_EVENTS = f"""
WITH {_payloads("openfda_event")},
o AS (SELECT *, {_opened("drugs")} AS dj, {_opened("reactions")} AS rj FROM d),
e AS (SELECT *, CAST(dj AS JSON[]) AS ds, CAST(rj AS VARCHAR[]) AS rs FROM o WHERE json_type(dj) = 'ARRAY' AND json_type(rj) = 'ARRAY'),
f AS (SELECT *, list_filter(ds, lambda x: json_type(x) = 'OBJECT') AS arms FROM e)
SELECT coalesce(j ->> '$.safetyreportid', '') AS doc_id,
  coalesce(list_filter(list_transform(arms, lambda x: x ->> '$.name'), lambda x: x IS NOT NULL AND trim(x) <> '')[1], '(unknown drug)') || ' → ' || coalesce(list_filter(rs, lambda x: x IS NOT NULL AND trim(x) <> '')[1], '(unspecified reaction)') AS title,
  'https://api.fda.gov/drug/event.json?search=safetyreportid:"' || coalesce(j ->> '$.safetyreportid', '') || '"' AS url, {_UPDATED} AS updated, j ->> '$.serious' AS serious,
  array_to_string(list_transform(arms, lambda x: CASE WHEN (x ->> '$.role') IN ('suspect', 'concomitant', 'interacting') THEN x ->> '$.role' ELSE 'unknown' END), ',') AS roles FROM f
"""

NORMALIZE_RECALLS = f"""
WITH {_payloads("openfda_enforcement")}
SELECT coalesce(j ->> '$.recall_number', '') AS doc_id, coalesce(nullif(j ->> '$.classification', ''), '(unclassified)') || ' — ' || coalesce(nullif(j ->> '$.recalling_firm', ''), '(unknown firm)') AS title,
  'https://api.fda.gov/drug/enforcement.json?search=recall_number:"' || coalesce(j ->> '$.recall_number', '') || '"' AS url, {_UPDATED} AS updated, j ->> '$.status' AS status, j ->> '$.recalling_firm' AS firm FROM d
"""

PAYLOAD_FIELDS = r"""
WITH d AS (SELECT doc_id, native_id, CASE WHEN json_valid(structured) THEN json(structured) END AS j FROM documents WHERE source = 'clinical')
SELECT doc_id, j ->> '$.nct_id' AS nct_id, j ->> '$.status' AS status, j ->> '$.interventions[0]' AS first_intervention, regexp_full_match(native_id, 'NCT[0-9]{8}') AS good_id FROM d
"""

TEXT_SCALARS = f"""
SELECT doc_id, sha256(trim(native_id)) AS digest, left(sha256(trim(native_id)), 12) AS key_id,
  CASE WHEN ingested_at IS NULL THEN 'never' WHEN s < 0 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' ELSE (s // 86400)::VARCHAR || 'd ago' END AS age,
  CASE WHEN native_id IS NOT NULL THEN 'https://x.test/q?api_key=***&id=' || doc_id END AS url, left(text, 40) AS head
FROM (SELECT *, (epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(date_trunc('second', ingested_at))::BIGINT) AS s FROM documents)
"""


def _knn(k: int, within: bool) -> str:
    part = "q.vec_id, d.label" if within else "q.vec_id"
    label = ", label" if within else ""
    return f"""
SELECT query_id{label}, doc_id, round(s, 6) AS similarity, place::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id{label} ORDER BY s DESC, doc_id) AS place FROM (
    SELECT q.vec_id AS query_id, d.label::VARCHAR AS label, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS s
    FROM embeddings q JOIN embeddings d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)) WHERE place <= {k}"""


_WORDS = r"[^\p{L}\p{N}]+"
_TERMS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', title, text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_RANK = "round(sum(1.0 + ln(tf)) / (1.0 + ln(1.0 + max(length))), 9)"


def _index(scope: str = "SELECT doc_id, source, title, text FROM documents") -> str:
    return f"""docs AS (SELECT doc_id, source, title, {_TERMS} AS terms FROM ({scope})),
postings AS (SELECT term, doc_id, length, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM docs) GROUP BY ALL)"""


def _topics(topics) -> str:
    rows = [(q, t, len(set(analyze(x, False)))) for q, x in topics for t in sorted(set(analyze(x, False)))]
    return "wanted AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}', {n})" for q, t, n in rows) + ") AS v(query_id, term, wanted))"


def _fts(every: bool) -> str:
    return f"""
WITH {_index()}, {_topics(TOPICS)},
scored AS (SELECT query_id, doc_id, {_RANK} AS rank FROM postings JOIN wanted USING (term) GROUP BY query_id, doc_id {'HAVING count(*) = max(wanted)' if every else ''})
SELECT query_id::BIGINT AS query_id, doc_id, round(rank, 6) AS rank, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS place FROM scored) WHERE place <= 10
"""


HYBRID = f"""
WITH {_index("SELECT doc_id, source, title, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")},
asked AS (SELECT d.doc_id AS query_id, e.embedding AS qe, d.title FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 20 = 0),
near AS (SELECT query_id, d.doc_id, round(list_cosine_similarity(qe::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM asked CROSS JOIN docs d JOIN embeddings e ON e.vec_id = d.doc_id),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rv FROM near),
q AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM asked),
wanted AS (SELECT query_id, len(t) AS wanted, unnest(t) AS term FROM q),
lex AS (SELECT query_id, doc_id, {_RANK} AS rank FROM postings JOIN wanted USING (term) GROUP BY query_id, doc_id HAVING count(*) = max(wanted)),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS rx FROM lex),
f AS (SELECT v.query_id, v.doc_id, similarity, round(1.0::DOUBLE / (60.0::DOUBLE + rv) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + rx), 0.0), 12) AS score FROM v LEFT JOIN x ON v.query_id = x.query_id AND v.doc_id = x.doc_id)
SELECT query_id, doc_id, place::INT AS place, round(similarity, 6) AS similarity, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC, doc_id) AS place FROM f) WHERE place <= 10
"""

def _comparator(name: str) -> str:
    spoken = f"' ' || regexp_replace(lower({name}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    return "(" + " OR ".join(f"contains({spoken}, ' {c} ')" for c in COMPARATORS) + ")"


TRIAL_CONTEXT = f"""
WITH {_index("SELECT doc_id, source, title, text FROM documents WHERE starts_with(source, 'openfda_')")},
trials AS (SELECT doc_id AS trial, CASE WHEN json_valid(structured) THEN json_extract(json(structured), '$.interventions') END AS j FROM documents WHERE source = 'clinical' AND structured IS NOT NULL),
names AS (SELECT trial, unnest(CAST(j AS VARCHAR[])) AS name, generate_subscripts(CAST(j AS VARCHAR[]), 1) AS nth FROM trials WHERE json_type(j) = 'ARRAY'),
drugs AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY nth) AS n FROM names WHERE name IS NOT NULL AND trim(name) <> ''
  AND NOT {_comparator('name')}),
kept AS (SELECT DISTINCT trial, name FROM drugs WHERE n <= 5),
terms AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM (SELECT DISTINCT name FROM kept)),
wanted AS (SELECT name, len(t) AS wanted, unnest(t) AS term FROM terms),
met AS (SELECT name, doc_id, {_RANK} AS rank FROM postings JOIN wanted USING (term) GROUP BY name, doc_id HAVING count(*) = max(wanted)),
best AS (SELECT name, d.source, m.doc_id, rank, row_number() OVER (PARTITION BY name, d.source ORDER BY rank DESC, m.doc_id) AS place FROM met m JOIN docs d USING (doc_id))
SELECT trial, name, source, doc_id, round(rank, 6) AS rank, place::INT AS place FROM kept JOIN best USING (name) WHERE place <= 3
"""

DRUG_PROFILES = f"""
WITH {_index("SELECT doc_id, source, title, text FROM documents WHERE source IN ('openfda_label', 'openfda_event', 'openfda_enforcement')")},
names AS (SELECT DISTINCT json_extract_string(json(structured), '$.brand_name[0]') AS name FROM documents WHERE source = 'openfda_label' AND doc_id % 20 = 0 AND json_valid(structured)),
terms AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM names WHERE name IS NOT NULL),
wanted AS (SELECT name, len(t) AS wanted, unnest(t) AS term FROM terms),
met AS (SELECT name, doc_id, {_RANK} AS rank FROM postings JOIN wanted USING (term) GROUP BY name, doc_id HAVING count(*) = max(wanted)),
best AS (SELECT name, d.source, m.doc_id, rank, row_number() OVER (PARTITION BY name, d.source ORDER BY rank DESC, m.doc_id) AS place FROM met m JOIN docs d USING (doc_id))
SELECT name, source, doc_id, round(rank, 6) AS rank, place::INT AS place FROM best WHERE place <= CASE source WHEN 'openfda_event' THEN 5 ELSE 3 END
"""

_WHITE = r"[\p{Z}\s\x0B\x{0085}]"
SAFETY_PROFILES = f"""
WITH p AS ({DRUG_PROFILES}),
t AS (SELECT doc_id, title, structured, regexp_replace(text, '{_WHITE}+', ' ', 'g') AS t FROM documents)
SELECT p.name, p.source, p.doc_id, p.place, title, regexp_replace(substr(t, greatest(instr(lower(t), 'take'), 1), 160), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS excerpt,
  concat_ws(',', CASE WHEN json_valid(structured) AND (json(structured) ->> '$.has_boxed_warning') = 'true' THEN 'boxed warning' END, CASE WHEN json_valid(structured) AND (json(structured) ->> '$.serious') = '1' THEN 'serious' END) AS flags
FROM p JOIN t ON p.doc_id = t.doc_id
"""

FTS_PLAIN_LANGUAGE = f"""
WITH t AS (SELECT doc_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS t FROM documents)
SELECT doc_id FROM t WHERE contains(t, ' heart ') AND (contains(t, ' failure ') OR contains(t, ' asthma ')) AND NOT contains(t, ' placebo ') AND contains(t, ' dose ') AND contains(t, ' heart failure ')
"""

ACCESS_LADDER = f"""
WITH used AS (SELECT user_id, count(*) AS used FROM events WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAYS GROUP BY 1),
calls AS (SELECT event_type AS tool, user_id, user_id % 10 <> 0 AS sent, c_custkey IS NOT NULL AS known, c_acctbal >= 0 AS active, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'BUILDING' END AS plan
  FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON user_id = c_custkey)
SELECT tool, CASE WHEN tool = 'signup' THEN NULL WHEN sent IS NOT TRUE THEN 'missing_key' WHEN NOT known OR NOT active THEN 'invalid_key' WHEN tool = 'purchase' AND plan <> 'AUTOMOBILE' THEN 'not_permitted'
  WHEN coalesce(used, 0) >= CASE plan WHEN 'AUTOMOBILE' THEN 60 WHEN 'BUILDING' THEN 40 END THEN 'rate_limit' END AS reason, count(*)::BIGINT AS calls
FROM calls LEFT JOIN used USING (user_id) GROUP BY ALL
"""

INGEST_COUNTS = r"""
SELECT count(*)::BIGINT AS fetched, count(*) FILTER (WHERE NOT ok)::BIGINT AS skipped, count(DISTINCT CASE WHEN ok THEN source || '/' || native_id END)::BIGINT AS "unique",
  (count(*) FILTER (WHERE ok) - count(DISTINCT CASE WHEN ok THEN source || '/' || native_id END))::BIGINT AS duplicates
FROM (SELECT *, coalesce(native_id, '') <> '' AND NOT regexp_full_match(coalesce(text, ''), '[\p{Z}\s\x0B\x{0085}]*') AS ok FROM documents)
"""

SOURCE_STATE = """
SELECT source, arg_max(status, k) AS status, CASE WHEN arg_max(status, k) = 'error' THEN nullif(left(arg_max(coalesce(notes, chr(1)), k), 500), chr(1)) END AS error, (max(started_at) FILTER (WHERE status = 'success'))::VARCHAR AS last_success
FROM (SELECT source || '/' || table_name AS source, status, notes, started_at, strftime(started_at, '%Y%m%d%H%M%S') || lpad(id::VARCHAR, 12, '0') AS k FROM load_run) GROUP BY source
"""

RETRIEVAL_EVAL = f"""
WITH {_index("SELECT doc_id, source, NULL::VARCHAR AS title, text FROM documents")},
q AS (SELECT doc_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '{_WORDS}'), lambda x: x <> '')) AS t FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
wanted AS (SELECT query_id, len(t) AS wanted, unnest(t) AS term FROM q),
met AS (SELECT query_id, doc_id, {_RANK} AS rank FROM postings JOIN wanted USING (term) GROUP BY query_id, doc_id HAVING count(*) = max(wanted)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS place FROM met),
f AS (SELECT q.query_id, min(place) AS place FROM q LEFT JOIN placed p ON p.query_id = q.query_id AND p.doc_id = q.query_id AND place <= 10 WHERE len(t) > 0 GROUP BY 1)
SELECT count(*)::BIGINT AS questions, {", ".join(f"round(avg(CASE WHEN place <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0 / place, 0.0)), 6) AS mrr FROM f
"""

CORPUS_STATUS = f"""
WITH c AS (SELECT source, count(*)::BIGINT AS documents, max(updated_at) FILTER (WHERE updated_at <= TIMESTAMP '{NOW}') AS newest FROM documents GROUP BY source),
s AS (SELECT source, max(finished_at) AS last_success FROM load_run WHERE status = 'success' GROUP BY source),
j AS (SELECT coalesce(c.source, s.source) AS source, coalesce(documents, 0)::BIGINT AS documents, newest, last_success, (epoch(TIMESTAMP '2026-03-01')::BIGINT - epoch(date_trunc('second', last_success))::BIGINT) AS t FROM c FULL JOIN s ON c.source = s.source)
SELECT source, documents, newest::VARCHAR AS newest, last_success::VARCHAR AS last_success,
  CASE WHEN last_success IS NULL THEN 'never' WHEN t < 0 THEN 'just now' WHEN t < 3600 THEN (t // 60)::VARCHAR || 'm ago' WHEN t < 86400 THEN (t // 3600)::VARCHAR || 'h ago' ELSE (t // 86400)::VARCHAR || 'd ago' END AS freshness FROM j
"""

DUE_SOURCES = """
WITH s AS (SELECT source, partition, table_name, max(finished_at) FILTER (WHERE status = 'success') AS last_success, CASE source WHEN 'faers' THEN 'weekly' WHEN 'aact' THEN 'daily' ELSE 'manual' END AS cadence FROM load_run GROUP BY 1, 2, 3)
SELECT source, partition, table_name, cadence, CASE WHEN cadence = 'manual' THEN false WHEN last_success IS NULL THEN true
  ELSE epoch(TIMESTAMP '2026-01-05 12:00:00')::BIGINT - epoch(date_trunc('second', last_success))::BIGINT >= 86400 * CASE cadence WHEN 'daily' THEN 1 ELSE 7 END END AS due FROM s
"""

UPSERT = """
SELECT source, native_id, doc_id, n_chars FROM documents WHERE native_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source, native_id ORDER BY (ingested_at >= TIMESTAMP '2025-01-01') DESC, ingested_at DESC NULLS LAST, doc_id DESC) = 1
"""

DEMO_SELECTION = f"""
WITH {_index()}, {_topics(TOPICS[:3])},
scored AS (SELECT query_id, doc_id, {_RANK} AS rank FROM postings JOIN wanted USING (term) GROUP BY query_id, doc_id HAVING count(*) = max(wanted)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS place FROM scored),
themes AS (SELECT doc_id, min(place) AS r FROM placed WHERE place <= 20 GROUP BY doc_id),
j AS (SELECT d.source, d.doc_id, d.updated_at, coalesce(r, 0) AS r, CASE WHEN d.doc_id % 500 = 1 THEN 0 WHEN r IS NOT NULL THEN 1 ELSE 2 END AS stage FROM documents d LEFT JOIN themes t ON d.doc_id = t.doc_id)
SELECT source, doc_id, CASE stage WHEN 0 THEN 'pinned' WHEN 1 THEN 'theme' ELSE 'newest' END AS why FROM j
QUALIFY row_number() OVER (PARTITION BY source ORDER BY stage, r, updated_at DESC NULLS LAST, doc_id) <= 30
"""

SQL = {
    "case_current": f"WITH {CURRENT} SELECT caseid, primaryid, quarter, caseversion, fda_dt_raw, strftime(fda_dt, '%Y-%m-%d') AS fda_dt, n_versions, superseded, is_deleted FROM current",
    "case_current_kept": f"WITH {CURRENT} SELECT caseid, primaryid FROM current WHERE NOT is_deleted",
    "grain": GRAIN,
    "grain_orders": _grain("orders", ("o_orderkey",), True) + " UNION ALL " + _grain("lineitem", ("l_orderkey", "l_linenumber"), False),
    "conservation_runs": "SELECT id, source, partition, table_name, rows_read, rows_loaded, rows_rejected FROM load_run WHERE status = 'success' AND rows_read <> rows_loaded + rows_rejected",
    "conservation_tables": f"WITH {LATEST}, n AS ({_counts(('faers_demo', 'faers_drug', 'faers_reac', 'faers_deleted_case', 'aact_studies'))}) SELECT table_name AS \"table\", sum(rows_loaded)::BIGINT AS claimed_by_load_runs, any_value(n) AS rows_in_table FROM latest JOIN n ON t = table_name GROUP BY table_name",
    "dedup_conservation": f"WITH {CURRENT} SELECT (SELECT count(*) FROM faers_demo) AS demo_rows, (SELECT count(caseid) FROM faers_demo) AS with_caseid, (SELECT count(*) FROM current) AS kept, (SELECT coalesce(sum(superseded), 0)::BIGINT FROM current) AS superseded, (SELECT count(*) FROM current WHERE is_deleted) AS deleted_cases",
    "integrity": _orphans("faers_drug") + " UNION ALL " + _orphans("faers_reac"),
    "integrity_orders": INTEGRITY_ORDERS,
    "reject_summary": f"WITH {LATEST} SELECT source, table_name, sum(rows_read)::BIGINT AS rows_read, sum(rows_rejected)::BIGINT AS rejected, count(notes)::BIGINT AS capped_runs, CASE WHEN sum(rows_read) = 0 THEN 0.0 ELSE round(sum(rows_rejected) / sum(rows_read), 6) END AS reject_rate FROM latest GROUP BY 1, 2 HAVING sum(rows_rejected) > 0",
    "reject_reasons": f"WITH {LATEST}, c AS (SELECT source, table_name, reason, count(*)::BIGINT AS n FROM load_reject WHERE load_id IN (SELECT id FROM latest) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, table_name ORDER BY n DESC, reason)::INT AS place FROM c) SELECT * FROM r WHERE place <= 3",
    "reject_totals": f"WITH {LATEST} SELECT (SELECT count(*) FROM load_reject WHERE load_id IN (SELECT id FROM latest)) AS stored, coalesce(sum(rows_rejected), 0)::BIGINT AS counted, count(notes)::BIGINT AS capped_runs FROM latest",
    "date_precision": " UNION ALL ".join(_precision(t, c) for t, c in (("faers_demo", "event_dt"), ("faers_demo", "fda_dt"), ("faers_drug", "exp_dt"))),
    "inventory": " UNION ALL ".join(_inventory(t, p) for t, p in (("faers_demo", "quarter"), ("faers_drug", "quarter"), ("faers_reac", "quarter"), ("faers_deleted_case", "quarter"), ("aact_studies", "strftime(snapshot, '%Y-%m-%d')"), ("load_run", "partition"), ("load_reject", "partition"))),
    "parse_dates": " UNION ALL ".join(_dates(c) for c in ("event_dt", "mfr_dt", "init_fda_dt", "fda_dt", "rept_dt")),
    "parse_numbers": PARSE_NUMBERS,
    "delimited_split": DELIMITED_SPLIT,
    "part_lines": PART_LINES,
    "normalize_applications": NORMALIZE_APPLICATIONS,
    "normalize_trials": NORMALIZE_TRIALS,
    "normalize_labels": NORMALIZE_LABELS,
    "normalize_events": NORMALIZE_EVENTS,
    "normalize_recalls": NORMALIZE_RECALLS,
    "payload_fields": PAYLOAD_FIELDS,
    "safety_profiles": SAFETY_PROFILES,
    "fts_plain_language": FTS_PLAIN_LANGUAGE,
    "access_ladder": ACCESS_LADDER,
    "event_props": "SELECT event_type, count(*)::BIGINT AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS sum_k, max((props::JSON ->> '$.k')::BIGINT) AS max_k FROM events GROUP BY event_type",
    "text_scalars": TEXT_SCALARS,
    "knn": _knn(10, False),
    "knn_per_label": _knn(3, True),
    "fts_and": _fts(True),
    "fts_or": _fts(False),
    "hybrid": HYBRID,
    "trial_context": TRIAL_CONTEXT,
    "drug_profiles": DRUG_PROFILES,
    "ingest_counts": INGEST_COUNTS,
    "source_state": SOURCE_STATE,
    "retrieval_eval": RETRIEVAL_EVAL,
    "corpus_status": CORPUS_STATUS,
    "usage_7d": f"SELECT event_type AS tool, count(*)::BIGINT AS calls, round(avg(value))::INT AS mean_ms, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors FROM events WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAYS GROUP BY 1",
    "rolling_30d": f"SELECT user_id::VARCHAR AS key, count(*)::BIGINT AS used, count(*) < 60 AS allowed FROM events WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAYS GROUP BY 1",
    "due_sources": DUE_SOURCES,
    "upsert_documents": UPSERT,
    "first_documents": "SELECT source, native_id, doc_id FROM documents WHERE native_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, native_id ORDER BY doc_id) = 1",
    "newest_documents": "SELECT source, doc_id, place::INT AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC NULLS LAST, doc_id) AS place FROM documents) WHERE place <= 5",
    "demo_selection": DEMO_SELECTION,
    "label_vectors": "WITH s AS (SELECT label, arg_min(embedding, vec_id) AS seed FROM embeddings GROUP BY label) SELECT e.label, count(*)::BIGINT AS n, round(avg(1.0 - list_cosine_similarity(e.embedding::DOUBLE[], seed::DOUBLE[])), 6) AS mean_distance FROM embeddings e JOIN s ON e.label = s.label GROUP BY 1",
}

