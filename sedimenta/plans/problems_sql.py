"""SQL counterparts of the general problems' queries, for an independent engine over the same tables."""

from __future__ import annotations

from sedimenta.plans.problems import AS_OF, DEMO_ATTRIBUTES

# ---------------------------------------------------------------- 1 nested records

#: What a JSON value says once JSON inside strings is opened (twice applied: two layers).
_OPEN = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN json({0} ->> '$') ELSE {0} END"


def _p1_rows() -> str:
    """Common table expressions with every object of every list: top_rows, sub_rows (JSON), prods, subm, ings, apps (typed)."""
    once = lambda x: _OPEN.format(x)

    def layers(source: str, keep: str) -> str:
        return f"SELECT {keep}, {once('v')} AS v FROM (SELECT {keep}, {once('v')} AS v FROM {source})"

    listed = "CASE json_type(v) WHEN 'OBJECT' THEN [v] WHEN 'ARRAY' THEN CAST(v AS JSON[]) ELSE [] END"
    keep = "record_key, path, parent_pos"
    return f"""
WITH docs AS (SELECT doc_id AS record_key, '' AS path, -1 AS parent_pos, json(structured) AS v FROM documents WHERE structured IS NOT NULL AND json_valid(structured)),
roots AS ({layers("docs", keep)}),
tops AS (
  SELECT record_key, name AS path, -1 AS parent_pos, json_extract(v, '$.' || name) AS v
  FROM roots, (VALUES ('products'), ('submissions'), ('drugs')) AS t(name) WHERE json_type(v) = 'OBJECT'),
top_open AS ({layers("tops", keep)}),
top_items AS (SELECT record_key, path, parent_pos, unnest(items) AS v, generate_subscripts(items, 1) - 1 AS pos FROM (SELECT record_key, path, parent_pos, {listed} AS items FROM top_open)),
top_rows AS (SELECT * FROM ({layers("top_items", keep + ", pos")}) WHERE json_type(v) = 'OBJECT'),
subs AS (
  SELECT record_key, path || '.' || name AS path, pos AS parent_pos, json_extract(v, '$.' || name) AS v
  FROM top_rows JOIN (VALUES ('products', 'active_ingredients'), ('submissions', 'application_docs')) AS t(top, name) ON path = top),
sub_open AS ({layers("subs", keep)}),
sub_items AS (SELECT record_key, path, parent_pos, unnest(items) AS v, generate_subscripts(items, 1) - 1 AS pos FROM (SELECT record_key, path, parent_pos, {listed} AS items FROM sub_open)),
sub_rows AS (SELECT * FROM ({layers("sub_items", keep + ", pos")}) WHERE json_type(v) = 'OBJECT'),
prods AS (SELECT record_id, unnest(products) AS p, generate_subscripts(products, 1) - 1 AS pos FROM openfda_drugsfda),
subm AS (SELECT record_id, unnest(submissions) AS s, generate_subscripts(submissions, 1) - 1 AS pos FROM openfda_drugsfda),
ings AS (SELECT record_id, pos AS parent_pos, unnest(p.active_ingredients) AS x, generate_subscripts(p.active_ingredients, 1) - 1 AS pos FROM prods),
apps AS (SELECT record_id, pos AS parent_pos, unnest(s.application_docs) AS x, generate_subscripts(s.application_docs, 1) - 1 AS pos FROM subm)
"""


P1_FOUND = f"""{_p1_rows()}
SELECT 'documents' AS source_table, record_key, path, parent_pos::INT AS parent_pos, pos::INT AS pos FROM (SELECT record_key, path, parent_pos, pos FROM top_rows UNION ALL SELECT record_key, path, parent_pos, pos FROM sub_rows)
UNION ALL SELECT 'openfda_drugsfda', record_id, 'products', -1, pos::INT FROM prods WHERE p IS NOT NULL
UNION ALL SELECT 'openfda_drugsfda', record_id, 'submissions', -1, pos::INT FROM subm WHERE s IS NOT NULL
UNION ALL SELECT 'openfda_drugsfda', record_id, 'products.active_ingredients', parent_pos::INT, pos::INT FROM ings WHERE x IS NOT NULL
UNION ALL SELECT 'openfda_drugsfda', record_id, 'submissions.application_docs', parent_pos::INT, pos::INT FROM apps WHERE x IS NOT NULL
"""

#: Leaves of every list, and where its typed objects are.
_LEAVES = {
    "products": ("prods", "p", "-1", ("product_number", "brand_name", "dosage_form", "route", "marketing_status")),
    "submissions": ("subm", "s", "-1", ("submission_type", "submission_number", "submission_status", "submission_status_date", "submission_class_code_description")),
    "products.active_ingredients": ("ings", "x", "parent_pos", ("name", "strength")),
    "submissions.application_docs": ("apps", "x", "parent_pos", ("id", "date", "type")),
    "drugs": (None, None, None, ("name", "role", "indication", "authorization_number")),
}


def p1_values() -> str:
    parts = []
    for path, (typed, x, parent, leaves) in _LEAVES.items():
        rows = "sub_rows" if "." in path else "top_rows"
        for leaf in leaves:
            parts.append(f"SELECT 'documents' AS source_table, record_key, path, parent_pos::INT AS parent_pos, pos::INT AS pos, '{leaf}' AS field, v ->> '$.{leaf}' AS value FROM {rows} WHERE path = '{path}'")
            if typed:
                parts.append(f"SELECT 'openfda_drugsfda', record_id, '{path}', {parent}::INT, pos::INT, '{leaf}', {x}.{leaf} FROM {typed} WHERE {x} IS NOT NULL")
    return f"{_p1_rows()} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


P1_INGREDIENTS = """
WITH prods AS (SELECT record_id, unnest(products) AS p FROM openfda_drugsfda),
ings AS (SELECT record_id, p, unnest(p.active_ingredients) AS x, generate_subscripts(p.active_ingredients, 1) - 1 AS pos FROM prods)
SELECT record_id AS record_key, p.product_number AS product_number, p.brand_name AS brand_name, pos::INT AS pos, x.name AS name, x.strength AS strength FROM ings WHERE x IS NOT NULL
"""

# ---------------------------------------------------------------- 2 history


def _valid(attributes: tuple[str, ...]) -> str:
    cols = ", ".join(f"coalesce(nullif(upper(trim(i_f_code)), ''), '?') AS i_f_code" if a == "i_f_code" else a for a in attributes)
    return f"""
ranked AS (
  SELECT caseid, caseversion, {cols}, CASE
      WHEN fda_dt_prec = 'day' AND fda_dt IS NOT NULL THEN fda_dt::DATE
      WHEN fda_dt_prec = 'month' THEN strptime(trim(fda_dt_raw) || '01', '%Y%m%d')::DATE
      WHEN fda_dt_prec = 'year' THEN strptime(trim(fda_dt_raw) || '0101', '%Y%m%d')::DATE
      ELSE make_date(substr(quarter, 1, 4)::INT, substr(quarter, 6, 1)::INT * 3 - 2, 1) END AS start,
    row_number() OVER (PARTITION BY caseid, caseversion ORDER BY quarter DESC) AS rn
  FROM faers_demo WHERE caseid IS NOT NULL AND caseversion IS NOT NULL),
ended AS (
  SELECT *, min(start) OVER (PARTITION BY caseid ORDER BY caseversion DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop
  FROM ranked WHERE rn = 1),
valid AS (SELECT * FROM ended WHERE stop IS NULL OR start < stop)"""


def p2(attributes: tuple[str, ...]) -> str:
    return f"WITH {_valid(attributes)} SELECT caseid, caseversion, {', '.join(attributes)}, strftime(start, '%Y-%m-%d') AS valid_from, coalesce(strftime(stop, '%Y-%m-%d'), 'open') AS valid_to FROM valid"


def p2_store() -> str:
    flags = " + ".join(f"CASE WHEN full_row OR {a} IS DISTINCT FROM lag({a}) OVER w THEN 1 ELSE 0 END" for a in DEMO_ATTRIBUTES)
    return f"""
WITH {_valid(DEMO_ATTRIBUTES)},
spans AS (SELECT *, floor(caseversion / 16) AS span FROM ended),
placed AS (SELECT *, row_number() OVER (PARTITION BY caseid, span ORDER BY caseversion) = 1 AS full_row FROM spans),
counted AS (SELECT caseid, full_row, {flags} AS kept FROM placed WINDOW w AS (PARTITION BY caseid, span ORDER BY caseversion))
SELECT caseid, count(*)::BIGINT AS versions, sum(full_row::INT)::BIGINT AS checkpoints, sum(kept)::BIGINT AS values_kept FROM counted GROUP BY caseid
"""


def p2_asof() -> str:
    return f"WITH {_valid(DEMO_ATTRIBUTES)} SELECT caseid, caseversion, {', '.join(DEMO_ATTRIBUTES)} FROM valid WHERE start <= DATE '{AS_OF}' AND (stop IS NULL OR stop > DATE '{AS_OF}')"


# ---------------------------------------------------------------- 3 orphans

P3_FOUND = """
WITH kids AS (SELECT DISTINCT 'faers_drug' AS child_table, quarter, primaryid, caseid FROM faers_drug UNION SELECT DISTINCT 'faers_reac', quarter, primaryid, caseid FROM faers_reac),
lost AS (SELECT * FROM kids k WHERE NOT EXISTS (SELECT 1 FROM faers_demo d WHERE d.quarter = k.quarter AND d.primaryid = k.primaryid)),
cases AS (SELECT child_table, quarter, primaryid, bool_or(EXISTS (SELECT 1 FROM faers_deleted_case x WHERE x.caseid = lost.caseid)) AS deleted FROM lost GROUP BY 1, 2, 3)
SELECT child_table, quarter, primaryid, CASE
  WHEN EXISTS (SELECT 1 FROM load_reject r WHERE r.table_name = 'faers_demo' AND r.partition = c.quarter AND regexp_replace(r.key_hint, '^[ \\t"]+|[ \\t"]+$', '', 'g') = c.primaryid::VARCHAR) THEN 'rejected'
  WHEN deleted THEN 'deleted'
  WHEN EXISTS (SELECT 1 FROM faers_demo d WHERE d.primaryid = c.primaryid AND d.quarter > c.quarter) THEN 'late'
  WHEN EXISTS (SELECT 1 FROM faers_demo d WHERE d.primaryid = c.primaryid AND d.quarter < c.quarter) THEN 'early'
  ELSE 'missing' END AS cause
FROM cases c
"""

P3_ORPHANS = f"""
WITH direct AS ({P3_FOUND}),
kids AS (SELECT DISTINCT 'faers_drug' AS child_table, quarter, primaryid FROM faers_drug UNION SELECT DISTINCT 'faers_reac', quarter, primaryid FROM faers_reac),
gone AS (SELECT DISTINCT d.quarter, d.primaryid FROM faers_demo d JOIN faers_deleted_case x ON x.caseid = d.caseid)
SELECT child_table, 'direct' AS kind, quarter, cause, count(*)::BIGINT AS keys FROM direct GROUP BY ALL
UNION ALL SELECT child_table, 'inherited', k.quarter, 'withdrawn', count(*)::BIGINT FROM kids k JOIN gone g ON g.quarter = k.quarter AND g.primaryid = k.primaryid GROUP BY ALL
"""

P3_TREE = """
WITH RECURSIVE v AS (SELECT caseid, caseversion, count(*) AS n FROM faers_demo WHERE caseid IS NOT NULL AND caseversion IS NOT NULL GROUP BY ALL),
lost AS (
  SELECT v.*, 0 AS depth FROM v WHERE caseversion > 1 AND NOT EXISTS (SELECT 1 FROM v b WHERE b.caseid = v.caseid AND b.caseversion = v.caseversion - 1)
  UNION ALL SELECT v.*, depth + 1 FROM v JOIN lost b ON b.caseid = v.caseid AND b.caseversion = v.caseversion - 1 WHERE v.caseversion > 1)
SELECT 'version' AS child_table, 'version' AS parent_table, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS kind, depth::INT AS depth, sum(n)::BIGINT AS orphan_rows, count(*)::BIGINT AS orphan_keys FROM lost GROUP BY depth
"""

P3_CASCADE = """
WITH bad_demo AS (SELECT *, 0 AS depth FROM faers_demo d WHERE d.caseid IS NULL OR d.caseid IN (SELECT caseid FROM faers_deleted_case WHERE caseid IS NOT NULL)),
kids AS (SELECT 'faers_drug' AS child_table, quarter, primaryid FROM faers_drug UNION ALL SELECT 'faers_reac', quarter, primaryid FROM faers_reac),
bad_kids AS (
  SELECT k.*, CASE WHEN NOT EXISTS (SELECT 1 FROM faers_demo d WHERE d.quarter = k.quarter AND d.primaryid = k.primaryid) THEN 0
    WHEN EXISTS (SELECT 1 FROM bad_demo b WHERE b.quarter = k.quarter AND b.primaryid = k.primaryid) THEN 1 END AS depth FROM kids k)
SELECT 'faers_demo' AS child_table, 'case' AS parent_table, 'direct' AS kind, 0 AS depth, quarter AS period, count(*)::BIGINT AS orphan_rows, (count(DISTINCT caseid) + max((caseid IS NULL)::INT))::BIGINT AS orphan_keys FROM bad_demo GROUP BY quarter
UNION ALL SELECT child_table, 'faers_demo', CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END, depth, quarter, count(*)::BIGINT, count(DISTINCT primaryid)::BIGINT FROM bad_kids WHERE depth IS NOT NULL GROUP BY child_table, depth, quarter
"""

# ---------------------------------------------------------------- 4 snapshot changes

STUDY_STRINGS = ("study_type", "overall_status", "last_known_status", "phase", "enrollment_type", "source", "source_class", "acronym", "brief_title", "official_title", "why_stopped", "start_date_type", "completion_date_type", "primary_completion_date_type")
STUDY_OTHERS = ("enrollment", "number_of_arms", "number_of_groups", "has_dmc", "is_fda_regulated_drug", "is_fda_regulated_device", "start_date", "completion_date", "primary_completion_date", "study_first_submitted_date", "study_first_posted_date", "last_update_submitted_date", "last_update_posted_date", "results_first_posted_date")


def _studies() -> str:
    loose = lambda c: f"lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    cols = ", ".join([f"{loose(c)} AS {c}" for c in STUDY_STRINGS] + list(STUDY_OTHERS))
    return f"""
days AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT snapshot AS day FROM aact_studies)),
one AS (SELECT snapshot, upper(nct_id) AS nct_id, {cols} FROM aact_studies QUALIFY row_number() OVER (PARTITION BY snapshot, upper(nct_id) ORDER BY aact_updated_at DESC NULLS LAST) = 1)"""


def p4_found() -> str:
    differs = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in (*STUDY_STRINGS, *STUDY_OTHERS))
    day = "strftime(day, '%Y-%m-%d') AS snapshot"
    return f"""
WITH {_studies()}
SELECT {day}, b.nct_id, CASE WHEN a.nct_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM days JOIN one b ON b.snapshot = day LEFT JOIN one a ON a.snapshot = before AND a.nct_id = b.nct_id
WHERE before IS NOT NULL AND (a.nct_id IS NULL OR {differs})
UNION ALL
SELECT {day}, a.nct_id, 'removed' FROM days JOIN one a ON a.snapshot = before LEFT JOIN one b ON b.snapshot = day AND b.nct_id = a.nct_id WHERE b.nct_id IS NULL
"""


def p4_fields() -> str:
    parts = " UNION ALL ".join(
        f"SELECT strftime(day, '%Y-%m-%d') AS snapshot, '{c}' AS field, count(*)::BIGINT AS studies FROM days JOIN one b ON b.snapshot = day JOIN one a ON a.snapshot = before AND a.nct_id = b.nct_id WHERE a.{c} IS DISTINCT FROM b.{c} GROUP BY day"
        for c in (*STUDY_STRINGS, *STUDY_OTHERS)
    )
    return f"WITH {_studies()} {parts}"


# ---------------------------------------------------------------- 6 rejects


def _judged() -> str:
    """Lines with their fields split by the quoting rule, as (load_id, line_no, names, cells, quoted)."""

    def member(d: str, where: str) -> str:
        e = "\\" + d
        one = f'(?:"(?:[^"]|"")*"|[^"{e}][^{e}]*|)'
        cell = f'{e}("(?:[^"]|"")*"|[^"{e}][^{e}]*|)'
        return f"""SELECT load_id, table_name, line_no, list_transform(string_split(header, '{d}'), lambda x: lower(trim(x, ' \t"'))) AS names,
  regexp_full_match(line, '{one}(?:{e}{one})*') AS quoted, regexp_extract_all('{d}' || line, '{cell}', 1) AS cells FROM paired WHERE {where}"""

    return f"""
lines AS (SELECT load_id, table_name, line_no, regexp_replace(regexp_replace(raw_line, '\\r$', ''), '^\\x{{FEFF}}', '') AS line FROM raw_member_line WHERE raw_line IS NOT NULL AND NOT regexp_full_match(raw_line, '[\\s\\x{{FEFF}}]*')),
heads AS (SELECT load_id, table_name, min(line_no) AS header_no, arg_min(line, line_no) AS header FROM lines GROUP BY 1, 2),
paired AS (SELECT l.*, h.header FROM lines l JOIN heads h ON l.load_id = h.load_id AND l.table_name = h.table_name WHERE l.line_no > h.header_no),
split AS ({member('$', "NOT starts_with(table_name, 'aact_')")} UNION ALL {member('|', "starts_with(table_name, 'aact_')")}),
plain AS (SELECT load_id, table_name, line_no, names, quoted, list_transform(cells, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' \t')) AS cells FROM split)"""


def _bad() -> str:
    real = "len(v) = 8 AND regexp_full_match(v, '(19[0-9]{2}|20[0-9]{2}|2100)[0-9]{4}') AND try_strptime(v, '%Y%m%d') IS NOT NULL OR regexp_full_match(v, '(19[0-9]{2}|20[0-9]{2}|2100)((0[1-9]|1[0-2]))?')"
    return f"""
WITH {_judged()},
cells AS (SELECT load_id, line_no, unnest(names) AS n, unnest(cells) AS v FROM plain WHERE quoted AND len(names) = len(cells)),
bad AS (SELECT DISTINCT load_id, line_no FROM cells WHERE (n IN ('primaryid', 'caseid', 'id') AND NOT regexp_full_match(v, '[0-9]+')) OR (n = 'nct_id' AND NOT regexp_full_match(v, 'NCT[0-9]{{8}}')) OR (ends_with(n, '_dt') AND v <> '' AND NOT ({real})))
"""


P6_FOUND = f"""{_bad()}
SELECT load_id, line_no, 'quoting' AS cause FROM plain WHERE NOT quoted
UNION ALL SELECT load_id, line_no, 'columns' FROM plain WHERE quoted AND len(names) <> len(cells)
UNION ALL SELECT load_id, line_no, 'value' FROM bad
"""

P6_LOADED = f"""{_bad()}
SELECT load_id, table_name, line_no, to_json(map(names, list_transform(cells, lambda x: nullif(x, ''))))::VARCHAR AS fields FROM plain
WHERE quoted AND len(names) = len(cells) AND (load_id, line_no) NOT IN (SELECT (load_id, line_no) FROM bad)
"""


SQL = {
    "p1_found": P1_FOUND,
    "p1_values": p1_values(),
    "p1_ingredients": P1_INGREDIENTS,
    "p2_found": p2(("i_f_code",)),
    "p2_history": p2(DEMO_ATTRIBUTES),
    "p2_store": p2_store(),
    "p2_append": p2(DEMO_ATTRIBUTES),
    "p2_asof": p2_asof(),
    "p3_found": P3_FOUND,
    "p3_orphans": P3_ORPHANS,
    "p3_tree": P3_TREE,
    "p3_cascade": P3_CASCADE,
    "p4_found": p4_found(),
    "p4_fields": p4_fields(),
    "p6_found": P6_FOUND,
    "p6_loaded": P6_LOADED,
}
