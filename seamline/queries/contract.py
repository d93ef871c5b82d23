"""Contract checks, types and field usage over the lens tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import contract, types
from seamline.operators.usage import field_reads
from seamline.queries.change_sql import described, json_text
from seamline.queries.duck import linked, shown
from seamline.queries.usage import Facts
from seamline.sources.lens import lens, lens_sql


def _tables(spark, folder):
    return [lens(spark, folder, n) for n in ("params", "dtos", "dto_fields")]


def _issues(spark, folder):
    f = Facts(spark, folder, keep=True)
    params, dtos, fields = _tables(spark, folder)
    return f, contract.check_contract(f.linked, f.reads, f.endpoints, params, dtos, fields)


def contract_issues(spark, folder):
    return _issues(spark, folder)[1].drop("message", "suggestion", "api_key")


def contract_messages(spark, folder):
    found = _issues(spark, folder)[1]
    return found.groupBy("repo", "severity", "code", "message", "suggestion").agg(F.count("*").alias("issues"))


def contract_result(spark, folder):
    return contract.contract_result(_issues(spark, folder)[1])


def checked_apis(spark, folder):
    f, issues = _issues(spark, folder)
    return contract.checked_apis(f.linked, f.reads, issues)


def contract_scope(spark, folder):
    f = Facts(spark, folder, keep=True)
    files = f.files.where("path LIKE '%5.tsx'").select("repo", F.col("path").alias("file"))
    calls, reads = contract.scope_calls(f.linked, f.reads, files)
    a = calls.groupBy("repo").agg(F.count("*").alias("calls"))
    return a.join(reads.groupBy("repo").agg(F.count("*").alias("reads")), "repo", "full_outer")


def type_walk(spark, folder):
    f = Facts(spark, folder, keep=True)
    _, dtos, fields = _tables(spark, folder)
    typed = field_reads(f.reads, f.linked).join(f.endpoints.select("repo", F.col("id").alias("endpoint_id"), F.col("response_type_json").alias("type")), ["repo", "endpoint_id"]).where("type IS NOT NULL")
    edges = types.type_edges(typed.select("repo", "type"), dtos, fields)
    walked = types.walk_paths(typed, edges, dtos)
    return walked.select("repo", "type", "path", "status", "step", "reason", types.describe(F.col("parent")).alias("parent"))


def dto_field_usage(spark, folder):
    f = Facts(spark, folder, keep=True)
    _, dtos, fields = _tables(spark, folder)
    edges = types.type_edges(f.endpoints.select("repo", F.col("response_type_json").alias("type")), dtos, fields)
    return types.field_usage(f.endpoints, edges, fields, field_reads(f.reads, f.linked))


def dto_usage(spark, folder):
    f = Facts(spark, folder, keep=True)
    _, dtos, fields = _tables(spark, folder)
    roots = f.endpoints.select("repo", F.col("response_type_json").alias("type")).union(f.endpoints.select("repo", "body_type_json"))
    return types.dto_usage(f.endpoints, types.type_edges(roots, dtos, fields), field_reads(f.reads, f.linked))


def field_impact(spark, folder):
    f = Facts(spark, folder, keep=True)
    _, dtos, fields = _tables(spark, folder)
    edges = types.type_edges(f.endpoints.select("repo", F.col("response_type_json").alias("type")), dtos, fields)
    reads = field_reads(f.reads, f.linked)
    one = types.impact_of_field("D3.parent.name", f.endpoints, edges, dtos, fields, reads)
    return one.unionByName(types.impact_of_field("pkg.Page.total", f.endpoints, edges, dtos, fields, reads))


def search_types(spark, folder):
    f = Facts(spark, folder, keep=True)
    _, dtos, fields = _tables(spark, folder)
    roots = f.endpoints.select("repo", F.col("response_type_json").alias("type")).union(f.endpoints.select("repo", "body_type_json"))
    edges, reads = types.type_edges(roots, dtos, fields), field_reads(f.reads, f.linked)
    return types.type_hits("Pa", f.endpoints, edges, dtos, fields, reads)


_NAME = "coalesce({0}, {1}, {2})".format(json_text("cur", "dtoId"), json_text("cur", "enumId"), json_text("cur", "name"))
_K = json_text("cur", "kind")
_SEG = "path[i + 1]"
_ARG = "coalesce(json_extract(cur, '$.typeArguments[0]')::VARCHAR, '')"
_PUT = f"""CASE WHEN {_ARG} <> '' THEN replace(type_json, '{{"kind":"typeParameter","name":"T"}}', {_ARG}) ELSE type_json END"""
#: The walk as a recursion: status is null while it goes on.
_WALK = f"""
typed AS (SELECT r.*, e.response_type_json AS type FROM reads r JOIN endpoints e ON e.repo = r.repo AND e.id = r.endpoint_id),
w AS (
  SELECT DISTINCT repo, type, path, 0 AS i, type AS cur, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason FROM typed WHERE type IS NOT NULL
  UNION ALL
  SELECT repo, type, path, i + 1, CASE WHEN st IS NULL THEN nxt ELSE cur END, st, CASE WHEN st = 'missing' THEN CASE WHEN seg = '[]' THEN 'not-an-array' WHEN k = 'dto' THEN 'no-such-field' ELSE 'not-an-object' END END FROM (
    SELECT *, CASE WHEN k IN ('unknown', 'typeParameter') OR (k = 'dto' AND did IS NULL) THEN 'unverifiable'
      WHEN seg = 'length' AND (k = 'array' OR k = 'enum' OR (k = 'scalar' AND {_NAME} IN ('String', 'CharSequence', 'char', 'Character'))) THEN 'ok' WHEN nxt IS NULL THEN 'missing' END AS st FROM (
      SELECT w.*, {_SEG} AS seg, {_K} AS k, d.id AS did,
        CASE {_K} WHEN 'array' THEN CASE WHEN {_SEG} = '[]' THEN json_extract(cur, '$.element')::VARCHAR END WHEN 'map' THEN CASE WHEN {_SEG} <> '[]' THEN json_extract(cur, '$.value')::VARCHAR END WHEN 'dto' THEN {_PUT} END AS nxt
      FROM w LEFT JOIN dtos d ON d.repo = w.repo AND d.id = {json_text('cur', 'dtoId')} LEFT JOIN dto_fields f ON f.repo = w.repo AND f.dto_id = {json_text('cur', 'dtoId')} AND f.name = {_SEG}
      WHERE w.status IS NULL AND i < len(path)) a) b),
walked AS (
  SELECT repo, type, path, coalesce(status, 'ok') AS status, CASE WHEN status IN ('missing', 'unverifiable') THEN CAST(i - 1 AS INT) END AS step, reason, CASE WHEN status IN ('missing', 'unverifiable') THEN cur END AS parent FROM w
  WHERE status IS NOT NULL OR i = len(path))"""
_CLOSE = lambda wrong, table, on: f"(SELECT arg_min(o.name, levenshtein(lower({wrong}), lower(o.name)) * 1000 + o.pos) FROM {table} o WHERE {on} AND levenshtein(lower({wrong}), lower(o.name)) <= greatest(2, length({wrong}) // 3))"
ISSUES = f"""{_WALK},
m AS (SELECT * FROM linked WHERE status = 'matched'),
q AS (SELECT * FROM params WHERE source = 'query'),
b AS (SELECT m.*, e.body_type_json AS bt, coalesce(e.body_required, FALSE) AS needed, {json_text('e.body_type_json', 'dtoId')} AS dto_id FROM m JOIN endpoints e ON e.repo = m.repo AND e.id = m.endpoint_id WHERE body_keys IS NOT NULL),
uq AS (SELECT * FROM (SELECT m.*, unnest(query_keys) AS wrong FROM m) x WHERE NOT EXISTS (FROM q WHERE q.repo = x.repo AND q.endpoint_id = x.endpoint_id AND q.name = wrong)),
ub AS (SELECT x.*, d.name AS dto_name FROM (SELECT b.*, unnest(body_keys) AS wrong FROM b WHERE dto_id IS NOT NULL) x JOIN dtos d ON d.repo = x.repo AND d.id = x.dto_id WHERE NOT EXISTS (FROM dto_fields f WHERE f.repo = x.repo AND f.dto_id = x.dto_id AND f.name = wrong)),
uqc AS (SELECT repo, endpoint_id, wrong, {_CLOSE('wrong', 'q', 'o.repo = x.repo AND o.endpoint_id = x.endpoint_id')} AS close FROM (SELECT DISTINCT repo, endpoint_id, wrong FROM uq) x),
ubc AS (SELECT repo, dto_id, wrong, {_CLOSE('wrong', 'dto_fields', 'o.repo = x.repo AND o.dto_id = x.dto_id')} AS close FROM (SELECT DISTINCT repo, dto_id, wrong FROM ub) x),
wc AS (SELECT *, path[step + 1] AS wrong, CASE WHEN reason = 'no-such-field' THEN {_CLOSE('path[step + 1]', 'dto_fields', "o.repo = wd.repo AND o.dto_id = json_extract_string(parent, '$.dtoId')")} END AS close FROM walked wd WHERE status <> 'ok'),
acc AS (
  SELECT t.*, wc.status AS result, wc.reason, wc.parent, wc.wrong, wc.close FROM typed t LEFT JOIN wc ON wc.repo = t.repo AND wc.type = t.type AND wc.path = t.path WHERE t.type IS NULL OR wc.status IS NOT NULL),
iss AS (
  SELECT repo, CASE status WHEN 'unresolved' THEN 'info' ELSE 'error' END AS severity, CASE status WHEN 'unresolved' THEN 'UNRESOLVED_ENDPOINT' WHEN 'not-found' THEN 'ENDPOINT_NOT_FOUND' ELSE 'METHOD_MISMATCH' END AS code,
    CASE status WHEN 'unresolved' THEN 'The URL of `' || callee || '` cannot be determined statically' WHEN 'not-found' THEN 'Backend has no endpoint for ' || method || ' ' || endpoint_pattern ELSE 'Backend does not accept ' || method || ' on ' || endpoint_pattern END AS message,
    CASE WHEN status = 'unresolved' THEN 'Add the client to the client map' WHEN status = 'method-mismatch' THEN 'Available: ' || array_to_string(candidates, ', ') WHEN len(candidates) > 0 THEN 'Similar endpoints: ' || array_to_string(candidates, ', ') END AS suggestion,
    file, line, col, api_key, id AS api_call_id, CAST(NULL AS VARCHAR) AS access_id FROM linked WHERE status <> 'matched'
  UNION ALL SELECT repo, 'warning', 'UNKNOWN_QUERY_PARAM', endpoint_id || ' does not accept query parameter `' || wrong || '`', 'Did you mean `' || close || '`?', file, line, col, api_key, id, NULL FROM uq JOIN uqc USING (repo, endpoint_id, wrong)
  UNION ALL SELECT m.repo, 'warning', 'MISSING_QUERY_PARAM', m.endpoint_id || ' requires query parameter `' || q.name || '`', NULL, file, line, col, api_key, id, NULL FROM m JOIN q ON q.repo = m.repo AND q.endpoint_id = m.endpoint_id WHERE q.required AND query_keys IS NOT NULL AND NOT list_contains(query_keys, q.name)
  UNION ALL SELECT repo, 'warning', 'UNKNOWN_BODY_FIELD', endpoint_id || ' does not take a request body', NULL, file, line, col, api_key, id, NULL FROM b WHERE bt IS NULL AND len(body_keys) > 0
  UNION ALL SELECT repo, 'warning', 'UNKNOWN_BODY_FIELD', dto_name || ' has no field `' || wrong || '`', 'Did you mean `' || close || '`?', file, line, col, api_key, id, NULL FROM ub JOIN ubc USING (repo, dto_id, wrong)
  UNION ALL SELECT b.repo, 'warning', 'MISSING_BODY_FIELD', d.name || '.' || f.name || ' is required but not sent', NULL, file, line, col, api_key, b.id, NULL FROM b JOIN dtos d ON d.repo = b.repo AND d.id = b.dto_id JOIN dto_fields f ON f.repo = b.repo AND f.dto_id = b.dto_id
    WHERE needed AND NOT f.nullable AND NOT list_contains(body_keys, f.name)
  UNION ALL SELECT repo, CASE WHEN result = 'unverifiable' THEN 'info' WHEN flow = 'derived' THEN 'warning' ELSE 'error' END,
    CASE WHEN result IS NULL THEN 'NO_RESPONSE_BODY' WHEN result = 'unverifiable' THEN 'UNVERIFIABLE_FIELD' WHEN reason = 'no-such-field' THEN 'FIELD_NOT_FOUND' WHEN reason = 'not-an-array' THEN 'NOT_AN_ARRAY' ELSE 'NOT_AN_OBJECT' END,
    CASE WHEN result IS NULL THEN 'Reads `' || sh || '` but ' || endpoint_id || ' returns no body' || via WHEN result = 'unverifiable' THEN 'Cannot verify `' || sh || '`: type `' || pn || '` is not known'
      WHEN reason = 'no-such-field' THEN pd || ' has no field `' || wrong || '` (reading `' || sh || '` from ' || endpoint_id || ')' || via WHEN reason = 'not-an-array' THEN 'Treats ' || pd || ' as an array (reading `' || sh || '` from ' || endpoint_id || ')' || via
      ELSE 'Reads `' || wrong || '` on ' || pd || ', which has no properties (reading `' || sh || '`)' || via END,
    CASE WHEN reason = 'no-such-field' THEN 'Did you mean `' || close || '`?' WHEN reason = 'not-an-array' THEN 'Response type is ' || td END, file, line, col, api_key, api_call_id, id
  FROM (SELECT *, {shown('path')} AS sh, CASE WHEN flow = 'derived' THEN ' (value passed through a function that could not be followed)' ELSE '' END AS via, {described('parent')} AS pd, {described('type')} AS td, {_NAME.replace('cur', 'parent')} AS pn FROM acc) x)"""
_NEED = ("params", "dtos", "dto_fields")
#: Where each DTO occurs in a type: not through maps, a DTO below itself not entered again.
_PLACES = f"""
roots AS (SELECT DISTINCT repo, response_type_json AS root FROM endpoints WHERE response_type_json IS NOT NULL UNION SELECT repo, body_type_json FROM endpoints WHERE body_type_json IS NOT NULL),
p AS (
  SELECT repo, root, []::VARCHAR[] AS path, root AS cur, []::VARCHAR[] AS seen FROM roots
  UNION ALL
  SELECT p.repo, root, list_append(path, CASE {_K} WHEN 'array' THEN '[]' ELSE f.name END), CASE {_K} WHEN 'array' THEN json_extract(cur, '$.element')::VARCHAR ELSE {_PUT} END, CASE {_K} WHEN 'dto' THEN list_append(seen, {json_text('cur', 'dtoId')}) ELSE seen END
  FROM p LEFT JOIN dto_fields f ON {_K} = 'dto' AND f.repo = p.repo AND f.dto_id = {json_text('cur', 'dtoId')} WHERE {_K} = 'array' OR (f.name IS NOT NULL AND NOT list_contains(seen, {json_text('cur', 'dtoId')}))),
pl AS (SELECT repo, root, path, {json_text('cur', 'dtoId')} AS dto_id FROM p WHERE {_K} = 'dto')"""

#: Rows of wanted fields ``q`` (repo, dto_id, field, tail) at each place, with their reads.
_SENT = """(SELECT e.repo, e.id AS endpoint_id, pl.dto_id, q.field, list_concat(pl.path, q.tail) AS target FROM endpoints e JOIN pl ON pl.repo = e.repo AND pl.root = e.response_type_json JOIN q ON q.repo = e.repo AND q.dto_id = pl.dto_id) s
  LEFT JOIN reads r ON r.repo = s.repo AND r.endpoint_id = s.endpoint_id AND r.path[1:len(s.target)] = s.target"""
_DTO_USAGE = """SELECT a.repo, a.dto_id, a.n AS endpoints, coalesce(b.n, 0) AS files FROM (SELECT e.repo, pl.dto_id, count(DISTINCT e.id) AS n FROM endpoints e JOIN pl ON pl.repo = e.repo AND (pl.root = e.response_type_json OR pl.root = e.body_type_json) GROUP BY ALL) a
  LEFT JOIN (SELECT e.repo, pl.dto_id, count(DISTINCT r.file) AS n FROM endpoints e JOIN pl ON pl.repo = e.repo AND pl.root = e.response_type_json JOIN reads r ON r.repo = e.repo AND r.endpoint_id = e.id AND len(r.path) > len(pl.path) AND r.path[1:len(pl.path)] = pl.path GROUP BY ALL) b USING (repo, dto_id)"""

QUERIES = {f.__name__: f for f in (contract_issues, contract_messages, contract_result, checked_apis, contract_scope, type_walk, dto_field_usage, dto_usage, field_impact, search_types)}
ORACLES = {
    "field_impact": linked(
        f"SELECT s.repo, s.dto_id, s.field, s.endpoint_id, {shown('s.target')} AS response_path, count(r.id) AS reads, count(DISTINCT r.file) AS files, count(DISTINCT r.containing_component) AS components FROM {_SENT} GROUP BY ALL",
        *_NEED, extra=f"{_PLACES}, q AS (SELECT d.repo, d.id AS dto_id, 'parent.name' AS field, ['parent', 'name'] AS tail FROM dtos d SEMI JOIN dto_fields f ON f.repo = d.repo AND f.dto_id = d.id AND f.name = 'parent' WHERE d.name = 'D3' UNION ALL SELECT repo, id, 'total', ['total'] FROM dtos WHERE id = 'pkg.Page')",
    ),
    "search_types": linked(
        f"""SELECT d.repo, 'dto' AS kind, d.name AS label, d.id AS detail, coalesce(u.endpoints, 0) AS apis, coalesce(u.files, 0) AS files FROM dtos d LEFT JOIN ({_DTO_USAGE}) u ON u.repo = d.repo AND u.dto_id = d.id WHERE contains(lower(d.id), 'pa')
        UNION ALL SELECT q.repo, 'field', d.name || '.' || q.field, q.dto_id, coalesce(n.apis, 0), coalesce(n.files, 0) FROM q JOIN dtos d ON d.repo = q.repo AND d.id = q.dto_id
        LEFT JOIN (SELECT s.repo, s.dto_id, s.field, count(DISTINCT (s.endpoint_id, s.target)) AS apis, count(DISTINCT r.file) AS files FROM {_SENT} GROUP BY ALL) n ON n.repo = q.repo AND n.dto_id = q.dto_id AND n.field = q.field""",
        *_NEED, extra=f"{_PLACES}, q AS (SELECT repo, dto_id, name AS field, [name] AS tail FROM dto_fields WHERE contains(lower(name), 'pa'))",
    ),
    "contract_issues": linked("SELECT repo, severity, code, file, line, col, api_call_id, access_id FROM iss", *_NEED, extra=ISSUES),
    "contract_messages": linked("SELECT repo, severity, code, message, suggestion, count(*) AS issues FROM iss GROUP BY ALL", *_NEED, extra=ISSUES),
    "contract_result": linked(
        "SELECT repo, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS result FROM iss GROUP BY repo",
        *_NEED, extra=ISSUES,
    ),
    "checked_apis": linked(
        "SELECT a.repo, a.api_key, a.status, a.n AS call_sites, coalesce(r.n, 0) AS field_reads, coalesce(i.n, 0) AS issues FROM (SELECT repo, api_key, min_by(status, id) AS status, count(*) AS n FROM linked GROUP BY ALL) a LEFT JOIN (SELECT repo, api_key, count(*) AS n FROM reads GROUP BY ALL) r USING (repo, api_key) LEFT JOIN (SELECT repo, api_key, count(*) AS n FROM iss GROUP BY ALL) i USING (repo, api_key)",
        *_NEED, extra=ISSUES,
    ),
    "contract_scope": linked(
        "SELECT * FROM (SELECT repo, count(*) AS calls FROM linked l WHERE EXISTS (FROM here h WHERE h.repo = l.repo AND h.id = l.id) OR EXISTS (FROM property_accesses a WHERE a.repo = l.repo AND a.api_call_id = l.id AND a.file LIKE '%5.tsx') GROUP BY repo) FULL JOIN (SELECT repo, count(*) AS reads FROM property_accesses a WHERE EXISTS (FROM kept k WHERE k.repo = a.repo AND k.id = a.id) GROUP BY repo) USING (repo)",
        extra="here AS (SELECT DISTINCT repo, id FROM linked WHERE file LIKE '%5.tsx'), kept AS (SELECT DISTINCT b.repo, b.id FROM property_accesses b WHERE b.file LIKE '%5.tsx' OR EXISTS (FROM here h WHERE h.repo = b.repo AND h.id = b.api_call_id))",
    ),
    "type_walk": linked(f"SELECT repo, type, path, status, step, reason, {described('parent')} AS parent FROM walked", *_NEED, extra=_WALK),
    "dto_field_usage": linked(
        f"SELECT s.repo, s.dto_id, s.field, s.endpoint_id, {shown('s.target')} AS response_path, count(r.id) AS reads, count(DISTINCT r.file) AS files, count(DISTINCT r.containing_component) AS components FROM (SELECT e.repo, e.id AS endpoint_id, pl.dto_id, f.name AS field, list_append(pl.path, f.name) AS target FROM endpoints e JOIN pl ON pl.repo = e.repo AND pl.root = e.response_type_json JOIN dto_fields f ON f.repo = e.repo AND f.dto_id = pl.dto_id) s LEFT JOIN reads r ON r.repo = s.repo AND r.endpoint_id = s.endpoint_id AND r.path[1:len(s.target)] = s.target GROUP BY ALL",
        *_NEED, extra=_PLACES,
    ),
    "dto_usage": linked(
        _DTO_USAGE, *_NEED, extra=_PLACES,
    ),
}
