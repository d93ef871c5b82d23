"""Contract diffs, graded impact, review, sync and extraction over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import paths as P
from seamline.operators import diff, extract, impact, index, review
from seamline.operators.contract import check_contract, contract_result
from seamline.plans.lineage import stored
from seamline.queries import change_sql as sql
from seamline.queries.contract import ISSUES
from seamline.queries.duck import linked, norm, shown
from seamline.queries.usage import CALLS, Facts
from seamline.sources.lens import lens, lens_sql
from seamline.sources.tables import table


def sides(spark, folder):
    get = lambda n: lens(spark, folder, n)
    dtos = get("dtos")
    before = diff.Side(get("endpoints"), get("params"), dtos, get("dto_fields"), get("enum_values"))
    return before, diff.Side(get("endpoints_after"), get("params_after"), dtos, get("dto_fields_after"), get("enum_values_after"))


def diff_endpoints(spark, folder):
    return diff.endpoint_pairs(*sides(spark, folder))


def diff_params(spark, folder):
    before, after = sides(spark, folder)
    return diff.param_changes(diff.endpoint_pairs(before, after), before, after).select("repo", "endpoint_id", "kind", "path", "before", "after", "breaking", "message")


def diff_contracts(spark, folder):
    return diff.diff_contracts(*sides(spark, folder))[1]


def diff_counts(spark, folder):
    pairs, changes = diff.diff_contracts(*sides(spark, folder))
    return diff.diff_counts(pairs, stored(changes))


def change_impact(spark, folder, keep=(*CALLS, "line", "col", "code", "query_keys", "body_keys")):
    f = Facts(spark, folder, keep=keep)
    pairs, changes, sites = impact.change_impact(f.linked, f.reads, f.functions, *sides(spark, folder))
    return f, pairs, changes, stored(sites)


def change_sites(spark, folder):
    return change_impact(spark, folder)[3]


def change_report(spark, folder):
    f, pairs, changes, sites = change_impact(spark, folder)
    return impact.endpoint_report(pairs, changes, sites, f.linked, f.reads)


def ci_gate(spark, folder):
    f, pairs, changes, sites = change_impact(spark, folder, keep=True)
    result = stored(impact.change_result(impact.endpoint_report(pairs, changes, sites, f.linked, f.reads)))
    get = lambda n: lens(spark, folder, n)
    issues = check_contract(f.linked, f.reads, f.endpoints, get("params"), get("dtos"), get("dto_fields"))
    return impact.ci_gate(result, contract_result(issues), fail_on="likely", contract_on="warning")


def merged_ranges(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.lit("default").alias("repo"), F.col("l_orderkey").cast("string").alias("endpoint_id"), F.col("l_linestatus").alias("file"), (F.col("l_quantity") * 3).cast("int").alias("line"))
    return review.merge_ranges(rows.select("repo", "endpoint_id", "file", (F.col("line") - 6).alias("first"), (F.col("line") + 6).alias("last")).distinct())


def index_sync(spark, folder):
    e = table(spark, folder, "events")
    rows = lambda d: d.groupBy(F.concat_ws(":", "user_id", "event_type").alias("id")).agg(F.max_by("props", F.struct("ts", "event_id")).alias("json"), F.max("user_id").alias("u")).select(F.lit("default").alias("repo"), "id", F.concat(F.lit("f"), F.col("u") % 10).alias("file"), "json")
    return index.sync(rows(e.where("event_id % 3 <> 0")), rows(e.where("event_id % 5 <> 0")))


def touched_apis(spark, folder):
    f = Facts(spark, folder, keep=True)
    old = index.with_payload(f.reads, ["repo", "id", "file"])
    new = index.with_payload(f.reads.withColumn("line", F.when(F.col("id").endswith("9:1"), F.col("line") + 1).otherwise(F.col("line"))), ["repo", "id", "file"])
    return index.touched_apis(index.sync(old, new), f.linked, f.reads)


def url_functions(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select("page_id", P.strip_origin(u).alias("stripped"), P.normalize_path(P.strip_origin(u)).alias("normal"), P.resolve_endpoint(u).alias("endpoint"), P.url_query_keys(u).alias("keys"), F.size(P.segments(u)).alias("n"))


def name_functions(spark, folder):
    camel = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("ID"))
    return table(spark, folder, "part").select("p_partkey", *[P.rename(camel, s).alias(s) for s in ("snake", "kebab", "dot", "upper_camel", "lower")], P.getter_property(F.concat(F.lit("get"), F.initcap(camel)), F.lit(False)).alias("property"), P.spring_join(F.lower("p_type"), F.concat(F.lit("/"), camel, F.lit("/"))).alias("joined"))


def text_functions(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", P.truncate_code(t).alias("code"), P.first_line(t).alias("first"), P.quote_in(F.concat(F.lit(" "), F.substring(t, 3, 9)), t).alias("quoted"))


def path_functions(spark, folder):
    a, e = lens(spark, folder, "property_accesses"), lens(spark, folder, "endpoints")
    starts = a.select("id", P.format_access_path(F.col("path")).alias("shown"), P.path_starts_with(F.col("path"), F.array(F.lit("content"), F.lit("*")), True).alias("wild"), P.path_starts_with(F.col("path"), F.slice("path", 1, 1)).alias("own")).distinct()
    return starts.groupBy("shown", "wild", "own").agg(F.count("*").alias("n")).union(e.groupBy(P.join_path(F.lit("/api"), F.col("path")).alias("shown"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).agg(F.count("*")))


def page_imports(spark, folder):
    """Import statements written from pages' links, scanned and resolved against the pages' own paths."""
    p = table(spark, folder, "pages").select(F.lit("default").alias("repo"), F.concat(F.lit("src/p"), F.col("page_id"), F.lit(".ts")).alias("file"), F.concat(F.lit("import { a, b as c } from './p"), (F.col("page_id") + 1).cast("string"), F.lit("';\nimport D from \"lib"), (F.col("page_id") % 7).cast("string"), F.lit('"')).alias("text"))
    return extract.resolve_imports(extract.scan_imports(p), p.select("repo", F.col("file").alias("path"))).select("file", "source", "specifiers", "resolved_file")


def scanned_calls(spark, folder):
    """Source text made from parts, scanned for calls."""
    p = table(spark, folder, "part").select(
        F.lit("default").alias("repo"), F.concat(F.lit("src/p"), F.col("p_partkey"), F.lit(".ts")).alias("file"),
        F.concat(F.lit("const x = await axios.get(`/api/"), F.lower("p_type"), F.lit("/${id}?size="), F.col("p_size"), F.lit("&q=${q}`, { params: { page: 1 } });\nfetch('/b"), F.substring("p_brand", 7, 4), F.lit("/' + name, { method: 'POST' });\nother.get('/x');")).alias("text"),
    )
    return extract.scan_calls(p)


def spring_mappings(spark, folder):
    rows = table(spark, folder, "part").select(F.lit("default").alias("repo"), F.concat(F.lit("C#h"), F.col("p_partkey")).alias("handler"), F.col("p_partkey").alias("pos"), F.array(F.lower("p_type")).alias("prefixes"), F.array(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("{id}")).alias("paths"), F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("GET"))).alias("methods"))
    return extract.expand_mappings(rows).select("id", "handler", "pos")


def bound_parameters(spark, folder):
    """Handler parameters of parts, objects among them with the fields of their DTOs."""
    k = F.col("p_partkey") % 40
    given = ('@PathVariable("id") Long key', "Pageable page", "HttpServletRequest request", "LocalTime at", "@RequestParam Map<String, String> all", "@CookieValue String c", "List<Long> ids", "E1 state")
    own = (F.concat(F.lit('@RequestParam(value = "q'), "p_size", F.lit('", required = false) String q')), F.concat(F.lit("@Valid D"), k, F.lit(" filter")), F.concat(F.lit("@RequestHeader Optional<String> h"), "p_size"))
    mappings = table(spark, folder, "part").select(F.lit("repo0").alias("repo"), F.concat(F.lit("C#h"), F.col("p_partkey")).alias("handler"), F.array(*map(F.lit, given), *own).alias("parameters"))
    last = lambda c: F.regexp_extract(c, r"(\w+)$", 1).alias("java_type")
    fields = lens(spark, folder, "dto_fields").select("repo", last("dto_id"), "name", F.get_json_object("type_json", "$.name").alias("type"))
    enums = lens(spark, folder, "enum_values").select("repo", last("enum_id"), F.lit(None).cast("string"), F.lit(None).cast("string")).distinct()
    return extract.bind_parameters(mappings, fields.union(enums))


def java_types(spark, folder):
    """Java types named after parts, as the JSON of types."""
    d, e = F.concat(F.lit("D"), F.col("p_partkey") % 40), F.concat(F.lit("E"), F.col("p_size") % 6)
    shapes = (("ResponseEntity<List<", d, ">>"), ("Map<String, ", d, "[]>"), ("WebAsyncTask<Optional<", e, ">>"), ("Deque<ConcurrentHashMap<Long, ", e, ">>"), ("CompletionStage<Page<", d, ">>"), ("AtomicReference<", d, ">"))
    text = F.array(*[F.concat(F.lit(a), x, F.lit(b)) for a, x, b in shapes], F.lit("Future<Duration>"), F.lit("ResponseEntity<?>"))
    texts = table(spark, folder, "part").select(F.lit("repo0").alias("repo"), F.explode(text).alias("java_type"))
    known = lens(spark, folder, "dtos").select("repo", "name", "id", F.lit(False).alias("is_enum"))
    enums = lens(spark, folder, "enum_values").select("repo", F.regexp_extract("enum_id", r"(\w+)$", 1), "enum_id", F.lit(True)).distinct()
    return extract.parse_types(texts, known.union(enums))


def callees(spark, folder):
    return extract.distinct_callees(lens(spark, folder, "api_calls"))


_BOTH = ("endpoints", "endpoints_after", "params", "params_after")
_EVENTS = lambda where: f"SELECT 'default' AS repo, user_id || ':' || event_type AS id, 'f' || (max(user_id) % 10) AS file, max_by(props, (ts, event_id)) AS json FROM events WHERE {where} GROUP BY user_id, event_type"
_CAMEL = "split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || 'ID'"
_SEP = lambda s: f"lower(regexp_replace({_CAMEL}, '([^A-Z_])([A-Z])', '\\1{s}\\2', 'g'))"
_STRIP = "CASE WHEN r = '' THEN '/' WHEN starts_with(r, '/') THEN r ELSE '/' || r END"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (
        diff_endpoints, diff_params, diff_contracts, diff_counts, change_sites, change_report, ci_gate, merged_ranges, index_sync, touched_apis,
        url_functions, name_functions, text_functions, path_functions, page_imports, scanned_calls, spring_mappings, bound_parameters, java_types, callees,
    )
}
ORACLES = {
    "diff_endpoints": f"WITH {lens_sql(*_BOTH)}, {sql.PAIRS} SELECT * FROM pr",
    "diff_params": f"WITH {lens_sql(*_BOTH)}, {sql.PAIRS}, {sql.PARAMS} SELECT * EXCLUDE (ord) FROM pc",
    "diff_contracts": linked("SELECT * FROM ch", *sql.SIDES, extra=sql.CHANGES),
    "diff_counts": linked(sql.COUNTS, *sql.SIDES, extra=sql.CHANGES),
    "change_sites": linked("SELECT * FROM st", *sql.SIDES, extra=sql.SITES),
    "change_report": linked("SELECT * FROM rep", *sql.SIDES, extra=sql.REPORT),
    "ci_gate": linked(
        """SELECT repo, CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) > 0 THEN 1 ELSE 0 END AS exit_code, concat_ws(',', CASE WHEN a.n > 0 THEN 'changes' END, CASE WHEN b.n > 0 THEN 'contract' END) AS reasons
        FROM (SELECT repo, sum(definite + likely) AS n FROM rep GROUP BY repo) a FULL JOIN (SELECT repo, count(*) FILTER (severity IN ('error', 'warning')) AS n FROM iss GROUP BY repo) b USING (repo)""",
        *sql.SIDES, extra=f"{sql.REPORT}, {ISSUES}",
    ),
    "scanned_calls": """WITH p AS (SELECT 'src/p' || p_partkey || '.ts' AS file, lower(p_type) AS t, p_size, substr(p_brand, 7, 4) AS b FROM part)
      SELECT 'default' AS repo, 'call:' || file || ':1:17' AS id, '/api/' || t || '/{param}' AS endpoint_pattern, 'GET' AS method, 'axios.get' AS callee, 'direct' AS resolution, file, 1 AS line, 17 AS col, ['size', 'q', 'page'] AS query_keys, []::VARCHAR[] AS body_keys,
        'axios.get(`/api/' || t || '/${id}?size=' || p_size || '&q=${q}`, { params: { page: 1 } })' AS code FROM p
      UNION ALL SELECT 'default', 'call:' || file || ':2:1', '/b' || b || '/{param}', 'POST', 'fetch', 'direct', file, 2, 1, [], [], 'fetch(''/b' || b || '/'' + name, { method: ''POST'' })' AS code FROM p""",
    "merged_ranges": """WITH r AS (SELECT DISTINCT 'default' AS repo, l_orderkey::VARCHAR AS endpoint_id, l_linestatus AS file, CAST(trunc(l_quantity * 3) AS INT) - 6 AS first, CAST(trunc(l_quantity * 3) AS INT) + 6 AS last FROM lineitem),
      m AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY endpoint_id, file ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r),
      i AS (SELECT *, sum(new) OVER (PARTITION BY endpoint_id, file ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM m)
      SELECT repo, endpoint_id, file, min(first) AS first, max(last) AS last FROM i GROUP BY repo, endpoint_id, file, island""",
    "index_sync": f"""WITH o AS ({_EVENTS('event_id % 3 <> 0')}), n AS ({_EVENTS('event_id % 5 <> 0')}) SELECT repo, id, CASE WHEN o.json IS NULL THEN 'insert' WHEN n.json IS NULL THEN 'delete' ELSE 'update' END AS action, o.file AS old_file, n.file AS new_file
      FROM o FULL JOIN n USING (repo, id) WHERE o.json IS DISTINCT FROM n.json""",
    "url_functions": f"""WITH a AS (SELECT page_id, url, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS r FROM pages), b AS (SELECT page_id, url, {_STRIP} AS s FROM a)
      SELECT page_id, s AS stripped, {norm('s')} AS normal, {norm('s')} AS endpoint, CASE WHEN contains(url, '?') THEN list_filter(list_transform(string_split(split_part(url, '?', 2), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> '' AND x <> '{{param}}') ELSE [] END AS keys,
      CAST(len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS INT) AS n FROM b""",
    "name_functions": f"SELECT p_partkey, {_SEP('_')} AS snake, {_SEP('-')} AS kebab, {_SEP('.')} AS dot, upper(substr({_CAMEL}, 1, 1)) || substr({_CAMEL}, 2) AS upper_camel, lower({_CAMEL}) AS lower, lower({_CAMEL}) AS property, '/' || lower(p_type) || '/' || {_CAMEL} AS joined FROM part",
    "text_functions": f"SELECT doc_id, CASE WHEN length({_FLAT}) > 200 THEN substr({_FLAT}, 1, 200) || '…' ELSE {_FLAT} END AS code, trim(split_part(text, chr(10), 1)) AS first, length(q) >= 2 AND contains({_FLAT}, q) AS quoted FROM (SELECT *, trim(regexp_replace(substr(text, 3, 9), '\\s+', ' ', 'g')) AS q FROM documents) d",
    "path_functions": f"WITH {lens_sql('property_accesses', 'endpoints')} SELECT shown, wild, own, count(*) AS n FROM (SELECT DISTINCT id, {shown('path')} AS shown, len(path) >= 2 AND path[1] = 'content' AS wild, TRUE AS own FROM property_accesses) GROUP BY ALL UNION ALL SELECT {norm(chr(39) + '/api/' + chr(39) + ' || path')}, NULL, NULL, count(*) FROM endpoints GROUP BY ALL",
    "page_imports": "SELECT 'src/p' || page_id || '.ts' AS file, './p' || (page_id + 1) AS source, ['a', 'b'] AS specifiers, CASE WHEN page_id + 1 IN (SELECT page_id FROM pages) THEN 'src/p' || (page_id + 1) || '.ts' END AS resolved_file FROM pages UNION ALL SELECT 'src/p' || page_id || '.ts', 'lib' || (page_id % 7), ['D'], NULL FROM pages",
    "spring_mappings": """WITH r AS (SELECT 'C#h' || p_partkey AS handler, p_partkey AS pos, '/' || lower(p_type) || '/' || unnest([replace(p_name, ' ', '/'), '{id}']) AS path, CASE WHEN p_size % 3 = 0 THEN ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'] ELSE ['GET'] END AS m FROM part)
      SELECT id, handler, pos FROM (SELECT *, unnest(m) || ' ' || path AS id FROM r) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1""",
    "touched_apis": linked(
        "SELECT DISTINCT repo, api_key FROM (SELECT repo, file, api_key FROM linked UNION ALL SELECT repo, file, api_key FROM reads) u SEMI JOIN (SELECT repo, file FROM property_accesses WHERE id LIKE '%9:1') t USING (repo, file)"
    ),
    "bound_parameters": f"""WITH {lens_sql('dto_fields', 'enum_values')}, p AS (SELECT 'C#h' || p_partkey AS handler, p_partkey % 40 AS k, p_size FROM part),
      o AS (SELECT handler, unnest([('id', 'path', TRUE, 'Long', 0), ('page', 'query', FALSE, 'Pageable', 1), ('size', 'query', FALSE, 'Pageable', 1), ('sort', 'query', FALSE, 'Pageable', 1), ('at', 'query', FALSE, 'LocalTime', 3), ('ids', 'query', FALSE, 'List<Long>', 6),
        ('q' || p_size, 'query', FALSE, 'String', 8), ('h' || p_size, 'header', FALSE, 'Optional<String>', 10)]) AS r FROM p)
      SELECT 'repo0' AS repo, handler, r[1] AS name, r[2] AS source, r[3] AS required, r[4] AS java_type, r[5] AS pos FROM o
      UNION ALL SELECT 'repo0', handler, f.name, 'query', FALSE, coalesce(json_extract_string(f.type_json, '$.name'), 'D' || k), 9 FROM p JOIN dto_fields f ON f.repo = 'repo0' AND f.dto_id = 'pkg.D' || k
      UNION ALL SELECT 'repo0', handler, 'state', 'query', FALSE, 'E1', 7 FROM p WHERE EXISTS (FROM enum_values WHERE repo = 'repo0' AND enum_id = 'pkg.E1')""",
    "java_types": f"""WITH {lens_sql('dtos', 'enum_values')}, p AS (SELECT 'D' || (p_partkey % 40) AS d, 'E' || (p_size % 6) AS e FROM part),
      n AS (SELECT *, CASE WHEN EXISTS (FROM dtos x WHERE x.repo = 'repo0' AND x.name = d) THEN '{{"kind":"dto","dtoId":"pkg.' || d || '","typeArguments":[]}}' ELSE '{{"kind":"unknown","name":"' || d || '"}}' END AS dj,
        CASE WHEN EXISTS (FROM enum_values x WHERE x.repo = 'repo0' AND x.enum_id = 'pkg.' || e) THEN '{{"kind":"enum","enumId":"pkg.' || e || '"}}' ELSE '{{"kind":"unknown","name":"' || e || '"}}' END AS ej FROM p),
      r AS (SELECT unnest([('ResponseEntity<List<' || d || '>>', '{{"kind":"array","element":' || dj || '}}'), ('Map<String, ' || d || '[]>', '{{"kind":"map","value":{{"kind":"array","element":' || dj || '}}}}'), ('WebAsyncTask<Optional<' || e || '>>', ej),
        ('Deque<ConcurrentHashMap<Long, ' || e || '>>', '{{"kind":"array","element":{{"kind":"map","value":' || ej || '}}}}'), ('CompletionStage<Page<' || d || '>>', '{{"kind":"dto","dtoId":"pkg.Page","typeArguments":[' || dj || ']}}'), ('AtomicReference<' || d || '>', dj),
        ('Future<Duration>', '{{"kind":"scalar","name":"Duration"}}'), ('ResponseEntity<?>', '{{"kind":"unknown","name":"ResponseEntity"}}')]) AS r FROM n)
      SELECT DISTINCT 'repo0' AS repo, r[1] AS java_type, r[2] AS type_json FROM r""",
    "callees": f"WITH {lens_sql('api_calls')} SELECT repo, caller_function_id AS function_id, list_sort(list_distinct(list(callee))) AS callees FROM api_calls GROUP BY ALL",
}
