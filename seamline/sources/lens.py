"""Code facts derived from the driver's tables, as SQL that Spark and DuckDB read alike.

Endpoints and DTOs come from parts and suppliers, calls and field reads from lineitems: every query's work grows with
the given tables. Each name of LENS is the text of one common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.sources.tables import table

_METHOD = "CASE {k} % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'GET' ELSE 'DELETE' END"
_PATH = "'/b' || substr(p_brand, 7, 4) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '/')"
_TAIL = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '/{id}' WHEN 2 THEN '/{id}/items' ELSE '/search' END"
_S = "CAST({} AS STRING)"


def _dto(expr: str, args: str = "") -> str:
    return f"""'{{"kind":"dto","dtoId":"pkg.' || {expr} || '","typeArguments":[{args}]}}'"""


_OWN = _dto("'D' || CAST(p_partkey % 40 AS STRING)")
_INNER = """{"kind":"dto","dtoId":"pkg.D' || CAST(p_partkey % 40 AS STRING) || '","typeArguments":[]}"""
_RESPONSE = (
    f"CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 9 = 1 THEN '{{\"kind\":\"array\",\"element\":{_INNER}}}'"
    f" WHEN p_size % 9 IN (2, 3) THEN '{{\"kind\":\"dto\",\"dtoId\":\"pkg.Page\",\"typeArguments\":[{_INNER}]}}'"
    f" WHEN p_size % 9 = 4 THEN '{{\"kind\":\"map\",\"value\":{_INNER}}}' WHEN p_size % 9 = 5 THEN '{{\"kind\":\"unknown\",\"name\":\"JsonNode\"}}' ELSE {_OWN} END"
)


def _endpoints(path: str, where: str, response: str = _RESPONSE) -> str:
    return f"""
  SELECT repo, method || ' ' || path AS id, method, path, handler, body_type_json, body_required, response_type_json, file, line, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, method, path ORDER BY pos) AS seen FROM (
      SELECT 'repo' || {_S.format('p_partkey % 2')} AS repo, {_METHOD.format(k='p_partkey')} AS method, {path} AS path,
        'C' || substr(p_brand, 7, 4) || '#h' || {_S.format('p_partkey')} AS handler,
        CASE WHEN p_partkey % 5 IN (1, 2) THEN {_OWN} END AS body_type_json, CASE WHEN p_partkey % 5 IN (1, 2) THEN p_size % 2 = 0 END AS body_required,
        {response} AS response_type_json, 'C' || substr(p_brand, 7, 4) || '.java' AS file, CAST(p_size AS INT) AS line, p_partkey AS pos
      FROM part WHERE {where}) e) d WHERE seen = 1"""


_SCALAR = """'{{"kind":"scalar","name":"{}"}}'"""


def _fields(after: bool) -> str:
    d = "SELECT DISTINCT 'pkg.D' || CAST(s_suppkey % 40 AS STRING) AS dto_id, s_suppkey % 40 AS k FROM supplier"
    f = lambda pos, name, kind, null, where="TRUE": f"SELECT dto_id, {pos} AS pos, '{name}' AS name, {kind} AS type_json, {null} AS nullable FROM d WHERE {where}"
    s = lambda n: _SCALAR.format(n)
    parent = """'{"kind":"dto","dtoId":"pkg.D' || CAST(CAST(floor(k / 2) AS INT) AS STRING) || '","typeArguments":[]}'"""
    enum = """'{"kind":"enum","enumId":"pkg.E' || CAST(k % 4 AS STRING) || '"}'"""
    rows = [
        f(0, "username" if after else "name", s("String"), "k % 2 = 0", "k % 3 = 0"),
        f(0, "name", s("String"), "k % 2 = 0", "k % 3 <> 0"),
        f(1, "total", s("String" if after else "int"), "k % 5 = 0", "k % 4 = 1"),
        f(1, "total", s("Long" if after else "Integer"), "k % 5 = 0" if not after else "k % 5 <= 1", "k % 4 <> 1"),
        f(2, "tags", s("String") if after else """'{"kind":"array","element":{"kind":"scalar","name":"String"}}'""", "TRUE", "k % 6 = 2"),
        f(2, "tags", """'{"kind":"array","element":{"kind":"scalar","name":"String"}}'""", "TRUE", "k % 6 <> 2"),
        f(3, "status", enum, "FALSE"),
        f(4, "parent", parent, "k % 7 <> 0" if after else "k % 2 = 1", "k > 0"),
        f(5, "attributes", """'{"kind":"map","value":{"kind":"scalar","name":"String"}}'""", "TRUE"),
    ]
    if after:
        rows.append(f(6, "extra", s("String"), "k % 2 = 1"))
    page = f"""SELECT 'pkg.Page' AS dto_id, 0 AS pos, 'content' AS name, '{{"kind":"array","element":{{"kind":"typeParameter","name":"T"}}}}' AS type_json, FALSE AS nullable
      UNION ALL SELECT 'pkg.Page', 1, 'total', {s('long')}, FALSE"""
    return f"SELECT r.repo, x.dto_id, CAST(x.pos AS INT) AS pos, x.name, x.type_json, x.nullable FROM ({' UNION ALL '.join(rows).replace('FROM d ', f'FROM ({d}) d ')} UNION ALL {page}) x CROSS JOIN repos r"


def _values(after: bool) -> str:
    return f"""
  SELECT r.repo, 'pkg.E' || CAST(e.k AS STRING) AS enum_id, CAST(v.pos AS INT) AS pos, v.value FROM (SELECT DISTINCT s_suppkey % 4 AS k FROM supplier) e
  CROSS JOIN (SELECT 0 AS pos, 'NEW' AS value UNION ALL SELECT 1, '{'CLOSED' if after else 'OPEN'}' UNION ALL SELECT 2, 'DONE') v CROSS JOIN repos r"""


def _params(after: bool) -> str:
    e = "endpoints_after" if after else "endpoints"
    s = _SCALAR.format("String")
    return f"""
  SELECT repo, id AS endpoint_id, 'q' AS name, {s} AS type_json, {'line % 3 = 0' if after else 'FALSE'} AS required, 'query' AS source, 0 AS pos FROM {e} WHERE method = 'GET'
  UNION ALL SELECT repo, id, 'size', {_SCALAR.format('int')}, line % 4 = 0, 'query', 1 FROM {e} WHERE method = 'GET' AND line % 2 = 0
  UNION ALL SELECT repo, id, 'id', {_SCALAR.format('String' if after else 'long')}, TRUE, 'path', 2 FROM {e} WHERE path LIKE '%{{id}}%'
  {"UNION ALL SELECT repo, id, 'tenant', " + s + ", line % 2 = 1, 'query', 3 FROM " + e + " WHERE line % 7 = 3" if after else ""}"""


_SUP, _LINE = "'repo' || CAST(s_suppkey % 2 AS STRING) AS repo", "'repo' || CAST(l_suppkey % 2 AS STRING) AS repo"
_K = "CAST(s_suppkey AS STRING)"
#: Line numbers of an order repeat in the given table.
_O = "CAST(l_orderkey AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING)"
_ONE = "(SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) l"
_NONE = "CAST(NULL AS STRING)"
#: Functions call the one before the last, in chains of twelve.
_INNER = "'g' || CAST(s_suppkey - 2 AS STRING)"

_T, _U = ('{"kind":"typeParameter","name":"%s"}' % n for n in "TU")
_UP = "CAST(2 * floor(s_suppkey / 4) + s_suppkey % 2 AS BIGINT)"
_CLASS = "'repo' || CAST(s_suppkey % 2 AS STRING) AS repo, 'pkg.S' || CAST(s_suppkey AS STRING) AS dto_id"


def _members() -> str:
    k, text, number = "s_suppkey", '{"kind":"scalar","name":"String"}', '{"kind":"scalar","name":"int"}'
    row = lambda kind, pos, name, type_json, null, where, json="CAST(NULL AS STRING)", skipped="FALSE": f"SELECT {_CLASS}, {pos} AS pos, '{kind}' AS kind, '{name}' AS name, {json} AS json_name, '{type_json}' AS type_json, {null} AS nullable, {skipped} AS skipped FROM supplier WHERE {where}"
    rows = (
        row("field", 0, "id", '{"kind":"scalar","name":"long"}', "FALSE", f"{k} % 2 = 0 OR {k} % 3 = 0"),
        row("field", 1, "userName", text, "TRUE", "TRUE", f"CASE WHEN {k} % 4 = 0 THEN 'user' END", f"{k} % 6 = 1"),
        row("field", 2, "total", number, "FALSE", f"{k} % 5 < 3"),
        row("field", 3, "value", _T, "TRUE", f"{k} % 3 < 2"),
        row("field", 4, "other", '{"kind":"map","value":' + _U + "}", f"{k} % 4 = 1", f"{k} % 3 = 1"),
        row("method", 0, "getId", text, "TRUE", f"{k} % 4 < 2", skipped=f"{k} % 9 = 0"),
        row("method", 1, "isActive", '{"kind":"scalar","name":"boolean"}', "FALSE", f"{k} % 3 = 0"),
        row("method", 2, "getURLPath", '{"kind":"array","element":' + _T + "}", "TRUE", f"{k} % 3 < 2 AND {k} % 7 < 2", f"CASE WHEN {k} % 2 = 0 THEN '' END"),
        row("method", 3, "toText", text, "TRUE", "TRUE"),
    )
    return " UNION ALL ".join(rows)


_FN = "'fn:' || CAST({s} AS STRING) || ':' || CAST({k} AS STRING)"
LENS = {
    "repos": "SELECT DISTINCT 'repo' || CAST(p_partkey % 2 AS STRING) AS repo FROM part",
    "endpoints": _endpoints(f"{_PATH} || {_TAIL}", "p_size % 11 <> 5"),
    "endpoints_after": _endpoints(f"{_PATH} || {_TAIL} || CASE WHEN p_size % 10 = 1 THEN '/v2' ELSE '' END", "p_size % 10 <> 3", _RESPONSE.replace("p_size % 9 = 0 THEN", "p_size % 9 = 8 THEN", 1)),
    "params": _params(False),
    "params_after": _params(True),
    "dtos": "SELECT r.repo, d.id, d.name, d.type_parameters FROM (SELECT DISTINCT 'pkg.D' || CAST(s_suppkey % 40 AS STRING) AS id, 'D' || CAST(s_suppkey % 40 AS STRING) AS name, split('', 'x') AS type_parameters FROM supplier UNION ALL SELECT 'pkg.Page', 'Page', split('T', ',')) d CROSS JOIN repos r",
    "dto_fields": _fields(False),
    "dto_fields_after": _fields(True),
    "enum_values": _values(False),
    "enum_values_after": _values(True),
    # a class for each supplier, that extends another one with arguments for its parameters
    "java_classes": f"""
  SELECT {_CLASS}, split(CASE s_suppkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'T,U' ELSE '' END, ',') AS type_parameters, CASE WHEN s_suppkey % 5 = 0 THEN 'snake' WHEN s_suppkey % 7 = 0 THEN 'kebab' END AS naming,
    CASE WHEN s_suppkey % 11 = 0 THEN split('total,none', ',') END AS ignored FROM supplier""",
    "java_extends": f"""
  SELECT {_CLASS}, 0 AS ord, 'pkg.S' || CAST({_UP} AS STRING) AS parent, CASE WHEN {_UP} % 3 < 2 THEN split(
      CASE s_suppkey % 3 WHEN 0 THEN '{{"kind":"array","element":{_T}}}' WHEN 1 THEN '{_U}' ELSE '{{"kind":"scalar","name":"String"}}' END
      || CASE WHEN {_UP} % 3 = 1 THEN '#' || CASE WHEN s_suppkey % 3 < 2 THEN '{_T}' ELSE '{{"kind":"scalar","name":"int"}}' END ELSE '' END, '#') END AS args FROM supplier WHERE {_UP} > 0
  UNION ALL SELECT {_CLASS}, 1, 'pkg.S2', NULL FROM supplier WHERE s_suppkey % 10 = 0""",
    "java_members": _members(),
    # chains of functions that pass a value on, and calls of them on API results
    "flow_seeds": f"SELECT {_LINE}, 'v:' || {_O} AS symbol, 'c' || {_O} AS call_id, CASE l_orderkey % 3 WHEN 0 THEN 'envelope' WHEN 1 THEN 'fetchResponse' ELSE 'body' END AS kind, 'direct' AS flow FROM {_ONE}",
    "flow_params": f"SELECT {_SUP}, 'g' || {_K} AS function_id, p AS position, CASE p WHEN 0 THEN 'p:' ELSE 'q:' END || {_K} AS symbol FROM supplier CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) n",
    "flow_results": f"SELECT {_SUP}, 'g' || {_K} AS function_id, 'r:' || {_K} AS symbol FROM supplier",
    "flow_steps": f"""
  SELECT {_SUP}, 'p:' || {_K} AS src, 'a:' || {_K} AS dst, CASE s_suppkey % 6 WHEN 1 THEN 'element' WHEN 2 THEN 'same' ELSE 'field' END AS op, CASE WHEN s_suppkey % 6 IN (0, 3, 5) THEN 'f' || CAST(s_suppkey % 5 AS STRING) END AS segment FROM supplier WHERE s_suppkey % 6 <> 4
  UNION ALL SELECT {_SUP}, 'a:' || {_K}, 'b:' || {_K}, 'same', {_NONE} FROM supplier WHERE s_suppkey % 24 < 2 OR s_suppkey <= 2
  UNION ALL SELECT {_SUP}, 'b:' || {_K}, 'r:' || {_K}, CASE WHEN s_suppkey % 4 = 0 THEN 'field' ELSE 'same' END, CASE WHEN s_suppkey % 4 = 0 THEN 'g' || CAST(s_suppkey % 3 AS STRING) END FROM supplier WHERE s_suppkey % 7 <> 3
  UNION ALL SELECT {_LINE}, 'v:' || {_O}, 'w:' || {_O}, CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 9 > 0 THEN 'field' ELSE 'same' END, CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 9 > 0 THEN 'data' END FROM {_ONE} WHERE l_orderkey % 3 <> 1
  UNION ALL SELECT {_LINE}, 'h:' || {_O}, 'z:' || {_O}, 'field', 'data' FROM {_ONE}""",
    "flow_methods": f"""
  SELECT {_SUP}, 'p:' || {_K} AS src, 'filter' AS method, 'a:' || {_K} AS dst, 'i:' || {_K} AS callback_param, {_NONE} AS callback_result FROM supplier WHERE s_suppkey % 6 = 4
  UNION ALL SELECT {_LINE}, 'v:' || {_O}, 'json', 'w:' || {_O}, {_NONE}, {_NONE} FROM {_ONE} WHERE l_orderkey % 3 = 1
  UNION ALL SELECT {_LINE}, 'z:' || {_O}, CASE l_partkey % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'find' WHEN 2 THEN 'then' ELSE 'join' END, 'u:' || {_O}, 'y:' || {_O}, 'y:' || {_O} FROM {_ONE}""",
    "flow_hooks": f"SELECT {_LINE}, 'x:' || {_O} AS result, 'h:' || {_O} AS dst FROM {_ONE}",
    "flow_calls": f"""
  SELECT {_SUP}, 'a:' || {_K} AS src, 'b:' || {_K} AS dst, CASE WHEN s_suppkey % 13 = 5 THEN 'ghost' ELSE {_INNER} END AS function_id, 0 AS position FROM supplier WHERE s_suppkey % 24 >= 2 AND s_suppkey > 2
  UNION ALL SELECT {_LINE}, 'w:' || {_O}, 'x:' || {_O}, CASE WHEN l_partkey % 10 > 0 THEN 'g' || CAST(l_suppkey AS STRING) END, 0 FROM {_ONE}""",
    # API calls within the innermost functions, what each function returns of its inner call, and where functions are called
    "wrap_calls": f"""
  SELECT {_SUP}, 'c' || {_K} AS id, CASE WHEN s_suppkey % 4 < 2 THEN '/api/s' || {_K} END AS endpoint_pattern, CASE WHEN s_suppkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE s_suppkey % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'envelope' ELSE 'fetchResponse' END AS kind,
    CASE WHEN s_suppkey % 4 >= 2 THEN CAST(floor(s_suppkey / 4) AS INT) % 2 END AS url_position FROM supplier WHERE s_suppkey % 6 < 2 OR s_suppkey <= 2""",
    "wrap_returns": f"""
  SELECT {_SUP}, 'g' || {_K} AS function_id, 'c' || {_K} AS call_id, CASE s_suppkey % 3 WHEN 1 THEN 'field' WHEN 2 THEN 'json' END AS op, CASE WHEN s_suppkey % 3 = 1 THEN 'data' END AS segment FROM supplier WHERE s_suppkey % 6 < 2 OR s_suppkey <= 2
  UNION ALL SELECT {_SUP}, 'g' || {_K}, 's' || {_K}, CASE s_suppkey % 5 WHEN 0 THEN 'field' WHEN 1 THEN 'element' END, CASE WHEN s_suppkey % 5 = 0 THEN 'x' || CAST(s_suppkey % 3 AS STRING) END FROM supplier WHERE s_suppkey % 6 >= 2 AND s_suppkey > 2 AND s_suppkey % 11 <> 7""",
    "wrap_sites": f"""
  SELECT {_SUP}, 's' || {_K} AS id, {_INNER} AS function_id, 'src/s' || {_K} || '.ts' AS file, CAST(s_suppkey % 90 AS INT) AS line, CASE WHEN s_suppkey % 9 = 4 THEN '/x/' || {_K} || '?a=1' END AS text0, CASE WHEN s_suppkey % 9 <> 4 THEN 1 END AS position0,
    CASE WHEN s_suppkey % 9 = 4 THEN '/y/' || {_K} || '/' END AS text1, CASE WHEN s_suppkey % 9 <> 4 THEN 0 END AS position1 FROM supplier WHERE s_suppkey % 6 >= 2 AND s_suppkey > 2
  UNION ALL SELECT {_LINE}, 'l' || {_O} || lower(l_returnflag), 'g' || CAST(l_suppkey AS STRING), 'src/l.ts', CAST(l_orderkey % 90 AS INT), '/o0/$' || '{{id}}', NULL, CASE WHEN l_partkey % 6 > 0 THEN '/o1/' || lower(l_returnflag) || '/$' || '{{id}}?q=1' END, NULL FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber = 2) l""",
    # classes within classes, with supertypes, static imports and constants made of names
    "scoped_types": "SELECT 'default' AS repo, 'pkg.K' || CAST(s_suppkey AS STRING) AS type, CASE WHEN s_suppkey % 4 IN (1, 2) AND s_suppkey > 2 THEN 'pkg.K' || CAST(s_suppkey - 1 AS STRING) END AS outer_type FROM supplier",
    "scoped_supers": """
  SELECT 'default' AS repo, 'pkg.K' || CAST(s_suppkey AS STRING) AS type, 1 AS ord, 'pkg.K' || CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING) AS parent FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 0
  UNION ALL SELECT 'default', 'pkg.K' || CAST(s_suppkey AS STRING), 0, 'pkg.K' || CAST(s_suppkey - 3 AS STRING) FROM supplier WHERE s_suppkey % 5 = 0""",
    "scoped_imports": """
  SELECT 'default' AS repo, 'pkg.K' || CAST(s_suppkey AS STRING) AS type, 0 AS ord, 'pkg.K' || CAST(CAST(floor(s_suppkey / 7) AS BIGINT) AS STRING) AS owner, CAST(NULL AS STRING) AS name FROM supplier WHERE s_suppkey % 7 < 2
  UNION ALL SELECT 'default', 'pkg.K' || CAST(s_suppkey AS STRING), 1, 'pkg.K' || CAST(s_suppkey - 5 AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN 'BASE' ELSE 'PATH' END FROM supplier WHERE s_suppkey % 7 < 5""",
    # the parts of constants in order: text, name, owner
    "scoped_parts": f"""
  SELECT 'default' AS repo, 'pkg.K' || {_K} AS type, 'BASE' AS name, 0 AS i, {_NONE} AS literal, 'BASE' AS ref, 'pkg.K' || CAST(s_suppkey - 12 AS STRING) AS owner FROM supplier WHERE s_suppkey % 12 = 6 AND s_suppkey % 60 <> 6
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'BASE', 1, '/b' || {_K}, {_NONE}, {_NONE} FROM supplier WHERE s_suppkey % 6 = 0
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'PATH', 0, {_NONE}, 'BASE', {_NONE} FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'PATH', 1, '/p' || {_K}, {_NONE}, {_NONE} FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'FULL', 0, {_NONE}, 'PATH', {_NONE} FROM supplier
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'FULL', 1, '/f', {_NONE}, {_NONE} FROM supplier
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'FULL', 2, {_NONE}, 'BASE', 'pkg.K' || CAST(s_suppkey - 2 AS STRING) FROM supplier WHERE s_suppkey % 9 = 2
  UNION ALL SELECT 'default', 'pkg.K' || {_K}, 'ROUND', 0, {_NONE}, CASE WHEN s_suppkey % 2 = 0 THEN 'ROUND' ELSE 'MISSING' END, {_NONE} FROM supplier WHERE s_suppkey % 11 = 0""",
    "files": "SELECT 'repo' || CAST(s_suppkey % 2 AS STRING) AS repo, 'src/s' || CAST(s_suppkey AS STRING) || '.tsx' AS path FROM supplier",
    "imports": """
  SELECT 'repo' || CAST(s_suppkey % 2 AS STRING) AS repo, 'src/s' || CAST(s_suppkey AS STRING) || '.tsx' AS file,
    'src/s' || CAST(CAST(2 * floor(s_suppkey / 4) + s_suppkey % 2 AS BIGINT) AS STRING) || '.tsx' AS resolved_file FROM supplier
  UNION ALL SELECT 'repo' || CAST(s_suppkey % 2 AS STRING), 'src/s' || CAST(s_suppkey AS STRING) || '.tsx', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'src/s' || CAST(s_suppkey + 6 AS STRING) || '.tsx' END FROM supplier WHERE s_suppkey % 10 < 2""",
    "functions": f"""
  SELECT 'repo' || CAST(s_suppkey % 2 AS STRING) AS repo, {_FN.format(s='s_suppkey', k='k')} AS id,
    CASE k WHEN 0 THEN 'get' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'Card' || CAST(s_suppkey AS STRING) WHEN 2 THEN '<anonymous>' ELSE 'use' || CAST(s_suppkey AS STRING) END AS name,
    'src/s' || CAST(s_suppkey AS STRING) || '.tsx' AS file, CAST(10 * k AS INT) AS line, CAST(1 AS INT) AS col,
    CASE WHEN k IN (1, 2) THEN 'Card' || CAST(s_suppkey AS STRING) END AS containing_component
  FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f""",
    "api_calls": f"""
  SELECT repo, id, CASE WHEN l_linenumber = 6 THEN NULL ELSE
      CASE l_linenumber % 3 WHEN 0 THEN replace(path, '{{id}}', '{{param}}') WHEN 1 THEN replace(path, '{{id}}', '42') ELSE replace(path, '/search', '/find') END END AS endpoint_pattern,
    CASE WHEN l_linenumber = 5 THEN 'PATCH' WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN NULL ELSE method END AS method, 'client.' || lower(method) AS callee,
    CASE WHEN l_returnflag = 'R' THEN 'wrapper' ELSE 'direct' END AS resolution,
    CASE WHEN l_returnflag = 'R' THEN {_FN.format(s='l_suppkey', k='0')} END AS wrapper_function_id,
    CASE WHEN l_linenumber <> 4 THEN {_FN.format(s='l_suppkey', k='(l_partkey % 4)')} END AS caller_function_id,
    'src/s' || CAST(l_suppkey AS STRING) || '.tsx' AS file, CAST(l_orderkey % 400 AS INT) AS line, CAST(l_linenumber AS INT) AS col,
    CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_partkey % 3 = 0 THEN split('q,page', ',') ELSE split('q,size', ',') END AS query_keys,
    CASE WHEN l_returnflag = 'R' OR method IN ('GET', 'DELETE') THEN NULL WHEN l_partkey % 3 = 0 THEN split('name,total,stats', ',') ELSE split('name,status', ',') END AS body_keys,
    'client.' || lower(method) || '(url)' AS code
  FROM (
    SELECT l.*, 'repo' || CAST(l_suppkey % 2 AS STRING) AS repo, CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS id, {_METHOD.format(k='p_partkey')} AS method, {_PATH} || {_TAIL} AS path
    FROM lineitem l JOIN part ON p_partkey = l_partkey) c""",
    "property_accesses": f"""
  SELECT 'repo' || CAST(l_suppkey % 2 AS STRING) AS repo, 'a:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS id,
    CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS api_call_id, 'data' AS object,
    split(CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'name' WHEN 1 THEN 'total' WHEN 2 THEN 'content,[],name' WHEN 3 THEN '[],name' WHEN 4 THEN 'tags,[]'
      WHEN 5 THEN 'parent,name' WHEN 6 THEN 'nmae' WHEN 7 THEN 'status' ELSE 'status,label' END, ',') AS path,
    CASE WHEN l_linestatus = 'O' THEN 'direct' ELSE 'derived' END AS flow, 'src/s' || CAST(CASE WHEN l_linenumber = 2 AND l_suppkey > 2 THEN l_suppkey - 2 ELSE l_suppkey END AS STRING) || '.tsx' AS file,
    CAST(l_orderkey % 400 + 1 AS INT) AS line, CAST(l_linenumber AS INT) AS col, {_FN.format(s='l_suppkey', k='(l_partkey % 3)')} AS containing_function_id,
    CASE WHEN l_partkey % 3 > 0 THEN 'Card' || CAST(l_suppkey AS STRING) END AS containing_component, 'data.x' AS code
  FROM lineitem WHERE l_linenumber <= 4""",
}
#: Names that a lens needs before it, and given tables that it reads.
NEEDS = {"params": ["endpoints"], "params_after": ["endpoints_after"], "dtos": ["repos"], "dto_fields": ["repos"], "dto_fields_after": ["repos"], "enum_values": ["repos"], "enum_values_after": ["repos"]}


def lens_sql(*names: str) -> str:
    """The named tables and what they need, as a list of common table expressions."""
    order: list[str] = []
    for n in names:
        for need in [*NEEDS.get(n, []), n]:
            if need not in order:
                order.append(need)
    return ", ".join(f"{n} AS ({LENS[n]})" for n in order)


def lens(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived table. The given tables are bound by name for this query only."""
    given = [t for t in ("part", "lineitem", "supplier") if any(t in LENS[n] for n in [*NEEDS.get(name, []), name])]
    text = f"WITH {lens_sql(name)} SELECT * FROM {name}"
    frames = {t: table(spark, folder, t) for t in given}
    head = ", ".join(f"{t} AS (SELECT * FROM {{{t}_}})" for t in given)
    safe = text.removeprefix("WITH ").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH {head}, {safe}", **{f"{t}_": df for t, df in frames.items()})
