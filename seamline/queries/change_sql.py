"""DuckDB texts of contract diffs and their impact, by recursions and plain joins.

``pr`` has the endpoints' fates, ``pc`` the changes of parameters, ``ch`` all changes, ``st`` graded sites, ``rep`` the
report. They read the lens tables in SIDES, and ``st`` and ``rep`` what ``linked`` gives.
"""

from __future__ import annotations

from seamline.functions.paths import NUMBERS
from seamline.operators import types
from seamline.queries.duck import shown

SIDES = ("endpoints_after", "params", "params_after", "dtos", "dto_fields", "dto_fields_after", "enum_values", "enum_values_after")


def json_text(x: str, key: str) -> str:
    return f"json_extract_string({x}, '$.{key}')"


def described(x: str) -> str:
    for _ in range(3):
        for pattern, text in types.DESCRIPTION:
            x = f"regexp_replace({x}, '{pattern}', '{text.replace('$', chr(92))}', 'g')"
    return x


PAIRS = """
gone AS (SELECT b.* FROM endpoints b ANTI JOIN endpoints_after a USING (repo, id)), new AS (SELECT a.* FROM endpoints_after a ANTI JOIN endpoints b USING (repo, id)),
tgt AS (SELECT repo, method, handler, max_by(id, pos) AS new_id FROM new GROUP BY ALL),
pr AS (
  SELECT g.repo, g.id AS endpoint_id, CASE WHEN t.new_id IS NULL THEN 'removed' ELSE 'moved' END AS status, t.new_id, g.handler FROM gone g LEFT JOIN tgt t USING (repo, method, handler)
  UNION ALL SELECT n.repo, n.id, 'added', NULL, n.handler FROM new n WHERE NOT EXISTS (FROM gone g JOIN tgt t USING (repo, method, handler) WHERE g.repo = n.repo AND t.new_id = n.id)
  UNION ALL SELECT b.repo, b.id, 'common', b.id, b.handler FROM endpoints b SEMI JOIN endpoints_after a USING (repo, id)),
kp AS (SELECT * FROM pr WHERE status IN ('common', 'moved'))"""


def _name(x: str) -> str:
    return f"coalesce({json_text(x, 'dtoId')}, {json_text(x, 'enumId')}, {json_text(x, 'name')})"


def _category(x: str, known: str) -> str:
    numbers = ", ".join(f"'{n}'" for n in NUMBERS)
    return (
        f"CASE {json_text(x, 'kind')} WHEN 'scalar' THEN CASE WHEN {_name(x)} IN ({numbers}) THEN 'number' WHEN {_name(x)} IN ('boolean', 'Boolean') THEN 'boolean' ELSE 'string' END"
        f" WHEN 'enum' THEN 'string' WHEN 'array' THEN 'array' WHEN 'map' THEN 'object' ELSE CASE WHEN {known} THEN 'object' ELSE 'unknown:' || {_name(x)} END END"
    )


PARAMS = f"""
pb AS (SELECT k.repo, k.endpoint_id, source, name, {json_text('type_json', 'name')} AS d, type_json AS t, required, p.pos FROM params p JOIN kp k ON k.repo = p.repo AND k.endpoint_id = p.endpoint_id),
pa AS (SELECT k.repo, k.endpoint_id, source, name, {json_text('type_json', 'name')} AS d, type_json AS t, required, p.pos FROM params_after p JOIN kp k ON k.repo = p.repo AND k.new_id = p.endpoint_id),
pp AS (SELECT repo, endpoint_id, source, name, b.d AS bd, a.d AS ad, b.t AS old, a.t AS now, b.required AS br, a.required AS ar, b.pos AS bp, a.pos AS ap, source || ' parameter `' || name || '`' AS label FROM pb b FULL JOIN pa a USING (repo, endpoint_id, source, name)),
pc AS (
  SELECT repo, endpoint_id, 'param-removed' AS kind, [name] AS path, bd AS before, NULL AS after, FALSE AS breaking, label || ' was removed' AS message, [1, bp, 0] AS ord FROM pp WHERE ad IS NULL
  UNION ALL SELECT repo, endpoint_id, 'param-type-changed', [name], bd, ad, {_category('old', 'FALSE')} <> {_category('now', 'FALSE')}, label || ' type changed: ' || bd || ' → ' || ad, [1, bp, 0] FROM pp WHERE bd <> ad
  UNION ALL SELECT repo, endpoint_id, 'param-required-changed', [name], 'optional', 'required', TRUE, label || ' is now required', [1, bp, 1] FROM pp WHERE NOT br AND ar
  UNION ALL SELECT repo, endpoint_id, 'param-added', [name], NULL, ad, ar, CASE WHEN ar THEN 'Required ' ELSE 'Optional ' END || label || ' was added', [2, ap] FROM pp WHERE bd IS NULL)"""

_K = lambda x: json_text(x, "kind")
_D = lambda x: json_text(x, "dtoId")
_IN = lambda x: f"coalesce(json_extract({x}, '$.element'), json_extract({x}, '$.value'))::VARCHAR"
_ARG = lambda x: f"coalesce(json_extract({x}, '$.typeArguments[0]')::VARCHAR, '')"
_PUT = lambda x, t: f"""CASE WHEN {_ARG(x)} <> '' THEN replace({t}, '{{"kind":"typeParameter","name":"T"}}', {_ARG(x)}) ELSE {t} END"""
_PAIR = f"({_D('x')} || '|' || {_D('y')})"
_BOTH = f"{_K('x')} = 'dto' AND {_K('y')} = 'dto'"
_CAP = "CASE direction WHEN 'response' THEN 'Response' ELSE 'Request' END"
_HERE = "list_append(path, seg)"
_SHOWN = f"'`' || {shown(_HERE)} || '`'"
_SHAPE = lambda k: f"CASE {k} WHEN 'array' THEN 'an array' ELSE 'an object/value' END"
_SIDE = lambda n, f, x: f"""f{n} AS (
  SELECT tw.repo, rx, ry, direction, path, ord, x, y, f.name AS seg, {_PUT(x, 'f.type_json')} AS n{n}, f.nullable AS b{n}, f.pos AS p{n}
  FROM tw JOIN {f} f ON f.repo = tw.repo AND f.dto_id = {_D(x)} WHERE {_BOTH} AND NOT list_contains(seen, {_PAIR})
    AND EXISTS (FROM dtos d WHERE d.repo = tw.repo AND d.id = {_D('x')}) AND EXISTS (FROM dtos d WHERE d.repo = tw.repo AND d.id = {_D('y')}))"""  # noqa: E731
#: One value of an enum that the other side lacks.
_VALUE = lambda what, mine, theirs, i, old, new, breaking, more: f"""
  SELECT lv.repo, rx, ry, direction, 'enum-value-{what}', path, {old}, {new}, {breaking}, regexp_replace({json_text(i, 'enumId')}, '^.*\\.', '') || ' value "' || v.value || '" (' || direction || ' ' || spot || ') was {what}', list_append(ord, v.pos + {more})
  FROM lv JOIN {mine} v ON v.repo = lv.repo AND v.enum_id = {json_text(i, 'enumId')} WHERE lv.kx = 'enum' AND lv.ky = 'enum'
    AND EXISTS (FROM {theirs} o WHERE o.repo = lv.repo AND o.enum_id = {json_text('y' if i == 'x' else 'x', 'enumId')})
    AND NOT EXISTS (FROM {theirs} o WHERE o.repo = lv.repo AND o.enum_id = {json_text('y' if i == 'x' else 'x', 'enumId')} AND o.value = v.value)"""  # noqa: E731

CHANGES = f"""{PAIRS}, {PARAMS},
ec AS (
  SELECT pr.repo, endpoint_id, 'endpoint-' || status AS kind, 'endpoint' AS "where", []::VARCHAR[] AS path, CASE status WHEN 'moved' THEN b.path WHEN 'removed' THEN endpoint_id END AS before,
    CASE status WHEN 'moved' THEN a.path WHEN 'added' THEN endpoint_id END AS after, status <> 'added' AS breaking,
    CASE status WHEN 'moved' THEN 'Moved to ' || new_id WHEN 'removed' THEN endpoint_id || ' was removed' ELSE endpoint_id || ' was added' END AS message, [0] AS ord
  FROM pr LEFT JOIN endpoints b ON b.repo = pr.repo AND b.id = endpoint_id LEFT JOIN endpoints_after a ON a.repo = pr.repo AND a.id = new_id WHERE status <> 'common'),
kb AS (
  SELECT k.repo, k.endpoint_id, b.body_type_json AS bb, a.body_type_json AS ab, coalesce(a.body_required, FALSE) AS aq, b.response_type_json AS br, a.response_type_json AS ar
  FROM kp k JOIN endpoints b ON b.repo = k.repo AND b.id = k.endpoint_id JOIN endpoints_after a ON a.repo = k.repo AND a.id = k.new_id),
two AS (SELECT repo, endpoint_id, bb AS x, ab AS y, 'request' AS direction, 3 AS o, aq FROM kb UNION ALL SELECT repo, endpoint_id, br, ar, 'response', 4, aq FROM kb),
whole AS (
  SELECT repo, endpoint_id, CASE direction WHEN 'response' THEN 'response' ELSE 'body' END || CASE WHEN y IS NULL THEN '-removed' ELSE '-added' END AS kind, direction AS "where", []::VARCHAR[] AS path, {described('x')} AS before, {described('y')} AS after,
    CASE WHEN y IS NULL THEN direction = 'response' ELSE direction <> 'response' AND aq END AS breaking,
    CASE WHEN direction = 'response' THEN 'Response body was ' || CASE WHEN y IS NULL THEN 'removed' ELSE 'added' END WHEN y IS NULL THEN 'Request body is no longer read'
      ELSE 'Request body ' || {described('y')} || ' was added' || CASE WHEN aq THEN ' (required)' ELSE '' END END AS message, [o] AS ord
  FROM two WHERE (x IS NULL) <> (y IS NULL)),
tw AS (
  SELECT DISTINCT repo, x AS rx, y AS ry, direction, []::VARCHAR[] AS path, x, y, []::VARCHAR[] AS seen, []::INT[] AS ord FROM two WHERE x IS NOT NULL AND y IS NOT NULL
  UNION ALL
  SELECT tw.repo, rx, ry, direction, list_append(path, CASE {_K('x')} WHEN 'array' THEN '[]' WHEN 'map' THEN '*' ELSE f.name END), CASE WHEN {_K('x')} = 'dto' THEN {_PUT('x', 'f.type_json')} ELSE {_IN('x')} END,
    CASE WHEN {_K('x')} = 'dto' THEN {_PUT('y', 'g.type_json')} ELSE {_IN('y')} END, CASE WHEN {_K('x')} = 'dto' THEN list_append(seen, {_PAIR}) ELSE seen END, CASE WHEN {_K('x')} = 'dto' THEN list_concat(ord, [f.pos, 1]) ELSE ord END
  FROM tw LEFT JOIN dto_fields f ON {_BOTH} AND f.repo = tw.repo AND f.dto_id = {_D('x')} LEFT JOIN dto_fields_after g ON g.repo = tw.repo AND g.dto_id = {_D('y')} AND g.name = f.name
  WHERE ({_K('x')} = {_K('y')} AND {_K('x')} IN ('array', 'map')) OR (g.name IS NOT NULL AND NOT list_contains(seen, {_PAIR}))),
lv AS (
  SELECT tw.*, {_K('x')} AS kx, {_K('y')} AS ky, {described('x')} AS xd, {described('y')} AS yd, CASE WHEN len(path) > 0 THEN '`' || {shown('path')} || '`' ELSE 'body' END AS spot,
    {_category('x', f"EXISTS (FROM dtos d WHERE d.repo = tw.repo AND d.id = {_D('x')})")} <> {_category('y', f"EXISTS (FROM dtos d WHERE d.repo = tw.repo AND d.id = {_D('y')})")} AS differ FROM tw),
{_SIDE('x', 'dto_fields', 'x')}, {_SIDE('y', 'dto_fields_after', 'y')},
met AS (SELECT * FROM fx FULL JOIN fy USING (repo, rx, ry, direction, path, ord, x, y, seg)),
tc AS (
  SELECT repo, rx, ry, direction, 'shape-changed' AS kind, path, xd AS before, yd AS after, TRUE AS breaking, {_CAP} || ' ' || spot || ' changed from ' || {_SHAPE('kx')} || ' to ' || {_SHAPE('ky')} || ' (' || xd || ' → ' || yd || ')' AS message, ord
  FROM lv WHERE (kx = 'array') <> (ky = 'array')
  UNION ALL SELECT repo, rx, ry, direction, 'field-type-changed', path, xd, yd, differ, {_CAP} || ' ' || spot || ' type changed: ' || xd || ' → ' || yd || CASE WHEN differ THEN '' ELSE ' (same JSON type)' END, ord
  FROM lv WHERE kx <> 'array' AND ky <> 'array' AND NOT (kx = ky AND kx IN ('dto', 'enum', 'map')) AND xd <> yd
  UNION ALL {_VALUE('removed', 'enum_values', 'enum_values_after', 'x', 'v.value', 'NULL', 'TRUE', 0)} UNION ALL {_VALUE('added', 'enum_values_after', 'enum_values', 'y', 'NULL', 'v.value', 'FALSE', 1000)}
  UNION ALL SELECT repo, rx, ry, direction, 'field-removed', {_HERE}, {described('nx')}, NULL, direction = 'response', {_CAP} || ' field ' || {_SHOWN} || ' was removed', list_concat(ord, [px, 0]) FROM met WHERE ny IS NULL
  UNION ALL SELECT repo, rx, ry, direction, 'field-added', {_HERE}, NULL, {described('ny')}, direction <> 'response' AND NOT "by", {_CAP} || ' field ' || {_SHOWN} || ' was added' || CASE WHEN direction <> 'response' AND NOT "by" THEN ' (required)' ELSE '' END, list_concat(ord, [py + 1000000, 0]) FROM met WHERE nx IS NULL
  UNION ALL SELECT repo, rx, ry, direction, 'field-nullable-changed', {_HERE}, CASE WHEN bx THEN 'nullable' ELSE 'non-null' END, CASE WHEN "by" THEN 'nullable' ELSE 'non-null' END, (direction = 'response') = "by",
    {_CAP} || ' field ' || {_SHOWN} || CASE WHEN direction = 'response' THEN CASE WHEN "by" THEN ' may now be null' ELSE ' is now never null' END WHEN "by" THEN ' is now optional' ELSE ' is now required' END, list_concat(ord, [px, 0])
  FROM met WHERE nx IS NOT NULL AND ny IS NOT NULL AND bx <> "by"),
ch AS (
  SELECT * FROM ec UNION ALL SELECT repo, endpoint_id, kind, 'param', path, before, after, breaking, message, ord FROM pc UNION ALL SELECT * FROM whole
  UNION ALL SELECT w.repo, w.endpoint_id, tc.kind, w.direction, tc.path, tc.before, tc.after, tc.breaking, tc.message, list_concat([w.o], tc.ord) FROM two w JOIN tc ON tc.repo = w.repo AND tc.rx = w.x AND tc.ry = w.y AND tc.direction = w.direction)"""

COUNTS = """SELECT repo, p.added, p.removed, coalesce(c.n, 0) AS changed, coalesce(b.n, 0) AS breaking
  FROM (SELECT repo, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed FROM pr GROUP BY repo) p
  LEFT JOIN (SELECT repo, count(DISTINCT endpoint_id) AS n FROM ch WHERE kind NOT IN ('endpoint-added', 'endpoint-removed') GROUP BY repo) c USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n FROM ch WHERE breaking GROUP BY repo) b USING (repo)"""

_UNSURE = "(body_keys IS NULL OR len(path) <> 1)"
_ADDED = "kind IN ('field-added', 'field-nullable-changed')"
_AT = shown("path")
SITES = f"""{CHANGES},
cc AS (
  SELECT c.repo, c.endpoint_id, c.kind, c.path, c.before, c.after, c.message, c.ord, p.new_id, s.id AS api_call_id, s.file, s.line, s.col, s.code, s.function_name, s.component, s.via, s.query_keys, s.body_keys
  FROM ch c JOIN pr p ON p.repo = c.repo AND p.endpoint_id = c.endpoint_id JOIN sites s ON s.repo = c.repo AND s.endpoint_id = c.endpoint_id AND s.status = 'matched' WHERE c.breaking AND c."where" <> 'response'),
rc AS (
  SELECT c.repo, c.endpoint_id, c.kind, c.path, c.before, c.after, c.ord, r.api_call_id, r.id AS access_id, r.path AS read, r.flow, r.file, r.line, r.col, r.code, f.name AS function_name, r.containing_component AS component, len(r.path) > len(c.path) AS deeper
  FROM ch c JOIN reads r ON r.repo = c.repo AND r.endpoint_id = c.endpoint_id LEFT JOIN functions f ON f.repo = r.repo AND f.id = r.containing_function_id
  WHERE c.breaking AND c."where" = 'response' AND len(c.path) <= len(r.path) AND NOT list_contains(list_transform(range(1, len(c.path) + 1), lambda i: c.path[i] = '*' OR c.path[i] = r.path[i]), FALSE)),
hit AS (
  SELECT repo, endpoint_id, ord, file, line, col, code, function_name, component, api_call_id, CAST(NULL AS VARCHAR) AS access_id,
    CASE WHEN kind = 'endpoint-removed' THEN 'DEFINITE' WHEN kind = 'endpoint-moved' THEN CASE WHEN via IS NOT NULL THEN 'POSSIBLE' ELSE 'DEFINITE' END
      WHEN kind IN ('param-added', 'param-required-changed') THEN CASE WHEN query_keys IS NULL THEN 'POSSIBLE' WHEN NOT list_contains(query_keys, path[1]) THEN 'DEFINITE' END
      WHEN kind IN ('param-type-changed', 'enum-value-removed') THEN 'POSSIBLE' WHEN kind = 'body-added' THEN CASE WHEN body_keys IS NULL OR len(body_keys) > 0 THEN 'POSSIBLE' ELSE 'DEFINITE' END
      WHEN kind IN ('field-added', 'field-nullable-changed', 'field-type-changed', 'shape-changed') THEN
        CASE WHEN {_UNSURE} THEN 'POSSIBLE' WHEN {_ADDED} AND NOT list_contains(body_keys, path[1]) THEN 'DEFINITE' WHEN NOT {_ADDED} AND list_contains(body_keys, path[1]) THEN 'LIKELY' END END AS grade,
    CASE WHEN kind = 'endpoint-removed' THEN 'Calls ' || endpoint_id || ', which was removed' WHEN kind = 'endpoint-moved' THEN CASE WHEN via IS NOT NULL THEN 'Goes through ' || via || '(), which must switch to ' || new_id ELSE 'Calls ' || endpoint_id || '; the endpoint moved to ' || new_id END
      WHEN kind IN ('param-added', 'param-required-changed') THEN CASE WHEN query_keys IS NULL THEN 'Cannot tell whether `' || path[1] || '` is sent; it is now required' ELSE 'Does not send `' || path[1] || '`, which is now required' END
      WHEN kind = 'param-type-changed' THEN 'Parameter `' || path[1] || '` changed ' || before || ' → ' || after WHEN kind = 'enum-value-removed' THEN 'May send removed value "' || before || '"'
      WHEN kind = 'body-added' THEN CASE WHEN body_keys IS NULL THEN 'A request body is now required' ELSE 'A request body ' || after || ' is now required' END
      WHEN {_UNSURE} THEN 'Request body `' || {_AT} || '`: ' || message WHEN {_ADDED} THEN 'Does not send `' || {_AT} || '`, which is now required' ELSE 'Sends `' || {_AT} || '`: ' || message END AS reason
  FROM cc
  UNION ALL
  SELECT repo, endpoint_id, ord, file, line, col, code, function_name, component, api_call_id, access_id, CASE WHEN g IS NOT NULL AND flow = 'derived' THEN 'POSSIBLE' ELSE g END,
    reason || CASE WHEN flow = 'derived' THEN ' (value passed through a function that could not be followed)' ELSE '' END
  FROM (
    SELECT *, CASE WHEN kind IN ('response-removed', 'field-removed') THEN 'DEFINITE' WHEN kind = 'field-type-changed' THEN 'LIKELY' WHEN kind = 'shape-changed' THEN CASE WHEN deeper THEN 'DEFINITE' ELSE 'LIKELY' END
        WHEN kind = 'field-nullable-changed' THEN CASE WHEN deeper THEN 'LIKELY' ELSE 'POSSIBLE' END WHEN kind = 'enum-value-removed' AND NOT deeper THEN 'POSSIBLE' END AS g,
      CASE WHEN kind = 'response-removed' THEN 'Reads `' || {shown('read')} || '` but the response body was removed' WHEN kind = 'field-removed' THEN 'Reads `' || {shown('read')} || '`; `' || {_AT} || '` was removed from the response'
        WHEN kind = 'field-type-changed' THEN 'Reads `' || {shown('read')} || '`; `' || {_AT} || '` changed ' || before || ' → ' || after
        WHEN kind = 'shape-changed' THEN CASE WHEN deeper THEN 'Reads `' || {shown('read')} || '`; `' || CASE WHEN len(path) = 0 THEN 'body' ELSE {_AT} END || '` changed ' || before || ' → ' || after ELSE 'Uses `' || {_AT} || '`, which changed ' || before || ' → ' || after END
        WHEN kind = 'field-nullable-changed' THEN CASE WHEN deeper THEN 'Reads `' || {shown('read')} || '` through `' || {_AT} || '`, which may now be null' ELSE 'Uses `' || {_AT} || '`, which may now be null' END
        ELSE 'Reads `' || {_AT} || '`; value "' || before || '" no longer exists' END AS reason FROM rc) x),
st AS (SELECT repo, endpoint_id, confidence, reason, f.file, f.line, f.col, f.code, f.function_name, f.component, api_call_id, access_id FROM (
  SELECT repo, endpoint_id, list({{'file': file, 'line': line, 'col': col, 'code': code, 'function_name': function_name, 'component': component}} ORDER BY ord, reason, file, line, col, code, function_name NULLS FIRST, component NULLS FIRST)[1] AS f, ['DEFINITE', 'LIKELY', 'POSSIBLE'][min(list_position(['DEFINITE', 'LIKELY', 'POSSIBLE'], grade))] AS confidence,
    list_reduce(list(reason ORDER BY ord, reason), lambda acc, r: CASE WHEN contains(acc, r) THEN acc ELSE acc || '; ' || r END) AS reason,
    api_call_id, access_id
  FROM hit WHERE grade IS NOT NULL GROUP BY repo, endpoint_id, api_call_id, access_id) x)"""

_RESULT = "CASE WHEN {d} > 0 THEN 'FAIL' WHEN {l} + {p} > 0 THEN 'WARNING' ELSE 'PASS' END"
REPORT = f"""{SITES},
rep AS (
  SELECT c.repo, c.endpoint_id, CASE WHEN p.status IN ('common', 'moved') THEN 'changed' ELSE p.status END AS status, CASE WHEN p.status = 'moved' THEN p.new_id END AS moved_to, c.breaking,
    coalesce(k.n, 0) AS call_sites, coalesce(f.n, 0) AS related_files, coalesce(g.d, 0) AS definite, coalesce(g.l, 0) AS likely, coalesce(g.p, 0) AS possible, {_RESULT.format(d='coalesce(g.d, 0)', l='coalesce(g.l, 0)', p='coalesce(g.p, 0)')} AS result
  FROM (SELECT repo, endpoint_id, count(*) FILTER (breaking) AS breaking FROM ch GROUP BY ALL) c JOIN pr p USING (repo, endpoint_id)
  LEFT JOIN (SELECT repo, endpoint_id, count(*) AS n FROM linked WHERE endpoint_id IS NOT NULL GROUP BY ALL) k USING (repo, endpoint_id)
  LEFT JOIN (SELECT repo, endpoint_id, count(DISTINCT file) AS n FROM (SELECT repo, endpoint_id, file FROM linked UNION ALL SELECT repo, endpoint_id, file FROM reads) u WHERE endpoint_id IS NOT NULL GROUP BY ALL) f USING (repo, endpoint_id)
  LEFT JOIN (SELECT repo, endpoint_id, count(*) FILTER (confidence = 'DEFINITE') AS d, count(*) FILTER (confidence = 'LIKELY') AS l, count(*) FILTER (confidence = 'POSSIBLE') AS p FROM st GROUP BY ALL) g USING (repo, endpoint_id))"""
