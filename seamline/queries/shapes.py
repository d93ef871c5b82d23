"""Shapes of responses, and DTO fields through generic supertypes, over the lens tables."""

from __future__ import annotations

from seamline.functions.paths import NUMBERS
from seamline.operators import diff, inherit, shapes
from seamline.queries.change import sides
from seamline.queries.change_sql import PAIRS, json_text
from seamline.sources.lens import lens, lens_sql


def endpoint_shapes(spark, folder):
    before, after = sides(spark, folder)
    return shapes.endpoint_shapes(diff.endpoint_pairs(before, after), before, after)


def inherited_fields(spark, folder):
    return inherit.flatten_fields(*(lens(spark, folder, n) for n in ("java_classes", "java_extends", "java_members")))


_NUMBERS = ", ".join(f"'{n}'" for n in NUMBERS)


def _tokens(side: str) -> str:
    """Each type's text as tokens in the order of their keys: a node opens at its key and closes behind its children."""
    s = f"_{side}" if side else ""
    n, x = f"n{s}", json_text("cur", "kind")
    put = """CASE WHEN arg <> '' THEN replace(f.type_json, '{"kind":"typeParameter","name":"T"}', arg) ELSE f.type_json END"""
    return f"""
vals{s} AS (SELECT repo, enum_id, string_agg(to_json(value)::VARCHAR, ' | ' ORDER BY pos) AS u FROM enum_values{s} GROUP BY ALL),
t{s} AS (
  SELECT DISTINCT repo, response_type_json AS root, response_type_json AS cur, '' AS key, []::VARCHAR[] AS seen, '' AS pre, '' AS post FROM endpoints{s} WHERE response_type_json IS NOT NULL
  UNION ALL
  SELECT repo, root, nxt, key || ord, CASE WHEN k = 'dto' THEN list_append(seen, id) ELSE seen END, CASE WHEN k = 'dto' THEN repeat('  ', len(seen) + 1) || name || ': ' ELSE '' END, CASE WHEN k = 'dto' THEN CASE WHEN nullable THEN ' | null' ELSE '' END || ';' || chr(10) ELSE '' END FROM (
    SELECT t.repo, root, key, seen, {x} AS k, {json_text('cur', 'dtoId')} AS id, f.name, f.nullable, CASE {x} WHEN 'dto' THEN '/' || lpad(f.pos::VARCHAR, 4, '0') ELSE 'a' END AS ord,
      CASE {x} WHEN 'array' THEN json_extract(cur, '$.element')::VARCHAR WHEN 'map' THEN json_extract(cur, '$.value')::VARCHAR ELSE {put} END AS nxt
    FROM (SELECT *, coalesce(json_extract(cur, '$.typeArguments[0]')::VARCHAR, '') AS arg FROM t{s}) t LEFT JOIN dto_fields{s} f ON {x} = 'dto' AND f.repo = t.repo AND f.dto_id = {json_text('cur', 'dtoId')}
    WHERE {x} IN ('array', 'map') OR (f.name IS NOT NULL AND len(seen) < 5 AND NOT list_contains(seen, {json_text('cur', 'dtoId')}))) c),
{n} AS (SELECT *, repeat('  ', len(seen)) AS ind, (simple IS NOT NULL AND (len(seen) >= 5 OR list_contains(seen, did))) AS cut FROM (
    SELECT t.*, {x} AS k, {json_text('cur', 'name')} AS nm, {json_text('cur', 'dtoId')} AS own, v.u, regexp_extract(base, '^.{{"kind":"([a-zA-Z]+)"', 1) AS bk, regexp_extract(base, '"dtoId":"([^"]*)"', 1) AS did, d.name AS simple, bv.u AS bu FROM (SELECT *, '.' || regexp_replace(cur, '^(.{{0}}\\{{"kind":"array","element":)+', '') AS base FROM t{s}) t
    LEFT JOIN vals{s} v ON v.repo = t.repo AND v.enum_id = {json_text('cur', 'enumId')} LEFT JOIN vals{s} bv ON bv.repo = t.repo AND bv.enum_id = regexp_extract(base, '"enumId":"([^"]*)"', 1)
    LEFT JOIN dtos d ON d.repo = t.repo AND d.id = regexp_extract(base, '"dtoId":"([^"]*)"', 1)) a),
shape{s} AS (SELECT repo, root, string_agg(txt, '' ORDER BY key) AS shape FROM (
    SELECT repo, root, key, pre || CASE k WHEN 'scalar' THEN CASE WHEN nm IN ({_NUMBERS}) THEN 'number' WHEN nm IN ('boolean', 'Boolean') THEN 'boolean' ELSE 'string' END WHEN 'enum' THEN coalesce(u, 'string')
        WHEN 'array' THEN CASE WHEN paren THEN '(' ELSE '' END WHEN 'map' THEN 'Record<string, ' WHEN 'dto' THEN CASE WHEN simple IS NULL THEN 'unknown' WHEN cut THEN simple || ' /* … */' ELSE '{{' || chr(10) END ELSE 'unknown' END AS txt
    FROM (SELECT *, bk = 'map' OR (bk = 'enum' AND contains(bu, ' ')) OR (bk = 'dto' AND cut) AS paren FROM {n}) p
    UNION ALL SELECT repo, root, key || '~', CASE WHEN k = 'array' THEN CASE WHEN paren THEN ')' ELSE '' END || '[]' WHEN k = 'map' THEN '>' WHEN k = 'dto' AND simple IS NOT NULL AND NOT cut THEN ind || '}}' ELSE '' END || post
    FROM (SELECT *, bk = 'map' OR (bk = 'enum' AND contains(bu, ' ')) OR (bk = 'dto' AND cut) AS paren FROM {n}) p) q GROUP BY ALL)"""


_MARK = """'{"kind":"typeParameter","name":"' || %s || '"}'"""
#: Parameters are T and U, in this order.
_PUT = lambda x: f"""replace(replace(replace(replace({x}, {_MARK % "'T'"}, '<0>'), {_MARK % "'U'"}, '<1>'), '<0>', coalesce(u.env[1], {_MARK % "'T'"})), '<1>', coalesce(u.env[2], {_MARK % "'U'"}))"""
_SEPARATED = lambda s: f"lower(regexp_replace(java_name, '([^A-Z_])([A-Z])', '\\1{s}\\2', 'g'))"
INHERITED = f"""
up AS (
  SELECT repo, dto_id, dto_id AS ancestor, type_parameters, list_transform(type_parameters, lambda p: {_MARK % 'p'}) AS env, naming, []::INT[] AS way, [dto_id] AS met FROM java_classes
  UNION ALL
  SELECT u.repo, u.dto_id, x.parent, c.type_parameters, list_transform(coalesce(x.args, []), lambda a: {_PUT('a')}), coalesce(c.naming, u.naming), list_append(way, x.ord), list_append(met, x.parent)
  FROM up u JOIN java_extends x ON x.repo = u.repo AND x.dto_id = u.ancestor JOIN java_classes c ON c.repo = x.repo AND c.dto_id = x.parent WHERE NOT list_contains(met, x.parent)),
ln AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY repo, dto_id, ancestor ORDER BY way) = 1),
ev AS (
  SELECT u.repo, u.dto_id, u.ancestor AS owner, u.naming, list_append(way, 2147483647) AS place, m.kind <> 'field' AS late, m.pos, m.skipped, m.nullable, m.json_name, {_PUT('m.type_json')} AS type_json,
    CASE m.name WHEN 'getId' THEN 'id' WHEN 'isActive' THEN 'active' WHEN 'getURLPath' THEN 'urlpath' ELSE m.name END AS java_name
  FROM ln u JOIN java_members m ON m.repo = u.repo AND m.dto_id = u.ancestor WHERE m.name <> 'toText' AND NOT (m.skipped AND m.kind = 'field')),
nu AS (SELECT *, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY repo, dto_id, java_name ORDER BY place, late, pos)),
lv AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN skipped THEN n END) OVER (PARTITION BY repo, dto_id, java_name), 0) AS freed FROM nu) f WHERE n > freed AND NOT skipped),
ch AS (SELECT *, min((place, late, pos)) OVER p AS spot FROM lv WINDOW p AS (PARTITION BY repo, dto_id, java_name) QUALIFY row_number() OVER (PARTITION BY repo, dto_id, java_name ORDER BY late, CASE WHEN late THEN n ELSE -n END) = 1),
sent AS (SELECT *, coalesce(nullif(json_name, ''), CASE naming WHEN 'snake' THEN {_SEPARATED('_')} WHEN 'kebab' THEN {_SEPARATED('-')} ELSE java_name END) AS name FROM ch)
SELECT s.repo, s.dto_id, CAST(row_number() OVER (PARTITION BY s.repo, s.dto_id ORDER BY spot) - 1 AS INT) AS pos, s.name, s.java_name, s.type_json, s.nullable, s.owner FROM sent s JOIN java_classes c USING (repo, dto_id) WHERE NOT coalesce(list_contains(c.ignored, s.name), FALSE)"""

QUERIES = {f.__name__: f for f in (endpoint_shapes, inherited_fields)}
ORACLES = {
    "endpoint_shapes": f"""WITH RECURSIVE {lens_sql('endpoints', 'endpoints_after', 'dtos', 'dto_fields', 'dto_fields_after', 'enum_values', 'enum_values_after')}, {PAIRS}, {_tokens('')}, {_tokens('after')}
      SELECT p.repo, p.endpoint_id, coalesce(b.shape, '(no response body)') AS before_shape, CASE WHEN p.status = 'removed' THEN '(endpoint removed)' ELSE coalesce(a.shape, '(no response body)') END AS after_shape
      FROM pr p JOIN endpoints e ON e.repo = p.repo AND e.id = p.endpoint_id LEFT JOIN shape b ON b.repo = e.repo AND b.root = e.response_type_json
      LEFT JOIN endpoints_after n ON n.repo = p.repo AND n.id = p.new_id LEFT JOIN shape_after a ON a.repo = n.repo AND a.root = n.response_type_json WHERE p.status <> 'added'""",
    "inherited_fields": f"WITH RECURSIVE {lens_sql('java_classes', 'java_extends', 'java_members')}, {INHERITED}",
}
