"""DuckDB texts that several oracles share."""

from __future__ import annotations

from seamline.sources.lens import lens_sql


def norm(x: str) -> str:
    p = f"regexp_replace(regexp_replace(split_part({x}, '?', 1), '\\{{[^}}/]*\\}}', '{{param}}', 'g'), ':[A-Za-z_][A-Za-z0-9_]*', '{{param}}', 'g')"
    p = f"regexp_replace('/' || {p}, '/+', '/', 'g')"
    return f"CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/$', '') ELSE {p} END"


def segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda s: s <> '')"


def shown(path: str) -> str:
    return f"replace(array_to_string({path}, '.'), '.[]', '[]')"


LINK = f"""
pat AS (SELECT DISTINCT repo, method, endpoint_pattern, {segs('endpoint_pattern')} AS fe FROM api_calls WHERE method IS NOT NULL AND endpoint_pattern IS NOT NULL),
ep AS (SELECT repo, id AS e_id, method AS e_method, pos, {segs(norm('path'))} AS be FROM endpoints),
sc AS (
  SELECT * FROM (SELECT pat.*, e_id, e_method, pos, coalesce(list_sum(list_transform(range(1, len(fe) + 1), lambda i:
      CASE WHEN fe[i] = be[i] THEN 3 WHEN be[i] = '{{param}}' THEN 1 WHEN fe[i] = '{{param}}' THEN 0 ELSE -1000 END)), 0) AS score
    FROM pat JOIN ep ON pat.repo = ep.repo AND len(fe) = len(be)) s WHERE score >= 0),
own AS (SELECT repo, method, endpoint_pattern, e_id FROM sc WHERE e_method = method QUALIFY row_number() OVER (PARTITION BY repo, method, endpoint_pattern ORDER BY score DESC, pos) = 1),
other AS (SELECT repo, method, endpoint_pattern, list(e_id ORDER BY pos) AS ids FROM (
    SELECT * FROM sc QUALIFY rank() OVER (PARTITION BY repo, method, endpoint_pattern ORDER BY score DESC) = 1) t GROUP BY ALL),
sim AS (
  SELECT repo, method, endpoint_pattern, list(e_id ORDER BY same DESC, e_id) AS ids FROM (
    SELECT p.repo, p.method, p.endpoint_pattern, e_id, len(list_filter(range(1, least(len(fe), len(be)) + 1), lambda i: fe[i] = be[i] AND fe[i] <> '{{param}}')) AS same
    FROM (SELECT * FROM pat ANTI JOIN sc USING (repo, method, endpoint_pattern)) p JOIN ep ON p.repo = ep.repo
    WHERE same > 0 QUALIFY row_number() OVER (PARTITION BY p.repo, p.method, p.endpoint_pattern ORDER BY same DESC, e_id) <= 3) t GROUP BY ALL),
linked AS (
  SELECT c.*, own.e_id AS endpoint_id,
    CASE WHEN c.method IS NULL OR c.endpoint_pattern IS NULL THEN 'unresolved' WHEN own.e_id IS NOT NULL THEN 'matched' WHEN other.ids IS NOT NULL THEN 'method-mismatch' ELSE 'not-found' END AS status,
    CASE WHEN own.e_id IS NOT NULL THEN [] ELSE coalesce(other.ids, sim.ids, []) END AS candidates,
    coalesce(own.e_id, coalesce(c.method, '?') || ' ' || c.endpoint_pattern, coalesce(c.method, '?') || ' <' || c.callee || '>') AS api_key
  FROM api_calls c LEFT JOIN own USING (repo, method, endpoint_pattern) LEFT JOIN other USING (repo, method, endpoint_pattern) LEFT JOIN sim USING (repo, method, endpoint_pattern)),
reads AS (
  SELECT a.*, l.api_key, l.status, l.endpoint_id, l.file AS call_file FROM property_accesses a JOIN linked l ON a.repo = l.repo AND a.api_call_id = l.id WHERE len(a.path) > 0),
sites AS (
  SELECT l.*, f.name AS function_name, f.containing_component AS component, w.name AS via FROM linked l
  LEFT JOIN functions f ON f.repo = l.repo AND f.id = l.caller_function_id LEFT JOIN functions w ON w.repo = l.repo AND w.id = l.wrapper_function_id)"""


def linked(select: str, *more: str, extra: str = "") -> str:
    """A query over linked, reads and sites, with further lens tables and texts."""
    return f"WITH RECURSIVE {lens_sql('endpoints', 'functions', 'api_calls', 'property_accesses', *more)}, {LINK}{', ' + extra if extra else ''} {select}"
