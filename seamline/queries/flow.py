"""Flow of API results through functions, and wrappers with their signatures, over the lens tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import flow
from seamline.sources.lens import lens, lens_sql

_NAMES = ("flow_seeds", "flow_params", "flow_results", "flow_steps", "flow_methods", "flow_hooks", "flow_calls")


def _flow(spark, folder):
    seeds, params, results, steps, methods, hooks, calls = (lens(spark, folder, n) for n in _NAMES)
    steps = steps.unionByName(flow.method_steps(methods)).unionByName(flow.hook_steps(hooks))
    return seeds.withColumn("path", F.array().cast("array<string>")), steps, calls, params, results


def function_summaries(spark, folder):
    """What each function makes of its parameters, as texts of steps."""
    _, *tables = _flow(spark, folder)
    shown = F.array_join(F.transform("steps", lambda s: F.concat_ws(" ", s["op"], s["segment"])), ", ")
    return flow.summaries(*tables).select("repo", "function_id", "position", shown.alias("steps"))


def api_flow(spark, folder):
    """Values at call sites; those of function bodies depend on which call comes first."""
    return flow.propagate(*_flow(spark, folder)).where("symbol RLIKE '^[vwxhzyu]:'")


def api_wrappers(spark, folder):
    calls, returns, sites = (lens(spark, folder, n) for n in ("wrap_calls", "wrap_returns", "wrap_sites"))
    steps = F.when(F.col("op").isNull(), F.array().cast(flow.STEPS)).otherwise(F.array(F.struct("op", "segment")).cast(flow.STEPS))
    arg = lambda i: F.struct(F.col(f"text{i}").alias("text"), F.col(f"position{i}").cast("int").alias("position"))
    found = flow.infer_wrappers(calls, returns.select("repo", "function_id", "call_id", steps.alias("steps")), sites.select("repo", "id", "function_id", "file", "line", F.array(arg(0), arg(1)).alias("args")))
    return found.drop("query_keys", "body_keys")


#: Steps as rows, those of methods and hooks among them.
_EDGES = """
e AS (
  SELECT repo, src, dst, op, segment FROM flow_steps UNION ALL SELECT repo, result, dst, 'wrap', NULL FROM flow_hooks
  UNION ALL SELECT repo, src, callback_param, CASE method WHEN 'then' THEN 'same' ELSE 'element' END, NULL FROM flow_methods WHERE method IN ('map', 'find', 'filter', 'then')
  UNION ALL SELECT repo, CASE method WHEN 'then' THEN callback_result ELSE src END, dst, CASE method WHEN 'json' THEN 'json' WHEN 'filter' THEN 'body' WHEN 'find' THEN 'element' ELSE 'same' END, NULL FROM flow_methods WHERE method IN ('json', 'filter', 'find', 'then')),
ok AS (SELECT repo, function_id, position FROM flow_params p WHERE position = 0 AND EXISTS (FROM flow_steps s JOIN flow_results r ON r.repo = s.repo AND r.symbol = s.dst WHERE r.repo = p.repo AND r.function_id = p.function_id))"""
#: Calls step into their function with the place to come back to on a stack: no summaries are made.
_VALUES = f"""{_EDGES},
tr AS (
  SELECT repo, src, dst, op, segment, NULL AS push FROM e
  UNION ALL SELECT c.repo, c.src, CASE WHEN o.function_id IS NULL THEN c.dst ELSE p.symbol END, CASE WHEN o.function_id IS NULL THEN 'derived' ELSE 'body' END, NULL, CASE WHEN o.function_id IS NOT NULL THEN c.dst END
    FROM flow_calls c LEFT JOIN ok o USING (repo, function_id, position) LEFT JOIN flow_params p ON p.repo = o.repo AND p.function_id = o.function_id AND p.position = o.position
  UNION ALL SELECT repo, symbol, NULL, 'pop', NULL, NULL FROM flow_results),
v AS (
  SELECT repo, symbol, call_id, kind, []::VARCHAR[] AS path, flow, []::VARCHAR[] AS stack FROM flow_seeds
  UNION ALL
  SELECT v.repo, CASE WHEN op = 'pop' THEN stack[len(stack)] ELSE t.dst END, call_id,
    CASE WHEN op = 'wrap' THEN 'envelope' WHEN op = 'json' OR (op = 'field' AND kind = 'envelope') THEN 'body' ELSE kind END,
    CASE WHEN op IN ('derived', 'json') THEN [] WHEN op = 'field' AND kind = 'body' THEN list_append(path, segment) WHEN op = 'element' THEN list_append(path, '[]') ELSE path END,
    CASE WHEN op = 'derived' THEN 'derived' ELSE flow END, CASE WHEN op = 'pop' THEN stack[1:len(stack) - 1] WHEN push IS NOT NULL THEN list_append(stack, push) ELSE stack END
  FROM v JOIN tr t ON t.repo = v.repo AND t.src = v.symbol
  WHERE CASE op WHEN 'same' THEN TRUE WHEN 'pop' THEN len(stack) > 0 WHEN 'json' THEN kind = 'fetchResponse' WHEN 'field' THEN kind = 'body' OR (kind = 'envelope' AND segment = 'data') ELSE kind = 'body' END)"""
#: The same walk from each parameter, with the steps for a value.
_SUMMARIES = f"""{_EDGES},
tr AS (
  SELECT repo, src, dst, op || coalesce(' ' || segment, '') AS txt, NULL AS push FROM e
  UNION ALL SELECT c.repo, c.src, CASE WHEN o.function_id IS NULL THEN c.dst ELSE p.symbol END, CASE WHEN o.function_id IS NULL THEN 'derived' ELSE 'body' END, CASE WHEN o.function_id IS NOT NULL THEN c.dst END
    FROM flow_calls c LEFT JOIN ok o USING (repo, function_id, position) LEFT JOIN flow_params p ON p.repo = o.repo AND p.function_id = o.function_id AND p.position = o.position
  UNION ALL SELECT repo, symbol, NULL, 'pop', NULL FROM flow_results),
v AS (
  SELECT repo, function_id, position, symbol, []::VARCHAR[] AS steps, []::VARCHAR[] AS stack FROM flow_params
  UNION ALL
  SELECT v.repo, function_id, position, CASE WHEN txt = 'pop' THEN stack[len(stack)] ELSE t.dst END, CASE WHEN txt = 'pop' THEN steps ELSE list_append(steps, txt) END, CASE WHEN txt = 'pop' THEN stack[1:len(stack) - 1] WHEN push IS NOT NULL THEN list_append(stack, push) ELSE stack END
  FROM v JOIN tr t ON t.repo = v.repo AND t.src = v.symbol WHERE txt <> 'pop' OR len(stack) > 0)"""
_PATTERN = lambda text: f"regexp_replace(replace(split_part({text}, '?', 1), '${{id}}', '{{param}}'), '(.)/$', '\\1')"
_STEP = lambda kind, path: (f"CASE WHEN r.op = 'json' OR (r.op = 'field' AND {kind} = 'envelope') THEN 'body' ELSE {kind} END", f"CASE WHEN r.op = 'json' THEN [] WHEN r.op = 'field' AND {kind} = 'body' THEN list_append({path}, r.segment) WHEN r.op = 'element' THEN list_append({path}, '[]') ELSE {path} END")
_FITS = lambda kind: f"(r.op IS NULL OR (r.op = 'json' AND {kind} = 'fetchResponse') OR (r.op = 'field' AND ({kind} = 'body' OR ({kind} = 'envelope' AND r.segment = 'data'))) OR (r.op = 'element' AND {kind} = 'body'))"
_ARG = f"CASE WHEN g.endpoint_pattern IS NOT NULL THEN g.endpoint_pattern WHEN g.url_position = 0 THEN {_PATTERN('s.text0')} WHEN g.url_position = 1 THEN {_PATTERN('s.text1')} END"
_NEXT = "CASE WHEN g.endpoint_pattern IS NULL AND g.url_position = 0 AND s.text0 IS NULL THEN s.position0 WHEN g.endpoint_pattern IS NULL AND g.url_position = 1 AND s.text1 IS NULL THEN s.position1 END"
_BASE, _MORE = _STEP("c.kind", "[]::VARCHAR[]"), _STEP("g.kind", "g.path")
_WRAPPERS = f"""
g AS (
  SELECT c.repo, r.function_id, c.endpoint_pattern, c.method, CAST(c.url_position AS INT) AS url_position, {_BASE[0]} AS kind, {_BASE[1]} AS path FROM wrap_calls c JOIN wrap_returns r ON r.repo = c.repo AND r.call_id = c.id WHERE {_FITS('c.kind')}
  UNION ALL
  SELECT g.repo, r.function_id, {_ARG}, g.method, {_NEXT}, {_MORE[0]}, {_MORE[1]} FROM g JOIN wrap_sites s ON s.repo = g.repo AND s.function_id = g.function_id JOIN wrap_returns r ON r.repo = s.repo AND r.call_id = s.id WHERE {_FITS('g.kind')})
SELECT s.repo, s.id, {_ARG} AS endpoint_pattern, g.method, {_NEXT} AS url_position, g.kind, g.path, 'direct' AS flow, s.function_id AS wrapper_function_id, s.file, s.line, 'wrapper' AS resolution FROM wrap_sites s JOIN g ON g.repo = s.repo AND g.function_id = s.function_id"""

QUERIES = {f.__name__: f for f in (function_summaries, api_flow, api_wrappers)}
ORACLES = {
    "function_summaries": f"WITH RECURSIVE {lens_sql(*_NAMES)}, {_SUMMARIES} SELECT v.repo, v.function_id, v.position, array_to_string(steps, ', ') AS steps FROM v JOIN flow_results r ON r.repo = v.repo AND r.function_id = v.function_id AND r.symbol = v.symbol WHERE len(stack) = 0",
    "api_flow": f"WITH RECURSIVE {lens_sql(*_NAMES)}, {_VALUES} SELECT repo, symbol, call_id, kind, path, flow FROM v WHERE len(stack) = 0 AND regexp_matches(symbol, '^[vwxhzyu]:')",
    "api_wrappers": f"WITH RECURSIVE {lens_sql('wrap_calls', 'wrap_returns', 'wrap_sites')}, {_WRAPPERS}",
}
