"""Where API results flow: through steps, array methods, hooks, callbacks and functions, and out of wrappers.

A value is (call_id, kind, path, flow): what of which call's result a symbol holds; kind is body, envelope (its ``data``
is the body) or fetchResponse (its ``json()`` is). Steps are rows (op, segment) that turn one value into another. A function's
summary is the list of steps from a parameter to its result; calls apply the summary to their own argument, so that calls
of one function with different values don't mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.paths import resolve_endpoint
from seamline.plans.lineage import Pile, stored

# Methods of arrays by what their callback and their result get.
ELEMENT_CALLBACKS = ("map", "forEach", "filter", "find", "findLast", "some", "every", "flatMap")
SAME_ARRAY = ("filter", "slice", "sort", "reverse", "toSorted", "toReversed")
ELEMENT_RESULTS = ("find", "findLast", "at")

STEPS = "array<struct<op: string, segment: string>>"


def stepped(value: Column, step: Column) -> Column:
    """A value (kind, path, flow) after one step (op, segment); null where nothing is known then.

    ``same`` and, for bodies alone, ``body``, ``field``, ``element`` and ``derived`` (through code that can't be followed: the
    path starts anew); ``field`` opens an envelope's data, ``json`` a fetch response, ``wrap`` puts a body into an envelope.
    """
    op, segment, kind, path = step["op"], step["segment"], value["kind"], value["path"]
    to = lambda k, p, f=value["flow"]: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), p.alias("path"), f.alias("flow"))
    none, body = F.array().cast("array<string>"), kind == "body"
    return (
        F.when(op == "same", value)
        .when(body & (op == "body"), value)
        .when(body & (op == "field"), to("body", F.concat(path, F.array(segment))))
        .when(body & (op == "element"), to("body", F.concat(path, F.array(F.lit("[]")))))
        .when(body & (op == "derived"), to("body", none, F.lit("derived")))
        .when(body & (op == "wrap"), to("envelope", path))
        .when((kind == "envelope") & (op == "field") & (segment == "data"), to("body", path))
        .when((kind == "fetchResponse") & (op == "json"), to("body", none))
    )


def after(kind: Column, path: Column, flow: Column, steps: Column) -> Column:
    """The value (kind, path, flow) after all ``steps``, or null."""
    return F.aggregate(steps, F.struct(kind.alias("kind"), path.alias("path"), flow.alias("flow")), stepped)


def method_steps(methods: DataFrame) -> DataFrame:
    """(repo, src, dst, op, segment) of method calls (repo, src, method, dst, callback_param, callback_result).

    ``then`` hands its receiver to the callback and gives the callback's result; ``json`` opens a fetch response; the array
    methods hand elements to their callbacks and give the array, an element, or nothing that can be followed.
    """
    m = F.col("method")
    case = lambda on, src, dst, op: F.struct(src.alias("src"), dst.alias("dst"), F.when(on, op).alias("op"))
    src, dst, given, got = F.col("src"), F.col("dst"), F.col("callback_param"), F.col("callback_result")
    cases = F.array(
        case(m == "json", src, dst, "json"), case(m == "then", src, given, "same"), case(m == "then", got, dst, "same"),
        case(m.isin(*ELEMENT_CALLBACKS), src, given, "element"), case(m.isin(*SAME_ARRAY), src, dst, "body"), case(m.isin(*ELEMENT_RESULTS), src, dst, "element"),
    )
    return methods.select("repo", F.inline(cases)).where("op IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select("repo", "src", "dst", "op", F.lit(None).cast("string").alias("segment"))


def hook_steps(hooks: DataFrame) -> DataFrame:
    """Steps of query hooks (repo, result, dst): the body that a hook's function returns becomes an envelope."""
    return hooks.select("repo", F.col("result").alias("src"), "dst", F.lit("wrap").alias("op"), F.lit(None).cast("string").alias("segment"))


def _one(op: str) -> Column:
    return F.array(F.struct(F.lit(op).alias("op"), F.lit(None).cast("string").alias("segment"))).cast(STEPS)


def _passing(calls: DataFrame, steps: DataFrame, params: DataFrame, results: DataFrame) -> DataFrame:
    """(repo, function_id, position): parameters from which a function's result can be reached, through calls too."""
    edges = stored(steps.select("repo", "src", "dst").union(calls.select("repo", "src", "dst")).distinct())
    seen = Pile(steps.sparkSession)
    fresh = seen.add(params.select("repo", "function_id", "position", "symbol").distinct())
    while not fresh.isEmpty():
        grown = fresh.join(edges.withColumnRenamed("src", "symbol"), ["repo", "symbol"]).select("repo", "function_id", "position", F.col("dst").alias("symbol")).distinct()
        fresh = seen.add(grown.join(seen.rows(), ["repo", "function_id", "position", "symbol"], "left_anti"))
    return seen.rows().join(results, ["repo", "function_id", "symbol"], "left_semi").select("repo", "function_id", "position").distinct()


def summaries(steps: DataFrame, calls: DataFrame, params: DataFrame, results: DataFrame) -> DataFrame:
    """(repo, function_id, position, steps): how each function's result comes from a parameter, if it does.

    ``steps``: repo, src, dst, op, segment; ``calls``: repo, src, dst, function_id, position (an argument, the call's result;
    function_id null or unknown for code outside); ``params``: repo, function_id, position, symbol; ``results``: repo, function_id, symbol.

    A call of a function that its argument doesn't pass is ``derived``. Summaries grow round by round from the innermost
    functions; a symbol keeps the way found first, and of one round's the least. Where only recursion is left, its calls
    count as derived, and the rounds go on.
    """
    spark, none = steps.sparkSession, F.array().cast(STEPS)
    passing = stored(_passing(calls, steps, params, results))
    edge = ["repo", "symbol", "dst", "steps"]
    plain = steps.select("repo", F.col("src").alias("symbol"), "dst", F.array(F.struct("op", "segment")).cast(STEPS).alias("steps"))
    each = calls.select("repo", F.col("src").alias("symbol"), "dst", "function_id", "position")
    lost = each.join(passing, ["repo", "function_id", "position"], "left_anti").select("repo", "symbol", "dst", _one("derived").alias("steps"))
    fixed = stored(plain.union(lost))
    waiting = stored(each.join(passing, ["repo", "function_id", "position"], "left_semi"))
    known, way = ["repo", "function_id", "position"], ["repo", "function_id", "position", "symbol"]
    # ways from the parameters to every symbol, and the summaries among them
    seen, found = Pile(spark), Pile(spark)
    fresh = seen.add(stored(params.select(*way).distinct()).select(*way, none.alias("steps")))
    done = found.add(fresh.join(results, ["repo", "function_id", "symbol"], "left_semi").groupBy(*known).agg(F.min("steps").alias("steps")))

    def via(rows: DataFrame, edges: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("steps", "_before").join(edges, ["repo", "symbol"]).select(*known, F.col("dst").alias("symbol"), F.concat("_before", "steps").alias("steps"))

    def opened(summary: DataFrame) -> DataFrame:
        return waiting.join(summary, known).select("repo", "symbol", "dst", F.concat(_one("body"), "steps").alias("steps"))

    while True:
        # new ways through all edges, and old ways through the edges that new summaries open
        grown = via(fresh, fixed.unionByName(opened(found.rows()))).unionByName(via(seen.rows(), opened(done)))
        least = grown.groupBy(*way).agg(F.min(F.struct(F.size("steps").alias("n"), "steps")).alias("s")).select(*way, "s.steps")
        fresh = seen.add(least.join(seen.rows().select(*way), way, "left_anti"))
        ended = fresh.join(results, ["repo", "function_id", "symbol"], "left_semi").groupBy(*known).agg(F.min(F.struct(F.size("steps").alias("n"), "steps")).alias("s")).select(*known, "s.steps")
        done = found.add(ended.join(found.rows().select(*known), known, "left_anti"))
        if fresh.isEmpty() and done.isEmpty():
            stuck = waiting.join(found.rows().select(*known), known, "left_anti")
            if stuck.isEmpty():
                return found.rows()
            fixed = stored(fixed.union(stuck.select("repo", "symbol", "dst", _one("derived").alias("steps"))))
            waiting = stored(waiting.join(found.rows().select(*known), known, "left_semi"))
            fresh = seen.rows()


def propagate(seeds: DataFrame, steps: DataFrame, calls: DataFrame, params: DataFrame, results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repo, symbol, call_id, kind, path, flow): what API result each symbol holds.

    ``seeds`` have these columns; the other tables are those of ``summaries``, whose result may be given as ``known``. A
    call's result is its function's summary applied to its argument, ``derived`` where there is none; only bodies go through
    calls. Parameters get what the calls hand to them. Round by round to the fixpoint; the first value of a symbol
    stays, of one round's that of the least call, path, kind and flow.
    """
    known = summaries(steps, calls, params, results) if known is None else known
    key = ["repo", "function_id", "position"]
    through = calls.join(known.withColumnRenamed("steps", "_steps"), key, "left").select("repo", "src", "dst", F.coalesce(F.concat(_one("body"), "_steps"), _one("derived")).alias("steps"))
    into = calls.join(params.select(*key, "symbol"), key).select("repo", "src", F.col("symbol").alias("dst"), _one("same").alias("steps"))
    plain = steps.select("repo", "src", "dst", F.array(F.struct("op", "segment")).cast(STEPS).alias("steps"))
    edges = stored(plain.unionByName(through).unionByName(into).withColumnRenamed("src", "symbol"))
    pile = Pile(seeds.sparkSession)
    fresh = pile.add(seeds.select("repo", "symbol", "call_id", "kind", "path", "flow"))
    while not fresh.isEmpty():
        met = fresh.join(edges, ["repo", "symbol"]).withColumn("v", after(F.col("kind"), F.col("path"), F.col("flow"), F.col("steps"))).where("v IS NOT NULL")
        least = met.groupBy("repo", F.col("dst").alias("symbol")).agg(F.min(F.struct("call_id", "v.path", "v.kind", "v.flow")).alias("m"))
        fresh = pile.add(least.select("repo", "symbol", "m.call_id", "m.kind", "m.path", "m.flow").join(pile.rows().select("repo", "symbol"), ["repo", "symbol"], "left_anti"))
    return pile.rows()


def infer_wrappers(calls: DataFrame, returns: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls of functions that return an API call's result, as API calls of their own, with all that a call of them tells.

    ``calls``: repo, id, endpoint_pattern, method, kind (of the result), url_position (the parameter of the function around
    it that is the URL, where the pattern is null). ``returns``: repo, function_id, call_id, steps (from the call's result to the
    function's). ``sites``: repo, id, function_id (called), file, line, args: array<struct<text, position>> (a URL text, or the
    position of the parameter of the function around it that is handed on).

    A function's signature is its call's method, pattern or URL parameter, and its result; a site puts its argument in:
    a text makes the pattern, a parameter of its own function moves the URL parameter one level up. Wrappers of wrappers
    are found round by round, so the outermost site's text becomes the URL. Of a function with several such results the one
    of least call id counts; what isn't followed any more is no wrapper. Returns (repo, id, endpoint_pattern, method,
    wrapper_function_id, url_position, kind, path, flow, file, line, resolution, query_keys, body_keys); keys are unknown.
    """
    none = F.array().cast("array<string>")
    known, found = Pile(calls.sparkSession), Pile(calls.sparkSession)
    told = ["endpoint_pattern", "method", "url_position", "kind", "path", "flow"]
    fresh = known.add(calls.select("repo", "id", "endpoint_pattern", "method", "url_position", "kind", none.alias("path"), F.lit("direct").alias("flow")))
    while True:
        result = after(F.col("kind"), F.col("path"), F.col("flow"), F.col("steps"))
        inner = returns.join(fresh.withColumnRenamed("id", "call_id"), ["repo", "call_id"]).withColumn("v", result).where("v IS NOT NULL")
        signed = inner.select("repo", "function_id", "call_id", "endpoint_pattern", "method", "url_position", "v.*")
        met = sites.join(signed, ["repo", "function_id"]).join(known.rows().select("repo", "id"), ["repo", "id"], "left_anti")
        arg = F.when(F.col("endpoint_pattern").isNull() & F.col("url_position").isNotNull(), F.get("args", F.col("url_position")))
        put = met.withColumns({"endpoint_pattern": F.coalesce("endpoint_pattern", resolve_endpoint(arg["text"])), "url_position": F.when(arg["text"].isNull(), arg["position"])})
        least = put.groupBy("repo", "id").agg(F.min_by(F.struct("function_id", "file", "line", *told), F.struct("call_id", "function_id", "file", "line")).alias("s"))
        round_ = found.add(least.select("repo", "id", "s.*"))
        if round_.isEmpty():
            break
        fresh = known.add(round_.select("repo", "id", *told))
    unknown = F.lit(None).cast("array<string>")
    return found.rows().select("repo", "id", *told, F.col("function_id").alias("wrapper_function_id"), "file", "line", F.lit("wrapper").alias("resolution"), unknown.alias("query_keys"), unknown.alias("body_keys"))
