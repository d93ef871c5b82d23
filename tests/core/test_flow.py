"""Flow through functions and wrappers on hand-written cases."""

import pytest

from seamline.operators import flow

SEEDS = "repo string, symbol string, call_id string, kind string, path array<string>, flow string"
STEPS = "repo string, src string, dst string, op string, segment string"
CALLS = "repo string, src string, dst string, function_id string, position int"
PARAMS = "repo string, function_id string, position int, symbol string"
RESULTS = "repo string, function_id string, symbol string"


@pytest.fixture(autouse=True)
def brief(spark):
    """For many small rounds: one partition."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("1", "false"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def tables(spark, steps=(), calls=(), params=(), results=()):
    return [spark.createDataFrame([("r", *row) for row in rows], schema).coalesce(1) for rows, schema in ((steps, STEPS), (calls, CALLS), (params, PARAMS), (results, RESULTS))]


def values(spark, seeds, *rows, **given):
    seeds = spark.createDataFrame([("r", s, c, k, [], "direct") for s, c, k in seeds], SEEDS).coalesce(1)
    return {r.symbol: (r.call_id, r.kind, r.path, r.flow) for r in flow.propagate(seeds, *tables(spark, *rows, **given)).collect()}


def test_steps_by_kind(spark):
    steps = [
        ("res", "body", "field", "data"), ("res", "status", "field", "status"), ("body", "user", "field", "user"), ("user", "item", "element", None), ("item", "again", "same", None),
        ("again", "user", "same", None), ("user", "lost", "derived", None), ("res", "no", "element", None), ("fetched", "json", "json", None), ("body", "no2", "json", None), ("fetched", "no3", "field", "json"),
    ]
    assert values(spark, [("res", "c1", "envelope"), ("fetched", "c2", "fetchResponse")], steps) == {
        "res": ("c1", "envelope", [], "direct"), "body": ("c1", "body", [], "direct"), "user": ("c1", "body", ["user"], "direct"), "item": ("c1", "body", ["user", "[]"], "direct"),
        "again": ("c1", "body", ["user", "[]"], "direct"), "lost": ("c1", "body", [], "derived"), "fetched": ("c2", "fetchResponse", [], "direct"), "json": ("c2", "body", [], "direct"),
    }


def test_methods_and_hooks(spark):
    methods = [("b", "map", "m", "each", "got"), ("b", "filter", "f", "one", None), ("b", "find", "found", None, None), ("b", "join", "text", None, None), ("p", "then", "t", "v", "back"), ("v", "json", "back", None, None), ("b", "at", "a", None, None)]
    m = flow.method_steps(spark.createDataFrame([("r", *x) for x in methods], "repo string, src string, method string, dst string, callback_param string, callback_result string"))
    h = flow.hook_steps(spark.createDataFrame([("r", "t", "query")], "repo string, result string, dst string"))
    seeds = spark.createDataFrame([("r", "b", "c1", "body", [], "direct"), ("r", "p", "c2", "fetchResponse", [], "direct")], SEEDS)
    none = tables(spark)
    more = spark.createDataFrame([("r", "query", "data", "field", "data")], STEPS)
    got = {r.symbol: (r.call_id, r.kind, r.path) for r in flow.propagate(seeds, m.unionByName(h).unionByName(more), *none[1:]).collect()}
    element = ("c1", "body", ["[]"])
    assert got == {
        "b": ("c1", "body", []), "each": element, "f": ("c1", "body", []), "one": element, "found": element, "a": element, "p": ("c2", "fetchResponse", []), "v": ("c2", "fetchResponse", []),
        "back": ("c2", "body", []), "t": ("c2", "body", []), "query": ("c2", "envelope", []), "data": ("c2", "body", []),
    }


def test_calls_of_one_function_do_not_mix(spark):
    steps = [("p", "q", "field", "name"), ("q", "ret", "same", None), ("b1", "a1", "field", "x"), ("r1", "s1", "field", "last")]
    calls = [("a1", "r1", "f", 0), ("b2", "r2", "f", 0), ("b2", "r3", "outside", 0), ("b2", "r4", None, 0), ("env", "r5", "f", 0), ("b2", "r6", "f", 1)]
    got = values(spark, [("b1", "c1", "body"), ("b2", "c2", "body"), ("env", "c3", "envelope")], steps, calls, [("f", 0, "p"), ("f", 1, "unused")], [("f", "ret")])
    assert got["r1"] == ("c1", "body", ["x", "name"], "direct") and got["s1"] == ("c1", "body", ["x", "name", "last"], "direct")
    assert got["r2"] == ("c2", "body", ["name"], "direct")
    assert got["r3"] == got["r4"] == got["r6"] == ("c2", "body", [], "derived")
    assert "r5" not in got
    assert got["p"] == ("c1", "body", ["x"], "direct") or got["p"] == ("c2", "body", [], "direct")


def test_calls_chained_over_ten_functions(spark):
    n = 10
    steps = [(f"p{i}", f"a{i}", "field", f"s{i}") for i in range(n)] + [("a9", "r9", "element", None)]
    calls = [(f"a{i}", f"r{i}", f"f{i + 1}", 0) for i in range(n - 1)] + [("seed", "out", "f0", 0)]
    got = values(spark, [("seed", "c", "body")], steps, calls, [(f"f{i}", 0, f"p{i}") for i in range(n)], [(f"f{i}", f"r{i}") for i in range(n)])
    assert got["out"] == ("c", "body", [*(f"s{i}" for i in range(n)), "[]"], "direct")


def test_recursion_ends(spark):
    """One function that comes to an end, two that only call each other, and a caller of these."""
    steps = [("p", "ret", "field", "leaf"), ("p", "n", "field", "next"), ("back", "ret", "same", None), ("x", "x1", "field", "down"), ("y", "y1", "same", None), ("u", "u1", "field", "z")]
    calls = [("n", "back", "f", 0), ("x1", "xr", "g", 0), ("y1", "yr", "h", 0), ("u1", "ur", "h", 0), ("seed", "out1", "f", 0), ("seed", "out2", "h", 0), ("seed", "out3", "k", 0)]
    got = values(spark, [("seed", "c", "body")], steps, calls, [("f", 0, "p"), ("h", 0, "x"), ("g", 0, "y"), ("k", 0, "u")], [("f", "ret"), ("h", "xr"), ("g", "yr"), ("k", "ur")])
    assert got["out1"] == ("c", "body", ["leaf"], "direct")
    assert got["out2"] == got["out3"] == ("c", "body", [], "derived")


def test_no_rows(spark):
    assert values(spark, []) == {}


def wrappers(spark, calls, returns, sites):
    found = flow.infer_wrappers(
        spark.createDataFrame([("r", *c) for c in calls], "repo string, id string, endpoint_pattern string, method string, kind string, url_position int").coalesce(1),
        spark.createDataFrame([("r", *x) for x in returns], f"repo string, function_id string, call_id string, steps {flow.STEPS}").coalesce(1),
        spark.createDataFrame([("r", i, f, "a", 1, a) for i, f, a in sites], "repo string, id string, function_id string, file string, line int, args array<struct<text: string, position: int>>").coalesce(1),
    )
    return {r.id: (r.method, r.endpoint_pattern, r.url_position, r.kind, r.path, r.wrapper_function_id) for r in found.collect()}


def test_url_comes_through_three_levels(spark):
    """request(url) <- get(kind, url) <- load(path); the position changes on the way, and each level opens the result further."""
    calls = [("c", None, "GET", "envelope", 0), ("d", "/fixed", "POST", "body", 0)]
    returns = [("request", "c", [("field", "data")]), ("get", "s1", [("field", "items")]), ("load", "s2", [("element", None)]), ("both", "d", []), ("both", "s1", []), ("stop", "s3", [("json", None)])]
    sites = [
        ("s1", "request", [(None, 1)]), ("s2", "get", [("k", None), (None, 0)]), ("s3", "load", [("/users/${id}?page=1", None)]), ("s4", "load", [(None, None)]), ("s5", "get", [("/no", None), ("`x`", None)]),
        ("s6", "both", [("/other", None)]), ("s7", "stop", []), ("s8", "get", [("/short", None)]), ("s9", "unknown", []),
    ]
    assert wrappers(spark, calls, returns, sites) == {
        "s1": ("GET", None, 1, "body", [], "request"), "s2": ("GET", None, 0, "body", ["items"], "get"), "s3": ("GET", "/users/{param}", None, "body", ["items", "[]"], "load"),
        "s4": ("GET", None, None, "body", ["items", "[]"], "load"), "s5": ("GET", None, None, "body", ["items"], "get"), "s6": ("POST", "/fixed", None, "body", [], "both"), "s8": ("GET", None, None, "body", ["items"], "get"),
    }


def test_wrappers_of_many_levels(spark):
    calls = [("w0", "/users", "GET", "body", None)]
    got = wrappers(spark, calls, [(f"g{i}", f"w{i}", []) for i in range(18)], [(f"w{i + 1}", f"g{i}", []) for i in range(18)])
    assert {k: v[1] for k, v in got.items()} == {f"w{i}": "/users" for i in range(1, 19)}
