"""Manifests, config, source trees, reports and persisted tables, written to files and read back."""

import json

from seamline.operators import index, usage
from seamline.sources import manifests

AT = {"file": "src/a.ts", "line": 3, "column": 7}
FRONT = {
    "repo": "web",
    "files": [{"path": "src/a.ts", "exports": ["a"], "imports": [{"source": "./b", "resolvedFile": "src/b.ts", "specifiers": ["b"], "location": AT}]}, {"path": "src/b.ts", "exports": [], "imports": []}],
    "functions": [{"id": "f1", "name": "a", "file": "src/a.ts", "params": [{"name": "x", "type": "string"}], "returnType": "void", "calls": ["b"], "location": AT, "containingComponent": None}],
    "apiCalls": [{"id": "c1", "endpointPattern": "/api/x/{param}", "method": "GET", "calleeExpression": "axios.get", "resolution": "direct", "callerFunctionId": "f1", "file": "src/a.ts", "location": AT, "arguments": ["url"], "request": {"queryKeys": ["q"], "bodyKeys": None}, "code": "axios.get(url)"}],
    "propertyAccesses": [{"id": f"p{i}", "apiCallId": call, "object": "data", "path": ["name"], "flow": "direct", "file": file, "location": AT, "code": "data.name"} for i, call, file in ((1, "c1", "src/b.ts"), (2, "c1", "src/a.ts"), (3, "c2", "src/a.ts"))],
}
TEXT = {"kind": "scalar", "name": "String"}
BACK = {
    "endpoints": [{"id": f"GET /x/{i}", "method": "GET", "path": f"/x/{i}", "handler": "X#get", "requestParams": [{"name": n, "type": TEXT, "required": n == "q", "source": "query"} for n in "qr"], "requestBody": {"type": TEXT, "required": True} if i else None, "response": TEXT, "location": AT} for i in range(2)],
    "dtos": [{"id": "pkg.D", "name": "D", "typeParameters": ["T"], "fields": [{"name": "a", "type": TEXT, "nullable": True}, {"name": "b", "type": TEXT, "nullable": False}], "location": AT}],
    "enums": [{"id": "pkg.E", "name": "E", "values": ["NEW", "DONE"]}],
}


def test_frontend_manifests_become_tables(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(FRONT, indent=1))
    (tmp_path / "two.json").write_text(json.dumps({"files": [{"path": "z.ts"}]}))
    tables = manifests.frontend_tables(manifests.read_manifests(spark, str(tmp_path), manifests.FRONTEND))
    assert sorted((r.repo, r.path) for r in tables["files"].collect()) == [("default", "z.ts"), ("web", "src/a.ts"), ("web", "src/b.ts")]
    assert [tuple(r) for r in tables["imports"].collect()] == [("web", "src/a.ts", "./b", "src/b.ts", ["b"], 3, 7)]
    assert [(r.id, r.return_type, r.line, r.params[0].name) for r in tables["functions"].collect()] == [("f1", "void", 3, "x")]
    assert [(r.endpoint_pattern, r.callee, r.query_keys, r.body_keys, r.wrapper_function_id) for r in tables["api_calls"].collect()] == [("/api/x/{param}", "axios.get", ["q"], None, None)]
    reads = tables["property_accesses"]
    assert [r.id for r in usage.reads_of_call(reads, "web", "c1").collect()] == ["p2", "p1"]
    assert [r.id for r in usage.calls_by_endpoint(tables["api_calls"], "GET", "/api/x/{param}").collect()] == ["c1"]
    assert usage.reads_of_call(reads, "other", "c1").count() == usage.calls_by_endpoint(tables["api_calls"], "POST", "/api/x/{param}").count() == 0


def test_backend_manifests_become_tables(spark, tmp_path):
    (tmp_path / "back.json").write_text(json.dumps(BACK))
    tables = manifests.backend_tables(manifests.read_manifests(spark, str(tmp_path), manifests.BACKEND))
    found = sorted(tables["endpoints"].collect(), key=lambda r: r.pos)
    assert [(r.repo, r.id, r.body_required, r.file, r.line) for r in found] == [("default", "GET /x/0", None, "src/a.ts", 3), ("default", "GET /x/1", True, "src/a.ts", 3)]
    assert json.loads(found[0].response_type_json) == json.loads(found[1].body_type_json) == TEXT
    assert sorted((r.endpoint_id, r.pos, r.name, r.required) for r in tables["params"].collect()) == [(f"GET /x/{i}", k, n, n == "q") for i in range(2) for k, n in enumerate("qr")]
    assert [tuple(r) for r in tables["dtos"].collect()] == [("default", "pkg.D", "D", ["T"])]
    assert sorted((r.pos, r.name, r.nullable) for r in tables["dto_fields"].collect()) == [(0, "a", True), (1, "b", False)]
    assert sorted((r.enum_id, r.pos, r.value) for r in tables["enum_values"].collect()) == [("pkg.E", 0, "NEW"), ("pkg.E", 1, "DONE")]


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"apiClientMap": {"client.get": {"method": "GET", "path": "/x"}}, "linking": {"frontendBasePath": "/api"}}))
    clients, bases = manifests.read_config(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in clients.collect()] == [("default", "client.get", "GET", "/x")]
    assert [tuple(r) for r in bases.collect()] == [("/api", None)]


def test_source_trees_and_changed_files(spark, tmp_path):
    root = tmp_path / "a tree.x"
    for name in ("src/a+b.ts", "src/a b.tsx", "src/types.d.ts", "node_modules/m/i.ts", "src/main/X.java", "src/test/Y.java", "readme.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"one\n{name}")
    got = {r.file: (r.repo, r.text) for r in manifests.read_sources(spark, str(root), "web").collect()}
    assert got == {n: ("web", f"one\n{n}") for n in ("src/a+b.ts", "src/a b.tsx", "src/main/X.java")}
    listing = lambda *files: spark.createDataFrame([("web", f) for f in files], "repo string, file string")
    changed = manifests.changed_files(listing("a.ts", "b.md", "a.ts"), listing("a.ts", "c.java", "build/d.java"))
    assert sorted(r.file for r in changed.collect()) == ["a.ts", "c.java"]


def test_reports_and_persisted_tables(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "a", ["x"]), ("r2", "b", None)], "repo string, id string, path array<string>")
    manifests.write_report(rows, str(tmp_path / "report"))
    manifests.write_report(rows.where("repo = 'r1'"), str(tmp_path / "report"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "report")).collect()] == [{"repo": "r1", "id": "a", "path": ["x"]}]
    index.write_table(rows, str(tmp_path / "t"), ["repo", "id"])
    index.write_table(spark.createDataFrame([("r2", "c", ["y"])], rows.schema), str(tmp_path / "t"), ["repo", "id"])
    kept = index.read_table(spark, str(tmp_path / "t"), rows.schema)
    assert sorted(tuple(r) for r in kept.collect()) == [("r1", "a", ["x"]), ("r2", "c", ["y"])]
