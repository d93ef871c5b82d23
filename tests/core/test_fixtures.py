"""The hand-written cases of FIXTURES.md as tiny tables."""

import json

import pytest
from pyspark.sql import functions as F

from seamline.operators import contract, diff, extract, graph, impact, index, link, review, types
from seamline.operators.usage import field_reads
from seamline.plans import closure

S = lambda n: json.dumps({"kind": "scalar", "name": n}, separators=(",", ":"))
D = lambda n, *a: '{"kind":"dto","dtoId":"%s","typeArguments":[%s]}' % (n, ",".join(a))
A = lambda t: '{"kind":"array","element":%s}' % t
M = lambda t: '{"kind":"map","value":%s}' % t
E_ = lambda n: '{"kind":"enum","enumId":"%s"}' % n
T_ = '{"kind":"typeParameter","name":"T"}'
DTOS = [("User", []), ("Profile", []), ("Page", ["T"]), ("Envelope", ["T"]), ("Create", [])]
ENDPOINT = "repo string, id string, method string, path string, handler string, body_type_json string, body_required boolean, response_type_json string, file string, line int, pos long"
FIELD = "repo string, dto_id string, pos int, name string, type_json string, nullable boolean"
CALL = "repo string, id string, endpoint_pattern string, method string, callee string, resolution string, wrapper_function_id string, caller_function_id string, file string, line int, col int, query_keys array<string>, body_keys array<string>, code string"
READ = "repo string, id string, api_call_id string, object string, path array<string>, flow string, file string, line int, col int, containing_function_id string, containing_component string, code string"
PARAM = "repo string, endpoint_id string, name string, type_json string, required boolean, source string, pos int"


def table(spark, rows, schema):
    return spark.createDataFrame([("r", *x) for x in rows], schema)


def endpoint(id_, pos, body=None, needed=None, response=None, handler=None):
    method, path = id_.split(" ")
    return (id_, method, path, handler or f"C#{method.lower()}{pos}", body, needed, response, "C.java", 1, pos)


def call(id_, method, pattern, file="src/a.tsx", query=None, body=None, wrapper=None, caller=None):
    return (id_, pattern, method, "client", "direct", wrapper, caller, file, 10, 1, query, body, "client()")


def read(id_, of, path, flow="direct", file="src/a.tsx"):
    return (id_, of, "x", path.split("."), flow, file, 20, 1, None, None, "x.y")


@pytest.fixture(scope="module")
def dtos(spark):
    return table(spark, [(n, n, p) for n, p in DTOS], "repo string, id string, name string, type_parameters array<string>")


FIELDS = [
    ("User", 0, "name", S("String"), True), ("User", 1, "age", S("int"), False), ("User", 2, "status", E_("Status"), True), ("User", 3, "tags", A(S("String")), True), ("User", 4, "profile", D("Profile"), True), ("User", 5, "attributes", M(S("String")), True),
    ("Profile", 0, "email", S("String"), True), ("Page", 0, "content", A(T_), True), ("Page", 1, "total", S("long"), False), ("Envelope", 0, "data", T_, True),
]


def test_linking(spark):
    ends = table(spark, [endpoint(e, i) for i, e in enumerate(["GET /users/{id}", "PUT /users/{id}", "GET /users/search", r"GET /products/{id:\d+}"])], ENDPOINT)
    cases = [("GET", "/users/{param}"), ("GET", "/users/42"), ("GET", "/users/search"), ("GET", "/products/{param}"), ("PATCH", "/users/{param}"), ("GET", "/orders"), ("GET", "/users/{param}/posts"), ("GET", None)]
    got = {r.id: r for r in link.link_calls(table(spark, [call(str(i), m, p) for i, (m, p) in enumerate(cases)], CALL), ends).collect()}
    assert [got[str(i)].status for i in range(8)] == ["matched"] * 4 + ["method-mismatch", "not-found", "not-found", "unresolved"]
    assert [got[str(i)].endpoint_id for i in range(4)] == ["GET /users/{id}", "GET /users/{id}", "GET /users/search", r"GET /products/{id:\d+}"]
    assert got["4"].candidates == ["GET /users/{id}", "PUT /users/{id}"] and got["5"].candidates == [] and "GET /users/{id}" in got["6"].candidates
    based = table(spark, [endpoint("GET /users", 0)], ENDPOINT)
    found = link.link_calls(table(spark, [call("a", "GET", "/users"), call("b", "GET", "/api/users")], CALL), based, "/api", "/api").collect()
    assert {r.status for r in found} == {"matched"}


WALKS = [
    (D("User"), "profile.email", "ok", None, None), (D("User"), "attributes.color", "ok", None, None), (D("User"), "name.length", "ok", None, None), (D("User"), "tags.length", "ok", None, None), (A(D("User")), "[].tags.[]", "ok", None, None),
    (D("Envelope", D("Page", D("User"))), "data.content.[].age", "ok", None, None), (D("Page", D("User")), "content.[].nmae", "missing", 2, "no-such-field"), (D("User"), "[].name", "missing", 0, "not-an-array"),
    (A(D("User")), "name", "missing", 0, "not-an-object"), (D("User"), "status.label", "missing", 1, "not-an-object"), (D("User"), "age.value", "missing", 1, "not-an-object"), ('{"kind":"unknown","name":"JsonNode"}', "a", "unverifiable", 0, None), (D("Envelope"), "data.x", "unverifiable", 1, None),
]


def test_type_walk_and_paths(spark, dtos):
    fields = table(spark, FIELDS, FIELD)
    asked = table(spark, [(t, p.split(".")) for t, p, *_ in WALKS], "repo string, type string, path array<string>")
    edges = types.type_edges(asked, dtos, fields)
    got = {(r.type, ".".join(r.path)): (r.status, r.step, r.reason) for r in types.walk_paths(asked, edges, dtos).collect()}
    assert got == {(t, p): (s, i, r) for t, p, s, i, r in WALKS}
    places = types.paths_to_dtos(asked.select("repo", "type"), edges).where(F.col("root") == D("Envelope", D("Page", D("User")))).where("dto_id = 'User'").collect()
    assert [".".join(r.path) for r in places] == ["data.content.[]"]


def test_contract_check(spark, dtos):
    fields = table(spark, [*FIELDS, ("Create", 0, "name", S("String"), False), ("Create", 1, "email", S("String"), True)], FIELD)
    ends = table(spark, [endpoint("GET /users/{id}", 0, response=D("User")), endpoint("GET /users", 1, response=D("Page", D("User"))), endpoint("POST /users", 2, D("Create"), True, D("User")), endpoint("DELETE /users/{id}", 3), endpoint("GET /unused", 4)], ENDPOINT)
    params = table(spark, [("GET /users", "keyword", S("String"), False, "query", 0), ("GET /users", "tenant", S("String"), True, "query", 1)], PARAM)
    calls = table(spark, [
        call("c:wrapper", "GET", "/users/{param}"), call("c:list", "GET", "/users", "src/List.tsx", ["keyword", "size"]), call("c:create", "POST", "/users", "src/List.tsx", None, ["name", "nickname"]),
        call("c:delete", "DELETE", "/users/{param}"), call("c:orders", "GET", "/orders", "src/Orders.tsx"), call("c:dynamic", "GET", None, "src/Orders.tsx"),
    ], CALL)
    reads = table(spark, [read("a:name", "c:wrapper", "name"), read("a:email", "c:wrapper", "profile.email"), read("a:typo", "c:wrapper", "nmae", file="src/Card.tsx"), read("a:derived", "c:wrapper", "missing", "derived", "src/Page.tsx"), read("a:list", "c:list", "content.[].name"), read("a:delete", "c:delete", "id", file="src/List.tsx"), read("a:orders", "c:orders", "items")], READ)
    linked = link.link_calls(calls, ends)
    found = contract.ordered(contract.check_contract(linked, reads, ends, params, dtos, fields)).collect()
    assert sorted((r.severity, r.code) for r in found) == sorted([
        ("error", "FIELD_NOT_FOUND"), ("error", "NO_RESPONSE_BODY"), ("error", "ENDPOINT_NOT_FOUND"), ("warning", "UNKNOWN_QUERY_PARAM"), ("warning", "MISSING_QUERY_PARAM"), ("warning", "UNKNOWN_BODY_FIELD"), ("warning", "FIELD_NOT_FOUND"), ("info", "UNRESOLVED_ENDPOINT"),
    ])
    assert [r.suggestion for r in found if r.access_id == "a:typo"] == ["Did you mean `name`?"]
    used = types.field_usage(ends, types.type_edges(ends.select("repo", F.col("response_type_json").alias("type")), dtos, fields), fields, field_reads(reads, linked)).where("dto_id = 'User' AND field = 'name'").collect()
    assert {(r.endpoint_id, r.response_path, r.reads) for r in used} == {("GET /users/{id}", "name", 1), ("GET /users", "content[].name", 1), ("POST /users", "name", 0)}


def versions(spark, dtos):
    old = [("User", 0, "name", S("String"), True), ("User", 1, "age", S("int"), False), ("User", 2, "score", S("Integer"), False), ("User", 3, "status", E_("Status"), True), ("User", 4, "tags", A(S("String")), True), ("User", 5, "profile", D("Profile"), False), ("Profile", 0, "email", S("String"), True), ("Create", 0, "name", S("String"), False), ("Create", 1, "nick", S("String"), True)]
    new = [("User", 0, "username", S("String"), True), ("User", 1, "age", S("String"), False), ("User", 2, "score", S("Long"), False), ("User", 3, "status", E_("Status"), True), ("User", 4, "tags", S("String"), True), ("User", 5, "profile", D("Profile"), True), ("Profile", 0, "email", S("String"), True), ("Create", 0, "name", S("String"), False), ("Create", 1, "password", S("String"), False)]
    before = [endpoint("GET /users/{id}", 0, response=D("User")), endpoint("POST /users", 1, D("Create"), True), endpoint("DELETE /users/{id}", 2), endpoint("PUT /users/{id}", 3, handler="C#put"), endpoint("GET /users", 4)]
    after = [endpoint("GET /users/{id}", 0, response=D("User")), endpoint("POST /users", 1, D("Create"), True), endpoint("PUT /users/{id}/profile", 3, handler="C#put"), endpoint("GET /users", 4), endpoint("GET /health", 5)]
    q = lambda need, *more: table(spark, [("GET /users", "q", S("String"), need, "query", 0), *more], PARAM)
    enum = lambda *v: table(spark, [("Status", i, x) for i, x in enumerate(v)], "repo string, enum_id string, pos int, value string")
    side = lambda e, p, f, v: diff.Side(table(spark, e, ENDPOINT), p, dtos, table(spark, f, FIELD), v)
    return side(before, q(False), old, enum("A", "B")), side(after, q(True, ("GET /users", "tenant", S("String"), True, "query", 1)), new, enum("A", "C"))


def test_diff_and_graded_impact(spark, dtos):
    before, after = versions(spark, dtos)
    calls = table(spark, [call("c:get", "GET", "/users/{param}"), call("c:del", "DELETE", "/users/{param}"), call("c:put", "PUT", "/users/{param}"), call("c:list", "GET", "/users", query=["q"]), call("c:post", "POST", "/users", body=["name"])], CALL)
    reads = table(spark, [read("a:name", "c:get", "name"), read("a:tags", "c:get", "tags.[]"), read("a:email", "c:get", "profile.email"), read("a:age", "c:get", "age"), read("a:derived", "c:get", "name", "derived"), read("a:status", "c:get", "status")], READ)
    functions = spark.createDataFrame([], "repo string, id string, name string, file string, line int, col int, containing_component string")
    linked = link.link_calls(calls, before.endpoints)
    pairs, changes, sites = impact.change_impact(linked, reads, functions, before, after)
    mine = changes.where("endpoint_id = 'GET /users/{id}'").orderBy("ord").collect()
    assert [(r.kind, ".".join(r.path), r.breaking) for r in mine] == [
        ("field-removed", "name", True), ("field-type-changed", "age", True), ("field-type-changed", "score", False), ("enum-value-removed", "status", True), ("enum-value-added", "status", False),
        ("shape-changed", "tags", True), ("field-nullable-changed", "profile", True), ("field-added", "username", False),
    ]
    grades = {r.access_id or r.api_call_id: r.confidence for r in sites.collect()}
    assert grades == {"a:name": "DEFINITE", "a:tags": "DEFINITE", "a:email": "LIKELY", "a:age": "LIKELY", "a:derived": "POSSIBLE", "a:status": "POSSIBLE", "c:del": "DEFINITE", "c:put": "DEFINITE", "c:list": "DEFINITE", "c:post": "DEFINITE"}
    report = impact.endpoint_report(pairs, changes, sites, linked, reads)
    total = impact.change_result(report).first()
    assert (total.changed_apis, total.definite, total.likely, total.possible, total.result) == (6, 6, 2, 2, "FAIL")
    gate = impact.ci_gate(impact.change_result(report), spark.createDataFrame([("r", 0, 1)], "repo string, errors long, warnings long"))
    assert (gate.first().exit_code, gate.first().reasons) == (1, "changes")


def test_closure_survives_cycles(spark):
    imports = spark.createDataFrame([("r", "Page", "api"), ("r", "App", "Page"), ("r", "api", "App"), ("r", "x", None)], "repo string, file string, resolved_file string")
    got = {(r.file, r.dependent) for r in graph.dependents(imports).collect()}
    assert got == {(a, b) for a in ("api", "Page", "App") for b in ("api", "Page", "App") if a != b}


@pytest.fixture
def brief(spark):
    """For many small rounds: one partition."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("1", "false"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_closure_of_a_long_chain(spark, brief):
    n = 70
    imports = spark.createDataFrame([("r", f"f{i + 1}", f"f{i}") for i in range(n)], "repo string, file string, resolved_file string").coalesce(1)
    start = spark.createDataFrame([("r", "f0")], "repo string, path string")
    assert {r.dependent for r in graph.dependents(imports, start).collect()} == {f"f{i}" for i in range(1, n + 1)}


def test_evidence(spark):
    shown = spark.createDataFrame([("r", "e", "a.ts", 10, ["const a = user.age;", "return a  +  1;"])], "repo string, endpoint_id string, file string, first int, lines array<string>")
    cases = [("a.ts", 11, "a + 1", True), ("a.ts", 10, "a + 1", True), ("a.ts", 30, "a + 1", False), ("b.ts", 10, "user.age", False), ("a.ts", 10, "user.name", False), ("a.ts", 10, " ", False)]
    rows = [("r", "e", f"c{i}", "FAIL", 2.0, "", [(f, n, q)], None) for i, (f, n, q, _) in enumerate(cases)]
    verdicts = spark.createDataFrame(rows, review.VERDICTS)
    chosen = spark.createDataFrame([("r", "e", f"c{i}") for i in range(7)], "repo string, endpoint_id string, candidate_id string")
    got = {r.candidate_id: (r.result, r.discarded, r.confidence) for r in review.apply_verdicts(chosen, verdicts, shown).collect()}
    assert got == {**{f"c{i}": ("FAIL", False, 1.0) if ok else ("UNKNOWN", True, 0.0) for i, (*_, ok) in enumerate(cases)}, "c6": ("UNKNOWN", False, 0.0)}


def test_reviewer_errors_are_kept(spark):
    asked = spark.createDataFrame([("r", "e1", 1), ("r", "e2", 2)], "repo string, endpoint_id string, n int")

    def reviewer(request):
        if request["n"] == 2:
            raise RuntimeError("no answer")
        return [{"candidate_id": "c1", "result": "PASS", "confidence": 0.5, "reason": "", "evidence": []}]

    got = review.run_reviewer(asked, reviewer)
    assert {(r.endpoint_id, r.error) for r in got.collect()} == {("e1", None), ("e2", "RuntimeError: no answer")}
    assert [(r.message, r.endpoints) for r in review.group_errors(got).collect()] == [("no answer", ["e2"])]


def test_sync(spark):
    rows = lambda *x: table(spark, list(x), "repo string, id string, file string, json string")
    old = rows(("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z"))
    assert index.sync(old, old).count() == 0
    got = {(r.id, r.action) for r in index.sync(old, rows(("1", "a", "x"), ("2", "b2", "changed"), ("4", "d", "n"))).collect()}
    assert got == {("2", "update"), ("3", "delete"), ("4", "insert")}


def test_scanners(spark):
    text = "const http = axios.create({});\nexport const getUser = (id) => { return http.get(`/users/${id}?size=1`, { params: { page } }); };\nfetch('/a/' + x, { method: 'POST', body: JSON.stringify({ name, ...rest }) });\naxios.post(url, { a: 1, 'b': 2 });"
    sources = spark.createDataFrame([("r", "src/a.ts", text), ("r", "src/b.ts", None)], "repo string, file string, text string")
    got = [(r.method, r.endpoint_pattern, r.query_keys, r.body_keys, r.line) for r in extract.scan_calls(sources).orderBy("line").collect()]
    assert got == [("GET", "/users/{param}", ["size", "page"], [], 2), ("POST", "/a/{param}", [], None, 3), ("POST", None, None, ["a", "b"], 4)]
    spans = extract.scan_functions(sources)
    assert [(r.name, r.line, r.component) for r in spans.collect()] == [("getUser", 2, False)]
    java = '@RestController @RequestMapping("/api") class UserController {\n @GetMapping("/users/{id}") public ResponseEntity<User> one(@PathVariable Long id, @RequestParam(required = false) String q, Pageable p) {}\n}'
    maps = extract.scan_spring(spark.createDataFrame([("r", "U.java", java)], "repo string, file string, text string"))
    assert [r.id for r in extract.expand_mappings(maps).collect()] == ["GET /api/users/{id}"]
    assert {(r.name, r.source, r.required) for r in extract.bind_parameters(maps).collect()} == {("id", "path", True), ("q", "query", False), ("page", "query", False), ("size", "query", False), ("sort", "query", False)}
    objects = spark.createDataFrame([("r", "Filter", "since", "LocalDate"), ("r", "Filter", "tags", "String"), ("r", "Role", None, None)], "repo string, java_type string, name string, type string")
    given = spark.createDataFrame([("r", "C#h", ["@Valid Filter f", "Role role", "ModelMap m", "@RequestParam Map<String, String> all", "@CookieValue String c", "Duration d", "Unknown u"])], "repo string, handler string, parameters array<string>")
    assert {(r.name, r.source, r.required, r.java_type) for r in extract.bind_parameters(given, objects).collect()} == {("since", "query", False, "LocalDate"), ("tags", "query", False, "String"), ("role", "query", False, "Role"), ("d", "query", False, "Duration")}


def test_constants(spark):
    parts = "repo string, name string, parts array<struct<literal:string,ref:string>>"
    rows = [("A", [("/api", None)]), ("B", [(None, "A"), ("/x", None)]), ("C", [(None, "B"), (None, "B")]), ("L", [(None, "L")])]
    got = {r.name: r.value for r in extract.resolve_constants(table(spark, rows, parts)).collect()}
    assert got == {"A": "/api", "B": "/api/x", "C": "/api/x/api/x", "L": "<expr>"}
