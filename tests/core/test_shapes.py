"""Shapes of types and fields through supertypes on hand-written cases."""

import pytest

from seamline.operators import inherit, shapes

SCALAR = '{"kind":"scalar","name":"%s"}'
DTO = '{"kind":"dto","dtoId":"%s","typeArguments":[%s]}'
ARRAY, MAP, ENUM, T = '{"kind":"array","element":%s}', '{"kind":"map","value":%s}', '{"kind":"enum","enumId":"%s"}', '{"kind":"typeParameter","name":"%s"}'


@pytest.fixture(scope="module")
def types(spark):
    dtos = [("r", "User", "User", []), ("r", "a.Page", "Page", ["T"]), ("r", "Node", "Node", []), ("r", "Empty", "Empty", []), *[("r", f"L{i}", f"L{i}", []) for i in range(7)]]
    fields = [("User", 0, "name", SCALAR % "String", True), ("User", 1, "age", SCALAR % "int", False), ("User", 2, "status", ENUM % "S1", True), ("a.Page", 0, "content", ARRAY % (T % "T"), False), ("a.Page", 1, "last", SCALAR % "Boolean", False)]
    fields += [("Node", 0, "next", DTO % ("Node", ""), True), ("Node", 1, "all", ARRAY % (DTO % ("Node", "")), False), *[(f"L{i}", 0, "down", DTO % (f"L{i + 1}", ""), False) for i in range(6)]]
    values = [("r", "S1", 0, "A"), ("r", "S2", 1, "B"), ("r", "S2", 0, 'A"x'), ("q", "S1", 0, "Z")]
    return (
        spark.createDataFrame(dtos, "repo string, id string, name string, type_parameters array<string>"),
        spark.createDataFrame([("r", *f) for f in fields], "repo string, dto_id string, pos int, name string, type_json string, nullable boolean"),
        spark.createDataFrame(values, "repo string, enum_id string, pos int, value string"),
    )


CASES = {
    ARRAY % (DTO % ("User", "")): '{\n  name: string | null;\n  age: number;\n  status: "A" | null;\n}[]',
    SCALAR % "LocalDate": "string",
    ENUM % "S2": '"A\\"x" | "B"',
    ENUM % "S9": "string",
    ARRAY % (ARRAY % (ENUM % "S2")): '(("A\\"x" | "B")[])[]',
    ARRAY % (MAP % (SCALAR % "long")): "(Record<string, number>)[]",
    DTO % ("a.Page", ENUM % "S2"): '{\n  content: ("A\\"x" | "B")[];\n  last: boolean;\n}',
    DTO % ("Node", ""): "{\n  next: Node /* … */ | null;\n  all: (Node /* … */)[];\n}",
    DTO % ("Empty", ""): "{}",
    DTO % ("Gone", ""): "unknown",
    T % "T": "unknown",
    DTO % ("L0", ""): "{\n  down: {\n    down: {\n      down: {\n        down: {\n          down: L5 /* … */;\n        };\n      };\n    };\n  };\n}",
}


def test_shapes(spark, types):
    roots = spark.createDataFrame([("r", t) for t in CASES] + [("r", None)], "repo string, type string")
    assert {r.type: r["shape"] for r in shapes.shapes(roots, *types).collect()} == CASES


def test_no_roots(spark, types):
    assert shapes.shapes(spark.createDataFrame([], "repo string, type string"), *types).collect() == []


def flat(spark, classes, extends, members):
    found = inherit.flatten_fields(
        spark.createDataFrame([("r", *c) for c in classes], "repo string, dto_id string, type_parameters array<string>, naming string, ignored array<string>"),
        spark.createDataFrame([("r", *e) for e in extends], "repo string, dto_id string, ord int, parent string, args array<string>"),
        spark.createDataFrame([("r", *m) for m in members], "repo string, dto_id string, pos int, kind string, name string, json_name string, type_json string, nullable boolean, skipped boolean"),
    )
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.dto_id, r.pos)):
        out.setdefault(r.dto_id, []).append((r.name, r.type_json))
    return out


def field(dto, pos, name, type_json=SCALAR % "int", json=None, skipped=False, kind="field"):
    return dto, pos, kind, name, json, type_json, False, skipped


def test_arguments_through_three_levels(spark):
    """Parameters of one name at all levels, swapped on the way."""
    classes = [("A", ["T", "U"], None, None), ("B", ["T", "U"], None, None), ("C", ["T"], None, None), ("D", [], None, None)]
    extends = [("B", 0, "A", [T % "U", T % "T"]), ("C", 0, "B", [ARRAY % (T % "T"), SCALAR % "int"]), ("D", 0, "C", [DTO % ("X", "")])]
    got = flat(spark, classes, extends, [field("A", 0, "first", T % "T"), field("A", 1, "second", MAP % (T % "U"))])
    assert got["B"] == [("first", T % "U"), ("second", MAP % (T % "T"))]
    assert got["C"] == [("first", SCALAR % "int"), ("second", MAP % (ARRAY % (T % "T")))]
    assert got["D"] == [("first", SCALAR % "int"), ("second", MAP % (ARRAY % (DTO % ("X", ""))))]


def test_raw_supertypes_cycles_and_unknown_parents(spark):
    classes = [("A", ["T"], None, None), ("B", [], None, None), ("C", [], None, None)]
    extends = [("B", 0, "A", None), ("A", 0, "B", []), ("C", 0, "Gone", [SCALAR % "int"])]
    got = flat(spark, classes, extends, [field("A", 0, "a", T % "T"), field("B", 0, "b"), field("C", 0, "c")])
    assert got == {"A": [("b", SCALAR % "int"), ("a", T % "T")], "B": [("a", T % "T"), ("b", SCALAR % "int")], "C": [("c", SCALAR % "int")]}


def test_precedence_of_fields_getters_and_names(spark):
    classes = [("P", [], "kebab", None), ("M", [], None, None), ("K", [], "snake", ["keptName"])]
    extends = [("M", 0, "P", None), ("K", 0, "M", None)]
    members = [
        field("P", 0, "userName"), field("P", 1, "oldId"), field("P", 2, "gone"), field("M", 0, "midName"), field("M", 1, "secret", skipped=True), field("K", 0, "keptName", json="keptName"),
        field("K", 1, "oldId", SCALAR % "String"), field("K", 0, "getUserName", SCALAR % "String", kind="method"), field("K", 1, "getGone", skipped=True, kind="method"),
        field("K", 2, "isOpen", SCALAR % "boolean", kind="method"), field("K", 3, "getSecret", kind="method"), field("K", 4, "isText", SCALAR % "String", kind="method"), field("K", 5, "getClass", kind="method"), field("K", 6, "getURLOf", json="link", kind="method"),
    ]
    got = flat(spark, classes, extends, members + members[:3])
    assert got["P"] == [("user-name", SCALAR % "int"), ("old-id", SCALAR % "int"), ("gone", SCALAR % "int")]
    assert got["M"] == [("user-name", SCALAR % "int"), ("old-id", SCALAR % "int"), ("gone", SCALAR % "int"), ("midName", SCALAR % "int")]
    assert got["K"] == [("user-name", SCALAR % "int"), ("old_id", SCALAR % "String"), ("mid_name", SCALAR % "int"), ("open", SCALAR % "boolean"), ("secret", SCALAR % "int"), ("link", SCALAR % "int")]
