"""Constants by scopes on hand-written classes."""

import pytest

from seamline.operators.constants import scoped_constants

PARTS = "repo string, type string, name string, parts array<struct<literal:string,ref:string,owner:string>>"


def text(t):
    return (t, None, None)


def use(name, owner=None):
    return (None, name, owner)


@pytest.fixture(scope="module")
def values(spark):
    types = [("A", None), ("A.In", "A"), ("A.In.Deep", "A.In"), ("P", None), ("Q", None), ("S", None), ("Up", None), ("C1", None), ("C2", None), (None, None)]
    supers = [("A.In", 1, "Q"), ("A.In", 0, "P"), ("P", 0, "Up"), ("C1", 0, "C2"), ("C2", 0, "C1"), ("S", 0, "Unknown")]
    imports = [("A", 1, "S", None), ("A", 0, "Q", "ONLY"), ("A.In.Deep", 0, "S", None)]
    constants = [
        ("A", "X", [text("a")]), ("A.In", "X", [text("in")]), ("A", "OUT", [text("out")]), ("Up", "BOTH", [text("up")]), ("Q", "BOTH", [text("q")]), ("Q", "ONLY", [text("only")]), ("S", "ONLY", [text("s")]), ("S", "STAT", [text("stat")]),
        ("A.In.Deep", "NEAR", [use("X"), text("/"), use("OUT")]), ("A.In.Deep", "FIRST", [use("BOTH")]), ("A", "IMPORTED", [use("ONLY"), use("STAT")]), ("A.In.Deep", "OWNER", [use("X", "A"), use("BOTH", "P")]), ("A.In.Deep", "NOTHERE", [use("STAT", "A")]),
        ("C1", "L", [use("M")]), ("C2", "M", [use("L")]), ("C1", "N", [text("n"), use("O")]), ("C2", "O", [text("")]), ("A", "EMPTY", []), ("A.In", "USES", [use("EMPTY")]), ("A", "NOTEXT", [(None, None, None), text("x")]), ("A", "TWICE", [text("b")]), ("A", "TWICE", [text("a")]), (None, "Z", [text("z")]),
    ]
    at = lambda rows, schema: spark.createDataFrame([("r", *r) for r in rows], "repo string, " + schema)
    found = scoped_constants(at(types, "type string, outer string"), at(supers, "type string, ord int, parent string"), at(imports, "type string, ord int, owner string, name string"), at(constants, PARTS.removeprefix("repo string, ")))
    rows = found.collect()
    assert len(rows) == len({(r.type, r.name) for r in rows})
    return {(r.type, r.name): r.value for r in rows}


CASES = {
    ("A.In.Deep", "NEAR"): "in/out", ("A.In.Deep", "FIRST"): "up", ("A", "IMPORTED"): "onlystat", ("A.In.Deep", "OWNER"): "aup", ("A.In.Deep", "NOTHERE"): "<expr>", ("C1", "L"): "<expr>", ("C2", "M"): "<expr>",
    ("C1", "N"): "n", ("A.In", "USES"): "<expr>", ("A", "NOTEXT"): "x", ("A", "TWICE"): "a",
}


@pytest.mark.parametrize("key", CASES, ids=".".join)
def test_a_name_means_the_nearest_constant(values, key):
    assert values[key] == CASES[key]


def test_what_has_no_value_or_class_is_left_out(values):
    assert ("A", "EMPTY") not in values and (None, "Z") not in values


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], "repo string, " + schema)
    found = scoped_constants(none("type string, outer string"), none("type string, ord int, parent string"), none("type string, ord int, owner string, name string"), none(PARTS.removeprefix("repo string, ")))
    assert found.collect() == []
