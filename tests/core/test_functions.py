"""Table-driven scalar cases."""

import pytest
from pyspark.sql import functions as F

from seamline.functions import paths as P
from seamline.operators.extract import type_json
from seamline.operators.types import describe


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


CASES = [
    (lambda: P.normalize_path(F.lit("/users/{id}")), "/users/{param}"),
    (lambda: P.normalize_path(F.lit("/users/:id/posts")), "/users/{param}/posts"),
    (lambda: P.normalize_path(F.lit("/users/")), "/users"),
    (lambda: P.normalize_path(F.lit("/users?page=1")), "/users"),
    (lambda: P.normalize_path(F.lit("//users//{id}")), "/users/{param}"),
    (lambda: P.normalize_path(F.lit("/")), "/"),
    (lambda: P.resolve_endpoint(F.lit("/users/${id}")), "/users/{param}"),
    (lambda: P.resolve_concat(F.array(F.lit("/users/"), F.lit(None).cast("string"), F.lit("/posts"))), "/users/{param}/posts"),
    (lambda: P.resolve_concat(F.array(F.lit("https://api.example.com/users/"), F.lit(None).cast("string"))), "/users/{param}"),
    (lambda: P.resolve_endpoint(F.lit("not-a-path")), None),
    (lambda: P.url_query_keys(F.lit("/users")), []),
    (lambda: P.url_query_keys(F.lit("/users?page=${id}&size=10")), ["page", "size"]),
    (lambda: P.url_query_keys(F.lit("/users?active")), ["active"]),
    (lambda: P.url_query_keys(F.lit("/users?a=1?b=2")), ["a"]),
    (lambda: P.url_query_keys(F.lit(None).cast("string")), None),
    (lambda: P.format_access_path(F.array(F.lit("content"), F.lit("[]"), F.lit("name"))), "content[].name"),
    (lambda: P.format_access_path(F.array(F.lit("[]"), F.lit("name"))), "[].name"),
    (lambda: P.frontend_path(F.lit("/users"), F.lit("/api")), "/api/users"),
    (lambda: P.frontend_path(F.lit("/api/users"), F.lit("/api")), "/api/users"),
    (lambda: P.rename(F.lit("userURLName"), "snake"), "user_urlname"),
    (lambda: P.getter_property(F.lit("getURLName"), F.lit(False)), "urlname"),
    (lambda: P.getter_property(F.lit("getClass"), F.lit(False)), None),
    (lambda: P.getter_property(F.lit("isActive"), F.lit(True)), "active"),
    (lambda: P.nullable(F.lit("int"), F.array().cast("array<string>")), False),
    (lambda: P.nullable(F.lit("String"), F.array(F.lit("NotBlank"))), False),
    (lambda: P.nullable(F.lit("Optional<String>"), F.array(F.lit("NotNull"))), True),
    (lambda: P.spring_join(F.lit("api"), F.lit("/users/")), "/api/users"),
    (lambda: P.quote_in(F.lit("a + 1"), F.lit("return a  +  1;")), True),
    (lambda: P.quote_in(F.lit("x"), F.lit("x")), False),
    (lambda: P.access_chain(F.lit("user?.profile.tags[0].name"))["path"], ["profile", "tags", "[]", "name"]),
    (lambda: P.access_chain(F.lit("user.items['x'].trim()"))["path"], ["items", "x"]),
    (lambda: P.resolve_specifier(F.lit("src/a/b.ts"), F.lit("../c/d")), "src/c/d"),
    (lambda: P.resolve_specifier(F.lit("src/a.ts"), F.lit("react")), None),
    (lambda: P.path_starts_with(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("*")), True), True),
    (lambda: P.path_starts_with(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), False),
    (lambda: P.relative_to(F.lit("/root/x/./a.ts"), F.lit("/root/x")), "a.ts"),
    (lambda: describe(F.lit('{"kind":"dto","dtoId":"p.Page","typeArguments":[{"kind":"array","element":{"kind":"dto","dtoId":"p.User","typeArguments":[]}},{"kind":"map","value":{"kind":"scalar","name":"int"}}]}')), "Page<User[], Map<string, int>>"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(spark, i):
    build, want = CASES[i]
    assert value(spark, build()) == want


def test_java_types():
    ids = {"User": "p.User", "Page": "p.Page", "Role": "p.Role"}
    user = '{"kind":"dto","dtoId":"p.User","typeArguments":[]}'
    assert type_json("ResponseEntity<List<User>>", ids, {"Role"}) == f'{{"kind":"array","element":{user}}}'
    assert type_json("Mono<Page<User>>", ids, set()) == f'{{"kind":"dto","dtoId":"p.Page","typeArguments":[{user}]}}'
    assert type_json("Flux<User>", ids, set()) == f'{{"kind":"array","element":{user}}}'
    assert type_json("Map<String, ? extends User>", ids, set()) == f'{{"kind":"map","value":{user}}}'
    assert type_json("void", ids, set()) is None
    assert type_json("ResponseEntity<?>", ids, set()) == '{"kind":"unknown","name":"ResponseEntity"}'
    assert type_json("T", ids, set(), ("T",)) == '{"kind":"typeParameter","name":"T"}'
    assert type_json("Role", ids, {"Role"}) == '{"kind":"enum","enumId":"p.Role"}'
