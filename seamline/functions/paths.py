"""Column functions over URL patterns, access paths, identifiers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARAM = "{param}"


def normalize_path(p: Column) -> Column:
    """``/users/{id}?x`` and ``users//:id/`` alike become ``/users/{param}``: no query, no doubled or final slash."""
    p = F.split_part(p, F.lit("?"), F.lit(1))
    p = F.regexp_replace(F.regexp_replace(p, r"\{[^}/]*\}", PARAM), r":[A-Za-z_][A-Za-z0-9_]*", PARAM)
    p = F.regexp_replace(F.concat(F.lit("/"), p), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def join_path(base: Column, p: Column) -> Column:
    return F.when(F.coalesce(base, F.lit("")) == "", p).otherwise(normalize_path(F.concat(base, F.lit("/"), p)))


def frontend_path(pattern: Column, base: Column) -> Column:
    """The base path in front, unless there is none or the pattern is at or under it already."""
    b = normalize_path(base)
    bare = base.isNull() | base.isin("", "/")
    return F.when(bare | (pattern == b) | F.startswith(pattern, F.concat(b, F.lit("/"))), pattern).otherwise(normalize_path(F.concat(b, F.lit("/"), pattern)))


def format_access_path(path: Column) -> Column:
    """``[content, [], name]`` as ``content[].name``."""
    return F.replace(F.array_join(path, "."), F.lit(".[]"), F.lit("[]"))


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda x: x != "")


def path_score(fe: Column, be: Column) -> Column:
    """Segment arrays of normalised paths: -1 where they can't be the same, else 3 for an equal segment, 1 for a backend and 0 for a frontend parameter."""
    each = F.zip_with(fe, be, lambda a, b: F.when(a == b, 3).when(b == PARAM, 1).when(a == PARAM, 0).otherwise(-1))
    return F.when((F.size(fe) != F.size(be)) | F.exists(each, lambda s: s < 0), -1).otherwise(F.aggregate(each, F.lit(0), lambda t, s: t + s))


def path_similarity(fe: Column, be: Column) -> Column:
    n = F.least(F.size(fe), F.size(be))
    same = F.zip_with(F.slice(fe, F.lit(1), n), F.slice(be, F.lit(1), n), lambda a, b: (a == b) & (a != PARAM))
    return F.size(F.filter(same, lambda s: s))


def api_key(endpoint: Column, method: Column, pattern: Column, callee: Column) -> Column:
    m = F.coalesce(method, F.lit("?"))
    return F.coalesce(endpoint, F.concat(m, F.lit(" "), pattern), F.concat(m, F.lit(" <"), callee, F.lit(">")))


def strip_origin(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(rest == "", "/").when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def resolve_endpoint(template: Column) -> Column:
    """A URL template's pattern: ``${...}`` is a parameter; null where no slash shows that it is a path."""
    t = F.regexp_replace(template, r"\$\{[^}]*\}", PARAM)
    return F.when(F.contains(t, F.lit("/")), normalize_path(strip_origin(t)))


def resolve_concat(pieces: Column) -> Column:
    """The same for a concatenation; null pieces are unknown parts."""
    return resolve_endpoint(F.array_join(F.transform(pieces, lambda x: F.coalesce(x, F.lit(PARAM))), ""))


def url_query_keys(raw: Column) -> Column:
    """Names of the query's pairs, from the text between the first and the second question mark; null stays null."""
    pairs = F.split(F.split_part(raw, F.lit("?"), F.lit(2)), "&")
    names = F.filter(F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: (x != "") & (x != PARAM))
    return F.when(raw.isNotNull(), F.when(F.contains(raw, F.lit("?")), names).otherwise(F.array().cast("array<string>")))


def path_starts_with(path: Column, prefix: Column, wildcard: bool = False) -> Column:
    """Prefix test of access paths; with ``wildcard`` a ``*`` in the prefix meets any segment."""
    n = F.size(prefix)
    same = (lambda a, b: (a == b) | (b == "*")) if wildcard else (lambda a, b: a == b)
    return (n <= F.size(path)) & F.forall(F.zip_with(F.slice(path, F.lit(1), n), prefix, same), lambda s: F.coalesce(s, F.lit(False)))


# Scalar types that arrive as JSON numbers.
NUMBERS = (
    "int", "long", "short", "byte", "float", "double", "Integer", "Long", "Short", "Byte", "Float", "Double",
    "BigDecimal", "BigInteger", "Number", "AtomicInteger", "AtomicLong",
)
STRING_LIKE = ("String", "CharSequence", "char", "Character")


def json_category(kind: Column, name: Column, known: Column) -> Column:
    """What a type is in JSON; ``known`` tells whether a DTO is described on its side."""
    return (
        F.when(kind == "scalar", F.when(name.isin(*NUMBERS), "number").when(name.isin("boolean", "Boolean"), "boolean").otherwise("string"))
        .when(kind == "enum", "string")
        .when(kind == "array", "array")
        .when((kind == "map") | ((kind == "dto") & known), "object")
        .otherwise(F.concat(F.lit("unknown:"), name))
    )


def truncate_code(code: Column) -> Column:
    """One line of at most 200 characters, with an ellipsis where it is cut."""
    flat = F.trim(F.regexp_replace(code, r"\s+", " "))
    return F.when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 200), F.lit("…"))).otherwise(flat)


def first_line(code: Column) -> Column:
    return F.trim(F.split_part(code, F.lit("\n"), F.lit(1)))


def rename(name: Column, strategy: str) -> Column:
    """A JSON property name under a naming strategy: snake, kebab, dot, upper_camel, lower or identity."""
    if strategy in ("snake", "kebab", "dot"):
        sep = {"snake": "_", "kebab": "-", "dot": "."}[strategy]
        return F.lower(F.regexp_replace(name, r"([^A-Z_])([A-Z])", f"$1{sep}$2"))
    if strategy == "upper_camel":
        return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
    return F.lower(name) if strategy == "lower" else name


def getter_property(method: Column, boolean: Column) -> Column:
    """The property of ``getX`` (but getClass) or a boolean ``isX``, with its leading capitals lowered; else null."""
    got = F.when((method != "getClass") & method.rlike("^get[A-Z0-9_]"), F.substring(method, 4, 1 << 30)).when(boolean & method.rlike("^is[A-Z0-9_]"), F.substring(method, 3, 1 << 30))
    head = F.regexp_extract(got, "^[A-Z]*", 0)
    return F.concat(F.lower(head), F.regexp_replace(got, "^[A-Z]*", ""))


PRIMITIVES = ("int", "long", "short", "byte", "float", "double", "boolean", "char")


def nullable(type_name: Column, annotations: Column) -> Column:
    """Primitives never are; @Nullable and Optional are; otherwise unless a not-null annotation says so."""
    has = lambda *names: F.arrays_overlap(annotations, F.array(*map(F.lit, names)))
    return F.when(type_name.isin(*PRIMITIVES), False).when(has("Nullable") | F.startswith(type_name, F.lit("Optional<")), True).otherwise(~has("NotNull", "NonNull", "Nonnull", "NotBlank", "NotEmpty"))


def spring_join(prefix: Column, path: Column) -> Column:
    p = F.regexp_replace(F.concat_ws("/", F.lit(""), F.coalesce(prefix, F.lit("")), F.coalesce(path, F.lit(""))), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quote_in(quote: Column, text: Column) -> Column:
    """Whether a quote of two characters or more stands in a text, white space apart."""
    q = squeeze(quote)
    return (F.length(q) >= 2) & F.contains(squeeze(text), q)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def positional_id(kind: str, file: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), file, line, column)


def relative_to(path: Column, root: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    r = F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/*$", "/")
    inside = F.when(F.startswith(p, r), F.substr(p, F.length(r) + 1)).otherwise(p)
    return F.regexp_replace(inside, r"^(\./)+", "")


def resolve_specifier(file: Column, specifier: Column) -> Column:
    """The path without extension that a relative import names, from the importing file's place; null for packages."""
    parts = F.split(F.concat_ws("/", F.regexp_replace(file, r"/?[^/]*$", ""), specifier), "/")
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.startswith(specifier, F.lit(".")), F.array_join(done, "/"))


def access_chain(text: Column) -> Column:
    """``user?.tags[0].name`` as (root, path): ``?.`` and ``!`` don't count, quoted keys are fields, other brackets elements; a called chain loses its last name."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\?\.", "."), "!", "")
    called = bare.rlike(r"\)\s*$")
    head = F.regexp_replace(bare, r"\([^()]*\)\s*$", "")
    marks = F.regexp_extract_all(head, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*|\[[^\]]*\]"), F.lit(0))
    read = F.transform(marks, lambda m: F.when(~F.startswith(m, F.lit("[")), m).when(m.rlike(r"""^\[["'].*["']\]$"""), F.regexp_replace(m, r"""^\[["']|["']\]$""", "")).otherwise("[]"))
    path = F.slice(read, 2, F.greatest(F.lit(0), F.size(read) - 1 - called.cast("int")))
    return F.struct(F.get(read, F.lit(0)).alias("root"), path.alias("path"))
