"""Facts from source text: lexical scanners with a stated scope, and the table steps that resolve what they find.

Scanners report less rather than guess: what isn't literal is null. They run as one pass over (repo, file, text).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.paths import resolve_endpoint, resolve_specifier, spring_join, truncate_code, url_query_keys
from seamline.plans.lineage import stored

METHODS = ("get", "post", "put", "delete", "patch")
_CALL = re.compile(r"\b(?:(\w+)\.(get|post|put|delete|patch)|fetch)\s*(?:<[^<>()]*>)?\(")
_INSTANCE = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*=\s*axios\.create\(")
_QUOTED = re.compile(r"""^(?:"([^"]*)"|'([^']*)'|`([^`]*)`)$""", re.S)
_KEY = re.compile(r"""^(?:(\w+)|["']([^"']+)["'])\s*(?::|$)""")


def arguments_at(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opens before ``at``, and the place after it; strings and brackets are skipped."""
    depth, start, parts, quote = 1, at, [], ""
    i = at
    while i < len(text) and depth:
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                parts.append(text[start:i])
        elif c == "," and depth == 1:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return [p.strip() for p in parts if p.strip()], i


def object_keys(text: str | None) -> list[str] | None:
    """Keys of an object literal; None where there is a spread, a computed key, or no literal."""
    if text is None or not (text.startswith("{") and text.endswith("}")):
        return None
    keys = []
    for part in arguments_at(text[1:-1] + ")", 0)[0]:
        m = _KEY.match(part)
        if not m:
            return None
        keys.append(m[1] or m[2])
    return keys


def url_template(text: str) -> str | None:
    """A literal, template or concatenation as a template with ``${}`` for unknown parts."""
    parts, depth, start = [], 0, 0
    pieces = [p.strip() for p in re.split(r"\+(?=(?:[^\"'`]|\"[^\"]*\"|'[^']*'|`[^`]*`)*$)", text)]
    for p in pieces:
        m = _QUOTED.match(p)
        parts.append(next(g for g in m.groups() if g is not None) if m else "${x}")
    return "".join(parts) if any(_QUOTED.match(p) for p in pieces) else None


CALLS = "repo string, file string, line int, col int, callee string, method string, template string, query_keys array<string>, body_keys array<string>, code string"


def scan_calls(sources: DataFrame) -> DataFrame:
    """Direct calls ``axios.get(...)``, of ``axios.create`` instances in the same file, and ``fetch(url, {method})``; ids, patterns and keys follow.

    A null text has no calls. Query keys are those of the URL and of ``params``; null where they can't all be told.
    """

    def one(repo: str, file: str, text: str) -> Iterator[dict]:
        clients = {"axios", *_INSTANCE.findall(text)}
        for m in _CALL.finditer(text):
            if m[1] and m[1] not in clients:
                continue
            args, end = arguments_at(text, m.end())
            if not args:
                continue
            method, options, body = (m[2] or "get").upper(), None, None
            if m[1] is None:
                options = args[1] if len(args) > 1 else None
                named = re.search(r"\bmethod\s*:\s*[\"'](\w+)[\"']", options or "")
                method = named[1].upper() if named else (None if options and ("..." in options or "method" in options) else "GET")
                sent = re.search(r"\bbody\s*:\s*JSON\.stringify\((\{.*?\})\)", options or "", re.S)
                body = object_keys(sent[1]) if sent else ([] if "body" not in (options or "") and (options is None or options.startswith("{")) else None)
            elif m[2] in ("get", "delete"):
                options, body = (args[1] if len(args) > 1 else None), []
            else:
                body, options = (object_keys(args[1]) if len(args) > 1 else []), (args[2] if len(args) > 2 else None)
            extra: list[str] | None = []
            if m[1] and options is not None:
                params = re.search(r"\bparams\s*:\s*", options)
                extra = object_keys(arguments_at(options[1:-1] + ")", 0)[0] and next((p.split(":", 1)[1].strip() for p in arguments_at(options[1:-1] + ")", 0)[0] if p.startswith("params")), None)) if params else ([] if options.startswith("{") and "..." not in options else None)
            line = text.count("\n", 0, m.start()) + 1
            yield {"repo": repo, "file": file, "line": line, "col": m.start() - text.rfind("\n", 0, m.start()), "callee": text[m.start() : m.end() - 1].strip(), "method": method, "template": url_template(args[0]), "query_keys": extra, "body_keys": body, "code": text[m.start() : end]}

    names = [c.split()[0] for c in CALLS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for x in batch.itertuples() if x.text for r in one(x.repo, x.file, x.text)], columns=names)

    found = sources.select("repo", "file", "text").mapInPandas(run, CALLS)
    own = url_query_keys(F.col("template"))
    keys = F.when(F.col("query_keys").isNotNull() & F.col("template").isNotNull(), F.array_distinct(F.concat(own, "query_keys")))
    return found.select(
        "repo", F.concat_ws(":", F.lit("call"), "file", "line", "col").alias("id"), resolve_endpoint(F.col("template")).alias("endpoint_pattern"), "method", "callee", F.lit("direct").alias("resolution"),
        "file", "line", "col", keys.alias("query_keys"), "body_keys", truncate_code(F.col("code")).alias("code"),
    )


def scan_imports(sources: DataFrame) -> DataFrame:
    """(repo, file, source, specifiers): ``import`` statements with default, namespace and named specifiers."""
    statement = r"""import\s+(?:type\s+)?(?:([^"';]+?)\s+from\s+)?["']([^"']+)["']"""
    each = sources.select("repo", "file", F.explode(F.regexp_extract_all("text", F.lit(statement), F.lit(0))).alias("s"))
    what = F.regexp_extract("s", statement, 1)
    names = F.filter(F.transform(F.split(F.regexp_replace(what, r"[{}]", ","), ","), lambda x: F.regexp_replace(F.trim(x), r"^(type\s+)?(.*?)(\s+as\s+\w+)?$", "$2")), lambda x: x != "")
    return each.select("repo", "file", F.regexp_extract("s", statement, 2).alias("source"), names.alias("specifiers"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with resolved_file: a relative specifier's file by extension or index; null for packages."""
    base = imports.withColumn("_base", resolve_specifier(F.col("file"), F.col("source"))).withColumn("_n", F.monotonically_increasing_id())
    tails = F.array(*map(F.lit, ("", ".ts", ".tsx", "/index.ts", "/index.tsx")))
    tried = base.where("_base IS NOT NULL").select("repo", "_n", F.posexplode(F.transform(tails, lambda t: F.concat("_base", t))).alias("_turn", "path"))
    hit = tried.join(files.select("repo", "path"), ["repo", "path"]).groupBy("repo", "_n").agg(F.min_by("path", "_turn").alias("resolved_file"))
    return base.join(hit, ["repo", "_n"], "left").drop("_base", "_n")


def scan_functions(sources: DataFrame) -> DataFrame:
    """(repo, id, name, file, line, last_line, component): named functions and arrow constants with their line span.

    A component has a capital and JSX inside.
    """
    head = re.compile(r"\b(?:function\s+(\w+)\s*(?:<[^<>()]*>)?\(|(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\s*)?\()")
    names = ["repo", "id", "name", "file", "line", "last_line", "component"]

    def one(repo: str, file: str, text: str) -> Iterator[tuple]:
        for m in head.finditer(text):
            _, end = arguments_at(text, m.end())
            after = re.compile(r"[^;{]*?(?:=>\s*)?\{").match(text, end)
            if not after:
                continue
            _, last = arguments_at(text, after.end())
            name, line = m[1] or m[2], text.count("\n", 0, m.start()) + 1
            body = text[after.end() : last]
            col = m.start() - text.rfind("\n", 0, m.start())
            yield repo, f"fn:{file}:{line}:{col}", name, file, line, text.count("\n", 0, last) + 1, name[0].isupper() and bool(re.search(r"<[A-Za-z>]", body))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for x in batch.itertuples() if x.text for r in one(x.repo, x.file, x.text)], columns=names)

    return sources.select("repo", "file", "text").mapInPandas(run, "repo string, id string, name string, file string, line int, last_line int, component boolean")


def _innermost(lines: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """(repo, file, line, ``value``): of the spans (repo, file, id, first, last, ``value``) around each line the shortest, then the one that begins last, then by id.

    A span is cut into the blocks of 2^level lines that make it up, two a level at most, and each block keeps its best span;
    a line looks up its own block of each level. Spans may overlap in any way, and no line meets all spans of its file.
    """
    size = F.col("last") - F.col("first") + 1
    level = spans.where("first <= last AND first >= 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(size)).cast("int"))))
    width = F.expr("shiftleft(1L, level)")
    low, high = F.ceil(F.col("first") / width).cast("long"), F.floor((F.col("last") + 1) / width).cast("long")
    ends = level.withColumns({"low": low, "high": high}).where("low < high")
    blocks = F.array_compact(F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)))
    best = F.min(F.struct(size.alias("size"), (-F.col("first")).alias("begin"), "id", value)).alias("best")
    kept = ends.withColumn("block", F.explode(blocks)).groupBy("repo", "file", "level", "block").agg(best)
    tops = kept.groupBy("repo", "file").agg(F.max("level").alias("top"))
    asked = lines.join(tops, ["repo", "file"]).withColumn("level", F.explode(F.sequence(F.lit(0), "top")))
    asked = asked.withColumn("block", F.floor(F.col("line") / width).cast("long"))
    found = asked.join(kept, ["repo", "file", "level", "block"]).groupBy("repo", "file", "line").agg(F.min("best").alias("best"))
    return found.select("repo", "file", "line", F.col(f"best.{value}").alias(value))


def enclosing(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """(repo, id, function_id, component): the innermost function around each site (repo, id, file, line), and the nearest component.

    ``spans``: repo, file, id, name, line, last_line, component. One row for each row of ``sites``, also where ids repeat; those
    outside all functions are left out. Only the lines that have a site are looked up, each once.
    """
    lines = sites.select("repo", "file", "line").distinct()
    given = spans.select("repo", "file", "id", F.col("id").alias("function_id"), F.col("name").alias("component"), F.col("line").alias("first"), F.col("last_line").alias("last"), F.col("component").alias("is_component"))
    on = ["repo", "file", "line"]
    met = _innermost(lines, given, "function_id").join(_innermost(lines, given.where("is_component"), "component"), on, "left")
    return sites.select("repo", "id", "file", "line").join(met, on).select("repo", "id", "function_id", "component")


def expand_mappings(mappings: DataFrame) -> DataFrame:
    """(repo, id, method, path, handler, pos): prefixes x paths x methods (none: all five), the first of each id by position."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    verbs = F.when(F.size("methods") > 0, F.col("methods")).otherwise(F.array(*[F.lit(m.upper()) for m in METHODS]))
    rows = mappings.select("repo", "handler", "pos", F.explode(some("prefixes")).alias("prefix"), "paths", "methods").select("repo", "handler", "pos", "prefix", F.explode(some("paths")).alias("sub"), verbs.alias("verbs")).select("repo", "handler", "pos", spring_join(F.col("prefix"), F.col("sub")).alias("path"), F.explode("verbs").alias("method"))
    named = rows.withColumn("id", F.concat_ws(" ", "method", "path"))
    n = F.row_number().over(W.partitionBy("repo", "id").orderBy("pos"))
    return named.withColumn("_n", n).where("_n = 1").drop("_n")


def scan_spring(sources: DataFrame) -> DataFrame:
    """(repo, file, prefixes, paths, methods, handler, returns, parameters, pos): mapping annotations of controllers; declarative clients are left out."""
    mapping = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b(?:\s*\()?")
    strings = re.compile(r'"([^"]*)"')
    names = ["repo", "file", "prefixes", "paths", "methods", "handler", "returns", "parameters", "pos"]

    def one(repo: str, file: str, text: str) -> Iterator[tuple]:
        klass = re.search(r"\bclass\s+(\w+)", text)
        if not klass or not re.search(r"@(Rest)?Controller\b", text) or re.search(r"@FeignClient|@HttpExchange", text):
            return
        prefixes: list[str] = []
        for pos, m in enumerate(mapping.finditer(text)):
            inner, end = arguments_at(text, m.end()) if m[0].endswith("(") else ([], m.end())
            paths = [s for a in inner if not re.match(r"(method|produces|consumes|params|headers|name)\s*=", a) for s in strings.findall(a)]
            if m.start() < klass.start():
                prefixes = paths
                continue
            verbs = [m[1].upper()] if m[1] != "Request" else [v for a in inner if a.startswith("method") for v in re.findall(r"RequestMethod\.(\w+)", a)]
            sig = re.compile(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+)?([\w.<>\[\],? ]+?)\s+(\w+)\s*\(").match(text, end)
            if sig:
                yield repo, file, prefixes, paths, verbs, f"{klass[1]}#{sig[2]}", sig[1].strip(), arguments_at(text, sig.end())[0], pos

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for x in batch.itertuples() if x.text for r in one(x.repo, x.file, x.text)], columns=names)

    return sources.select("repo", "file", "text").mapInPandas(run, "repo string, file string, prefixes array<string>, paths array<string>, methods array<string>, handler string, returns string, parameters array<string>, pos long")


# Java types by how they are written as JSON, in natural order.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short")
SCALARS = (
    "String", "CharSequence", "Character", "Boolean", "Byte", "Short", "Integer", "Long", "Float", "Double", "BigDecimal", "BigInteger", "Number", "UUID",
    "Date", "LocalDate", "LocalDateTime", "LocalTime", "OffsetDateTime", "OffsetTime", "ZonedDateTime", "Instant", "Duration", "Period",
    "YearMonth", "Year", "MonthDay", "URI", "URL", "Currency", "Locale", "ZoneId",
)
LISTS = ("List", "ArrayList", "LinkedList", "Set", "HashSet", "LinkedHashSet", "TreeSet", "SortedSet", "Collection", "Iterable", "Stream", "Queue", "Deque", "Flux")
MAPS = ("Map", "HashMap", "LinkedHashMap", "TreeMap", "SortedMap", "ConcurrentHashMap", "MultiValueMap")
#: Seen through in responses, and in any type.
WRAPPERS = ("ResponseEntity", "HttpEntity", "CompletableFuture", "CompletionStage", "Future", "ListenableFuture", "Callable", "DeferredResult", "WebAsyncTask", "Mono")
TRANSPARENT = ("Optional", "AtomicReference", "JsonNullable")
#: Handler parameters that the framework puts in.
FRAMEWORK = (
    "HttpServletRequest", "HttpServletResponse", "ServletRequest", "ServletResponse", "HttpSession", "Principal", "Authentication", "Model", "ModelMap",
    "BindingResult", "Errors", "Locale", "TimeZone", "ZoneId", "WebRequest", "NativeWebRequest", "ServerWebExchange", "ServerHttpRequest", "ServerHttpResponse",
    "UriComponentsBuilder", "RedirectAttributes", "SessionStatus", "HttpMethod", "HttpHeaders", "InputStream", "OutputStream", "Reader", "Writer",
)
#: Annotations that leave open how a parameter is bound.
PASSIVE = (
    "Valid", "Validated", "NotNull", "NotBlank", "NotEmpty", "Nullable", "NonNull", "Min", "Max", "Size", "Pattern", "Positive", "PositiveOrZero", "Negative",
    "Email", "Parameter", "Schema", "ApiParam", "ModelAttribute", "ParameterObject", "Final",
)


def bind_parameters(mappings: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """(repo, handler, name, source, required, java_type, pos): bound parameters.

    Without a binding annotation, simple types, enums and lists are optional query parameters, Pageable gives page, size
    and sort, and an object gives one for each of its fields, as ``objects`` (repo, java_type, name, type; name null for
    an enum) tells. Framework types, whole maps, other annotations and types that nobody knows are left out.
    """
    each = mappings.select("repo", "handler", F.posexplode("parameters").alias("pos", "p"))
    mark = F.regexp_extract("p", r"@(PathVariable|RequestParam|RequestHeader|RequestBody)\b", 1)
    marks = F.regexp_extract_all("p", F.lit(r"@(?:\w+\.)*(\w+)"), F.lit(1))
    bare = F.trim(F.regexp_replace("p", r"@[\w.]+(\([^)]*\))?|\bfinal\b", ""))
    own, kind = F.regexp_extract(bare, r"(\w+)$", 1), F.trim(F.regexp_replace(bare, r"\w+$", ""))
    named = F.regexp_extract("p", r'@\w+\([^)]*?(?:(?:value|name)\s*=\s*)?"([^"]+)"', 1)
    source = F.when(mark == "PathVariable", "path").when(mark == "RequestParam", "query").when(mark == "RequestHeader", "header").when(mark == "RequestBody", "body")
    optional = F.col("p").rlike(r"required\s*=\s*false|defaultValue") | F.startswith(kind, F.lit("Optional<"))
    odd = F.size(F.array_except(marks, F.array(*map(F.lit, PASSIVE)))) > 0
    rows = each.select("repo", "handler", "pos", F.when(named != "", named).otherwise(own).alias("name"), source.alias("source"), optional.alias("optional"), kind.alias("java_type"), (named != "").alias("named"), odd.alias("odd"))
    raw = F.regexp_extract("java_type", r"^(?:\w+\.)*(\w+)", 1)
    bound = rows.where(F.col("source").isNotNull() & ((F.col("source") == "body") | F.col("named") | ~raw.isin(*MAPS)))
    free = rows.where(F.col("source").isNull() & ~F.col("odd") & ~raw.isin(*FRAMEWORK))
    simple = raw.isin(*PRIMITIVES, *SCALARS, *LISTS) | F.endswith("java_type", F.lit("[]"))
    paged = F.when(raw == "Pageable", F.array(*map(F.lit, ("page", "size", "sort")))).when(raw == "Sort", F.array(F.lit("sort"))).when(simple, F.array("name"))
    out = ["repo", "handler", "name", "source", "required", "java_type", "pos"]
    query, no = F.lit("query").alias("source"), F.lit(False).alias("required")
    found = bound.withColumn("required", ~F.col("optional")).select(*out).union(free.where(paged.isNotNull()).select("repo", "handler", F.explode(paged).alias("name"), query, no, "java_type", "pos"))
    if objects is None:
        return found
    fields = objects.select("repo", "java_type", F.col("name").alias("_field"), F.col("type").alias("_type"))
    met = free.where(paged.isNull()).join(fields, ["repo", "java_type"])
    return found.union(met.select("repo", "handler", F.coalesce("_field", "name").alias("name"), query, no, F.coalesce("_type", "java_type").alias("java_type"), "pos"))


def type_json(text: str, ids: dict[str, str], enums: set[str], parameters: tuple[str, ...] = ()) -> str | None:
    """A Java type's text as a type's JSON; response wrappers are seen through, ``void`` is None, a raw or wildcard wrapper unknown."""
    text = re.sub(r"^\?\s*(extends|super)\s+", "", text.strip())
    if text in ("void", "Void"):
        return None
    unknown = lambda n: f'{{"kind":"unknown","name":"{n}"}}'
    if text == "?":
        return unknown("?")
    if text == "byte[]":
        return '{"kind":"scalar","name":"byte[]"}'
    if text.endswith("[]"):
        return f'{{"kind":"array","element":{type_json(text[:-2], ids, enums, parameters)}}}'
    m = re.match(r"^([\w.]+)\s*(?:<(.*)>)?$", text, re.S)
    if not m:
        return unknown(text)
    base, inner = m[1].split(".")[-1], m[2]
    args, depth, start = [], 0, 0
    for i, c in enumerate((inner or "") + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth and inner is not None:
            args.append(inner[start:i])
            start = i + 1
    if base in parameters:
        return f'{{"kind":"typeParameter","name":"{base}"}}'
    if base in WRAPPERS or base in TRANSPARENT:
        return type_json(args[0], ids, enums, parameters) if args and args[0].strip() != "?" else unknown(base)
    if base in LISTS:
        return f'{{"kind":"array","element":{type_json(args[0], ids, enums, parameters) if args else unknown("?")}}}'
    if base in MAPS:
        return f'{{"kind":"map","value":{type_json(args[1], ids, enums, parameters) if len(args) > 1 else unknown("?")}}}'
    if base in SCALARS or base in PRIMITIVES:
        return f'{{"kind":"scalar","name":"{base}"}}'
    if base in enums:
        return f'{{"kind":"enum","enumId":"{ids.get(base, base)}"}}'
    if base in ids:
        return f'{{"kind":"dto","dtoId":"{ids[base]}","typeArguments":[{",".join(type_json(a, ids, enums, parameters) or unknown("void") for a in args)}]}}'
    return unknown(base)


def parse_types(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, java_type, type_json) of distinct (repo, java_type); ``known`` has (repo, name, id, is_enum). Each type is sent only the names in it."""
    each = texts.select("repo", "java_type").distinct()
    words = each.select("repo", "java_type", F.explode(F.array_distinct(F.regexp_extract_all("java_type", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    named = words.join(known, ["repo", "name"]).groupBy("repo", "java_type").agg(F.collect_list(F.struct("name", "id", "is_enum")).alias("names"))

    @F.pandas_udf("string")
    def parse(text: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for t, ns in zip(text, names):
            ns = [] if ns is None else list(ns)
            out.append(type_json(t, {n["name"]: n["id"] for n in ns}, {n["name"] for n in ns if n["is_enum"]}))
        return pd.Series(out)

    return each.join(named, ["repo", "java_type"], "left").select("repo", "java_type", parse("java_type", "names").alias("type_json"))


def enum_wire_values(constants: DataFrame) -> DataFrame:
    """(repo, enum_id, pos, value): the JSON name where one is given, else the constant's name."""
    return constants.select("repo", "enum_id", "pos", F.coalesce("json_name", "name").alias("value"))


def resolve_constants(constants: DataFrame, steps: int = 16) -> DataFrame:
    """(repo, name, value): string constants ``A + "/x"`` with references put in; ``<expr>`` where that doesn't end.

    ``constants``: repo, name, parts: array<struct<literal, ref>>. Each round puts in the constants that are known.
    """
    value = F.array_join(F.transform("parts", lambda p: p["literal"]), "")
    open_ = lambda c: F.exists(c, lambda p: p["ref"].isNotNull())
    done = constants.where(~open_("parts")).select("repo", "name", value.alias("value"))
    todo = constants.where(open_("parts")).select("repo", "name", "parts")
    for _ in range(steps):
        each = todo.select("repo", "name", F.posexplode("parts").alias("i", "p")).select("repo", "name", "i", "p.*")
        met = each.join(done.select("repo", F.col("name").alias("ref"), F.col("value").alias("_v")), ["repo", "ref"], "left")
        put = met.withColumn("p", F.struct(F.coalesce("literal", "_v").alias("literal"), F.when(F.col("_v").isNull(), F.col("ref")).alias("ref")))
        grown = stored(put.groupBy("repo", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("parts")))
        ready = grown.where(~open_("parts"))
        if ready.isEmpty():
            break
        done = stored(done.unionByName(ready.select("repo", "name", value.alias("value"))))
        todo = grown.where(open_("parts"))
    return done.unionByName(todo.select("repo", "name", F.lit("<expr>").alias("value")))


def run_extractor(sources: DataFrame, extract: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """Call a user's extractor (file, text) -> rows on every source; ``schema`` names the rows' columns without the repo."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"repo": x.repo, **r} for x in batch.itertuples() if x.text for r in extract(x.file, x.text)]
            yield pd.DataFrame(rows, columns=["repo", *[c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]])

    return sources.select("repo", "file", "text").mapInPandas(run, f"repo string, {schema}")


def distinct_callees(calls: DataFrame) -> DataFrame:
    """(repo, function_id, callees) per calling function."""
    return calls.groupBy("repo", F.col("caller_function_id").alias("function_id")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
