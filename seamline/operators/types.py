"""Types of contracts: expansion into edges, walks of access paths, paths to a DTO.

A type is a JSON text; with its generic arguments put in, the text itself is the type's key. Everything runs on distinct
types, by joins with the field table; recursive types end by the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.paths import STRING_LIKE
from seamline.plans.lineage import Pile, stored

DEPTH = 16
# How one level of a type's JSON is written for people; names are the last parts of ids.
DESCRIPTION = (
    (r'\{"kind":"(?:scalar|unknown|typeParameter)","name":"([^"]*)"\}', "$1"),
    (r'\{"kind":"enum","enumId":"(?:[^"]*\.)?([^".]*)"\}', "$1"),
    (r'\{"kind":"dto","dtoId":"(?:[^"]*\.)?([^".]*)","typeArguments":\[\]\}', "$1"),
    (r'\{"kind":"dto","dtoId":"(?:[^"]*\.)?([^".]*)","typeArguments":\[([^{}"]*)\]\}', "$1<$2>"),
    (r'\{"kind":"array","element":([^{}"]*)\}', "$1[]"),
    (r'\{"kind":"map","value":([^{}"]*)\}', "Map<string, $1>"),
)


def describe(t: Column) -> Column:
    """``Page<User[]>`` for a type's JSON, however deep: each round writes the innermost levels, and a text has as many
    levels as braces at most. For distinct types rather than for every row."""

    def written(acc: Column) -> Column:
        for pattern, text in DESCRIPTION:
            acc = F.regexp_replace(acc, pattern, text)
        return acc

    braces = F.length(t) - F.length(F.replace(t, F.lit("{")))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(braces, F.lit(1))))
    return F.regexp_replace(F.aggregate(levels, t, lambda acc, _: F.when(F.contains(acc, F.lit("{")), written(acc)).otherwise(acc)), ",([^ ])", ", $1")


def kind(t: Column) -> Column:
    return F.get_json_object(t, "$.kind")


def name(t: Column) -> Column:
    return F.coalesce(F.get_json_object(t, "$.dtoId"), F.get_json_object(t, "$.enumId"), F.get_json_object(t, "$.name"))


def children(types: DataFrame, dtos: DataFrame, fields: DataFrame) -> DataFrame:
    """(repo, type, segment, next, nullable, pos): one level below each distinct (repo, type)."""
    t = types.select("repo", "type").distinct()
    down = lambda k, key, mark: t.where(kind(F.col("type")) == k).select("repo", "type", F.lit(mark).alias("segment"), F.get_json_object("type", key).alias("next"), F.lit(False).alias("nullable"), F.lit(0).alias("pos"))
    own = t.where(kind(F.col("type")) == "dto").select("repo", "type", name(F.col("type")).alias("dto_id"), F.from_json(F.get_json_object("type", "$.typeArguments"), "array<string>").alias("args"))
    full = own.join(dtos.select("repo", F.col("id").alias("dto_id"), "type_parameters"), ["repo", "dto_id"]).join(fields, ["repo", "dto_id"])
    marker = lambda i: F.concat(F.lit('{"kind":"typeParameter","name":"'), F.get("type_parameters", i), F.lit('"}'))
    put = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("args") - 1)),
        F.col("type_json"),
        lambda acc, i: F.coalesce(F.replace(acc, marker(i), F.get("args", i)), acc),
    )
    return down("array", "$.element", "[]").union(down("map", "$.value", "*")).union(full.select("repo", "type", F.col("name").alias("segment"), put.alias("next"), "nullable", "pos"))


def type_edges(roots: DataFrame, dtos: DataFrame, fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The edges of all types that can be reached from (repo, type) within ``depth`` steps."""
    # few rows against what they come from, and read in every round
    seen, found = Pile(roots.sparkSession), Pile(roots.sparkSession)
    fresh = seen.add(roots.select("repo", "type").where("type IS NOT NULL").distinct())
    for _ in range(depth):
        level = found.add(children(fresh, dtos, fields))
        fresh = seen.add(level.select("repo", F.col("next").alias("type")).distinct().join(seen.rows(), ["repo", "type"], "left_anti"))
        if fresh.isEmpty():
            break
    return found.rows()


def walk_paths(asked: DataFrame, edges: DataFrame, dtos: DataFrame) -> DataFrame:
    """(repo, type, path, status, step, reason, parent): each distinct access path through its type: ok, missing or unverifiable.

    One join with the edges for each step of the longest path.
    """
    todo = stored(asked.select("repo", "type", "path").distinct())
    steps = todo.agg(F.max(F.size("path"))).first()[0] or 0
    known = dtos.select("repo", F.col("id").alias("_id"), F.lit(True).alias("_known"))
    edge = edges.select("repo", F.col("type").alias("cur"), F.col("segment").alias("_key"), "next").distinct()
    nothing = F.lit(None).cast("string")
    state = todo.select("*", F.col("type").alias("cur"), nothing.alias("status"), F.lit(None).cast("int").alias("step"), nothing.alias("reason"), nothing.alias("parent"))
    for i in range(steps):
        on = F.col("status").isNull() & (F.size("path") > i)
        seg, k, n = F.get("path", F.lit(i)), kind(F.col("cur")), name(F.col("cur"))
        keyed = state.withColumn("_key", F.when(on, F.when(k == "map", F.when(seg != "[]", "*")).otherwise(seg))).withColumn("_id", F.when(on & (k == "dto"), n))
        met = keyed.join(edge, ["repo", "cur", "_key"], "left").join(known, ["repo", "_id"], "left")
        unknown = k.isin("unknown", "typeParameter") | ((k == "dto") & F.col("_known").isNull())
        fine = ((k == "array") & (seg == "length")) | ((seg == "length") & ((k == "enum") | ((k == "scalar") & n.isin(*STRING_LIKE))))
        reason = F.when(seg == "[]", "not-an-array").when(k == "dto", "no-such-field").otherwise("not-an-object")
        now = F.when(~on, F.col("status")).when(unknown, "unverifiable").when(fine, "ok").when(F.col("next").isNull(), "missing")
        stop = on & now.isNotNull()
        state = met.select(
            "repo", "type", "path",
            F.when(on & now.isNull(), F.col("next")).otherwise(F.col("cur")).alias("cur"),
            now.alias("status"),
            F.when(stop & (now != "ok"), i).otherwise(F.col("step")).alias("step"),
            F.when(stop & (now == "missing"), reason).otherwise(F.col("reason")).alias("reason"),
            F.when(stop & (now != "ok"), F.col("cur")).otherwise(F.col("parent")).alias("parent"),
        )
    return state.select("repo", "type", "path", F.coalesce("status", F.lit("ok")).alias("status"), "step", "reason", "parent")


def expand(roots: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(repo, root, path, type): every path within each distinct (repo, type); a DTO below itself isn't entered again."""
    rows = roots.select("repo", F.col("type").alias("root"), F.array().cast("array<string>").alias("path"), "type").where("type IS NOT NULL").distinct().withColumn("seen", F.array().cast("array<string>"))
    found, step = Pile(roots.sparkSession), edges.select("repo", "type", "segment", "next")
    rows = found.add(rows)
    for _ in range(depth):
        own = F.when(kind(F.col("type")) == "dto", name(F.col("type")))
        open_ = rows.where(own.isNull() | ~F.array_contains("seen", F.coalesce(own, F.lit(""))))
        rows = found.add(open_.join(step, ["repo", "type"]).select("repo", "root", F.concat("path", F.array("segment")).alias("path"), F.col("next").alias("type"), F.when(own.isNotNull(), F.concat("seen", F.array(own))).otherwise(F.col("seen")).alias("seen")))
        if rows.isEmpty():
            break
    return found.rows().select("repo", "root", "path", "type")


def paths_to_dtos(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, root, path, dto_id): where each DTO occurs in a type, through generics and arrays but not maps."""
    found = expand(roots, edges.where("segment <> '*'"))
    return found.where(kind(F.col("type")) == "dto").select("repo", "root", "path", name(F.col("type")).alias("dto_id"))


def field_usage(endpoints: DataFrame, edges: DataFrame, fields: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, dto_id, field, endpoint_id, response_path, reads, files, components): who reads which DTO field, at every place where it is sent.

    ``reads`` are field reads with their endpoint. Endpoints whose response holds the DTO have a row without reads too.
    """
    own = fields.select("repo", "dto_id", F.col("name").alias("field"), F.array("name").alias("tail"))
    return _counted(places_with_reads(endpoints, edges, own, reads))


def match_fields(query: str, dtos: DataFrame, fields: DataFrame) -> DataFrame:
    """(repo, dto_id, field, tail): DTO fields that ``Type.field.path`` names; ``tail`` is the path.

    The longest type name counts for which a repository has a DTO, by its id, the end of its id or its simple name, that
    owns the first field. A query without a dot names nothing.
    """
    parts = query.split(".")
    splits = [(i, ".".join(parts[: len(parts) - 1 - i]), parts[len(parts) - 1 - i :]) for i in range(len(parts) - 1)]
    if not splits:
        return dtos.limit(0).select("repo", F.col("id").alias("dto_id"), F.col("name").alias("field"), F.array("name").alias("tail"))
    cases = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(t).alias("type_name"), F.array(*map(F.lit, path)).alias("tail")) for i, t, path in splits])
    each = dtos.select("repo", F.col("id").alias("dto_id"), F.col("name").alias("simple"), F.inline(cases))
    named = each.where((F.col("dto_id") == F.col("type_name")) | (F.col("simple") == F.col("type_name")) | F.endswith("dto_id", F.concat(F.lit("."), "type_name")))
    owned = named.withColumn("head", F.get("tail", F.lit(0))).join(fields.select("repo", "dto_id", F.col("name").alias("head")), ["repo", "dto_id", "head"], "left_semi")
    least = owned.groupBy("repo").agg(F.min("turn").alias("turn"))
    return owned.join(least, ["repo", "turn"]).select("repo", "dto_id", F.array_join("tail", ".").alias("field"), "tail")


def impact_of_field(query: str, endpoints: DataFrame, edges: DataFrame, dtos: DataFrame, fields: DataFrame, reads: DataFrame) -> DataFrame:
    """field_usage() of the fields that ``Type.field.path`` names: every place where they are sent, with reads at it or below."""
    return _counted(places_with_reads(endpoints, edges, match_fields(query, dtos, fields), reads))


def type_hits(text: str, endpoints: DataFrame, edges: DataFrame, dtos: DataFrame, fields: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, kind, label, detail, apis, files): DTOs whose id, and fields whose name, holds ``text``, in any case.

    ``apis`` of a field counts the places where it is sent.
    """
    has = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    names = dtos.select("repo", F.col("id").alias("dto_id"), F.col("name").alias("simple"))
    by_dto = names.where(has("dto_id")).join(dto_usage(endpoints, edges, reads), ["repo", "dto_id"], "left").select("repo", F.lit("dto").alias("kind"), F.col("simple").alias("label"), F.col("dto_id").alias("detail"), zero("endpoints").alias("apis"), zero("files"))
    wanted = fields.where(has("name")).select("repo", "dto_id", F.col("name").alias("field"), F.array("name").alias("tail"))
    met = places_with_reads(endpoints, edges, wanted, reads)
    counts = met.groupBy("repo", "dto_id", "field").agg(F.count_distinct("endpoint_id", "target").alias("apis"), F.count_distinct("file").alias("files"))
    found = wanted.select("repo", "dto_id", "field").join(names, ["repo", "dto_id"]).join(counts, ["repo", "dto_id", "field"], "left")
    return by_dto.unionByName(found.select("repo", F.lit("field").alias("kind"), F.concat_ws(".", "simple", "field").alias("label"), F.col("dto_id").alias("detail"), zero("apis"), zero("files")))


def places_with_reads(endpoints: DataFrame, edges: DataFrame, wanted: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, dto_id, field, endpoint_id, target, id, file, ...): each place where a wanted field (repo, dto_id, field, tail) is sent, with the reads at it or below, or one row without."""
    from seamline.functions.paths import path_starts_with

    roots = endpoints.select("repo", F.col("response_type_json").alias("type"))
    places = paths_to_dtos(roots, edges).withColumnRenamed("root", "response_type_json")
    named = places.join(wanted.select("repo", "dto_id", "field", "tail"), ["repo", "dto_id"]).withColumn("target", F.concat("path", "tail")).drop("path", "tail")
    sent = endpoints.select("repo", F.col("id").alias("endpoint_id"), "response_type_json").join(named, ["repo", "response_type_json"])
    seen = reads.select("repo", "endpoint_id", "id", "path", "file", "containing_component").where("endpoint_id IS NOT NULL")
    # a read is met by its own prefixes, so that an endpoint with many reads and many fields isn't multiplied out
    prefixes = seen.withColumn("target", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))))
    return sent.join(prefixes, ["repo", "endpoint_id", "target"], "left").where(F.col("path").isNull() | path_starts_with(F.col("path"), F.col("target")))


def _counted(met: DataFrame) -> DataFrame:
    from seamline.functions.paths import format_access_path

    return met.groupBy("repo", "dto_id", "field", "endpoint_id", format_access_path(F.col("target")).alias("response_path")).agg(
        F.count("id").alias("reads"), F.count_distinct("file").alias("files"), F.count_distinct("containing_component").alias("components")
    )


def dto_usage(endpoints: DataFrame, edges: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, dto_id, endpoints, files): endpoints whose request or response holds a DTO, and files that read below it."""
    types = lambda c: endpoints.select("repo", F.col("id").alias("endpoint_id"), F.col(c).alias("root")).where("root IS NOT NULL")
    roots = types("response_type_json").union(types("body_type_json")).select("repo", F.col("root").alias("type")).distinct()
    places = stored(paths_to_dtos(roots, edges))
    sent = types("response_type_json").join(places, ["repo", "root"])
    every = sent.select("repo", "endpoint_id", "dto_id").union(types("body_type_json").join(places, ["repo", "root"]).select("repo", "endpoint_id", "dto_id")).distinct()
    counts = every.groupBy("repo", "dto_id").agg(F.count("*").alias("endpoints"))
    seen = reads.where("endpoint_id IS NOT NULL").select("repo", "endpoint_id", "path", "file").distinct()
    above = seen.select("repo", "endpoint_id", "file", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    files = sent.join(above, ["repo", "endpoint_id", "path"]).groupBy("repo", "dto_id").agg(F.count_distinct("file").alias("files"))
    return counts.join(files, ["repo", "dto_id"], "left").withColumn("files", F.coalesce("files", F.lit(0)))
