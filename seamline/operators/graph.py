"""The impact graph, reach counts and import dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.paths import format_access_path
from seamline.operators.usage import field_reads, unused_endpoints
from seamline.plans.closure import closure
from seamline.plans.lineage import stored


def dependents(imports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(repo, file, dependent): all files that import a file directly or through others, however far; itself left out."""
    edges = imports.select("repo", F.col("resolved_file").alias("src"), F.col("file").alias("dst"))
    wanted = None if files is None else files.select("repo", F.col("path").alias("node"))
    found = closure(edges, wanted)
    return found.select("repo", F.col("start").alias("file"), F.col("node").alias("dependent"))


def _function_nodes(functions: DataFrame) -> DataFrame:
    component = F.col("containing_component") == F.col("name")
    label = F.when((F.col("name") == "<anonymous>") & F.col("containing_component").isNotNull(), F.concat("containing_component", F.lit(" (callback)"))).otherwise(F.col("name"))
    return functions.select("repo", "id", F.when(component, "component").otherwise("function").alias("kind"), label.alias("label"), F.concat_ws(":", "file", "line").alias("detail"), F.lit(None).cast("string").alias("status"), "file", "line")


def build_graph(linked: DataFrame, reads: DataFrame, functions: DataFrame, endpoints: DataFrame, unused: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): API -> client function -> caller -> file and API -> field -> reader -> file.

    Nodes: repo, id, kind, label, detail, status, file, line. Edges: repo, src, dst, kind; one per pair, the later kind
    of (calls, has-field, reads, defined-in) wins. A caller that isn't known falls back to its file. The ends of calls and
    of reads are stored when this is called, as nodes and edges read them several times; edges make them distinct.
    """
    known = functions.select("repo", F.col("id").alias("fid"), F.col("file").alias("ffile"))
    calls = linked.select("repo", "id", "api_key", "status", "endpoint_id", "caller_function_id", "wrapper_function_id", "file")
    caller = known.select("repo", F.col("fid").alias("caller_function_id"), F.lit(True).alias("has_caller"))
    client = known.select("repo", F.col("fid").alias("wrapper_function_id"), F.lit(True).alias("has_client"))
    named = calls.join(caller, ["repo", "caller_function_id"], "left").join(client, ["repo", "wrapper_function_id"], "left")
    api = F.concat(F.lit("api:"), F.col("api_key"))
    target = F.when(F.col("has_caller"), F.col("caller_function_id")).otherwise(F.concat(F.lit("file:"), F.col("file")))
    sites = named.select("repo", api.alias("api"), target.alias("target"), F.when(F.col("has_client"), F.col("wrapper_function_id")).alias("client"), "file", "has_caller")
    sites = stored(sites)
    # readers before calls: reads are narrower without their call's key
    reader = known.select("repo", F.col("fid").alias("containing_function_id"), F.lit(True).alias("has_reader"))
    seen = reads.select("repo", "api_call_id", "path", "containing_function_id", "file").join(reader, ["repo", "containing_function_id"], "left")
    seen = field_reads(seen, linked.select("repo", "id", "api_key", "status", "endpoint_id", "file")).withColumn("path", format_access_path(F.col("path")))
    field = F.concat(F.lit("field:"), F.col("api_key"), F.lit("#"), F.col("path"))
    user = F.when(F.col("has_reader"), F.col("containing_function_id")).otherwise(F.concat(F.lit("file:"), F.col("file")))
    fields = seen.select("repo", api.alias("api"), field.alias("field"), user.alias("user"), "path", "api_key", "file", "has_reader")
    fields = stored(fields)
    used = (
        sites.where("has_caller").select("repo", F.col("target").alias("fid")).union(sites.where("client IS NOT NULL").select("repo", "client")).union(fields.where("has_reader").select("repo", "user")).distinct()
    )
    homes = known.join(used, ["repo", "fid"], "left_semi")
    edges = (
        sites.select("repo", F.col("api").alias("src"), F.coalesce("client", "target").alias("dst"), F.lit(0).alias("turn"))
        .union(sites.where("client IS NOT NULL").select("repo", "client", "target", F.lit(0)))
        .union(fields.select("repo", "api", "field", F.lit(1)))
        .union(fields.select("repo", "field", "user", F.lit(2)))
        .union(homes.select("repo", "fid", F.concat(F.lit("file:"), F.col("ffile")), F.lit(3)))
        .where("src <> dst")
    )
    kinds = F.array(*map(F.lit, ("calls", "has-field", "reads", "defined-in")))
    edges = edges.groupBy("repo", "src", "dst").agg(F.max("turn").alias("turn")).select("repo", "src", "dst", F.get(kinds, F.col("turn")).alias("kind"))
    where = endpoints.select("repo", F.col("id").alias("api_key"), "handler", F.col("file").alias("e_file"), F.col("line").alias("e_line"))
    apis = calls.groupBy("repo", "api_key").agg(F.min_by("status", "id").alias("status")).join(where, ["repo", "api_key"], "left")
    nodes = apis.select("repo", F.concat(F.lit("api:"), F.col("api_key")).alias("id"), F.lit("endpoint").alias("kind"), F.col("api_key").alias("label"), F.col("handler").alias("detail"), "status", F.col("e_file").alias("file"), F.col("e_line").alias("line"))
    nothing = F.lit(None).cast("string")
    nodes = nodes.union(fields.select("repo", "field", F.lit("field"), "path", "api_key", nothing, nothing, F.lit(None).cast("int")).distinct())
    nodes = nodes.union(_function_nodes(functions.join(used.withColumnRenamed("fid", "id"), ["repo", "id"], "left_semi")))
    paths = homes.select("repo", F.col("ffile").alias("path")).union(sites.where("has_caller IS NULL").select("repo", "file")).union(fields.where("has_reader IS NULL").select("repo", "file")).distinct()
    nodes = nodes.union(paths.select("repo", F.concat(F.lit("file:"), F.col("path")), F.lit("file"), "path", nothing, nothing, "path", F.lit(None).cast("int")))
    if unused:
        free = endpoints.join(unused_endpoints(linked, endpoints).select("repo", "id"), ["repo", "id"], "left_semi")
        nodes = nodes.union(free.select("repo", F.concat(F.lit("api:"), F.col("id")), F.lit("endpoint"), "id", "handler", F.lit("unused"), "file", "line"))
    return nodes, edges


def merge_graphs(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of graphs: nodes by id and edges by their ends; the later graph's row wins."""
    out = []
    for i, key in ((0, ["repo", "id"]), (1, ["repo", "src", "dst"])):
        rows = None
        for turn, graph in enumerate(graphs):
            part = graph[i].withColumn("_turn", F.lit(turn))
            rows = part if rows is None else rows.unionByName(part)
        last = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_turn")))
        out.append(rows.withColumn("_n", last).where("_n = 1").drop("_n", "_turn"))
    return tuple(out)


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, kind, impact): files downstream of endpoints and fields; endpoints upstream of everything else.

    Layer by layer, as distinct pairs of ends: a field's functions and files belong to its endpoint, a function's files
    to those that call it. Only edges between functions can form chains or cycles, so only these are closed by a loop.
    Nodes are numbered and the ends of edges looked up once; from then on pairs of numbers are shuffled, not of ids.
    """
    kinds = nodes.select("repo", "id", "kind").distinct()
    layer = F.when(F.col("kind") == "endpoint", "api").when(F.col("kind") == "field", "field").when(F.col("kind") == "file", "file").otherwise("fn")
    kinds = stored(kinds.withColumns({"n": F.monotonically_increasing_id(), "layer": layer}))  # numbers stay as stored
    side = lambda c: kinds.select("repo", F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("layer").alias(f"{c}_layer"))
    ends = edges.select("repo", "src", "dst").join(side("src"), ["repo", "src"]).drop("src").join(side("dst"), ["repo", "dst"])
    known = stored(ends.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "src_layer", "dst_layer"))
    between = lambda a, b: known.where((F.col("src_layer") == a) & (F.col("dst_layer") == b)).select("src", "dst")

    chains = closure(between("fn", "fn").withColumn("repo", F.lit(0))).select(F.col("start").alias("fn"), F.col("node").alias("dst"))
    functions = kinds.where("layer = 'fn'").select(F.col("n").alias("fn"))
    further = chains.union(functions.select("fn", "fn"))
    homes = between("fn", "file").select(F.col("src").alias("dst"), F.col("dst").alias("file"))
    files_of = stored(further.join(homes, "dst").select("fn", "file").distinct())

    # fields pass on to their endpoint what they lead to
    owners = between("api", "field").select(F.col("dst").alias("src"), F.col("src").alias("api"))
    own = lambda rows, is_api: rows.select("src", "dst", F.lit(is_api).alias("is_api"))
    passed = lambda b: own(between("field", b).join(owners, "src").select(F.col("api").alias("src"), "dst"), True)
    leads = lambda b: own(between("api", b), True).unionByName(own(between("field", b), False)).unionByName(passed(b))
    to_fn = stored(leads("fn").distinct().withColumnRenamed("dst", "fn"))
    through = to_fn.join(files_of, "fn").select("src", F.col("file").alias("dst"), "is_api")
    reached = stored(leads("file").unionByName(through).distinct())
    down = reached.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("impact"))

    up_file = reached.where("is_api").groupBy(F.col("dst").alias("n")).agg(F.count("*").alias("impact"))
    up_fn = to_fn.where("is_api").join(further, "fn").select("src", "dst").distinct().groupBy(F.col("dst").alias("n")).agg(F.count("*").alias("impact"))
    counts = down.unionByName(up_file).unionByName(up_fn)
    return kinds.join(counts, "n", "left").select("repo", "id", "kind", F.coalesce("impact", F.lit(0)).alias("impact"))
