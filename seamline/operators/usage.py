"""Who uses which API: usage, rankings, file impact and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.paths import format_access_path, normalize_path
from seamline.plans.lineage import stored
from seamline.plans.ranks import numbered


def call_sites(linked: DataFrame, functions: DataFrame) -> DataFrame:
    """Linked calls with function_name and component of their caller and the name of their client function (``via``)."""
    caller = functions.select("repo", F.col("id").alias("caller_function_id"), F.col("name").alias("function_name"), F.col("containing_component").alias("component"))
    client = functions.select("repo", F.col("id").alias("wrapper_function_id"), F.col("name").alias("via"))
    return linked.join(caller, ["repo", "caller_function_id"], "left").join(client, ["repo", "wrapper_function_id"], "left")


def field_reads(reads: DataFrame, linked: DataFrame) -> DataFrame:
    """Reads of indexed calls with the call's api_key, status, endpoint and file; reads without a path don't count."""
    calls = linked.select("repo", F.col("id").alias("api_call_id"), "api_key", "status", "endpoint_id", F.col("file").alias("call_file"))
    return reads.where(F.size("path") > 0).join(calls, ["repo", "api_call_id"])


def api_keys(linked: DataFrame, endpoints: DataFrame) -> DataFrame:
    return linked.select("repo", "api_key").union(endpoints.select("repo", "id")).distinct()


def api_usage(linked: DataFrame, reads: DataFrame, functions: DataFrame, endpoints: DataFrame | None) -> DataFrame:
    """(repo, api_key, status, handler, call_sites, field_reads, files, components) of every API, unused endpoints too.

    Files and components are made distinct per API before they are counted, so a popular API is no hot spot. The status
    is that of the first call by id.
    """
    sites, seen = call_sites(linked, functions), field_reads(reads, linked)
    calls = sites.groupBy("repo", "api_key").agg(F.count("*").alias("call_sites"), F.min_by("status", "id").alias("status"))
    counted = seen.groupBy("repo", "api_key").agg(F.count("*").alias("field_reads"))
    where = sites.select("repo", "api_key", "file", "component").union(seen.select("repo", "api_key", "file", "containing_component"))
    files = where.select("repo", "api_key", "file").distinct().groupBy("repo", "api_key").agg(F.count("*").alias("files"))
    parts = where.where("component IS NOT NULL").select("repo", "api_key", "component").distinct().groupBy("repo", "api_key").agg(F.count("*").alias("components"))
    keys = linked.select("repo", "api_key").distinct() if endpoints is None else api_keys(linked, endpoints)
    found = keys
    for part in (calls, counted, files, parts):
        found = found.join(part, ["repo", "api_key"], "left")
    if endpoints is None:
        found = found.withColumn("handler", F.lit(None).cast("string")).withColumn("status", F.lit("no-backend"))
    else:
        found = found.join(endpoints.select("repo", F.col("id").alias("api_key"), "handler"), ["repo", "api_key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("repo", "api_key", F.coalesce("status", F.lit("unused")).alias("status"), "handler", *map(zero, ("call_sites", "field_reads", "files", "components")))


def rank_apis(usage: DataFrame) -> DataFrame:
    """APIs by the files that use them; ``rank`` counts per repo. Stores the rows when called."""
    return numbered(usage, "repo", [F.desc("files"), F.desc("call_sites"), F.col("api_key")], "rank")


def field_counts(reads: DataFrame, linked: DataFrame) -> DataFrame:
    """(repo, api_key, path, reads): reads of each response field."""
    return field_reads(reads, linked).groupBy("repo", "api_key", format_access_path(F.col("path")).alias("path")).agg(F.count("*").alias("reads"))


def unused_endpoints(linked: DataFrame, endpoints: DataFrame) -> DataFrame:
    return endpoints.select("repo", "id", "handler").join(linked.select("repo", F.col("api_key").alias("id")).distinct(), ["repo", "id"], "left_anti")


def file_apis(linked: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, file, api_key, via): the APIs of every file, by calls in it, reads in it, or both."""
    calls = linked.select("repo", "file", "api_key", F.lit("call").alias("kind"))
    seen = field_reads(reads, linked).select("repo", "file", "api_key", F.lit("read"))
    both = calls.union(seen).distinct()
    return both.groupBy("repo", "file", "api_key").agg(F.array_sort(F.collect_set("kind")).alias("via"))


def rank_files(linked: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, file, apis, rank): files by the APIs that they call or read. Stores the rows when called."""
    counts = file_apis(linked, reads).groupBy("repo", "file").agg(F.count("*").alias("apis"))
    return numbered(counts, "repo", [F.desc("apis"), F.col("file")], "rank")


def client_functions(linked: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo, file, name, call_sites, apis): client functions of each file that other files call."""
    own = functions.select("repo", F.col("id").alias("wrapper_function_id"), "name", F.col("file").alias("home"))
    met = linked.join(own, ["repo", "wrapper_function_id"]).where("home <> file")
    return met.groupBy("repo", F.col("home").alias("file"), "name").agg(F.count("*").alias("call_sites"), F.count_distinct("api_key").alias("apis"))


def _affected(linked: DataFrame, reads: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, clients): distinct (repo, home, kind, what, own) that a change of the file ``home`` may affect, and distinct
    (repo, file, name) of client functions that other files call.

    Calls get their caller's component and their client's file, and reads get all of that from their call, each in one join
    that is stored. Pairs within a call or a read need no further join; only calls whose id repeats, and reads of one call
    from several files, meet each other. ``own`` says that the home calls or reads the API itself.
    """
    caller = functions.select("repo", F.col("id").alias("caller_function_id"), F.col("containing_component").alias("component"))
    client = functions.select("repo", F.col("id").alias("wrapper_function_id"), F.col("name").alias("via"), F.col("file").alias("client_home"))
    calls = linked.select("repo", F.col("id").alias("api_call_id"), "api_key", F.col("file").alias("call_file"), "caller_function_id", "wrapper_function_id")
    calls = calls.join(caller, ["repo", "caller_function_id"], "left").drop("caller_function_id").join(client, ["repo", "wrapper_function_id"], "left").drop("wrapper_function_id")
    calls = stored(calls)
    seen = reads.where(F.size("path") > 0).select("repo", "api_call_id", "file", "containing_component")
    seen = stored(seen.join(calls.drop("via"), ["repo", "api_call_id"]).distinct())

    def part(rows: DataFrame, home: str, kind: str, what: str, own: bool = False) -> DataFrame:
        return rows.select("repo", F.col(home).alias("home"), F.lit(kind).alias("kind"), F.col(what).alias("what"), F.lit(own).alias("own"))

    key, of_call = ["repo", "api_call_id"], (("api", "api_key"), ("file", "call_file"), ("component", "component"))
    repeated = calls.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    alike = stored(calls.drop("via").join(repeated, key, "left_semi"))
    homes = alike.select(*key, F.col("call_file").alias("home")).union(alike.select(*key, "client_home")).where("home IS NOT NULL").distinct()
    alike = homes.join(alike.drop("client_home").distinct(), key)
    # reads of one call from several files
    spread = seen.groupBy(*key).agg(F.min("file").alias("_a"), F.max("file").alias("_b")).where("_a <> _b").select(*key)
    several = stored(seen.select(*key, "file", "containing_component").join(spread, key, "left_semi").distinct())
    several = several.select(*key, F.col("file").alias("home")).distinct().join(several, key)
    # a client's or a reader's home that is the call's own adds nothing to what the call gives
    apart = lambda rows, home: rows.where(~F.col(home).eqNullSafe(F.col("call_file")))
    pairs = [
        *[part(calls, "call_file", kind, what, True) for kind, what in of_call],
        *[part(apart(calls, "client_home"), "client_home", kind, what) for kind, what in (*of_call, ("file", "client_home"))],
        *[part(apart(seen, "file"), "file", kind, what, True) for kind, what in of_call],
        *[part(rows, home, kind, what) for rows, home in ((seen, "call_file"), (apart(seen, "client_home"), "client_home"), (apart(seen, "file"), "file")) for kind, what in (("file", "file"), ("component", "containing_component"))],
        *[part(alike, "home", kind, what) for kind, what in of_call],
        part(several, "home", "file", "file"), part(several, "home", "component", "containing_component"),
    ]
    pairs = reduce(DataFrame.union, pairs).where("home IS NOT NULL AND what IS NOT NULL")
    clients = calls.where("client_home <> call_file").select("repo", F.col("client_home").alias("file"), F.col("via").alias("name")).distinct()
    return pairs.groupBy("repo", "home", "kind", "what").agg(F.max("own").alias("own")), clients


def _radius(pairs: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return pairs.groupBy("repo", F.col("home").alias("file")).agg(n("api").alias("apis"), n("file").alias("files"), n("component").alias("components"), F.count_if((F.col("kind") == "api") & F.col("own")).alias("own_apis"))


def blast_radius(linked: DataFrame, reads: DataFrame, functions: DataFrame) -> DataFrame:
    """(repo, file, apis, files, components): what a change of each file may affect.

    Affected are calls in the file, calls through its client functions, and calls whose response it reads; then all
    reads of these calls. Everything is computed for all files at once, as distinct pairs before counts. Calls and reads
    with what they need of each other are stored when this is called.
    """
    return _radius(_affected(linked, reads, functions)[0]).drop("own_apis")


def summary(files: DataFrame, functions: DataFrame, calls: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, files, functions, calls, resolved_calls, reads) of the index."""
    parts = [
        files.groupBy("repo").agg(F.count("*").alias("files")),
        functions.groupBy("repo").agg(F.count("*").alias("functions")),
        calls.groupBy("repo").agg(F.count("*").alias("calls"), F.count_if(F.col("endpoint_pattern").isNotNull()).alias("resolved_calls")),
        reads.groupBy("repo").agg(F.count("*").alias("reads")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.join(p, "repo", "full_outer")
    return found.na.fill(0)


def calls_by_endpoint(calls: DataFrame, method: str, pattern: str) -> DataFrame:
    return calls.where((F.col("method") == method) & (F.col("endpoint_pattern") == pattern)).orderBy("file", "id")


def reads_of_call(reads: DataFrame, repo: str, call_id: str) -> DataFrame:
    """The response fields read of one call, in file order."""
    return reads.where((F.col("repo") == repo) & (F.col("api_call_id") == call_id)).orderBy("file", "line", "col", "id")


def match_api_keys(keys: DataFrame, endpoints: DataFrame, query: str) -> DataFrame:
    """(repo, api_key, tier): keys that a query names: 1 exactly, else 2 by normalised path (and method), else 3 by part of the handler."""
    q = query.strip()
    words = q.split()
    method, path = (words[0].upper(), words[1]) if len(words) == 2 and words[0].isalpha() else (None, q)
    named = keys.join(endpoints.select("repo", F.col("id").alias("api_key"), "handler"), ["repo", "api_key"], "left")
    own = F.split_part("api_key", F.lit(" "), F.lit(2))
    by_path = (own != "") & (normalize_path(own) == normalize_path(F.lit(path)))
    if method:
        by_path &= F.split_part("api_key", F.lit(" "), F.lit(1)) == method
    tier = F.when(F.col("api_key") == q, 1).when(by_path, 2).when(F.contains(F.lower("handler"), F.lit(q.lower())), 3)
    found = named.withColumn("tier", tier).where("tier IS NOT NULL")
    return found.withColumn("least", F.min("tier").over(W.partitionBy("repo"))).where("tier = least").select("repo", "api_key", "tier")


def impact_of_api(keys: DataFrame, usage: DataFrame, counts: DataFrame) -> DataFrame:
    """``usage`` of the matched ``keys`` (repo, api_key, tier), with ``fields``: the reads of each response path (field_counts), by path."""
    wanted = keys.select("repo", "api_key", "tier")
    read = counts.join(wanted, ["repo", "api_key"], "left_semi").groupBy("repo", "api_key").agg(F.array_sort(F.collect_list(F.struct("path", "reads"))).alias("fields"))
    return wanted.join(usage, ["repo", "api_key"]).join(read, ["repo", "api_key"], "left")


def impact_of_files(linked: DataFrame, reads: DataFrame, functions: DataFrame, dependents: DataFrame) -> DataFrame:
    """(repo, file, own_apis, clients, dependents, apis, files, components) of every file that uses an API: its own APIs, client
    functions that other files call, files that import it (repo, file, dependent), and what a change of it may affect."""
    pairs, named = _affected(linked, reads, functions)
    clients = named.groupBy("repo", "file").agg(F.count("*").alias("clients"))
    above = dependents.groupBy("repo", "file").agg(F.count("*").alias("dependents"))
    found = _radius(pairs)
    for part in (clients, above):
        found = found.join(part, ["repo", "file"], "left")
    return found.na.fill(0, ["clients", "dependents"]).select("repo", "file", "own_apis", "clients", "dependents", "apis", "files", "components")


def _has(c: str, text: str) -> Column:
    return F.contains(F.lower(c), F.lit(text.lower()))


def search(text: str, usage: DataFrame, linked: DataFrame, reads: DataFrame, functions: DataFrame, files: DataFrame, radius: DataFrame, dto_hits: DataFrame | None = None) -> DataFrame:
    """(repo, kind, label, detail, apis, files): APIs, files, functions and, where ``dto_hits`` has them, DTOs and fields whose name holds ``text``."""
    apis = usage.where(_has("api_key", text) | F.coalesce(_has("handler", text), F.lit(False))).select("repo", F.lit("api").alias("kind"), F.col("api_key").alias("label"), F.col("handler").alias("detail"), F.lit(1).cast("long").alias("apis"), "files")
    counts = file_apis(linked, reads).groupBy("repo", "file").agg(F.count("*").alias("apis"))
    paths = files.where(_has("path", text)).select("repo", F.col("path").alias("file")).join(counts, ["repo", "file"], "left").join(radius.select("repo", "file", "files"), ["repo", "file"], "left")
    by_file = paths.select("repo", F.lit("file"), "file", F.lit(None).cast("string"), F.coalesce("apis", F.lit(0)), F.coalesce("files", F.lit(1)))
    named = functions.where((F.col("name") != "<anonymous>") & _has("name", text))
    uses = (
        linked.select("repo", F.col("caller_function_id").alias("id"), "api_key", "file")
        .union(linked.select("repo", "wrapper_function_id", "api_key", "file"))
        .union(field_reads(reads, linked).select("repo", "containing_function_id", "api_key", "file"))
        .where("id IS NOT NULL")
    )
    used = uses.join(named.select("repo", "id"), ["repo", "id"], "left_semi").groupBy("repo", "id").agg(F.count_distinct("api_key").alias("apis"), F.count_distinct("file").alias("files"))
    kind = F.when(F.col("containing_component") == F.col("name"), "component").otherwise("function")
    by_function = named.join(used, ["repo", "id"], "left").select("repo", kind, "name", F.concat_ws(":", "file", "line"), F.coalesce("apis", F.lit(0)), F.coalesce("files", F.lit(0)))
    found = apis.union(by_file).union(by_function)
    return found if dto_hits is None else found.unionByName(dto_hits)
