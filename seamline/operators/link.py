"""Linking API calls to backend endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.paths import PARAM, api_key, frontend_path, join_path, normalize_path, path_score, path_similarity, segments
from seamline.plans.lineage import stored

SIMILAR = 3
#: Literal segments of a path whose sets are made at most, and parts of a set's holders that are cut down one by one.
WIDE, PARTS = 12, 64


def shape(parts: Column) -> Column:
    """One sign for each segment: ``*`` for a parameter, ``-`` for a literal."""
    return F.array_join(F.transform(parts, lambda s: F.when(s == PARAM, "*").otherwise("-")), "")


def literals(parts: Column, other: Column) -> Column:
    """The segments that are literal here and in the ``other`` shape, at their places."""
    return F.array_join(F.transform(parts, lambda s, i: F.when((s != PARAM) & (F.substring(other, i + 1, F.lit(1)) == "-"), s).otherwise("")), "/")


def subsets(rows: DataFrame, parts: str) -> DataFrame:
    """``rows`` with ``_key`` for each non-empty set of literal segments (with their places) of the first WIDE ones."""
    literal = F.filter(F.transform(F.slice(parts, 1, WIDE), lambda s, i: F.when(s != PARAM, F.concat_ws(":", i.cast("string"), s))), lambda s: s.isNotNull())
    each = rows.withColumn("_literal", literal).where(F.size("_literal") > 0).withColumn("_set", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("_literal")) - 1).cast("int"))))
    return each.withColumn("_key", F.xxhash64(F.filter("_literal", lambda s, i: F.bit_get(F.col("_set"), i) == 1))).drop("_literal", "_set")


def first_by(rows: DataFrame, by: list[str], order: list[str | Column], spread: str, most: int) -> DataFrame:
    """The first ``most`` ``rows`` of each group in ``order``: of each of PARTS parts of a group first (by the hash of
    ``spread``), then of what they leave, which is PARTS x ``most`` rows at most, whatever the group holds."""
    for keys in ([*by, "_part"], by):
        rows = rows if "_part" in rows.columns else rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return rows.drop("_part")


def similar_endpoints(far: DataFrame, known: DataFrame, most: int = SIMILAR) -> DataFrame:
    """(repo, endpoint_pattern, similar): of each pattern (repo, endpoint_pattern, fe) the ``most`` endpoints that share most literal segments, then by id.

    An endpoint among a pattern's best shares some set of segments with it, and of the endpoints that have the whole set
    it is among the first ``most`` by id: the others before it would be better ones. So only the first ``most`` endpoints
    of each such set are kept, and a pattern looks up its own sets: work grows with the paths, however many share a
    segment, and no set's holders meet in one place. Patterns of more than WIDE segments are met segment by segment instead.
    """
    pair = ["repo", "endpoint_pattern", "fe"]
    holders = known.select("repo", "e_id", "be").distinct()
    kept = first_by(subsets(holders, "be"), ["repo", "_key"], ["e_id"], "e_id", most)
    met = subsets(far.where(F.size("fe") <= WIDE), "fe").join(kept, ["repo", "_key"]).select(*pair, "e_id", "be")
    parts = far.where(F.size("fe") > WIDE).select(*pair, F.posexplode("fe").alias("place", "part")).where(F.col("part") != PARAM)
    direct = parts.join(holders.select("repo", "e_id", "be", F.posexplode("be").alias("place", "part")), ["repo", "place", "part"]).select(*pair, "e_id", "be")
    scored = met.unionByName(direct).distinct().withColumn("same", path_similarity(F.col("fe"), F.col("be"))).where("same > 0")
    near = scored.withColumn("rank", F.row_number().over(W.partitionBy("repo", "endpoint_pattern").orderBy(F.desc("same"), "e_id"))).where(F.col("rank") <= most)
    return near.groupBy("repo", "endpoint_pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e_id"))), lambda x: x["e_id"]).alias("similar"))


def link_patterns(patterns: DataFrame, endpoints: DataFrame, frontend_base: str = "", backend_base: str = "") -> DataFrame:
    """(repo, method, endpoint_pattern, status, endpoint_id, candidates) for distinct pairs of method and pattern.

    Compatible endpoints are met by an equi-join on the segments that are literal on both sides, once for each pair of
    shapes (which segments are parameters) that occur: only pairs that fit are ever made. The score decides among them.
    Only patterns without any go on to the search for similar ones.
    """
    asked = patterns.select("repo", "method", "endpoint_pattern").where("method IS NOT NULL AND endpoint_pattern IS NOT NULL").distinct()
    asked = asked.withColumn("fe", segments(frontend_path(F.col("endpoint_pattern"), F.lit(frontend_base)))).withColumn("fs", shape(F.col("fe")))
    asked = stored(asked)  # distinct patterns, few against calls, and read several times
    known = endpoints.select("repo", F.col("id").alias("e_id"), F.col("method").alias("e_method"), "pos", segments(join_path(F.lit(backend_base), normalize_path(F.col("path")))).alias("be")).withColumn("bs", shape(F.col("be")))
    key = ["repo", "method", "endpoint_pattern"]
    shapes = asked.select("repo", "fs").distinct().join(known.select("repo", "bs").distinct(), "repo").where(F.length("fs") == F.length("bs"))
    left = asked.join(shapes, ["repo", "fs"]).withColumn("literals", literals(F.col("fe"), F.col("bs")))
    right = known.join(shapes, ["repo", "bs"]).withColumn("literals", literals(F.col("be"), F.col("fs")))
    scored = left.join(right, ["repo", "fs", "bs", "literals"]).withColumn("score", path_score(F.col("fe"), F.col("be"))).where("score >= 0")
    # a matching method goes before any score
    ranked = scored.withColumn("own", F.col("e_method") == F.col("method"))
    best = W.partitionBy(*key).orderBy(F.col("own").desc(), F.col("score").desc())
    top = ranked.withColumn("rank", F.rank().over(best)).where("rank = 1")
    met = top.groupBy(*key).agg(F.first("own").alias("own"), F.min_by("e_id", "pos").alias("first_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "e_id"))), lambda x: x["e_id"]).alias("ids"))
    # what is similar doesn't depend on methods
    far = asked.join(met, key, "left_anti").select("repo", "endpoint_pattern", "fe").distinct()
    none = F.array().cast("array<string>")
    found = asked.join(met, key, "left").join(similar_endpoints(far, known), ["repo", "endpoint_pattern"], "left")
    return found.select(
        *key,
        F.when(F.col("own"), "matched").when(F.col("own").isNotNull(), "method-mismatch").otherwise("not-found").alias("status"),
        F.when(F.col("own"), F.col("first_id")).alias("endpoint_id"),
        F.when(F.col("own"), none).when(F.col("own").isNotNull(), F.col("ids")).otherwise(F.coalesce("similar", none)).alias("candidates"),
    )


def link_calls(calls: DataFrame, endpoints: DataFrame, frontend_base: str = "", backend_base: str = "") -> DataFrame:
    """``calls`` with status, endpoint_id, candidates and api_key. Distinct patterns are linked once, then joined back."""
    links = link_patterns(calls, endpoints, frontend_base, backend_base)
    joined = calls.join(links, ["repo", "method", "endpoint_pattern"], "left")
    unknown = F.col("method").isNull() | F.col("endpoint_pattern").isNull()
    return joined.withColumns(
        {
            "status": F.when(unknown, "unresolved").otherwise(F.col("status")),
            "candidates": F.coalesce("candidates", F.array().cast("array<string>")),
            "api_key": api_key(F.col("endpoint_id"), F.col("method"), F.col("endpoint_pattern"), F.col("callee")),
        }
    )


def with_clients(calls: DataFrame, clients: DataFrame) -> DataFrame:
    """Calls of configured clients (repo, callee, method, path) take method and path from there; their keys are unknown."""
    known = clients.select("repo", "callee", F.col("method").alias("_method"), normalize_path(F.col("path")).alias("_path"))
    joined = calls.join(known, ["repo", "callee"], "left")
    hit = F.col("_path").isNotNull()
    return joined.withColumns(
        {
            "method": F.coalesce("_method", "method"),
            "endpoint_pattern": F.coalesce("_path", "endpoint_pattern"),
            "resolution": F.when(hit, "config").otherwise(F.col("resolution")),
            "query_keys": F.when(~hit, F.col("query_keys")),
            "body_keys": F.when(~hit, F.col("body_keys")),
        }
    ).drop("_method", "_path")
