"""Transitive closure by semi-naive iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.plans.lineage import Pile, stored


def closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(repo, start, node) for all nodes that can be reached from each start by one edge or more (repo, src, dst), the start left out.

    Each round joins only the pairs that the round before found, drops those seen, and is stored, so that the plan
    stays small and lost executors cost one round. The rounds end when one finds no pair, as the pairs are finite.
    """
    steps = stored(edges.select("repo", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    first = steps if sources is None else steps.join(sources.select("repo", F.col("node").alias("src")).distinct(), ["repo", "src"], "left_semi")
    seen = Pile(edges.sparkSession)
    fresh = seen.add(first.select("repo", F.col("src").alias("start"), F.col("dst").alias("node")))
    while not fresh.isEmpty():
        grown = fresh.join(steps.withColumnRenamed("src", "node"), ["repo", "node"]).select("repo", "start", F.col("dst").alias("node")).where("start <> node").distinct()
        fresh = seen.add(grown.join(seen.rows(), ["repo", "start", "node"], "left_anti"))
    return seen.rows()
