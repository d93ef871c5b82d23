"""Union-find grouping of links as distributed star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.plans.lineage import cut


ROWS_A_FILE = 250_000


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is the smallest node that can be reached.

    Each round points every node's larger neighbours, then its smaller ones, at its smallest neighbour, so that paths
    halve as in union-find; the rounds end when nothing changes. Minima are aggregated before they are shuffled, so a
    node with very many links is no hot spot. Nothing but a count and a checksum comes to the driver. Null ends, loops
    and repeated links are dropped. No link: no row.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    before = None
    while True:
        # as few files as the links fill
        edges = cut(edges if before is None else edges.coalesce(1 + before[0] // ROWS_A_FILE))
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = mark
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.least("w", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct()
