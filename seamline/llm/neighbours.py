"""Nearest neighbours by cosine: 2-stable projections to a few dimensions, kd-trees over them, and a chi-square stopping test.

On unit vectors the largest cosine is the least distance. A Gaussian projection to DIMS dimensions turns a distance d into
d times a chi variable of DIMS degrees of freedom, so a vector at distance d shows a projected distance above e with a
chance of 1 - P(chi2 <= e^2 / d^2). Projected neighbours are verified on the whole vectors, nearest cells first, until the
next one could be nearer than the K-th found with a chance below 1 - SURE only.

The upper levels of the tree come from a bounded sample and deal all vectors out to leaves and blocks; each block has a
tree of its own. A query first asks its own leaf, and then only leaves that its stopping test has to open.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.plans.lineage import stored

DIMS = 16
SURE = 0.96
#: Rows that the upper levels are fitted on, at most; the most leaves; rows of a block and of a cell in it, on average.
SAMPLE, LEAVES, BLOCK, CELL = 16_384, 1024, 1024, 32
#: Queries that one task puts to a block at once, on average.
ASKED = 512
SEED = 20240229


def chi2_below(x: float, dims: int = DIMS) -> float:
    """P(chi2 <= x) for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_point(sure: float = SURE, dims: int = DIMS) -> float:
    """Where ``chi2_below`` is ``sure``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, dims) < sure else (low, mid)
    return high


def matrix(rows: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def project(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors under the stable projection for their length."""
    stable = np.random.Generator(np.random.PCG64([SEED, vectors.shape[1]])).standard_normal((vectors.shape[1], DIMS))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))) @ stable


class Tree:
    """The upper levels of a kd-tree: 2**depth leaves, cut at medians of a sample along the widest dimension."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.cut = depth, np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        members = {0: points}
        for node in range(len(self.axis)):
            own = members.pop(node)
            if len(own):
                axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
                self.axis[node], self.cut[node] = axis, np.median(own[:, axis])
            right = own[:, self.axis[node]] > self.cut[node]
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - len(self.axis)


def usable(vector: str) -> Column:
    """Vectors that take part: not null nor zero, all components finite numbers."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def assigned(distinct: DataFrame, tree: Tree) -> DataFrame:
    """``distinct`` (id, members, vector) with size (components), leaf, and the projected point."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            rows = batch.column("vector")
            size = rows.value_lengths().to_numpy()
            leaf, point = np.zeros(len(size), np.int64), np.zeros((len(size), DIMS))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                point[at] = project(matrix(rows.take(pa.array(at))))
            leaf = shared.value.leaf(point)
            points = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * DIMS, pa.int32()), pa.array(point.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), pa.array(leaf.astype(np.int32)), points], names=["id", "members", "vector", "size", "leaf", "point"])

    return distinct.mapInArrow(run, "id long, members array<long>, vector array<double>, size int, leaf int, point array<double>")


def fit(rows: DataFrame) -> Tree:
    """The upper levels for ``rows`` (id, vector): as many leaves as the rows fill with BLOCK each, LEAVES at most, cut at
    the medians of SAMPLE rows at most, which come to the driver as points."""
    n = rows.count()
    depth = max(0, min(LEAVES, n // BLOCK).bit_length() - 1)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    flat = Tree(np.zeros((0, DIMS)), 0)
    taken = assigned(drawn.select("id", F.array().cast("array<long>").alias("members"), "vector"), flat).select("point").toPandas()["point"]
    return Tree(np.array(taken.tolist()).reshape(-1, DIMS), depth)


def cells(point: np.ndarray) -> list[np.ndarray]:
    """The rows of each cell of a kd-tree over ``point``: halves along the widest dimension down to CELL rows."""
    todo, out = [np.arange(len(point))], []
    while todo:
        own = todo.pop()
        if len(own) <= CELL:
            out.append(own)
            continue
        axis = np.ptp(point[own], axis=0).argmax()
        own = own[np.argsort(point[own, axis], kind="stable")]
        todo += [own[: len(own) // 2], own[len(own) // 2 :]]
    return out


def search(vectors: np.ndarray, point: np.ndarray, queries: np.ndarray, asked: np.ndarray, bound: np.ndarray, k: int, ids: np.ndarray, sure: float = SURE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (its vector and point, and the squared distance of the k-th found elsewhere): rows found here and their cosines.

    Cells come in order of their least projected distance; a query stops at the first one beyond its stopping test, and of a
    cell only vectors whose projected distance passes it are verified.
    """
    limit = chi2_point(sure)
    own = cells(point)
    low, high = np.array([point[c].min(axis=0) for c in own]), np.array([point[c].max(axis=0) for c in own])
    width = max(map(len, own))
    member = np.array([np.pad(c, (0, width - len(c)), constant_values=-1) for c in own])
    # by query, so that no array holds queries x cells x dimensions
    gap = np.array([(np.maximum(0, np.maximum(low - a, a - high)) ** 2).sum(axis=1) for a in asked])
    order = gap.argsort(axis=1, kind="stable")
    norm, asked_norm = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    best = np.full((len(queries), k), -np.inf)
    rows = np.full((len(queries), k), -1)
    kth = bound.copy()
    active = np.arange(len(queries))
    for t in range(len(own)):
        cell = order[active, t]
        go = gap[active, cell] < limit * kth[active]
        active, cell = active[go], cell[go]
        if not len(active):
            break
        for i in range(0, len(active), 256):
            some, there = active[i : i + 256], member[cell[i : i + 256]]
            shown = ((point[there] - asked[some, None]) ** 2).sum(axis=2)
            q, c = np.nonzero((shown < limit * kth[some, None]) & (there >= 0))
            cosine = np.full(there.shape, -np.inf)
            row, query = there[q, c], some[q]
            cosine[q, c] = np.einsum("pd,pd->p", vectors[row], queries[query]) / (norm[row] * asked_norm[query])
            all_best, all_rows = np.concatenate((best[some], cosine), axis=1), np.concatenate((rows[some], there), axis=1)
            tie = np.where(all_rows < 0, np.iinfo(np.int64).max, ids[all_rows])
            top = np.lexsort((tie, -all_best), axis=1)[:, :k]
            best[some], rows[some] = np.take_along_axis(all_best, top, 1), np.take_along_axis(all_rows, top, 1)
            kth[some] = np.minimum(kth[some], np.maximum(0, 2 - 2 * best[some, -1]))
    return [(r[(r >= 0) & (b > -np.inf)], b[(r >= 0) & (b > -np.inf)]) for r, b in zip(rows, best)]


def asked_of(index: DataFrame, visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query, id, score, members): the best k that each block holds for the queries that visit its leaf.

    ``index`` has the vectors by leaf, ``visits`` (query, size, vector, point, bound, leaf); ``blocks`` (leaf, n_blocks), one row a
    leaf. A group is one block with a share of the queries: both are bounded on average, whatever a leaf holds.
    """
    shares = visits.groupBy("size", "leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("n_shares"))
    here = index.join(F.broadcast(blocks), "leaf").join(shares, ["size", "leaf"]).select("size", "leaf", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_shares") - 1)).alias("share"), "id", "members", "vector", "point")
    to = visits.join(F.broadcast(blocks), "leaf").join(shares, ["size", "leaf"]).select("size", "leaf", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1).cast("array<long>")).alias("block"), F.pmod(F.xxhash64("query"), F.col("n_shares")).cast("int").alias("share"), "query", "vector", "point", "bound")
    keys = ["size", "leaf", "block", "share"]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float, list[int]]] = []
        if rows.num_rows and queries.num_rows:
            flat = lambda t, c: matrix(t.column(c).combine_chunks())
            ids, members, asked = rows.column("id").to_numpy(), rows.column("members"), queries.column("query").to_pylist()
            found = search(flat(rows, "vector"), flat(rows, "point"), flat(queries, "vector"), flat(queries, "point"), queries.column("bound").to_numpy(), k, ids)
            out = [(q, int(ids[i]), float(s), members[int(i)].as_py()) for q, (at, score) in zip(asked, found) for i, s in zip(at, score)]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())))], names=["query", "id", "score", "members"])

    return here.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(run, "query long, id long, score double, members array<long>")


def opened(wanted: DataFrame, leaves: DataFrame) -> DataFrame:
    """``wanted`` (query, size, vector, point, home, bound) once for each leaf but its home that the stopping test opens.
    ``leaves`` has LEAVES rows at most, which come to the driver."""
    frame = leaves.orderBy("leaf").toPandas()
    ends = [frame[[f"{side}{i}" for i in range(DIMS)]].to_numpy(float) for side in ("low", "high")]
    shared, limit = wanted.sparkSession.sparkContext.broadcast((frame["leaf"].to_numpy(np.int32), *ends)), chi2_point()

    def run(batches):
        leaf, low, high = shared.value
        for batch in batches:
            point, home, bound = matrix(batch.column("point")), batch.column("home").to_numpy(), batch.column("bound").to_numpy()
            lists = []
            for a, h, b in zip(point, home, bound):
                gap = (np.maximum(0, np.maximum(low - a, a - high)) ** 2).sum(axis=1)
                lists.append(leaf[(gap < limit * b) & (leaf != h)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "leaves"])

    slim = wanted.select("query", "size", "vector", "point", "bound", "home")
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields]).add("leaves", T.ArrayType(T.IntegerType()))).select("query", "size", "vector", "point", "bound", F.explode("leaves").alias("leaf"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, by score and then id."""
    return found.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k).drop("_n")


def nearest(df: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every``, the k nearest other rows by cosine.

    Ties go to the smaller key; fewer than k rows if there are no more. Vectors that are null, zero, or hold a null or
    non-finite component take no part, nor do null keys; of rows that repeat a key, the one of least vector counts. Vectors
    are compared with those of their own length. An empty table gives an empty one. Other columns aren't read.

    Equal vectors are searched for once: k + 1 least keys stand for all of them, as no query can be given more.
    """
    one = stored(df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable("vector")).groupBy("id").agg(F.min("vector").alias("vector")))
    tree = fit(one)
    few = one.withColumn("_n", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("_n") <= k + 1)
    distinct = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("id"), "members", "vector")
    index = stored(assigned(distinct, tree))
    # the extent of each leaf, from all its vectors: at most LEAVES rows
    ends = reduce(list.__add__, ([F.min(F.col("point")[i]).alias(f"low{i}"), F.max(F.col("point")[i]).alias(f"high{i}")] for i in range(DIMS)))
    leaves = stored(index.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"), *ends))
    blocks = leaves.select("leaf", "n_blocks")

    asking = one.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")
    queries = stored(asking.join(index.select(F.col("id").alias("query"), "vector"), "vector").select("query_id", "query"))
    wanted = stored(index.join(queries.select(F.col("query").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("query"), "size", "vector", "point", F.col("leaf").alias("home")))
    home = stored(best(asked_of(index, wanted.select("*", F.lit(math.inf).alias("bound"), F.col("home").alias("leaf")), blocks, k + 1), k + 1))

    worst = home.groupBy("query").agg(F.when(F.count("*") > k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(math.inf).alias("bound"))
    away = asked_of(index, opened(wanted.join(worst, "query"), leaves), blocks, k + 1)

    groups = best(home.unionByName(away), k + 1)
    each = queries.join(groups, "query").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
