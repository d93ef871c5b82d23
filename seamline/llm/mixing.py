"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks, and a source of weight w (its share of all weights, an exact fraction) owns w of every
slot. Its k-th block, from 0, is released at floor(k / w) and due at ceil((k + 1) / w). At every slot, of the sources
whose next block is released, the one with the earliest deadline runs (ties: by name). As the shares sum to 1, every
deadline is met, so at any slot t each source has run within less than one block of t * w: nothing is rounded, and no
deviation grows with the input.

A source that has ended is left out, and the others keep to their windows; a slot at which no block is released stays
empty. No row is dropped or repeated. The schedule has one row for each block of BLOCK rows. It is made in one task, a few
comparisons a block, which holds the sources alone and writes it as it is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from heapq import heappop, heappush
from itertools import islice
from math import lcm
from sys import float_info

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.plans.lineage import cut

#: A schedule of more blocks isn't broadcast.
BROADCAST_BLOCKS = 1 << 20
BLOCK = 64
#: Blocks that are written at a time.
BATCH = 1 << 16
#: Rows that one group of the ranking holds on average.
BUCKET_ROWS = 4096
SPACE = 1 << 60


def draw(key: Column) -> Column:
    """A number below 2**60 from the key's MD5 digest: the order of rows within their source."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def whole_weights(weights: list[float]) -> list[int]:
    """The weights times a common factor, exactly. A weight of 0 counts as the least of the others, as 1 where there are none.

    Weights below 2**-24 of all count as that, so that slots fit into 64 bits.
    """
    exact = [Fraction(w) for w in weights]
    least = max(min((w for w in exact if w), default=Fraction(1)), sum(exact) / (1 << 24))
    exact = [max(w, least) for w in exact]
    factor = lcm(*(w.denominator for w in exact))
    return [int(w * factor) for w in exact]


def earliest_deadline(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of every block, slot by slot; a source is its place in ``weights`` and has ``blocks`` blocks."""
    total, done, t = sum(weights), [0] * len(weights), 0
    released = [(0, i) for i, n in enumerate(blocks) if n]
    ready: list[tuple[int, int]] = []
    while released or ready:
        if not ready:
            t = max(t, released[0][0])
        while released and released[0][0] <= t:
            i = heappop(released)[1]
            heappush(ready, (-(-(done[i] + 1) * total // weights[i]), i))
        i = heappop(ready)[1]
        yield i, done[i], t
        done[i] += 1
        t += 1
        if done[i] < blocks[i]:
            heappush(released, (done[i] * total // weights[i], i))


def schedule(sources: DataFrame) -> DataFrame:
    """(name, block, slot): where each block of each source (name, weight, blocks) runs.

    Null, negative and not-a-number weights count as 0, infinite ones as the largest number.
    """
    number = F.coalesce(F.nanvl(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    weight = F.least(F.greatest(number, F.lit(0.0)), F.lit(float_info.max))
    row = sources.agg(F.array_sort(F.collect_list(F.struct("name", weight.alias("weight"), "blocks"))).alias("p")).where(F.size("p") > 0)

    def run(batches):
        for batch in batches:
            for found in batch.column(0).to_pylist():
                runs = earliest_deadline(whole_weights([s["weight"] for s in found]), [s["blocks"] for s in found])
                while some := [(found[i]["name"], block, slot) for i, block, slot in islice(runs, BATCH)]:
                    columns = zip((pa.string(), pa.int64(), pa.int64()), zip(*some, strict=True), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values, kind) for kind, values in columns], names=["name", "block", "slot"])

    return row.mapInArrow(run, "name string, block long, slot long")


def ranked(df: DataFrame, source: str, key: str, rows: int, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_name`` and ``_rank``: the place of each row within its source, by (draw, key, ties), from 0.

    A source is cut into ranges of the drawn number, so that a hot source is spread over many groups; their offsets
    come from counts that are aggregated first. ``rows`` (the table's size) sets the number of ranges.
    """
    ranges = max(1, -(-rows // BUCKET_ROWS))
    width = -(-SPACE // ranges)
    drawn = df.withColumn("_name", F.col(source).cast("string")).withColumn("_draw", draw(F.col(key))).withColumn("_range", F.expr(f"_draw div {width}"))
    # one key for window and join, so that rows are shuffled once
    cell = F.concat(F.col("_range").cast("string"), F.when(F.col("_name").isNull(), "-").otherwise("+"), F.coalesce("_name", F.lit("")))
    drawn = drawn.withColumn("_cell", cell)
    before = W.partitionBy("_name").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = drawn.groupBy("_name", "_range", "_cell").count().select("_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_cell").orderBy("_draw", F.col(key).asc_nulls_first(), *ties)
    placed = drawn.withColumn("_in", F.row_number().over(inside) - 1)
    return placed.join(counts, "_cell").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_draw", "_range", "_in", "_cell", "_before")


def target_weights(df: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """(name, weight): each source's number of rows to ``power``, the usual flattening of a skewed mixture, in millionths."""
    return df.groupBy(F.col(source).cast("string").alias("name")).agg(F.round(F.pow(F.count("*").cast("double"), F.lit(power)) * 1e6).alias("weight"))


def mix(df: DataFrame, weights: DataFrame, source: str = "source", key: str = "doc_id", block: int = BLOCK, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``block`` (of its source, from 0), ``slot`` (of the whole mixture) and ``position`` (of the row: order by it).

    Rows of equal key are ranked among themselves by the columns ``ties``, then in any order. Null sources form a source of their own. Sources that
    ``weights`` lacks, or gives a null, negative or zero weight, get the least of the other weights; of several weights
    of a source the largest counts. ``position`` is unique; gaps stand where a slot is empty or a block isn't full. Columns
    of these names are replaced. An empty table gives an empty result.
    """
    kept = [c for c in df.columns if c.lower() not in ("block", "slot", "position")]
    sizes = df.groupBy(F.col(source).cast("string").alias("name")).count().select("name", "count", F.expr(f"(count + {block - 1}) div {block}").alias("blocks"))
    size = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
    known = weights.groupBy(F.col("name").alias("_n")).agg(F.max("weight").alias("weight"))
    slots = cut(schedule(sizes.join(known, sizes["name"].eqNullSafe(known["_n"]), "left").select("name", "weight", "blocks")))
    slots = slots.select(F.col("name").alias("_n"), F.col("block").alias("_block"), "slot")
    rows = ranked(df.select(*kept), source, key, size.rows, ties)
    rows = rows.withColumn("block", F.expr(f"_rank div {block}")).withColumn("_row", F.col("_rank") % block)
    found = rows.join(F.broadcast(slots) if size.blocks <= BROADCAST_BLOCKS else slots, F.col("_name").eqNullSafe(F.col("_n")) & (F.col("block") == F.col("_block")))
    return found.withColumn("position", F.col("slot") * block + F.col("_row")).select(*kept, "block", "slot", "position")


#: DuckDB: the same mixture of documents, by square roots of the sources' sizes. The state of the fold is the blocks done, the next slot, and the runs with their slots.
ORACLE = f"""
WITH w AS (SELECT source AS name, CAST(round(pow(count(*)::DOUBLE, 0.5) * 1e6) AS BIGINT) AS weight, (count(*) + {BLOCK - 1}) // {BLOCK} AS blocks FROM documents GROUP BY source),
p AS (SELECT list(name ORDER BY name NULLS FIRST) AS names, list(weight ORDER BY name NULLS FIRST) AS a, list(blocks ORDER BY name NULLS FIRST) AS m, sum(weight)::BIGINT AS n, sum(blocks)::BIGINT AS b FROM w),
run AS (
  SELECT names, list_reduce(range(0, b), lambda s, k:
    list_transform([greatest(s[2][1], list_min(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN s[1][i] < m[i] THEN s[1][i] * n // a[i] END)))], lambda t:
      list_transform([list_min(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN s[1][i] < m[i] AND s[1][i] * n // a[i] <= t THEN (((s[1][i] + 1) * n + a[i] - 1) // a[i]) * 1000000 + i END)) % 1000000], lambda j:
        [list_transform(range(1, len(a) + 1), lambda i: s[1][i] + CASE WHEN i = j THEN 1 ELSE 0 END), [t + 1], list_append(s[3], j), list_append(s[4], t)])[1])[1],
    [list_transform(a, lambda x: 0::BIGINT), [0::BIGINT], []::BIGINT[], []::BIGINT[]]) AS s FROM p),
slots AS (SELECT names[i] AS name, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS block FROM (SELECT names, unnest(s[3]) AS i, unnest(s[4]) AS slot FROM run)),
r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id) - 1 AS rank FROM documents),
b AS (SELECT doc_id, source, rank // {BLOCK} AS block, rank % {BLOCK} AS row FROM r)
SELECT b.doc_id, b.source, b.block, s.slot, s.slot * {BLOCK} + b.row AS position FROM b JOIN slots s ON b.source IS NOT DISTINCT FROM s.name AND b.block = s.block
"""
