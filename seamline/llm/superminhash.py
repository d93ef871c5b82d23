"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.common import SPACED, Words, mix, narrowed, runs, sliced, texts_of
from seamline.llm.components import connected
from seamline.plans.lineage import cut, stored

#: Bits of a shingle's value; the upper 12 hold the text's place in a step while a step is sorted.
BITS = 52
LEVEL = np.uint64(40)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle values of each text, one after the other, and where each text's begin (one more at the end)."""
    value, text = runs(words.hashes, words.starts, width)
    keys = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | (value >> np.uint64(64 - BITS)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    # the last end is the number of keys: its mark may need a bit more than there is
    marks = np.arange(len(words.starts) - 1, dtype=np.uint64) << np.uint64(BITS)
    starts = np.append(np.searchsorted(keys, marks), len(keys))
    return keys & np.uint64((1 << BITS) - 1), starts


def set_digests(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(2 x texts): a 128-bit digest of each text's shingle set, in two numbers."""
    total = np.concatenate((np.zeros((2, 1), np.uint64), np.cumsum([mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D))], axis=1, dtype=np.uint64)), axis=1)
    return (total[:, starts[1:]] - total[:, starts[:-1]]).view(np.int64)


def signatures(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures (texts x size). Texts without elements keep the largest value.

    Each element draws, for rank 0, 1, ..., a number and the next place of its own random permutation; the value is
    the rank and the number, rank first. At rank j a text whose every place holds a value of rank j or less is done, as
    later ranks can only be larger: the early stop.
    """
    n = np.diff(starts)
    out = np.full((len(n), size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    text = np.repeat(np.arange(len(n)), n)
    seed = mix(values + np.uint64(0x632BE59BD9B4E019))
    order = None
    for j in range(size):
        draw = mix(seed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = (j + (draw & np.uint64(0xFFFFFF)) % np.uint64(size - j)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            row = np.arange(len(seed))
            place = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, j]
        np.minimum.at(flat, text * size + place, (np.uint64(j) << LEVEL) | (draw >> np.uint64(64) - LEVEL))
        open_ = (out >> LEVEL > np.uint64(j)).any(axis=1) & (n > 0)
        if not open_.any() or j + 1 == size:
            break
        keep = open_[text]
        if order is None:
            first = pick[keep]
            text, seed = text[keep], seed[keep]
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(seed), 1))
            order[np.arange(len(seed)), first] = 0
        elif not keep.all():
            text, seed, order = text[keep], seed[keep], order[keep]
    return out


def sketch(df: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(key, n_shingles, d1, d2, bands): the size and a 128-bit digest of each text's shingle set, and its band values.

    Null and wordless texts have no shingle and no band.
    """
    names = [key, "n_shingles", "d1", "d2", "bands"]

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                values, starts = shingle_sets(Words(texts_of(part, "_text"), SPACED), width)
                n = np.diff(starts)
                found = signatures(values, starts, bands * rows)
                chosen = np.zeros((len(n), bands), np.uint64)
                for r in range(rows):
                    chosen = mix(chosen * np.uint64(0xA24BAED4963EE407) + found[:, r::rows] + np.uint64(r + 1))
                digests = set_digests(values, starts)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen[n > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]), lists], names=names)

    slim = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, n_shingles long, d1 long, d2 long, bands array<long>")


def shingles(df: DataFrame, text: str, width: int, node: str = "node", digest: tuple[str, str] = ("d1", "d2")) -> DataFrame:
    """(node, shingles): the whole shingle set, as sorted numbers, of each text whose set has the digest that its row states."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                values, starts = shingle_sets(Words(texts_of(part, "_text"), SPACED), width)
                found = set_digests(values, starts)
                same = (part.column(1).to_numpy() == found[0]) & (part.column(2).to_numpy() == found[1])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "shingles"]).filter(pa.array(same))

    slim = df.select(F.col(node), *digest, F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, "node long, shingles array<long>")


#: Larger buckets are compared in blocks. Texts and shingles that one block holds on average.
SMALL_BUCKET = 8
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 1 << 16


def linked(percent: int):
    """Whether two set sizes and their intersection make a link: 100 * intersection >= percent * union."""
    return lambda x, n, m: (x * 100) >= percent * (n + m - x)


def compare_blocks(percent: int):
    """For applyInArrow: the links between one block of left texts and one of right texts, in other groups than theirs."""
    meets = linked(percent)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("left").to_numpy()
        ids, group = table.column("doc").to_numpy(), table.column("group").to_numpy()
        sets = table.column("shingles").combine_chunks()
        ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        flat = sets.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        shared = np.intersect1d(flat[side[owner]], flat[~side[owner]])
        row, size = np.cumsum(side) - 1, np.diff(ends)
        other = np.cumsum(~side) - 1
        count = np.zeros((int(side.sum()), int((~side).sum())), np.float32)
        at = np.searchsorted(shared, flat)
        there = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == flat) if len(shared) else np.zeros(len(flat), bool)
        at, own = at[there], owner[there]
        for first in range(0, len(shared), 4096):
            part = (at >= first) & (at < first + 4096)
            a, o = at[part] - first, own[part]
            left, right = np.zeros((count.shape[0], 4096), np.float32), np.zeros((count.shape[1], 4096), np.float32)
            left[row[o[side[o]]], a[side[o]]] = 1
            right[other[o[~side[o]]], a[~side[o]]] = 1
            count += left @ right.T
        both = count.astype(np.int64)
        hit = meets(both, size[side][:, None], size[~side][None, :]) & (group[side][:, None] != group[~side][None, :])
        i, j = np.nonzero(hit)
        return pa.table({"a": pa.array(ids[side][i], pa.int64()), "b": pa.array(ids[~side][j], pa.int64())})

    return run


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """(key, n_shingles, component_id, kept): groups of texts whose shingle sets have a Jaccard similarity of ``percent`` or more.

    1. Texts with equal sets form a class (digests are aggregated before the shuffle); one text stands for each class.
       A class has the number of its smallest key; where rows repeat a key so that it is the smallest of several
       classes, the first of them has it and the others a number by hash.
    2. Signatures of bands * rows values are banded. In each bucket every text is compared with the bucket's leader,
       the smallest id: as many pairs as texts. Links are confirmed on the full sets, and grouped.
    3. Buckets that still hold several groups are compared further, so that no link is lost: small ones by pairs of
       texts in different groups, larger ones in blocks of bounded size that are matched as matrices. A pair of texts
       in one group is never compared again, so groups of copies cost no more than their size.
    A link of the least similarity fails to share a bucket with a chance of (1 - s**rows)**bands: 3e-6 at the default,
    4e-7 for 85 percent and 20 bands.

    ``key`` must be a whole number. Rows that repeat a key are judged by their own texts, and get a row each. Null and
    wordless texts are linked with nothing; an empty table gives an empty result. Other columns aren't read.
    """
    source = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    found = stored(sketch(source, "doc", "text", width, bands, rows))
    firsts = found.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc").alias("rep")).where("rep IS NOT NULL")
    again = F.row_number().over(W.partitionBy("rep").orderBy("n_shingles", "d1", "d2")) > 1
    classes = stored(firsts.withColumn("node", F.when(again, F.xxhash64("rep", "n_shingles", "d1", "d2")).otherwise(F.col("rep"))))
    one = found.join(classes, ["n_shingles", "d1", "d2"]).where("doc = rep").select("node", "rep", "n_shingles", "d1", "d2", "bands")
    # rows that repeat a key and a set
    reps = one.dropDuplicates(["node"])
    places = reps.select("node", "rep", "n_shingles", "d1", "d2", F.posexplode("bands").alias("band", "value")).withColumnsRenamed({"node": "doc", "n_shingles": "n"})
    # stored, so that the join has a shuffle of its own in which a bucket that very many texts share can be split
    heads = stored(places.groupBy("band", "value").agg(F.min("doc").alias("leader"), F.count("*").alias("texts")).where("texts > 1"))
    placed = stored(places.join(heads, ["band", "value"]).select("band", "value", "doc", "rep", "d1", "d2", "n", "leader", "texts"))

    # from here on doc is the number of a class
    wanted = placed.select(F.col("doc").alias("node"), F.col("rep").alias("doc"), "d1", "d2").distinct()
    texts_ = narrowed(source, wanted, "doc").join(wanted, "doc")
    sets = stored(shingles(texts_, "text", width).dropDuplicates(["node"]).withColumnRenamed("node", "doc"))
    fits = lambda n, m: (F.least(n, m) * 100) >= F.greatest(n, m) * percent
    meets = linked(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s")), "a")
        two = one.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("t")), "b")
        return two.where(meets(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("a", "b")

    sizes = sets.select(F.col("doc").alias("leader"), F.size("shingles").alias("m"))
    first = placed.where("doc <> leader").select("doc", "n", "leader").distinct().join(sizes, "leader").where(fits(F.col("n"), F.col("m")))
    links = cut(confirmed(first.select(F.col("leader").alias("a"), F.col("doc").alias("b"))))
    groups = connected(links)

    def grouped(rows_: DataFrame, doc: str, name: str) -> DataFrame:
        known = groups.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return rows_.join(known, F.col(doc) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", doc)).drop("_node", "_component")

    marked = cut(grouped(placed.where("texts > 2"), "doc", "group"))
    # by group first, then by bucket: what the blocks need to know, in one row for each bucket
    each = marked.groupBy("band", "value", "group").agg(F.count("*").alias("texts"), F.sum("n").alias("mass"), F.max(F.col("doc") == F.col("leader")).alias("leads"))
    main = lambda c: F.sum(F.when(F.col("leads"), F.col(c)).otherwise(0))
    blocks_of = lambda texts, mass: F.greatest(F.ceil(mass / BLOCK_SHINGLES), F.ceil(texts / BLOCK_TEXTS), F.lit(1))
    mixed = each.groupBy("band", "value").agg(
        F.count("*").alias("groups"), F.min(F.when(F.col("leads"), F.col("group"))).alias("main"), blocks_of(F.sum("texts") - main("texts"), F.sum("mass") - main("mass")).alias("ln"), blocks_of(F.sum("texts"), F.sum("mass")).alias("rn")
    )
    # stored for the same reason as the leaders
    mixed = stored(mixed.where("groups > 1").drop("groups"))
    open_ = marked.join(mixed, ["band", "value"])

    small = open_.where(f"texts <= {SMALL_BUCKET} AND doc <> leader")
    left = small.select("band", "value", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("group").alias("ga"))
    right = small.select("band", "value", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("group").alias("gb"))
    pairs = left.join(right, ["band", "value"]).where("a < b AND ga <> gb").where(fits(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    more = confirmed(pairs)

    spread = open_.where(f"texts > {SMALL_BUCKET}")
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lefts = spread.where("group <> main").select("band", "value", "doc", "group", F.lit(True).alias("left"), own("ln").alias("i"), every("rn").alias("j"))
    rights = spread.select("band", "value", "doc", "group", F.lit(False).alias("left"), every("ln").alias("i"), own("rn").alias("j"))
    blocks = lefts.unionByName(rights).join(sets, "doc")
    matched = blocks.groupBy("band", "value", "i", "j").applyInArrow(compare_blocks(percent), "a long, b long")

    final = connected(links.unionByName(more).unionByName(matched).distinct())
    # a component has the smallest key of its texts
    within = classes.select("node", "rep").join(final, "node")
    least = within.groupBy("component").agg(F.min("rep").alias("least"))
    labels = within.join(least, "component").select("node", "least")
    named = classes.join(labels, "node", "left").select("n_shingles", "d1", "d2", F.coalesce("least", "rep").alias("component_id"))
    result = found.select("doc", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.coalesce("component_id", "doc")
    return result.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
