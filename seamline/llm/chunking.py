"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of its last 16 bytes is larger than at any of the RADIUS places before and not smaller
than at any of the RADIUS places after. Whether a place is a cut depends on the 40 bytes before and the 24 after it
only, so chunks after an insertion are the same again; and as each neighbourhood has its maximum, repetitive text is cut
as well. Chunks are deduplicated by digest; runs of chunks that a text shares with the first text that has them are
joined, extended word by word in both directions, and reported where they are long enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.common import _WINDOW, _hashed, mix, narrowed, raw, sliced, texts_of
from seamline.plans.lineage import Pile, stored

SPAN = 16
RADIUS = 24
MOST = 256
#: Passages of over 50 words.
MIN_WORDS = 51
#: Bytes beyond a run in which its extension is sought first: 50 usual words and what a cut may be away. Where all of them
#: agree and the run is still short, four times as many follow.
REACH = 512
#: A place in one long number: so many bits for the byte in its text.
SHIFT = 26
SLOTS_OF_DIGESTS = 1 << 22
GEAR = (mix(np.arange(7, 263, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def gear(b: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR[b[i - j]] << j for j < 16, modulo 2**16, by doubling."""
    h = GEAR[b]
    step = 1
    while step < SPAN:
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    return h


def cuts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end of all: texts' offsets, hash cuts, and cuts of longer chunks at MOST bytes."""
    n = len(b)
    if not n:
        return np.zeros(1, np.int64)
    h = gear(b)
    blind = (offsets[:-1][:, None] + np.arange(SPAN + RADIUS)).reshape(-1)
    h[blind[blind < n]] = 0  # here the hash or what it is compared with would reach into the text before
    most = np.concatenate((np.zeros(RADIUS, np.uint16), h, np.zeros(RADIUS, np.uint16)))
    for step in (1, 2, 4, 8):
        most[:-step] = np.maximum(most[:-step], most[step:])
    most[:-8] = np.maximum(most[:-8], most[8:])  # of 24 places from each on
    right = h >= most[RADIUS + 1 : RADIUS + 1 + n]
    edges = np.union1d(offsets, np.flatnonzero((h > most[:n]) & right) + 1)
    # text of a period below RADIUS has only equal maxima: there every RADIUS bytes the next one cuts, at the same phase in all texts
    for i in np.flatnonzero(np.diff(edges) > MOST):
        a, z = edges[i], edges[i + 1]
        equal = np.flatnonzero((h[a:z] >= most[a:z]) & right[a:z] & (h[a:z] > 0)) + 1
        chosen, last = [], 0
        while last + RADIUS < z - a and (k := np.searchsorted(equal, last + RADIUS)) < len(equal):
            last = int(equal[k])
            chosen.append(a + last)
        if chosen:
            edges = np.append(edges, chosen)
    edges = np.unique(edges)
    edges = edges[edges <= n]
    sizes = np.diff(edges)
    long = np.flatnonzero(sizes > MOST)
    if len(long):
        extra = [np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in long]
        edges = np.union1d(edges, np.concatenate(extra))
    # no chunk begins within a character
    for _ in range(3):
        inside = (b[np.minimum(edges, n - 1)] & 0xC0 == 0x80) & (edges < n)
        edges = np.unique(edges + inside)
    return edges


def digests(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    if len(b) <= _WINDOW:
        return _hashed(b, edges[:-1], edges[1:])
    out, first = [], 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + _WINDOW, side="right")) - 1)
        part = edges[first : last + 1] - edges[first]
        out.append(_hashed(b[edges[first] : edges[last]], part[:-1], part[1:]))
        first = last
    return np.concatenate(out)


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """(doc, start, size, words, digest): the chunks of every text, in bytes. Null and empty texts have none.

    ``words`` counts the words that begin in the chunk; the digest covers bytes and size. Chunks cover the text without
    gaps; with ``wanted``, a bitmap over hash slots of digests, only chunks in its slots are returned.
    """

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                offsets, data = raw(texts_of(part, "_text"))
                b = np.frombuffer(data, np.uint8)
                edges = cuts(b, offsets)
                if len(edges) < 2:
                    continue
                blank = b <= 32
                begins = ~blank & np.concatenate(([True], blank[:-1]))
                heads = offsets[:-1][offsets[:-1] < len(b)]
                begins[heads] = ~blank[heads]
                counted = np.concatenate(([0], np.cumsum(begins)))
                owner = np.searchsorted(offsets, edges[:-1], side="right") - 1
                sizes = np.diff(edges)
                digest = mix(digests(b, edges) + sizes.astype(np.uint64))
                keep = np.flatnonzero(wanted[digest & np.uint64(len(wanted) - 1)]) if wanted is not None else np.arange(len(sizes))
                first, owner = edges[:-1][keep], owner[keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)),
                        pa.array((first - offsets[owner]).astype(np.int32)),
                        pa.array(sizes[keep].astype(np.int32)),
                        pa.array(np.diff(counted[edges])[keep].astype(np.int32)),
                        pa.array(digest[keep].view(np.int64)),
                    ],
                    names=["doc", "start", "size", "words", "digest"],
                )

    slim = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, "doc long, start int, size int, words int, digest long")


def firsts(found: DataFrame, narrow: bool) -> DataFrame:
    """(digest, keeper, keeper_start): chunks that several texts have, with their first place by (doc, start).

    The least and the largest place are taken before rows are shuffled. A place is one long number where ids and sizes
    leave room for that (``narrow``), else a decimal; both order alike.
    """
    if narrow:
        place, unit = F.col("doc") * (1 << SHIFT) + F.col("start"), F.lit(1 << SHIFT)
    else:
        unit = F.lit(1 << 31).cast("decimal(10,0)")
        place = (F.col("doc").cast("decimal(20,0)") * unit + F.col("start").cast("decimal(10,0)")).cast("decimal(31,0)")
    text_of = lambda c: F.floor(F.col(c) / unit).cast("long") if not narrow else F.shiftright(c, SHIFT)
    ends = found.groupBy("digest").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(text_of("low") != text_of("high"))
    start = F.col("low") % unit if narrow else F.col("low") - text_of("low").cast("decimal(20,0)") * unit
    return ends.select("digest", text_of("low").alias("keeper"), start.cast("int").alias("keeper_start"))


def slot_bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` hash slots the digests take. The bitmap is put together on the executors; bits / 8 bytes come to the driver."""
    slot = F.pmod("digest", F.lit(bits)) + 1
    parts = found.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out, size = np.zeros(bits, bool), 1 << 15
    for row in parts.toLocalIterator():
        out[(row.bucket - 1) * size : row.bucket * size] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
    return out


def shared_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, keeper, start, keeper_start, size, words): unbroken runs of chunks that a text shares with the first text that has them.

    Texts are cut twice rather than stored as chunks; the second time only chunks in the hash slots of shared digests
    are passed on. The slots are a bitmap of SLOTS_OF_DIGESTS bits whatever the input is.
    """
    size = df.agg(F.min(F.col(key).cast("long")), F.max(F.col(key).cast("long")), F.max(F.octet_length(text))).first()
    narrow = size[0] is not None and size[0] >= 0 and size[1] < 1 << (62 - SHIFT) and (size[2] or 0) < 1 << SHIFT
    shared = stored(firsts(chunks(df, key, text), narrow))
    wanted = slot_bitmap(shared, SLOTS_OF_DIGESTS)
    met = chunks(df, key, text, wanted).join(shared, "digest").where("doc <> keeper").withColumn("shift", F.col("keeper_start") - F.col("start"))
    line = W.partitionBy("doc", "keeper", "shift").orderBy("start")
    new = F.coalesce((F.lag(F.col("start") + F.col("size")).over(line) != F.col("start")).cast("int"), F.lit(1))
    marked = met.select("doc", "keeper", "shift", "start", "size", "words").withColumn("new", new).withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy("doc", "keeper", "shift", "run").agg(F.min("start").alias("start"), F.sum("size").cast("int").alias("size"), F.sum("words").cast("int").alias("words"))
    return runs.select("doc", "keeper", "start", (F.col("start") + F.col("shift")).alias("keeper_start"), "size", "words")


def _alike(a, b):
    """Leading equal elements of two arrays."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same).cast("long")).cast("int")


def lengthened(runs: DataFrame, df: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``runs`` extended until they have ``least`` words or the texts differ, however long the words are: those that have."""
    found, reach = Pile(df.sparkSession), REACH
    while True:
        step = stored(extended(runs, df, key, text, reach))
        found.add(step.where(F.col("words") >= least).drop("open"))
        runs, reach = step.where(F.col("open") & (F.col("words") < least)).drop("open"), reach * 4
        if runs.isEmpty():
            return found.rows()


def extended(runs: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``runs`` with start, keeper_start, size and words after extension to both sides by equal blank-separated words.

    What stands around a run, ``reach`` bytes on each side, is compared with what stands around it in the keeper's text,
    byte by byte (as one character each); the words that agree are added. Surroundings that are cut off at ``reach``
    lose what is left of a character there. Those of a keeper are taken once for all runs at one place in it. Only
    texts with runs are read again. ``open`` says that all bytes on a side agreed and that there are more.
    """
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.encode(F.col(text).cast("string"), "UTF-8").alias("b"))

    def around(places: DataFrame, doc: str, at: str, before: str, after: str) -> DataFrame:
        one = narrowed(texts, places.select(F.col(doc).alias("doc")).distinct(), "doc").withColumnRenamed("doc", "_doc")
        first = F.greatest(F.lit(0), F.col(at) - reach)
        cut = {before: F.substring("b", first + 1, F.col(at) - first), after: F.substring("b", F.col(at) + F.col("size") + 1, F.lit(reach))}
        return places.join(one, F.col(doc) == F.col("_doc")).withColumns(cut).drop("_doc", "b")

    theirs = around(runs.select("keeper", "keeper_start", "size").distinct(), "keeper", "keeper_start", "b2", "a2")
    both = around(runs, "doc", "start", "b1", "a1").join(theirs, ["keeper", "keeper_start", "size"])
    text_of = lambda c: F.decode(F.col(c), "ISO-8859-1")
    head = lambda c, at: F.when(F.col(at) > reach, F.regexp_replace(text_of(c), "^[\x80-\xBF]{1,3}", "")).otherwise(text_of(c))
    tail = lambda c: F.when(F.length(c) == reach, F.regexp_replace(text_of(c), "[\xC0-\xFF][\x80-\xBF]{0,2}$", "")).otherwise(text_of(c))
    words = lambda t: F.split(F.regexp_replace(t, "[\x00-\x20]", " "), " ")
    both = both.withColumns({"b1": F.reverse(words(head("b1", "start"))), "b2": F.reverse(words(head("b2", "keeper_start"))), "a1": words(tail("a1")), "a2": words(tail("a2"))})
    met = both.select("doc", "keeper", "start", "keeper_start", "size", "words", F.slice("b1", F.lit(1), _alike(F.col("b1"), F.col("b2"))).alias("l"), F.slice("a1", F.lit(1), _alike(F.col("a1"), F.col("a2"))).alias("r"))
    length = lambda c: F.length(F.array_join(c, " "))
    full = lambda c: F.size(F.filter(c, lambda w: w != ""))
    grown = met.withColumns({"lb": length("l"), "rb": length("r")})
    # up to three bytes of a character that was cut off count as met
    more = (F.col("lb") >= reach - 3) | (F.col("rb") >= reach - 3)
    return grown.select(
        more.alias("open"), "doc", "keeper", (F.col("start") - F.col("lb")).alias("start"), (F.col("keeper_start") - F.col("lb")).alias("keeper_start"),
        (F.col("size") + F.col("lb") + F.col("rb")).alias("size"), (F.col("words") + full("l") + full("r")).alias("words"),
    ).distinct()


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, n_bytes, n_words, keeper_id, is_keeper): passages of ``min_words`` words or more that texts share.

    Each passage is reported for every text that has it; ``keeper_id`` is the first such text by id, whose copy stays,
    and the others' copies may go. Starts and sizes are in bytes of the UTF-8 text. Overlapping passages of one text
    with one keeper are joined. ``key`` must be a whole number; rows without one, null and empty texts share nothing;
    rows that repeat a key are taken for one text. Other columns aren't read.
    """
    runs = stored(shared_runs(df, key, text))
    long = runs.where(F.col("words") >= min_words)
    short = lengthened(runs.where(F.col("words") < min_words), df, min_words, key, text)
    passages = stored(long.unionByName(short))
    copies = passages.select("doc", "start", "size", "words", "keeper", F.lit(False).alias("is_keeper"))
    kept = passages.select(F.col("keeper").alias("doc"), F.col("keeper_start").alias("start"), "size", "words", "keeper", F.lit(True).alias("is_keeper")).distinct()
    line = W.partitionBy("doc", "keeper").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(line.rowsBetween(W.unboundedPreceding, -1))
    marked = copies.unionByName(kept).withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    joined = marked.groupBy("doc", "keeper", "is_keeper", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.max("words").alias("n_words"))
    return joined.select(F.col("doc").alias(key), "start", (F.col("end") - F.col("start")).alias("n_bytes"), "n_words", F.col("keeper").alias("keeper_id"), "is_keeper")
