"""Benchmark decontamination with a distributed positional inverted index.

Postings (term, document, positions) of the training tokens are stored as a table. A phrase is found from its rarest
terms: their lists, moved by the terms' places in the phrase, are intersected, and what is left is checked word for
word. A proximity match is found from the lists of an item's two rarest terms. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.common import ALNUM, SLOTS, Words, narrowed, sliced, texts_of
from seamline.plans.lineage import cut, stored

WINDOW = 10
#: So many of a window's rarest terms have their lists intersected before the words are checked.
RAREST = 2
#: Places at most between the two rarest terms of an item in a proximity match.
SLOP = 8


def _slots(terms: DataFrame | None) -> np.ndarray | None:
    """A bitmap of SLOTS bits over the hashes of ``terms``; its size doesn't depend on their number."""
    if terms is None:
        return None
    found = terms.select(F.pmod(F.col("term"), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[found] = True
    return np.packbits(bits)


def _wanted(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    slot = (hashes.view(np.int64) % SLOTS).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, text_hash, terms): each distinct item text as an array of terms in order. Items without words have no row."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                words = Words(texts_of(part, "_text"), ALNUM)
                lists = pa.ListArray.from_arrays(pa.array(words.starts.astype(np.int32)), pa.array(words.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["item", "terms"])

    slim = items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("_text"))
    found = slim.mapInArrow(run, "item string, terms array<long>").where("size(terms) > 0 AND item IS NOT NULL")
    return found.select("item", F.xxhash64("terms").alias("text_hash"), "terms").distinct()


def term_counts(df: DataFrame, terms: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(term, n): how often each term occurs in all texts. ``terms`` (a ``term`` column) narrows the count to its hash slots."""
    bits = _slots(terms)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                hashes = Words(texts_of(part, "_text"), ALNUM).hashes
                found, n = np.unique(hashes[_wanted(bits, hashes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return df.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def build_index(df: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, n_words, term, positions): the posting lists of every text, and one row with a null term per text.

    With ``terms`` only the lists of terms in their hash slots are stored. Null texts have no words. Rows that repeat
    a document give repeated postings.
    """
    bits = _slots(terms)

    def run(batches):
        names = ["doc", "text_hash", "n_words", "term", "positions"]
        for batch in batches:
            for part in sliced(batch, "_text"):
                words = Words(texts_of(part, "_text"), ALNUM)
                n = np.diff(words.starts)
                at = np.flatnonzero(_wanted(bits, words.hashes))
                owner = words.text_of_words()[at]
                term, place = words.hashes[at].view(np.int64), at - words.starts[:-1][owner]
                order = np.lexsort((place, term, owner))
                owner, term, place = owner[order], term[order], place[order]
                new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])))) if len(at) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(len(n) + 1), np.append(new, len(at))[1:])).astype(np.int32)), pa.array(place.astype(np.int32)))
                rows = np.concatenate((np.arange(len(n)), owner[new]))
                blank = np.arange(len(rows)) < len(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), pa.array(np.concatenate((np.zeros(len(n), np.int64), term[new])), mask=blank), lists],
                    names=names,
                )

    slim = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc {kind}, text_hash long, n_words long, term long, positions array<int>")


def windows(items: DataFrame, counts: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, item_hash, term, place, others): each window's rarest term with its place in the item, and the next rarest ones.

    A window is ``size`` consecutive terms, or a whole shorter item. Windows that share their rarest terms are one.
    Every window is covered. Terms that the texts lack count 0, so that their windows match nothing.
    """
    flat = items.select("item", F.col("text_hash").alias("item_hash"), F.size("terms").alias("m"), F.posexplode("terms").alias("place", "term"))
    known = flat.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("place") - size + 1)
    last = F.least(F.col("place"), F.greatest(F.lit(0), F.col("m") - size))
    inside = known.withColumn("start", F.explode(F.sequence(first, last)))
    rank = F.row_number().over(W.partitionBy("item", "item_hash", "start").orderBy("n", "place"))
    chosen = inside.withColumn("rank", rank).where(F.col("rank") <= rarest)
    picked = chosen.groupBy("item", "item_hash", "start").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "term"))).alias("p"))
    other = lambda x: F.struct(x["place"].alias("place"), x["term"].alias("term"))
    others = F.transform(F.slice("p", 2, rarest), other)
    return picked.select("item", "item_hash", F.col("p")[0]["term"].alias("term"), F.col("p")[0]["place"].alias("place"), others.alias("others")).distinct()


def window_terms(sought: DataFrame) -> DataFrame:
    return sought.select(F.explode(F.concat(F.array("term"), F.transform("others", lambda o: o["term"]))).alias("term")).distinct()


def alignments(index: DataFrame, sought: DataFrame) -> DataFrame:
    """(doc, text_hash, item, item_hash, shift): where all rarest terms of a window stand at one offset between item and text.

    The rarest term's lists are moved by its place in the item; the next terms' lists, moved likewise, are intersected
    with what is left, joined by text and term. So a more frequent term's positions are looked up, never multiplied.
    """
    postings = index.where("term IS NOT NULL").select("doc", "text_hash", "term", "positions")
    led = postings.join(sought, "term").select("doc", "text_hash", "item", "item_hash", "others", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("shift"))
    alone = led.where("size(others) = 0").select("doc", "text_hash", "item", "item_hash", "shift")
    asked = led.select("doc", "text_hash", "item", "item_hash", "shift", F.xxhash64("others").alias("set"), F.size("others").alias("parts"), F.explode("others").alias("o"))
    asked = asked.withColumn("term", F.col("o.term")).withColumn("at", F.col("shift") + F.col("o.place")).drop("o").where("at >= 0").distinct()
    met = asked.join(postings, ["doc", "text_hash", "term"]).where("array_contains(positions, at)")
    agreed = met.groupBy("doc", "text_hash", "item", "item_hash", "shift", "set", "parts").agg(F.count_distinct("term", "at").alias("n")).where("n = parts")
    return agreed.select("doc", "text_hash", "item", "item_hash", "shift").union(alone).distinct()


def verify(df: DataFrame, found: DataFrame, items: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, n_hit, hits): per text with a candidate, the words inside occurrences of windows and the matched spans.

    ``hits`` are (item, start in the text, start in the item, words), exact and maximal per alignment.
    """
    sought = found.join(items.select("item", F.col("text_hash").alias("item_hash"), "terms"), ["item", "item_hash"])
    per = sought.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("item", "shift", "terms")).alias("sought"))
    slim = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("_text"))
    texts = narrowed(slim, found.select("doc"), "doc").join(per, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"])

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                words = Words(texts_of(part, "_text"), ALNUM)
                hashes, counts, hits = words.hashes.view(np.int64), [], []
                for i, todo in enumerate(part.column(3).to_pylist()):
                    own = hashes[words.starts[i] : words.starts[i + 1]]
                    marked, spans = np.zeros(len(own) + 1, np.int64), []
                    for x in todo:
                        terms, shift = np.array(x["terms"], np.int64), x["shift"]
                        a, b = max(0, shift), min(len(own), shift + len(terms))
                        least = min(size, len(terms))
                        same = np.concatenate(([False], own[a:b] == terms[a - shift : b - shift], [False]))
                        edges = np.flatnonzero(same[1:] != same[:-1])
                        for s, e in zip(edges[::2], edges[1::2]):
                            if e - s >= least:
                                marked[a + s] += 1
                                marked[a + e] -= 1
                                spans.append({"item": x["item"], "start": int(a + s), "item_start": int(a + s - shift), "words": int(e - s)})
                    counts.append(int((np.cumsum(marked) > 0).sum()))
                    hits.append(spans)
                kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["doc", "text_hash", "n_hit", "hits"])

    kind = slim.schema["doc"].dataType.simpleString()
    chosen = texts.select("doc", "text_hash", "_text", "sought")
    return chosen.mapInArrow(run, f"doc {kind}, text_hash long, n_hit long, hits array<struct<item:string,start:int,item_start:int,words:int>>").where("n_hit > 0")


def _indexed(df: DataFrame, benchmark: DataFrame, size: int, key: str, text: str, item: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The items, the counts of their terms in ``df``, their windows, and the stored index of the windows' rarest terms."""
    items = cut(item_terms(benchmark, item, item_text))
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    counts = stored(term_counts(df, vocabulary, text).join(vocabulary, "term", "left_semi"))
    sought = cut(windows(items, counts, size))
    return items, counts, sought, stored(build_index(df, window_terms(sought), key, text))


def _phrases(df: DataFrame, items: DataFrame, sought: DataFrame, index: DataFrame, size: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    return index.where("term IS NULL").select("doc", "text_hash", "n_words"), verify(df, cut(alignments(index, sought)), items, size, key, text)


def phrase_matches(df: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The headers (doc, text_hash, n_words) of all texts and the verified matches (doc, text_hash, n_hit, hits)."""
    items, _, sought, index = _indexed(df, benchmark, size, key, text, item, item_text)
    return _phrases(df, items, sought, index, size, key, text)


def proximity_matches(index: DataFrame, items: DataFrame, counts: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc, text_hash, item, start, spread): places where an item's two rarest terms stand, in any order, ``slop`` places apart at most.

    Ties go to the term that the item has first; an item of one term matches wherever it stands. The nearest two places
    of different terms are neighbours among the places of both, so a text's places are sorted once and only neighbours
    compared. The rarest two terms of an item are also the rarest of a window, so that an index of windows has them.
    Rows without a key match nothing.
    """
    flat = items.select("item", F.col("text_hash").alias("item_hash"), F.posexplode("terms").alias("place", "term")).groupBy("item", "item_hash", "term").agg(F.min("place").alias("place"))
    rank = F.row_number().over(W.partitionBy("item", "item_hash").orderBy("n", "place"))
    chosen = flat.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", rank).where("rank <= 2")
    of_item = W.partitionBy("item", "item_hash")
    # a term that no text has rules its item out, before any list is read
    parts = chosen.withColumn("parts", F.count("*").over(of_item)).withColumn("least", F.min("n").over(of_item)).where("least > 0").select("item", "item_hash", "term", "rank", "parts")
    lists = index.where("term IS NOT NULL AND doc IS NOT NULL").select("doc", "text_hash", "term", "positions").join(parts, "term")
    alone = lists.where("parts = 1").select("doc", "text_hash", "item", F.explode("positions").alias("start"), F.lit(0).alias("spread"))
    in_text = W.partitionBy("doc", "text_hash", "item", "item_hash")
    both = lists.where("parts = 2").withColumn("ranks", F.size(F.collect_set("rank").over(in_text))).where("ranks = 2")
    places = both.select("doc", "text_hash", "item", "item_hash", "rank", F.explode("positions").alias("start")).distinct()
    before = lambda c: F.lag(c).over(in_text.orderBy("start"))
    near = places.select("*", before("start").alias("last"), before("rank").alias("other")).where((F.col("rank") != F.col("other")) & (F.col("start") - F.col("last") <= slop))
    return near.select("doc", "text_hash", "item", F.col("last").alias("start"), (F.col("start") - F.col("last")).alias("spread")).union(alone).distinct()


def decontaminate(df: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``df``; with ``slop`` also n_near, the items with a proximity match.

    A word inside any occurrence of a window of ``size`` consecutive item words (or of a whole shorter item) is hit. Null
    texts and items have no words; items of equal id count once. Rows that repeat a text give repeated rows. Other
    columns aren't read. Empty tables give no row, or no hit. Rows without a key have no hits.
    """
    items, counts, sought, index = _indexed(df, benchmark, size, key, text, item, item_text)
    headers, matches = _phrases(df, items, sought, index, size, key, text)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    hit = matches.select(F.col("doc").alias("_d"), F.col("text_hash").alias("_h"), "n_hit", ids.alias("ids"))
    if slop is not None:
        near = proximity_matches(index, items, counts, slop).groupBy(F.col("doc").alias("_d"), F.col("text_hash").alias("_h")).agg(F.count_distinct("item").alias("n_near"))
        hit = hit.join(near, ["_d", "_h"], "full")
    joined = headers.join(hit, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        F.col("doc").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if slop is not None else []),
    )


ORACLE = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, i FROM grams JOIN win USING (n, g)),
per AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
ip AS (SELECT item_id, w, t, min(pos) AS place FROM (SELECT item_id, w, unnest(w) AS t, unnest(range(len(w))) AS pos FROM (SELECT DISTINCT item_id, w FROM iw WHERE item_id IS NOT NULL)) GROUP BY ALL),
dt AS (SELECT doc_id, w, unnest(w) AS t, unnest(range(len(w))) AS pos FROM dw),
tn AS (SELECT t, count(*) AS n FROM dt GROUP BY t),
rk AS (SELECT item_id, w, t, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(n, 0), place) AS rank FROM ip LEFT JOIN tn USING (t) QUALIFY rank <= 2),
pair AS (SELECT item_id, max(t) FILTER (rank = 1) AS a, max(t) FILTER (rank = 2) AS b FROM rk GROUP BY item_id, w),
at1 AS (SELECT DISTINCT item_id, b, doc_id, w, pos FROM pair JOIN dt ON a = t),
near AS (SELECT doc_id, w, count(DISTINCT item_id) AS n_near FROM at1 WHERE b IS NULL OR list_contains(w[greatest(pos - {SLOP}, 0) + 1 : pos + {SLOP} + 1], b) GROUP BY doc_id, w),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id, w)
"""
