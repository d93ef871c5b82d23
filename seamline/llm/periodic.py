"""Runs of words: stretches that repeat a period three times or more, found by block convolution.

At each dyadic scale the words are cut into blocks of L. A number-theoretic transform gives, for a block and the distances
of its scale, the sums of squared differences to the words that follow; a sum of zero is an occurrence. Each distance is a
seed that is extended as far as words agree. Periods from L to 2 L - 1 show at scale L, and those below at the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import sliced, texts_of

#: 3 * 2**30 + 1, a prime; 5 generates its units. Products of two residues fit into 64 bits.
PRIME, UNIT = 3221225473, 5
#: The first scale. A run of LEAST words or more, three periods or more, holds an aligned block of its scale and that
#: block's next occurrence: with period q at scale L, LEAST - q >= 2 L - 1 for q < L = FIRST, and 2 q >= 2 L - 1 above.
FIRST, LEAST, TIMES = 8, 24, 3
#: Numbers that one transform step holds at once; a larger block makes a step of its own.
STEP = 1 << 18
FAR = np.iinfo(np.int64).max >> 1


def powers(root: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(root, done, PRIME)) % PRIME
        done += more
    return out


def forward(a: np.ndarray) -> np.ndarray:
    """The transform of each column, in bit-reversed order, in place. The number of rows is a power of two."""
    n, m = a.shape
    size = n
    while size > 1:
        w = powers(pow(UNIT, (PRIME - 1) // size, PRIME), size // 2)[:, None]
        v = a.reshape(n // size, 2, size // 2, m)
        low, high = v[:, 0], v[:, 1]
        total = (low + high) % PRIME
        v[:, 1] = (low + (PRIME - high)) % PRIME * w % PRIME
        v[:, 0] = total
        size //= 2
    return a


def backward(a: np.ndarray) -> np.ndarray:
    """The inverse of ``forward``, in place."""
    n, m = a.shape
    size = 2
    while size <= n:
        w = powers(pow(UNIT, PRIME - 1 - (PRIME - 1) // size, PRIME), size // 2)[:, None]
        v = a.reshape(n // size, 2, size // 2, m)
        high = v[:, 1] * w % PRIME
        low = v[:, 0].copy()
        v[:, 0] = (low + high) % PRIME
        v[:, 1] = (low + (PRIME - high)) % PRIME
        size *= 2
    a *= np.uint64(pow(n, PRIME - 2, PRIME))
    a %= PRIME
    return a


def mismatches(x: np.ndarray, begin: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """(distances from low to high - 1) x (blocks): the sum of squared differences, modulo PRIME, of the block of ``size``
    at each of ``begin`` to the words that far on. ``x`` reaches to the last word that is looked at."""
    span = size + high - low - 1
    n = 1 << (span - 1).bit_length()
    block = np.zeros((n, len(begin)), np.uint64)
    block[(-np.arange(size)) % n] = mine = x[begin + np.arange(size)[:, None]]
    later = np.zeros((n, len(begin)), np.uint64)
    later[:span] = x[begin + (low + np.arange(span))[:, None]]
    squares = np.zeros((span + 1, len(begin)), np.uint64)
    np.cumsum(later[:span] * later[:span] % PRIME, axis=0, out=squares[1:])
    theirs = squares[size:] - squares[: high - low]
    own = (mine * mine % PRIME).sum(axis=0, dtype=np.uint64)
    product = backward(forward(block) * forward(later) % PRIME)[: high - low]
    return (own + theirs + 2 * (PRIME - product)) % PRIME


def extent(x: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many places from ``at`` on, in steps of 1 or -1, have the same word as the place ``distance`` further on."""
    found, size = 0, 64
    room = len(x) - distance - at if step > 0 else at + 1
    while found < room:
        size = min(size, room - found)
        first = at + found if step > 0 else at - found - size + 1
        unlike = x[first : first + size] != x[first + distance : first + distance + size]
        if unlike.any():
            return found + int((unlike if step > 0 else unlike[::-1]).argmax())
        found += size
        size *= 2
    return found


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of codes from 0 on, by period. ``longest``: of the texts in it; a
    code that is unique (a mark between texts) is in no run.

    A block with a word that isn't used again in reach of its scale has no occurrence there and isn't transformed; nor is
    one all of whose reach lies in a known run: what occurs at a distance there has that run's period.
    """
    n = len(words)
    key = (words.astype(np.int64) << 32) | np.arange(n)
    key.sort()
    place = key & 0xFFFFFFFF
    again = np.full(n, FAR)
    same = np.flatnonzero((key[1:] >> 32) == (key[:-1] >> 32))
    again[place[same]] = place[same + 1] - place[same]
    runs: list[tuple[int, int, int]] = []
    size = FIRST
    furthest = np.append(again, np.full(-n % size, FAR)).reshape(-1, size).max(axis=1)
    while TIMES * (size if size > FIRST else 1) <= longest and longest >= LEAST:
        low, high = (1 if size == FIRST else size), 2 * size
        live = furthest < high
        for start, length, _ in runs:
            live[-(-start // size) : max(0, (start + length - size - high + 1) // size + 1)] = False
        begin = np.flatnonzero(live) * size
        if len(begin):
            x = np.concatenate((words.astype(np.uint64), np.arange(n, n + size + high, dtype=np.uint64)))
            step = max(1, STEP // (4 * size))
            seeds = []
            for i in range(0, len(begin), step):
                d, b = np.nonzero(mismatches(x, begin[i : i + step], size, low, high) == 0)
                seeds.append(np.stack((d + low, begin[i : i + step][b])))
            runs += extended(words, np.concatenate(seeds, axis=1), size, runs)
        size *= 2
        furthest = np.append(furthest, [FAR] * (len(furthest) % 2)).reshape(-1, 2).max(axis=1)
    return runs


def extended(words: np.ndarray, seeds: np.ndarray, size: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """New runs from seeds (distances, blocks) of one scale. ``known`` holds the runs of shorter periods.

    A seed within a known run of period ``size`` at most, or within what the same distance gave before, tells nothing new:
    two periods of a stretch as long as both have their common divisor as a period.
    """
    seeds = seeds[:, np.lexsort((seeds[1], seeds[0]))]
    distances, firsts = np.unique(seeds[0], return_index=True)
    found: list[tuple[int, int, int]] = []
    starts = reach = None
    for d, begins in zip(distances.tolist(), np.split(seeds[1], firsts[1:])):
        if starts is None or found and found[-1][2] <= size:
            shorter = sorted((s, s + length) for s, length, q in known + found if q <= size)
            starts = np.array([s for s, _ in shorter], np.int64)
            reach = np.maximum.accumulate(np.array([0, *(e for _, e in shorter)], np.int64))
        begins = begins[reach[np.searchsorted(starts, begins, side="right")] < begins + d + size]
        end = 0
        for b in begins.tolist():
            if b + d + size <= end or b + d + size > len(words) or (words[b : b + size] != words[b + d : b + d + size]).any():
                continue
            start = b - extent(words, b - 1, d, -1)
            end = b + size + extent(words, b + size, d, 1) + d
            if end - start >= max(LEAST, TIMES * d):
                found.append((start, end - start, d))
    return found


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The code of each word of some texts, where each text's words begin (one more at the end), and the words by code."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    starts = np.concatenate(([0], np.cumsum(full)))[offsets]
    coded = pc.dictionary_encode(flat.filter(pa.array(full)))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary


def runs_of(codes: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period."""
    n = len(starts) - 1
    text = np.repeat(np.arange(n), np.diff(starts))
    joined = np.arange(len(codes) + n) + len(codes)
    joined[np.arange(len(codes)) + text] = codes
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    shifted = starts[:-1] + np.arange(n)
    for start, length, period in find_runs(joined, int(np.diff(starts).max(initial=0))):
        i = int(np.searchsorted(shifted, start, side="right")) - 1
        out[i].append((start - int(shifted[i]), length, period))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed): the runs of each whole text's words, and the text without what runs repeat. One row for each row.

    ``runs``: array of (start, length, period) by start, then period: the maximal stretches of words with that smallest
    period and at least max(LEAST, TIMES * period) words. ``collapsed``: the words, joined by blanks, that no run holds
    after its first period. Words are what stands between ASCII white space. Null and empty texts have no runs and an empty
    ``collapsed``; rows that repeat and null keys are as any other. Other columns aren't read. No shuffle; a task holds
    about a megabyte of text at once, or one text.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in sliced(batch, "_text"):
                codes, starts, words = word_codes(texts_of(part, "_text"))
                found = runs_of(codes, starts)
                keep = np.ones(len(codes), bool)
                for base, own in zip(starts.tolist(), found):
                    for start, length, period in own:
                        keep[base + start + period : base + start + length] = False
                ends = np.concatenate(([0], np.cumsum(keep)))[starts]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(codes[keep])))
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(rows, kind), pc.binary_join(lists, " ")], names=["_key", "runs", "collapsed"])

    kind = dict(slim.dtypes)["_key"]
    return slim.mapInArrow(run, f"_key {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").withColumnRenamed("_key", key)


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): ``df`` with every tenth text, by crc32 of its key, made to repeat itself from some word on. A null key's text stays."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("_words")
    chosen = df.select(key, text, F.when(h % 10 == 0, words).alias("_words"), g.alias("_g")).withColumn("_a", F.when(n > 0, F.col("_g") % n))
    chosen = chosen.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    a = F.col("_a").cast("int")
    again = F.transform(F.sequence(a, n - 1), lambda i: F.get("_words", (a + (i - a) % F.col("_p")).cast("int")))
    return chosen.select(key, F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice("_words", 1, a), again), " ")).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row of figures for each row of ``periodic_runs``: the run of greatest exact length / period, the first of equals, and digests."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select(key, "collapsed", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"), lines.alias("lines"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return best.select(key, "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
