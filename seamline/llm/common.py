"""Helpers that the Arrow-backed operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at once; a single longer text makes a step of its own.
STEP_BYTES = 1 << 20
STEP_ROWS = 4096


def sliced(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column``, one row at least and STEP_ROWS at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))), start + STEP_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column as a contiguous string array without nulls (null: empty)."""
    found = pc.fill_null(batch.column(column), "")
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return pa.concat_arrays([found]) if found.offset == 0 else pa.concat_arrays([found.slice(0, 0), found])


def raw(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets (from 0) and the bytes of a string array without nulls."""
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = bytes(memoryview(data)[ends[0] : ends[-1]]) if data is not None and len(ends) else b""
    return ends - ends[0], whole


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table_of(separators: bytes, lower: bool = True) -> bytes:
    """A byte-for-byte translation: A-Z to lower case, separators to blanks, all else as it is."""
    return bytes(32 if b in separators else b + 32 if lower and 65 <= b <= 90 else b for b in range(256))


#: Words are runs of anything but ASCII white space.
SPACED = table_of(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII digits and letters and of all bytes beyond ASCII.
ALNUM = table_of(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_WINDOW = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _hashed(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin])


class Words:
    """The words of some texts: ``starts`` (index of each text's first word, one more at the end), ``hashes`` (64 bits
    each, alike everywhere), ``begin`` and ``end`` (byte places in ``data``), ``offsets`` of the texts in ``data``."""

    def __init__(self, texts: pa.Array, table: bytes):
        self.offsets, data = raw(texts)
        self.data = data.translate(table)
        b = np.frombuffer(self.data, np.uint8)
        inside = b != 32
        edge = np.zeros(len(b) + 1, bool)  # a word ends where its text does
        edge[self.offsets] = True
        self.begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        self.end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        self.starts = np.searchsorted(self.begin, self.offsets)
        if len(b) <= _WINDOW:
            self.hashes = _hashed(b, self.begin, self.end)
        else:  # long texts in windows that end with a word
            parts, first = [], 0
            while first < len(self.begin):
                base = self.begin[first]
                last = max(first + 1, int(np.searchsorted(self.end, base + _WINDOW, side="right")))
                parts.append(_hashed(b[base : self.end[last - 1]], self.begin[first:last] - base, self.end[first:last] - base))
                first = last
            self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def runs(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``width`` words within a text, and its text; a shorter text with words is one run."""
    n = np.diff(starts)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes)) - starts[:-1][text]
    full = np.flatnonzero(at + width <= n[text])
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value = value * np.uint64(0xA24BAED4963EE407) + hashes[full + k]
    short = np.flatnonzero((n > 0) & (n < width))
    brief = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        there = n[short] > k
        brief[there] = brief[there] * np.uint64(0x9FB21C651E98DF25) + hashes[starts[:-1][short[there]] + k]
    return mix(np.concatenate((value, brief + n[short].astype(np.uint64)))), np.concatenate((text[full], short))


#: Slots of a bounded filter: at most so many whole numbers are ever broadcast by ``narrowed``.
SLOTS = 1 << 18


def narrowed(df, ids, key: str):
    """Rows of ``df`` that may have a key in ``ids``: a cheap filter on the map side, before a join on ``key``.

    Keys are hashed to SLOTS slots, so the broadcast has at most that many rows whatever the input is; where most slots
    are taken, all rows pass and the join that follows does the work.
    """
    from pyspark.sql import functions as F

    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS))
    taken = ids.select(slot.alias("_slot")).distinct()
    return df.withColumn("_slot", slot).join(F.broadcast(taken), "_slot", "left_semi").drop("_slot")


def without(df, ids, key: str):
    """Rows of ``df`` whose key isn't in ``ids`` (null keys stay). Rows in hash slots that no id has pass without a shuffle."""
    from pyspark.sql import functions as F

    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS))
    taken = F.broadcast(ids.select(slot.alias("_slot")).distinct())
    marked = df.withColumn("_slot", slot)
    sure = marked.join(taken, "_slot", "left_anti").drop("_slot")
    return sure.unionByName(marked.join(taken, "_slot", "left_semi").drop("_slot").join(ids, key, "left_anti"))
