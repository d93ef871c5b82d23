"""Media columns: Matroska files as binary columns, parsed into packet and cue tables.

The parser reads variable-length EBML elements (unknown sizes of Segment and Cluster included), clusters, simple
blocks and block groups, the three kinds of lacing, and cues. The writer makes the files that the round trip needs.
Every row is handled alone, in Arrow batches, so nothing is shuffled and no state outlives a batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import sliced

# Element ids of the Matroska format.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose children are read.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACES = ("none", "xiph", "fixed", "ebml")

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32


# ---------------------------------------------------------------- writing
def vint(n: int) -> bytes:
    """A number as an EBML variable-length integer of the least length (all ones is kept free)."""
    length = 1
    while n >= (1 << (7 * length)) - 1:
        length += 1
    return (n | 1 << (7 * length)).to_bytes(length, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: str) -> bytes:
    """The body of a block after its flags: the lace header, then the frames."""
    sizes = [len(f) for f in frames]
    head = b"" if kind == "none" else bytes([len(frames) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += vint(sizes[0])
        for before, n in zip(sizes[:-2], sizes[1:-1]):
            head += signed_vint(n - before)
    return head + b"".join(frames)


def signed_vint(n: int) -> bytes:
    length = 1
    while not -(1 << (7 * length - 1)) < n < (1 << (7 * length - 1)):
        length += 1
    return (n + (1 << (7 * length - 1)) - 1 | 1 << (7 * length)).to_bytes(length, "big")


def write(payload: bytes, laces: tuple[str, ...] = ("fixed", "ebml", "xiph")) -> bytes:
    """A file with one 8-bit PCM track. ``payload`` is a positive multiple of 576 bytes; blocks take turns in lacing."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS))
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000)
    track += element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues, turn = sum(map(len, parts)), [], 0
    per = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for first in range(0, len(frames), per):
        begin = first * FRAME_MS
        body = [number(TIMESTAMP, begin)]
        for k in range(first, min(first + per, len(frames)), FRAMES_A_BLOCK):
            group = frames[k : min(k + FRAMES_A_BLOCK, first + per)]
            kind = laces[turn % len(laces)] if len(group) > 1 else "none"
            turn += 1
            head = b"\x81" + struct.pack(">h", k * FRAME_MS - begin) + bytes([0x80 | LACES.index(kind) << 1])
            body.append(element(SIMPLE_BLOCK, head + lace(group, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, begin) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska")
    head += number(0x4287, 4) + number(0x4285, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- reading
class Malformed(ValueError):
    """The bytes aren't a whole Matroska file."""


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """The number at ``at`` and the place after it; None for an unknown size (all ones)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise Malformed(f"cut off at {at}")
    n = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return n, at + length
    n ^= 1 << (7 * length)
    return (None if n == (1 << (7 * length)) - 1 else n), at + length


def elements(data, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """Each element under ``parent``: id, start and end of its body. An unknown size ends with the parent or a sibling of its level."""
    while at < end:
        key, body = read_vint(data, at, True)
        size, body = read_vint(data, body)
        if size is None:
            if key not in (SEGMENT, CLUSTER):
                raise Malformed(f"unknown size of {key:#x}")
            stop = end
            if key == CLUSTER:
                stop = body
                while stop < end:
                    below, after = read_vint(data, stop, True)
                    if below in TOP_LEVEL:
                        break
                    n, after = read_vint(data, after)
                    stop = after + (n or 0)
        else:
            stop = body + size
        if stop > end:
            raise Malformed(f"{key:#x} reaches beyond its parent")
        yield key, body, stop
        at = stop


def unsigned(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frames_of(data, at: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """A block's track, relative time, flags, lacing, and the byte range of each frame."""
    track, at = read_vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = LACES[flags >> 1 & 3]
    if kind == "none":
        return track, time, flags, kind, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "fixed":
        if (end - at) % n:
            raise Malformed("frames of unequal size under fixed lacing")
        sizes = [(end - at) // n] * n
    elif kind == "xiph":
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
            sizes.append(size)
    elif n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            step, at = unsigned(data, at, at + length) ^ 1 << (7 * length), at + length
            size += step - (1 << (7 * length - 1)) + 1
            sizes.append(size)
    if len(sizes) < n:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise Malformed("the frames' sizes don't fill their block")
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, time, flags, kind, ranges


def parse(data: bytes) -> dict:
    """``doc_type``, ``scale`` (ns), ``tracks`` (number: codec, rate, channels, bits, default duration in ns), ``clusters``, ``cues`` and ``packets``.

    A packet is (track, timestamp, duration, offset, size, keyframe, lacing); times are in ticks of ``scale``.
    """
    out = {"doc_type": "", "scale": 1_000_000, "tracks": {}, "clusters": [], "cues": [], "packets": []}
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Malformed("no EBML header")
    for key, a, b in elements(data, top[0][1], top[0][2], EBML):
        if key == DOC_TYPE:
            out["doc_type"] = bytes(data[a:b]).decode()
    for segment, a, b in top[1:]:
        if segment != SEGMENT:
            continue
        base = a
        for key, x, y in elements(data, a, b, SEGMENT):
            if key == INFO:
                out["scale"] = next((unsigned(data, p, q) for k, p, q in elements(data, x, y) if k == TIMESTAMP_SCALE), out["scale"])
            elif key == TRACKS:
                for k, p, q in elements(data, x, y):
                    if k == TRACK_ENTRY:
                        track = {"codec": "", "rate": 8000.0, "channels": 1, "bits": None, "default": None}
                        n = 0
                        for kk, pp, qq in elements(data, p, q):
                            if kk == TRACK_NUMBER:
                                n = unsigned(data, pp, qq)
                            elif kk == CODEC_ID:
                                track["codec"] = bytes(data[pp:qq]).decode()
                            elif kk == DEFAULT_DURATION:
                                track["default"] = unsigned(data, pp, qq)
                            elif kk == AUDIO:
                                for k3, p3, q3 in elements(data, pp, qq):
                                    if k3 == SAMPLING_FREQUENCY:
                                        track["rate"] = struct.unpack(">d" if q3 - p3 == 8 else ">f", data[p3:q3])[0]
                                    elif k3 == CHANNELS:
                                        track["channels"] = unsigned(data, p3, q3)
                                    elif k3 == BIT_DEPTH:
                                        track["bits"] = unsigned(data, p3, q3)
                        out["tracks"][n] = track
            elif key == CLUSTER:
                out["clusters"].append(x)
                now = 0
                for k, p, q in elements(data, x, y):
                    if k == TIMESTAMP:
                        now = unsigned(data, p, q)
                    elif k == SIMPLE_BLOCK:
                        add(out, data, p, q, now, None, None)
                    elif k == BLOCK_GROUP:
                        inside = {kk: (pp, qq) for kk, pp, qq in elements(data, p, q)}
                        if BLOCK in inside:
                            lasts = unsigned(data, *inside[BLOCK_DURATION]) if BLOCK_DURATION in inside else None
                            add(out, data, *inside[BLOCK], now, lasts, REFERENCE_BLOCK not in inside)
            elif key == CUES:
                for k, p, q in elements(data, x, y):
                    if k == CUE_POINT:
                        time, at = 0, []
                        for kk, pp, qq in elements(data, p, q):
                            if kk == CUE_TIME:
                                time = unsigned(data, pp, qq)
                            elif kk == CUE_POSITIONS:
                                found = {k3: unsigned(data, p3, q3) for k3, p3, q3 in elements(data, pp, qq)}
                                at.append((found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
                        out["cues"] += [(time, track, offset) for track, offset in at]
    return out


def add(out: dict, data, at: int, end: int, now: int, lasts: int | None, key: bool | None) -> None:
    """The packets of one block. Laced frames follow each other by the block's share or the track's default duration."""
    track, time, flags, kind, ranges = frames_of(data, at, end)
    default = out["tracks"].get(track, {}).get("default")
    each = lasts // len(ranges) if lasts is not None else default // out["scale"] if default else None
    for i, (offset, size) in enumerate(ranges):
        out["packets"].append((track, now + time + i * (each or 0), each, offset, size, bool(flags & 0x80) if key is None else key, kind))


# ---------------------------------------------------------------- operators
def padded(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of 576; 255 is in no UTF-8 text, so the text's end can be found again."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One Matroska file per row: (key, media). A null text counts as empty; other columns are not read, repeated rows give equal rows."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                files = [write(padded(x or b"")) for x in part.column("_text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], names=[key, "media"])

    slim = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, media binary")


def parsed(data: bytes) -> tuple[dict | None, str | None]:
    """What ``parse`` finds, or why the bytes can't be read: damage ends with the file it is in."""
    try:
        found = parse(data)
        if any(not -(1 << 63) <= x < 1 << 63 for row in (*found["packets"], *found["cues"]) for x in row if type(x) is int):
            raise Malformed("a number beyond 64 bits")
    except (ValueError, IndexError, ArithmeticError, struct.error) as e:
        return None, f"{type(e).__name__}: {e}"
    return found, None


def packets(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The packet table: one row per frame, with track, timestamp, duration, byte range, keyframe flag and lacing. Null media: no rows.

    A file that can't be read has one row, with ``error`` and nulls.
    """

    def run(batches):
        names = [key, "packet", "track", "timestamp", "duration", "offset", "size", "keyframe", "lacing", "error"]
        for batch in batches:
            for part in sliced(batch, "_media"):
                keys, rows = part.column(0).to_pylist(), []
                for k, data in zip(keys, part.column(1).to_pylist()):
                    if data is not None:
                        found, error = parsed(data)
                        rows += [(k, i, *p, None) for i, p in enumerate(found["packets"])] if found else [(k, *[None] * 8, error)]
                arrays = [pa.array([r[i] for r in rows], part.schema.field(0).type if i == 0 else t) for i, t in enumerate([None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    slim = df.select(F.col(key), F.col(media).alias("_media"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, packet long, track long, timestamp long, duration long, offset long, size long, keyframe boolean, lacing string, error string")


def cues(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """The cue table: one row per cue point and track, with the cluster's byte offset in the file. Null media: no rows.

    A file that can't be read has one row, with ``error`` and nulls.
    """

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_media"):
                rows = []
                for k, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if data is not None:
                        found, error = parsed(data)
                        rows += [(k, *c, None) for c in found["cues"]] if found else [(k, None, None, None, error)]
                arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()])]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "time", "track", "cluster_offset", "error"])

    slim = df.select(F.col(key), F.col(media).alias("_media"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, time long, track long, cluster_offset long, error string")


def read_back(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Parse each file again, join its packets' byte ranges into the payload, and describe payload, file and samples.

    ``feature`` has the numbers of packets, clusters and cues, the time in ms, and mean, standard deviation and mean
    absolute step of the samples. Null media: no row. Of a file that can't be read, or whose packets leave the file, only
    ``media_bytes``, ``media_sha256`` and ``error`` are known; one without packets has an empty payload.
    """
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def describe(data: bytes) -> tuple:
        found, error = parsed(data)
        stored = (len(data), hashlib.sha256(data).hexdigest())
        if found is None:
            return None, None, None, None, *stored, None, error
        payload = b"".join([data[p[3] : p[3] + p[4]] for p in found["packets"]])
        samples = np.frombuffer(payload, np.uint8)
        step = np.abs(np.diff(samples.astype(np.int16)))
        last = max(((p[1] + (p[2] or 0)) for p in found["packets"][-1:]), default=0)
        mean, std = (samples.mean(), samples.std()) if len(samples) else (0.0, 0.0)
        feature = (
            f"packets={len(found['packets'])};clusters={len(found['clusters'])};cues={len(found['cues'])};ms={last};"
            f"mean={mean:.3f};std={std:.3f};step={step.mean() if len(step) else 0.0:.3f}"
        )
        return len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature, None

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_media"):
                here = [(k, data) for k, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if data is not None]
                rows = [describe(data) for _, data in here]
                arrays = [pa.array([k for k, _ in here], part.schema.field(0).type)]
                arrays += [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    slim = df.select(F.col(key), F.col(media).alias("_media"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
