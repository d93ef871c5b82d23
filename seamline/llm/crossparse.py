"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed greedily into the longest phrases that
occur in that text; the language that needs the fewest phrases, each weighed by the bits that point to a phrase, wins.

The automata are fitted on a bounded sample: ``docs`` texts a language, drawn by hash, of which ``chars`` characters in
all are used, from places in the whole text that a hash chooses. Everything else covers whole texts: pieces of PIECE
characters are parsed side by side, and where a piece begins within a phrase it is parsed anew from there, until both
ways are in one state.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.common import sliced, texts_of

DOCS = 96
CHARS = 20_000
PIECE = 512
#: The most frequent letters have a column of their own in the automata; the others' transitions are looked up.
LETTERS = 120
#: Bits of advantage that halve the odds of the other languages by this many times less.
TEMPER = 8.0


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = DOCS, chars: int = CHARS) -> DataFrame:
    """(lang, text): at most ``docs`` rows a language and 4 * chars / docs characters a row, drawn by the key's hash.

    The characters of a row begin at a place of its whole text that the hash chooses, and go on from the text's start
    where it ends.

    One draw for each of ``docs`` hash buckets; minima are aggregated before the shuffle, and the text is read for the
    drawn rows only.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"), h.alias("_h"))
    drawn = rows.where(F.length("_text") > 0).groupBy("_lang", F.pmod("_h", F.lit(docs)).alias("b")).agg(F.min("_h").alias("_m"))
    # at most ``docs`` rows for each language
    picked = rows.join(F.broadcast(drawn.select(F.col("_lang").alias("l"), "_m")), (F.col("_lang") == F.col("l")) & (F.col("_h") == F.col("_m")))
    size = F.length("_text")
    place = F.pmod(F.xxhash64("_h"), size).cast("int")
    most = 4 * chars // docs
    turned = F.concat(F.substring("_text", place + 1, F.lit(most)), F.when(place > 0, F.concat(F.lit(" "), F.substring("_text", F.lit(1), F.least(place, F.lit(most))))).otherwise(""))
    return picked.select(F.col("_lang").alias("lang"), F.substring(turned, 1, most).alias("text"), "_h").dropDuplicates(["lang", "_h"]).select("lang", "text")


def transitions(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of a sequence of codes."""
    go, link, longest = [{}], [-1], [0]
    last = 0
    for c in codes:
        now = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return go


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The transitions (states x width; 0: none) of the suffix automaton of a sequence of codes below ``width``."""
    go = transitions(codes)
    out = np.zeros((len(go), width), np.int32)
    for i, row in enumerate(go):
        for c, t in row.items():
            out[i, c] = t
    return out


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


class Model:
    """``langs``, the class of each character (0: no letter, 1: a letter that the sample lacks), and the joined automata."""

    def __init__(self, texts: dict[str, list[str]], chars: int = CHARS, letters: int = LETTERS):
        self.langs = sorted(texts)
        counts: dict[str, int] = {}
        joined = {}
        for lang in self.langs:
            parts = sorted(folded(t) for t in texts[lang])
            # every drawn text gives a like share
            share = max(1, chars // max(1, len(parts)))
            taken = " ".join(p[:share] for p in parts)
            rest = " ".join(p[share:] for p in parts)
            joined[lang] = (taken + " " + rest)[:chars]
            for c in joined[lang]:
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        self.kinds = np.zeros(sys.maxunicode + 1, np.int32)
        self.kinds[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = 1
        for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))):
            self.kinds[ord(c)] = i + 2
        self.codes = int(self.kinds.max()) + 1
        self.width = min(self.codes, letters + 2)
        tables, rare, self.roots, self.bits = [], [], [], []
        base = 0
        for lang in self.langs:
            codes = squeeze(self.kinds[np.frombuffer(joined[lang].encode("utf-32-le", "replace"), np.uint32)]).tolist()
            go = transitions(codes)
            table = np.zeros((len(go), self.width), np.int32)
            for i, row in enumerate(go):
                for c, t in row.items():
                    if c < self.width:
                        table[i, c] = t + base
                    else:
                        rare.append(((i + base) * self.codes + c, t + base))
            tables.append(table)
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(codes))))
            base += len(table)
        # one row in front stands for "none", so that root 0 is never a target
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
        self.roots, self.bits = np.array(self.roots, np.int32), np.array(self.bits)
        rare.sort()
        self.rare_keys, self.rare_next = np.array([r[0] for r in rare], np.int64), np.array([r[1] for r in rare], np.int32)

    def follow(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states (languages x texts) after the codes ``char`` of the texts; 0: none."""
        wide = np.flatnonzero(char >= self.width)
        if not len(wide):
            return self.table.take(state * self.width + char)
        # no state has a transition by 1
        after = self.table.take(state * self.width + np.where(char < self.width, char, 1))
        keys = np.broadcast_to(state, after.shape)[:, wide].astype(np.int64) * self.codes + char[wide]
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        after[:, wide] = np.where(self.rare_keys[at] == keys, self.rare_next[at], 0)
        return after


def squeeze(kinds: np.ndarray) -> np.ndarray:
    """Runs of non-letters become one."""
    return kinds[(kinds != 0) | np.concatenate(([True], kinds[:-1] != 0))] if len(kinds) else kinds


def phrases(model: Model, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts x languages): phrases of each text, given the character classes of all texts and where each begins."""
    sizes = np.diff(starts)
    pieces = -(-sizes // PIECE)
    text = np.repeat(np.arange(len(sizes)), pieces)
    first = np.cumsum(pieces) - pieces
    part = np.arange(len(text)) - first[text]
    begin = starts[:-1][text] + part * PIECE
    size = np.minimum(PIECE, starts[1:][text] - begin)
    roots = model.roots[:, None]
    # every piece from the root: states and phrases ended after each of its characters
    at = np.arange(PIECE)[:, None]
    chars = kinds[np.minimum(begin + at, max(len(kinds) - 1, 0))].astype(np.int32) if len(text) else np.zeros((PIECE, 0), np.int32)
    width = int(size.max(initial=0))
    states = np.zeros((width, len(model.langs), len(text)), np.int32)
    ended = np.zeros((width, len(model.langs), len(text)), np.int16)
    state = np.broadcast_to(roots, (len(model.langs), len(text))).copy()
    count = np.zeros(state.shape, np.int16)
    for t in range(width):
        state, more = _next(model, state, chars[t])
        count = count + more
        states[t], ended[t] = state, count
    lane = np.arange(len(text))
    last = states[size - 1, :, lane].T.copy() if len(text) else state  # languages x pieces
    total = ended[size - 1, :, lane].T.astype(np.int64) if len(text) else count.astype(np.int64)
    # pieces that don't begin a text and come in another state than the root
    todo = np.zeros(last.shape, bool)
    todo[:, 1:] = (part[1:] > 0) & (last[:, :-1] != roots)
    while todo.any():
        lang, piece = np.nonzero(todo)
        todo = np.zeros(last.shape, bool)
        state = last[lang, piece - 1]
        n = np.zeros(len(piece), np.int64)
        for t in range(width):
            state, more = _next(model, state, chars[t, piece], lang)
            n += more
            met = (state == states[t, lang, piece]) | (t + 1 == size[piece])
            if met.any():
                own, which = lang[met], piece[met]
                same = state[met] == states[t, own, which]
                end = size[which] - 1
                total[own, which] = n[met] + np.where(same, ended[end, own, which] - ended[t, own, which], 0)
                after = np.where(same, states[end, own, which], state[met])
                changed = after != last[own, which]
                last[own, which] = after
                # the next piece of the text is parsed again where this one now ends otherwise
                follow = which[changed] + 1
                there = (follow < len(text)) & (part[np.minimum(follow, len(text) - 1)] > 0)
                todo[own[changed][there], follow[there]] = True
                lang, piece, state, n = lang[~met], piece[~met], state[~met], n[~met]
            if not len(piece):
                break
    out = np.zeros((len(sizes), len(model.langs)), np.int64)
    ends = np.flatnonzero(np.append(part[1:] == 0, True)) if len(text) else np.zeros(0, np.int64)
    for i in range(len(model.langs)):
        out[:, i] = np.bincount(text, weights=total[i], minlength=len(sizes))
        out[text[ends], i] += last[i, ends] != model.roots[i]
    return out


def _next(model: Model, state: np.ndarray, char: np.ndarray, lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The states after one more character, and whether a phrase ended before it. ``state``: languages x texts, or one a text with its ``lang``."""
    roots = model.roots[:, None] if lang is None else model.roots[lang]
    after = model.follow(state, char) if lang is None else model.follow(state[None], char)[0]
    ends = after == 0
    again = model.follow(roots, char) if lang is None else model.follow(roots[None], char)[0]
    again = np.where(again == 0, roots, again)
    return np.where(ends, again, after), ends


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = DOCS, chars: int = CHARS) -> Model:
    """Fit on the labelled rows of ``df``. The sample that comes to the driver is bounded for each language (see sample())."""
    texts: dict[str, list[str]] = {}
    for row in sample(df, key, text, lang, docs, chars).toLocalIterator():
        texts.setdefault(row.lang, []).append(row.text)
    return Model(texts, chars)


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(key, lang_pred, score, bits_per_char), or all columns and these where ``carry`` is set (columns of these names are replaced): one row per row of ``df``, whole texts, no shuffle.

    ``und`` with score 0 for a null text, a text without letters, or a model without languages; ties go to the first
    language by name. ``score`` is the winner's share of tempered odds. Other columns aren't read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "bits_per_char"]
    if carry:
        slim = df.drop(*new)
        column, olds = text, slim.columns
    else:
        slim = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
        column, olds = "_text", [key]

    def run(batches):
        m = shared.value
        labels = np.array([*m.langs, "und"], object)
        for batch in batches:
            for part in sliced(batch, column):
                texts = [t.replace("\0", " ") for t in texts_of(part, column).to_pylist()]
                codes = np.frombuffer("\0".join([*map(folded, texts), ""]).encode("utf-32-le", "replace"), np.uint32)
                kinds = m.kinds[codes]
                keep = (kinds != 0) | np.concatenate(([True], kinds[:-1] != 0))
                ends = np.flatnonzero(codes == 0)
                keep[ends] = False
                kept = np.concatenate(([0], np.cumsum(keep)))
                starts = kept[np.concatenate(([0], ends + 1))][: len(texts) + 1]
                kinds = kinds[keep]
                n = np.diff(starts)
                letters = np.add.reduceat(np.append(kinds != 0, False).astype(np.int64), starts[:-1]) * (n > 0) if len(n) else n
                if m.langs:
                    bits = phrases(m, kinds, starts) * m.bits
                    best = bits.argmin(axis=1)
                    odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) / TEMPER)
                    score = 1 / odds.sum(axis=1)
                    low = bits.min(axis=1) / np.maximum(n, 1)
                else:
                    best, score, low = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n))
                none = (letters == 0) | (not m.langs)
                best = np.where(none, len(m.langs), best)
                old = [part.column(c) for c in olds]
                yield pa.RecordBatch.from_arrays([*old, pa.array(labels[best], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, 0.0, low))], names=[*olds, *new])

    schema = T.StructType([slim.schema[c] for c in olds]).add("lang_pred", "string").add("score", "double").add("bits_per_char", "double")
    return slim.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that no model is fitted on: crc32(key as text) mod 3 is 1. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def learnable(key: str = "doc_id"):
    """Rows that a model may be fitted on: those with a key that aren't held out."""
    return F.col(key).isNotNull() & ~held_out(key)
