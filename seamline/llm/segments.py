"""Toxicity by maximum-scoring segments of token log-odds.

Words get the log-odds of their documents being toxic, under a Dirichlet prior, where these differ from 0 by enough
standard deviations. A linear scan finds all maximal scoring segments of a text. Their scores are calibrated by the
extreme-value law of such scores in clean text: E = K * n * exp(-lambda * S) segments are expected by chance.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE, drawn by hash). Words are 64-bit hashes. All words
of the sample are counted, and the model holds every word whose exact z is LEAST_Z or more; the sample is its only bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import ALNUM, SLOTS, Words, sliced, texts_of
from seamline.plans.lineage import stored

SAMPLE = 60_000
PRIOR = 0.5
LEAST_Z = 3.0
#: Score of a word that tells nothing; keeps the expected score of clean text below 0.
DRIFT = 0.1
THRESHOLD = 0.7
BINS = 400
ALPHA = 0.01


def maximal_segments(place: list[int], score: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) in one left-to-right scan of linear time.

    ``place`` and ``score`` list the words of other than the usual score, which is ``gap`` (negative) for all others.
    A candidate is kept with the total before it and after it, and with the nearest earlier candidate whose total before
    it is lower; a new candidate follows these links, so that one it has passed is never looked at again, and takes in
    those it improves on.
    """
    first, end, low, high, lower = [], [], [], [], []
    total, at = 0.0, 0
    for p, s in zip(place, score):
        total += gap * (p - at)
        at = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start = p
        j = len(first) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = lower[j]
            if j < 0 or high[j] >= total:
                break
            start, before, nearest = first[j], low[j], lower[j]
            del first[j:], end[j:], low[j:], high[j:], lower[j:]
            j = nearest
        first.append(start)
        end.append(p + 1)
        low.append(before)
        high.append(total)
        lower.append(j)
    return [(a, b, t - f) for a, b, f, t in zip(first, end, low, high)]


def log_odds(toxic, clean, n_toxic: float, n_clean: float, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of documents with a word to be toxic, smoothed by a Dirichlet prior, and their z scores."""
    a, b = np.asarray(toxic, float) + prior, np.asarray(clean, float) + prior
    delta = np.log(a / (n_toxic + 2 * prior - np.minimum(a, n_toxic + prior))) - np.log(b / (n_clean + 2 * prior - np.minimum(b, n_clean + prior)))
    return delta, delta / np.sqrt(1 / a + 1 / b)


class Model:
    """Words (sorted hashes) with their scores, lambda and K of the extreme-value law, and the final logistic curve."""

    def __init__(self, terms: np.ndarray, scores: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.scores = terms[order], scores[order]
        self.bits = np.zeros(SLOTS, bool)
        self.bits[self.terms & np.uint64(SLOTS - 1)] = True
        self.rate, self.scale, self.slope, self.shift = 1.0, 1e-6, 1.0, -8.0

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the model's words among ``hashes``, and their scores."""
        at = np.flatnonzero(self.bits[hashes & np.uint64(SLOTS - 1)])
        if not len(self.terms):
            return at[:0], self.scores
        i = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        hit = self.terms[i] == hashes[at]
        return at[hit], self.scores[i[hit]]

    def strength(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum over the segments of -ln E, as far as E is below 1: the evidence of all significant segments."""
        base = math.log(self.scale * max(n, 1))
        return sum(max(0.0, self.rate * s - base) for _, _, s in segments)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * x + self.shift))))


def _scan(model: Model, words: Words):
    """For each text: its maximal segments and its number of words."""
    at, scores = model.lookup(words.hashes)
    edges = np.searchsorted(at, words.starts)
    at, scores = at.tolist(), scores.tolist()
    for i in range(len(words.starts) - 1):
        a, b, first = edges[i], edges[i + 1], int(words.starts[i])
        found = maximal_segments([p - first for p in at[a:b]], scores[a:b], -DRIFT) if a < b else []
        yield found, int(words.starts[i + 1]) - first


def training(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int) -> DataFrame:
    """(label, _text) of at most about ``bound`` labelled rows, drawn by hash. A row with several labels counts as toxic if one says so."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col(label).cast("int")).alias("label"))
    total = chosen.count()
    if total > bound:
        chosen = chosen.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int(bound / total * (1 << 30)))
    slim = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_text"))
    # about ``bound`` rows of two numbers, whatever the input is
    return stored(slim.join(F.broadcast(chosen), "_k").select("label", "_text"))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``df``. What comes to the driver is bounded by BINS and the words of the sample that differ.

    Ties of z don't matter, as all words from LEAST_Z on are taken; rows that repeat a key are documents of their own.
    """
    rows = training(df, labels, key, text, label, bound)

    def terms(batches):
        """Documents of either label with a term, and its uses in clean ones; a null term for all documents and words."""
        for batch in batches:
            for part in sliced(batch, "_text"):
                words = Words(texts_of(part, "_text"), ALNUM)
                own = part.column(0).to_numpy(zero_copy_only=False)
                term, doc = words.hashes, words.text_of_words()
                order = np.lexsort((doc, term))
                term, doc = term[order], doc[order]
                new = np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, bool)
                head = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else new
                at = np.flatnonzero(head)
                total = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                clean = own[doc] == 0
                values = [np.append(x, n) for x, n in ((total(new & clean), (own == 0).sum()), (total(new & ~clean), (own != 0).sum()), (total(clean), clean.sum()))]
                yield pa.RecordBatch.from_arrays([pa.array([*term[at].view(np.int64).tolist(), None], pa.int64()), *[pa.array(x.astype(np.int64)) for x in values]], names=["term", "clean", "toxic", "uses"])

    # as many rows as the sample has different words
    counted = stored(rows.mapInArrow(terms, "term long, clean long, toxic long, uses long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "uses")]))
    every = counted.where("term IS NULL").first()
    n_clean, n_toxic, tokens = (every.clean, every.toxic, every.uses) if every else (0, 0, 0)
    if not n_clean or not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    a, b = F.col("toxic") + PRIOR, F.col("clean") + PRIOR
    # log_odds() as columns, with a little to spare for rounding
    exact = F.abs(F.log(a / (n_toxic + 2 * PRIOR - a)) - F.log(b / (n_clean + 2 * PRIOR - b))) / F.sqrt(1 / a + 1 / b)
    top = counted.where(F.col("term").isNotNull() & (exact >= LEAST_Z - 1e-6)).orderBy("term").toPandas()
    delta, z = log_odds(top["toxic"], top["clean"], n_toxic, n_clean)
    keep = np.abs(z) >= LEAST_Z
    model = Model(top["term"].to_numpy(np.int64)[keep].view(np.uint64), np.clip(delta[keep], -8, 12) - DRIFT)
    share = (top["uses"].to_numpy(float)[keep] + 0.01) / (tokens + 1)
    model.rate = _rate(np.append(np.clip(delta[keep], -8, 12) - DRIFT, -DRIFT), np.append(share, max(0.0, 1 - share.sum())))
    least = max(0.5, float(np.min(model.scores[model.scores > 0], initial=1.0)))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def segments_of(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                own = part.column(0).to_pylist()
                rows_ = [(y, s, n) for y, (found, n) in zip(own, _scan(shared.value, Words(texts_of(part, "_text"), ALNUM))) for _, _, s in found if y == 0 and s >= least]
                yield pa.RecordBatch.from_arrays([pa.array([len(rows_)], pa.int64())], names=["n"])

    chance = rows.mapInArrow(segments_of, "n long").agg(F.sum("n")).first()[0] or 0
    model.scale = (chance + 0.5) * math.exp(model.rate * least) / max(tokens, 1)
    ready = df.sparkSession.sparkContext.broadcast(model)

    def strengths(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                x = [ready.value.strength(found, n) for found, n in _scan(ready.value, Words(texts_of(part, "_text"), ALNUM))]
                bins = np.minimum(np.ceil(np.array(x) * 2), BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bins)], names=["label", "bin"])

    seen = rows.mapInArrow(strengths, "label int, bin long").groupBy("label", "bin").count().toPandas()
    model.slope, model.shift = _logistic(seen["bin"].to_numpy(float) / 2, seen["label"].to_numpy(float), seen["count"].to_numpy(float))
    return model


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root lambda of sum(share * exp(lambda * score)) = 1; 1 where there is none."""
    if not (scores > 0).any() or (share * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1e-6
    f = lambda x: (share * np.exp(np.minimum(x * scores, 700))).sum() - 1
    while f(high) <= 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    return min(4.0, high)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with a weak prior that keeps separable data finite."""
    a, b = 0.5, -3.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = n * p * (1 - p)
        g = np.array([(n * (y - p) * x).sum() - 0.05 * a, (n * (y - p)).sum() - 0.05 * (b + 3)])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(0.01, a + step[0]), b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, n_segments, top_score): one row per row of ``df``; whole texts, one pass, no shuffle.

    Null, empty and wordless texts have no segment and the least score. Repeated rows score alike; other columns aren't read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [key, "score", "predicted", "n_segments", "top_score"]

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                m, rows = shared.value, []
                for found, n in _scan(m, Words(texts_of(part, "_text"), ALNUM)):
                    p = m.probability(m.strength(found, n))
                    limit = math.log(m.scale * max(n, 1) / ALPHA)
                    rows.append((p, int(p >= THRESHOLD), sum(m.rate * s >= limit for _, _, s in found), max((s for _, _, s in found), default=0.0)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.int32(), pa.int32(), pa.float64()))]], names=names)

    slim = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, score double, predicted int, n_segments int, top_score double")


def passages(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(key, first_word, words, passage, segment_score, e_value): every maximal segment that chance gives less than ``alpha`` times."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [key, "first_word", "words", "passage", "segment_score", "e_value"]

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "_text"):
                m, rows = shared.value, []
                texts = texts_of(part, "_text")
                words = Words(texts, ALNUM)
                whole = b"".join(t.encode() for t in texts.to_pylist())
                for i, (found, n) in enumerate(_scan(m, words)):
                    for a, b, s in found:
                        e = m.scale * n * math.exp(-m.rate * s)
                        if e < alpha:
                            f = int(words.starts[i])
                            rows.append((i, a, b - a, whole[words.begin[f + a] : words.end[f + b - 1]].decode("utf-8", "replace"), s, e))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds)]], names=names)

    slim = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[key].dataType.simpleString()
    return slim.mapInArrow(run, f"`{key}` {kind}, first_word int, words int, passage string, segment_score double, e_value double")
