"""Spelling variants: PartEnum signatures over letter multisets, joined by equality, verified by edit distance.

A word's letter multiset is a binary vector with one dimension for each (letter, how often it came before). One inserted,
deleted or replaced letter changes two dimensions at most, so of PARTS parts of the dimensions all but two are alike, and
the words share the signature of one choice of PARTS - 2 parts. One edit also leaves the first or the last END letters as
they are, whatever the word, so each signature is joined together with either.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import sliced, texts_of
from seamline.plans.lineage import stored

#: Parts of the dimensions; a part of a word is known by BITS bits, and all of them fit into one long.
PARTS, BITS = 5, 12
KEPT = list(itertools.combinations(range(PARTS), PARTS - 2))
MASKS = [sum(((1 << BITS) - 1) << (BITS * p) for p in kept) for kept in KEPT]
#: Letters at either end that go with a signature. Two words of LEAST letters share one end at least.
END = 3
LEAST = 7
#: The further occurrences of a letter share one dimension: equal counts still agree.
DEEPEST = 8
#: Every 31st (document, run) loses a letter; forms are so many times as frequent as their variants.
SLIP, FACTOR = 31, 10
#: Distinct words that a task sums up before it hands them on.
HELD = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")


def words_of(key: str, text: str) -> Counter:
    """The words of a text with their counts: lower-cased runs of LEAST letters or more, some without one of their letters."""
    found: Counter = Counter()
    head = zlib.crc32(f"{key}:".encode())
    for run, n in Counter(_RUNS.findall(text.encode("utf-8", "replace").translate(_LOWER).decode())).items():
        h = zlib.crc32(run.encode(), head)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        found[run] += n
    return found


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """(word, n): the words of all whole texts that occur ``least`` times or more. Each task sums up before the shuffle."""
    slim = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for part in sliced(batch, "text"):
                for k, t in zip(part.column("key").to_pylist(), texts_of(part, "text").to_pylist()):
                    total.update(words_of(k, t))
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def dimensions(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of each word: the word's place, and the letter's dimension."""
    texts = words.to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((letters, word))
    word, letters = word[order], letters[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (letters[1:] != letters[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(word)), 0))
    return word, letters * DEEPEST + np.minimum(np.arange(len(word)) - begin, DEEPEST - 1)


def partition(words: DataFrame) -> dict[int, int]:
    """The part of each dimension, so that parts hold about as many letters. At most DEEPEST dimensions for each letter of
    the two alphabets come to the driver."""

    def run(batches):
        for batch in batches:
            seen, n = np.unique(dimensions(batch.column("word"))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], names=["dim", "n"])

    load, part = [0] * PARTS, {}
    for row in words.select("word").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").collect():
        part[row.dim] = load.index(min(load))
        load[part[row.dim]] += row.n
    return part


def fingerprints(words: DataFrame, part: dict[int, int]) -> DataFrame:
    """``words`` with ``parts``: BITS bits for what the word has in each part of the dimensions, side by side in one long."""
    known = np.array(sorted(part), np.int64)
    where = np.array([part[d] for d in known.tolist()], np.int64)

    def run(batches):
        for batch in batches:
            word, dim = dimensions(batch.column("word"))
            value = np.array([zlib.crc32(b"%d" % d) for d in known.tolist()], np.int64) & ((1 << BITS) - 1)
            at = np.searchsorted(known, dim)
            sums = np.bincount(word * PARTS + where[at], weights=value[at], minlength=batch.num_rows * PARTS).astype(np.int64) & ((1 << BITS) - 1)
            packed = (sums.reshape(-1, PARTS) << (BITS * np.arange(PARTS))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(packed)], names=["word", "n", "parts"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, parts long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a before b: all pairs of words that differ by one inserted, deleted or replaced letter, once each.

    ``words`` (word, n), of LEAST letters or more. A pair is made where its words' first common signature is, of the two
    ends at the first if they share it, so it needs no distinct.
    """
    marked = fingerprints(words, partition(words))
    choice = lambda j, end, letters: F.struct(F.lit(2 * j + end).cast("short").alias("choice"), F.xxhash64(F.lit(2 * j + end), F.col("parts").bitwiseAND(F.lit(MASKS[j])), letters).alias("key"))
    first, last = F.substring("word", 1, END), F.substring("word", -END, END)
    signed = marked.select("word", "n", "parts", F.inline(F.array(*(choice(j, end, letters) for j in range(len(KEPT)) for end, letters in enumerate((first, last))))))
    a, b = signed.alias("a"), signed.alias("b")
    unlike = F.col("a.parts").bitwiseXOR(F.col("b.parts"))
    common = F.coalesce(*(F.when(unlike.bitwiseAND(F.lit(MASKS[j])) == 0, F.lit(2 * j)) for j in range(len(KEPT))))
    end = F.when(F.substring("a.word", 1, END) == F.substring("b.word", 1, END), 0).otherwise(1)
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.choice") == F.col("b.choice")) & (F.col("a.word") < F.col("b.word"))
    met = a.join(b, meet & (F.col("a.choice") == common + end) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the last form that following forms leads to. Each round doubles the steps taken.

    A form has FACTOR times its word's count at least, so chains are as short as the counts have digits, and have no cycle.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        grown = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = grown.select("word", "root")
        if grown.where("moved").isEmpty():
            return steps


def variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts, with the near word that each is a spelling of.

    A word's form is its near word of largest n, the first in code-point order of those, if that is FACTOR times the word's
    own; its root is where following forms ends, itself without one. Null and empty texts have no words, rows that repeat
    count again, a null key is as an empty one, and an empty table gives an empty one. Other columns aren't read.
    """
    words = stored(word_counts(df, key, text))
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("near")).alias("best")), F.struct(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("near")).alias("best")))))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    formed = F.coalesce(-F.col("best.less") >= FACTOR * F.col("n"), F.lit(False))
    found = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words meet at the word without its i-th letter: at the same i if replaced, at the whole shorter word otherwise.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT key, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY key, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(key || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, bits
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.gap = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.gap = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word
), pick AS (
  SELECT b.word, b.n_near, b.top, min(x.near) AS near FROM best b JOIN near x ON x.word = b.word AND x.n = b.top GROUP BY ALL
), graded AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.top >= 10 * w.n THEN p.near END AS form, CASE WHEN p.top >= 10 * w.n THEN p.top END AS form_n FROM words w LEFT JOIN pick p ON p.word = w.word
), walk AS (
  SELECT word, coalesce(form, word) AS root, form FROM graded
  UNION ALL SELECT k.word, coalesce(g.form, g.word), g.form FROM walk k JOIN graded g ON g.word = k.form
), ends AS (SELECT word, root FROM walk WHERE form IS NULL)
SELECT g.word, g.form, e.root, g.n, g.n_near, g.form_n FROM graded g JOIN ends e ON e.word = g.word
"""
