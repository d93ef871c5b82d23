"""op12: runs against brute force, the whole query on odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from seamline.llm import periodic, registry


def brute(x):
    """Runs by trying every period."""
    n, found = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            w = x[i : i + length]
            if j > i and length >= max(24, 3 * q) and not any(w[p:] == w[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if key is not None:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], sha(lines), sha(kept))


def some_words(r, n, kinds):
    x = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n > 30:
            a = r.randrange(n)
            q = r.randrange(1, 1 + max(1, (n - a) // 3))
            for i in range(a, min(n, a + r.randrange(1, n))):
                x[i] = x[a + (i - a) % q]
    return x


def test_runs_of_several_texts_are_those_of_brute_force():
    r = random.Random(5)
    seen = 0
    for _ in range(150):
        texts = [some_words(r, r.randrange(0, 200), r.choice([1, 2, 3, 5, 50])) for _ in range(r.randrange(1, 5))]
        codes = np.array([c for x in texts for c in x], np.int64)
        want = [brute(x) for x in texts]
        assert periodic.runs_of(codes, np.cumsum([0, *map(len, texts)])) == want
        seen += sum(map(len, want))
    assert seen > 100


@pytest.mark.parametrize("word", [[0], [0, 1], list(range(1000)), [*range(17), *range(17), 5]])
def test_one_run_over_a_long_text(word):
    n = 60_000
    x = np.array((word * (n // len(word) + 1))[:n], np.int64)
    assert periodic.runs_of(x, np.array([0, n])) == [[(0, n, len(word))]]


def test_transform_is_exact():
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 31, 400).astype(np.uint64)
    begin = np.array([0, 32, 64])
    got = periodic.mismatches(x, begin, 32, 32, 64)
    want = [[int(sum((int(a) - int(b)) ** 2 for a, b in zip(x[s : s + 32], x[s + d : s + d + 32])) % periodic.PRIME) for s in begin] for d in range(32, 64)]
    assert got.tolist() == want


def test_query_on_odd_rows(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{c}" for c in some_words(r, r.randrange(0, 150), r.choice([1, 2, 40])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a " * 5000), (203, "a " * 5000), (204, "A a b\x1fc " * 30), (None, "x y " * 40), (None, None), (-7, "é　ü " * 25)]
    df = spark.createDataFrame([(t, k, "clash", 1, [2], "c") for k, t in rows], "text string, doc_id long, runs string, start int, length array<int>, collapsed string").repartition(3)
    got = periodic.digests(periodic.periodic_runs(periodic.planted(df))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(k, t)) for k, t in rows)
    assert sum(g.n_runs for g in got) > 20
    assert periodic.digests(periodic.periodic_runs(periodic.planted(df.limit(0)))).collect() == []


def test_query_on_documents(spark):
    from seamline.sources.tables import table

    got = registry.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = {d.doc_id: d.text for d in table(spark, "/root/testdata/sf0.001", "documents").collect() if len(d.text or "") < 6000}
    assert {g.doc_id: tuple(g) for g in got if g.doc_id in docs} == {k: brute_row(k, t) for k, t in docs.items()}
