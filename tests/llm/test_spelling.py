"""op13: near words against brute force, on odd rows and against the SQL."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from seamline.llm import registry, spelling


def near(a, b):
    """Differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    by = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in by.items():
        top = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top and words[top] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_variants_are_those_of_brute_force(spark):
    r = random.Random(4)
    stems = ["".join(r.choice("abceÀéß") for _ in range(r.randrange(6, 12))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = stems[min(int(r.expovariate(0.3)), 24)]
            for _ in range(r.choice([0] * 30 + [1, 1, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcé") + w[at:], w[:at] + r.choice("abcé") + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "\n", "-"]).join(words)))
    rows += [(500, None), (501, ""), (502, "12 _ 日本語"), (None, "nokeyhere nokeyhere nokeyhare"), (None, None), (3, rows[3][1]), (600, "chainaaaa " * 500), (601, "chainbaaa " * 40), (602, "chainbbaa " * 3), (503, "a" * 50_000 + " " + "a" * 50_000 + " " + "a" * 49_999 + " " + "a" * 49_999)]
    df = spark.createDataFrame([(t, k, "x", 1, "y") for k, t in rows], "text string, doc_id long, word string, n int, form string").repartition(3)
    want = brute(rows)
    got = rows_of(spelling.variants(df))
    assert got == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] for w in want if w[1])
    assert rows_of(spelling.variants(df.limit(0))) == []


def test_pairs_are_made_once(spark):
    words = sorted({"".join(p) for p in itertools.product("abc", repeat=7)})[:600]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert sorted(got) == [(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)]


def test_roots_follow_long_chains(spark):
    forms = spark.range(1, 40).select(F.concat(F.lit("w"), "id").alias("word"), F.concat(F.lit("w"), F.col("id") - 1).alias("form"))
    assert {r.root for r in spelling.roots(forms).collect()} == {"w0"}


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    columns = "word, form, root, n, n_near, form_n"
    want = con.execute(f"SELECT {columns} FROM ({spelling.ORACLE})").fetchall()
    assert rows_of(registry.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == sorted(want)
