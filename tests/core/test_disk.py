"""What larger inputs fill the disk with: shuffles of steps that are done, and texts or ids that are shuffled again."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from seamline import catalog
from seamline.operators import graph, review, usage
from seamline.plans.lineage import stored
from seamline.queries import review as reviews
from seamline.queries.review import Review

FOLDER = "/root/testdata/sf0.001"


def left_behind(spark, before=frozenset()):
    """The shuffle files that there are now and weren't ``before``; removal goes on in the background for a moment."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    for _ in range(50):
        found = {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")} - before
        if not found:
            break
        time.sleep(0.2)
    return found


def test_a_stored_step_leaves_no_shuffles(spark):
    rows = spark.range(1000).repartition(3).groupBy(F.col("id") % 7).agg(F.count("*").alias("n"))
    before = left_behind(spark)
    kept = [stored(rows), stored(rows)]
    assert not left_behind(spark, before)
    assert [df.count() for df in (*kept, rows)] == [7, 7, 7]


@pytest.mark.parametrize("name", ("graph_reach", "file_impact", "change_sites", "merged_graphs", "ci_gate", "change_report", "blast_radius", "graph_edges"))
def test_no_shuffle_of_an_earlier_step_is_kept(spark, name):
    before = left_behind(spark)
    catalog.QUERIES[name](spark, FOLDER)
    assert not left_behind(spark, before)


@pytest.fixture(scope="module")
def made(spark):
    return Review(spark, FOLDER)


def test_a_review_keeps_no_shuffle_and_no_snippet(spark, made):
    before = left_behind(spark)
    Review(spark, FOLDER).merged()
    assert not left_behind(spark, before)
    plan = made.shown._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "endpoint_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_candidates_need_no_lines_around_them(spark, made, monkeypatch):
    monkeypatch.setattr(reviews, "Review", lambda *_: made)
    made.__dict__.pop("around", None)
    monkeypatch.setattr(review, "merge_ranges", None)
    assert reviews.review_candidates(spark, FOLDER).count() > 0


def test_errors_are_counted_without_storing_verdicts(spark, made, monkeypatch):
    monkeypatch.setattr(reviews, "Review", lambda *_: made)
    monkeypatch.setattr(Review, "verdicts", None)
    assert {r.message for r in reviews.review_errors(spark, FOLDER).collect()} == {"no answer on deletes"}


@pytest.mark.parametrize("name", ("review_summary", "review_verdicts"))
def test_the_reviewer_is_asked_once_and_no_text_is_left(spark, made, monkeypatch, name):
    monkeypatch.setattr(reviews, "Review", lambda *_: made)
    asked, answers = [], Review.answers
    monkeypatch.setattr(Review, "answers", lambda self: asked.append(1) or answers(self))
    before = left_behind(spark)
    found = reviews.QUERIES[name](spark, FOLDER)
    assert asked == [1] and not left_behind(spark, before) and found.count() > 0


def test_requests_are_not_shuffled_again(spark):
    asked = spark.range(20, numPartitions=5).select(F.lit("r").alias("repo"), F.concat(F.lit("e"), "id").alias("endpoint_id"))
    got = review.run_reviewer(asked, lambda request: [{"candidate_id": "c1"}], parallel=2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() == 2 and got.count() == 20


def test_snippets_and_evidence_of_whole_files(spark):
    draw = random.Random(3)
    word = lambda: draw.choice(["a + b", "x  y", "", "foo", "bar baz"])
    files = [("r", f"f{n}", "\n".join(word() for _ in range(draw.choice([1, 2, 9, 30])))) for n in range(8)]
    files = spark.createDataFrame(files, "repo string, file string, text string")
    rows = [("r", f"e{n % 5}", f"f{draw.randrange(9)}", first := draw.randrange(1, 33), first + draw.randrange(13)) for n in range(60)]
    merged = review.merge_ranges(spark.createDataFrame(rows, "repo string, endpoint_id string, file string, first int, last int").distinct())
    want = review.snippets(merged, review.source_lines(files))
    lines = review.file_lines(files)
    key = lambda df: sorted(map(tuple, df.select("repo", "endpoint_id", "file", "first", "lines").collect()))
    assert key(review.file_snippets(merged, lines)) == key(want) != []
    said = [("r", f"e{draw.randrange(5)}", f"c{n}", "FAIL", 1.0, "", [(f"f{draw.randrange(9)}", draw.randrange(0, 40), draw.choice(["a + b", "x y", "foo bar", "baz foo", "a", " "]))], None) for n in range(400)]
    verdicts = spark.createDataFrame(said, review.VERDICTS)
    held = lambda df: {r.candidate_id for r in df.collect()}
    assert held(review.evidence_in_files(verdicts, merged, lines)) == held(review.evidence_holds(verdicts, want)) != set()


def test_radius_of_repeated_calls_equals_brute_force(spark):
    draw = random.Random(4)
    functions = [("r", f"g{n}", f"n{n}", f"f{n % 4}", None if n % 3 else f"C{n}") for n in range(8)]
    by_id = {f[1]: f for f in functions}
    calls = [("r", f"c{draw.randrange(30)}", f"api{draw.randrange(6)}", "matched", None, draw.choice([None, "g1", "g3", "g6", "ghost"]), draw.choice([None, "g0", "g5", "ghost"]), f"f{draw.randrange(6)}") for _ in range(40)]
    reads = [("r", f"a{n}", f"c{draw.randrange(34)}", ["x"] if n % 7 else [], f"f{draw.randrange(7)}", draw.choice([None, "D1", "D2"])) for n in range(40)]
    linked = spark.createDataFrame(calls, "repo string, id string, api_key string, status string, endpoint_id string, caller_function_id string, wrapper_function_id string, file string")
    seen = spark.createDataFrame(reads, "repo string, id string, api_call_id string, path array<string>, file string, containing_component string")
    known = spark.createDataFrame(functions, "repo string, id string, name string, file string, containing_component string")
    ids = {c[1] for c in calls}
    touched = {(c[7], c[1]) for c in calls} | {(by_id[c[6]][3], c[1]) for c in calls if c[6] in by_id} | {(a[4], a[2]) for a in reads if a[3] and a[2] in ids}
    pairs = {(home, "file", home) for home, _ in touched}
    for home, i in touched:
        for c in (c for c in calls if c[1] == i):
            pairs |= {(home, "api", c[2]), (home, "file", c[7]), (home, "component", by_id[c[5]][4] if c[5] in by_id else None)}
        for a in (a for a in reads if a[3] and a[2] == i):
            pairs |= {(home, "file", a[4]), (home, "component", a[5])}
    count = lambda home, kind: sum(p[0] == home and p[1] == kind and p[2] is not None for p in pairs)
    want = {home: tuple(count(home, k) for k in ("api", "file", "component")) for home, _ in touched}
    assert {r.file: (r.apis, r.files, r.components) for r in usage.blast_radius(linked, seen, known).collect()} == want
    none = spark.createDataFrame([], "repo string, file string, dependent string")
    found = {r.file: (r.own_apis, r.clients) for r in usage.impact_of_files(linked, seen, known, none).collect()}
    own = {(r.file, r.own_apis) for r in usage.file_apis(linked, seen).groupBy("file").agg(F.count("*").alias("own_apis")).collect()}
    named = {r.file: r.n for r in usage.client_functions(linked, known).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert found == {home: (dict(own).get(home, 0), named.get(home, 0)) for home in want}


def test_reach_of_cycles_equals_brute_force(spark):
    draw = random.Random(5)
    kinds = {"endpoint": [f"api:{n}" for n in range(5)], "field": [f"field:{n}" for n in range(9)], "function": [f"g{n}" for n in range(12)], "file": [f"file:{n}" for n in range(6)]}
    pick = lambda kind: draw.choice(kinds[kind])
    edges = {(pick(a), pick(b)) for a, b, n in (("endpoint", "field", 9), ("endpoint", "function", 6), ("endpoint", "file", 2), ("field", "function", 8), ("field", "file", 3), ("function", "function", 14), ("function", "file", 10)) for _ in range(n)}
    edges = {e for e in edges if e[0] != e[1]}
    reached = {}
    for start in (i for ids in kinds.values() for i in ids):
        todo, seen = [start], set()
        while todo:
            new = {b for a, b in edges if a == todo[-1]} - seen
            todo.pop()
            seen |= new
            todo += new
        reached[start] = seen - {start}
    kind_of = {i: k for k, ids in kinds.items() for i in ids}
    want = {}
    for i, kind in kind_of.items():
        down = sum(kind_of[x] == "file" for x in reached[i])
        want[i] = down if kind in ("endpoint", "field") else sum(i in reached[a] for a in kinds["endpoint"])
    nodes = spark.createDataFrame([("r", i, k) for i, k in kind_of.items()], "repo string, id string, kind string")
    rows = spark.createDataFrame([("r", a, b) for a, b in sorted(edges)] * 2, "repo string, src string, dst string")
    got = graph.reach(nodes, rows)
    assert {r.id: r.impact for r in got.collect()} == want
    assert "hashpartitioning(repo" not in got._jdf.queryExecution().executedPlan().toString()
