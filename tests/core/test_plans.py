"""Row numbers by ranges, and the innermost span around a line, against brute force."""

import random

from pyspark.sql import functions as F

from seamline.operators.extract import enclosing
from seamline.plans.ranks import numbered


def test_numbers_are_those_of_one_sort(spark):
    draw = random.Random(1)
    found = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([1, 1, 2, None]), n) for n in range(500)]
    df = spark.createDataFrame(found, "repo string, points int, id int").repartition(3)
    got = {r.id: r.rank for r in numbered(df, "repo", [F.desc_nulls_last("points"), F.col("id")], "rank", parts=7).collect()}
    for repo in ("a", "b", None):
        group = sorted((f for f in found if f[0] == repo), key=lambda f: (-(f[1] or 0), f[2]))
        assert [got[f[2]] for f in group] == list(range(1, len(group) + 1))
    assert numbered(df.limit(0), "repo", [F.col("id")], "rank").collect() == []


def test_no_task_of_a_rank_gets_a_whole_group(spark):
    df = spark.range(4000).select(F.lit("r").alias("repo"), F.col("id"), F.lit(1).alias("points"))
    ranked = numbered(df, "repo", [F.desc("points"), F.col("id")], "rank", parts=8)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and ranked.where("rank <> id + 1").isEmpty()


def test_innermost_spans_equal_brute_force(spark):
    draw = random.Random(2)
    spans = []
    for n in range(120):
        first = draw.randrange(1, 300)
        spans.append(("r", draw.choice(["f", "g"]), f"s{n}", f"N{n}", first, first + draw.choice([0, 1, 3, 17, 64, 250]), n % 3 == 0))
    spans.append(("r", "h", "one", "One", 5, 4, True))
    sites = [("r", n, draw.choice(["f", "g", "h", "none"]), draw.randrange(0, 600)) for n in range(800)]
    got = {r.id: (r.function_id, r.component) for r in enclosing(spark.createDataFrame(sites, "repo string, id int, file string, line int"), spark.createDataFrame(spans, "repo string, file string, id string, name string, line int, last_line int, component boolean")).collect()}
    want = {}
    for _, n, file, line in sites:
        around = sorted((s[5] - s[4], -s[4], s[2], s) for s in spans if s[1] == file and s[4] <= line <= s[5])
        if around:
            want[n] = (around[0][3][2], next((s[3][3] for s in around if s[3][6]), None))
    assert got == want and want


def test_a_file_of_many_sites_and_deep_functions(spark):
    sites = spark.range(100_000).select(F.lit("r").alias("repo"), "id", F.lit("f").alias("file"), (F.col("id") + 1).cast("int").alias("line"))
    spans = spark.range(2_000).select(F.lit("r").alias("repo"), F.lit("f").alias("file"), F.format_string("s%05d", "id").alias("id"), F.lit("n").alias("name"), (F.col("id") + 1).cast("int").alias("line"), (100_000 - F.col("id")).cast("int").alias("last_line"), F.lit(False).alias("component"))
    want = F.format_string("s%05d", F.least(F.col("id"), 99_999 - F.col("id"), F.lit(1_999)))
    found = enclosing(sites, spans)
    assert found.count() == 100_000 and found.where(F.col("function_id") != want).isEmpty()
