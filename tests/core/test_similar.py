"""The search for similar endpoints against every pair, with a segment that all endpoints share."""

import random

from seamline.functions.paths import PARAM
from seamline.operators.link import PARTS, SIMILAR, first_by, similar_endpoints


def test_similar_endpoints_equal_all_pairs(spark):
    draw = random.Random(5)
    path = lambda n: ["api", *(draw.choice(["a", "b", "c", "d", PARAM]) for _ in range(n))]
    known = [("r", f"e{i:04d}", path(draw.randrange(5))) for i in range(900)] + [("other", "x", ["api", "a"]), ("r", "e0000", ["api"])]
    far = [("r", f"p{i}", path(draw.randrange(7))) for i in range(60)] + [("r", "none", ["zzz", PARAM]), ("r", "empty", []), ("r", "long", ["api"] + ["a"] * 14), ("other", "p0", ["api"]), ("gone", "p0", ["api"])]
    got = similar_endpoints(spark.createDataFrame(far, "repo string, endpoint_pattern string, fe array<string>"), spark.createDataFrame(known, "repo string, e_id string, be array<string>"))
    want = {}
    for repo, pattern, fe in far:
        scored = [(-sum(a == b != PARAM for a, b in zip(fe, be)), e) for r, e, be in known if r == repo]
        if best := sorted(x for x in scored if x[0] < 0)[:SIMILAR]:
            want[repo, pattern] = [e for _, e in best]
    assert {(r.repo, r.endpoint_pattern): r.similar for r in got.collect()} == want


def test_first_rows_of_a_group_larger_than_its_parts(spark):
    n = PARTS * SIMILAR * 5
    rows = spark.range(n).selectExpr("id % 2 AS g", "id AS k")
    got = sorted(tuple(r) for r in first_by(rows, ["g"], ["k"], "k", SIMILAR).collect())
    assert got == [(g, g + 2 * i) for g in range(2) for i in range(SIMILAR)]
    assert first_by(rows.where("k < 0"), ["g"], ["k"], "k", SIMILAR).count() == 0
