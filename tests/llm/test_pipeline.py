"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import random

import corpus_pipeline as p
import pytest

from seamline.llm import mixing
from seamline.plans.ranks import numbered_as_stored
from tests.llm.test_operators import brute_components, brute_contamination, words


def make(folder, spark):
    rows = [(i, words(60 + i, i), "xx" if i % 2 else "yy", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, words(64, 4), "xx", "s0", 1), (51, words(64, 4), "xx", None, 1), (51, words(64, 4), "xx", None, 1), (52, None, "xx", "s1", 1), (53, "123 !!", "yy", "s1", 1), (54, "", None, "s1", 1)]
    r = random.Random(4)
    edited = words(140, 80).split()
    rows.append((60, " ".join(edited), "yy", "s2", 1))
    edited[r.randrange(140)] = "edit"
    rows.append((61, " ".join(edited), "yy", "s2", 1))
    items = [(1, words(66, 6)), (2, words(30, 500))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = make(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {d: t for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    want = [set(kept)]
    groups = brute_components(list(kept.items()), 5, 80)
    want.append({d for d in kept if groups[d][1] == d})
    dirty = {d for d, _, hit, *_ in brute_contamination(list(kept.items()), items) if hit}
    want += [want[1] - dirty] * 3
    sizes = [len(kept) + 1, *[len(w) for w in want[1:]]]  # a repeated row stays until near-dedup
    assert 6 in dirty and 51 not in want[1] and 61 not in want[1]
    for i, (name, stage) in enumerate(p.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) == want[i] and len(ids) == sizes[i], name
        if name != "sharded":
            assert docs.columns == columns
    assert docs.where("shard IS NULL").count() == 0
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == want[-1]


def test_stages_keep_further_columns(spark, tmp_path):
    """Columns that operators use themselves, rows without an id, empty and very long texts; then an empty table."""
    make(str(tmp_path), spark)
    names = ["score", "lang_pred", "block", "slot", "position", "_slot", "_n", "c0", "Text_"]
    rows = [(None, "no id here at all", "xx", None, 1), (1, words(30_000, 71), "xx", "s", 2), (2, "", None, "s", 3), (3, words(50, 72), "yy", "s", 4), (4, words(50, 72), "yy", "s", 4)]
    docs = spark.createDataFrame([(*r, *["mine"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    left = {"language": {None, 1, 3, 4}, "near_dedup": {None, 1, 3}, "decontaminated": {None, 1, 3}, "mixed": {None, 1, 3}}
    empty = docs.limit(0)
    for name, stage in p.STAGES[:-1]:
        out = str(tmp_path / f"wide_{name}")
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        columns, docs = docs.columns, spark.read.parquet(out)
        got = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in got} == left[name], name
        assert all(r[n] == "mine" for r in got for n in names), name
        assert stage(spark, empty, str(tmp_path)).count() == 0
    last = p.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.where("shard IS NULL").count() == 0 and last.count() == 3
    assert {r.score for r in last.collect()} == {"mine"}


def mixture(rows):
    """Brute force: the rows (doc_id, text, source) in the order of the mixture."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, s))
    for own in by.values():
        own.sort(key=lambda r: (int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], 16), r[1]))
    weights = mixing.whole_weights([round(len(by[s]) ** 0.5 * 1e6) for s in names])
    runs = mixing.earliest_deadline(weights, [-(-len(by[s]) // mixing.BLOCK) for s in names])
    return [r for i, block, _ in runs for r in by[names[i]][block * mixing.BLOCK : (block + 1) * mixing.BLOCK]]


@pytest.mark.parametrize("written", [True, False])
def test_shards_follow_the_mixture(spark, tmp_path, written):
    """The order of the mixture reaches the result, over many files, with rows that have no id; without the stage it's another one."""
    rows = [(None if i % 50 == 0 else i, f"text {i}", None if i % 7 == 0 else "a" if i % 3 else "b") for i in range(1500)]
    columns = "doc_id long, text string, source string, _metadata string, c0 string, Position string, _path string"
    docs = spark.createDataFrame([(*r, "mine", "mine", "old", "mine") for r in rows], columns).repartition(5)
    docs.write.parquet(f"{tmp_path}/docs")
    plain = docs = spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = p.mixed(spark, docs, str(tmp_path))
        if written:
            docs.write.parquet(f"{tmp_path}/mixed")
            docs = spark.read.parquet(f"{tmp_path}/mixed")
            assert len(docs.inputFiles()) > 10
        out = p.sharded(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "source", "_metadata", "c0", "_path", "slot", "shard", "position"]
        got = sorted(out.collect(), key=lambda r: r.position)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = mixture(rows)
    assert [r.position for r in got] == list(range(1500))
    assert [(r.doc_id, r.text, r.source) for r in got] == want
    assert all(r["_metadata"] == r.c0 == r["_path"] == "mine" and r.shard for r in got)
    unmixed = sorted(p.sharded(spark, plain, str(tmp_path)).collect(), key=lambda r: r.position)
    assert sorted(r.text for r in unmixed) == sorted(t for _, t, _ in rows) and [r.text for r in unmixed] != [t for _, t, _ in want]
    assert p.sharded(spark, plain.limit(0), str(tmp_path)).count() == 0


def test_files_are_taken_by_the_numbers_of_their_parts(spark, tmp_path):
    """As text, part-100000 comes before part-99999."""
    for i, part in enumerate(["00002-x-c000", "00002-x-c001", "00002-x-c1000", "99999-x-c000", "100000-x-c000"]):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (one,) = (tmp_path / str(i)).glob("*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        one.rename(tmp_path / "all" / f"part-{part}.snappy.parquet")
    got = numbered_as_stored(spark.read.parquet(f"{tmp_path}/all"), "at").collect()
    assert len(got) == 50 and all(r.id == r.at for r in got)
