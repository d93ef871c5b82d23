"""The stored index: versions, deletes, rewritten buckets, repeated and late batches."""

import random

import pytest

from seamline.operators import store
from seamline.streaming import upsert_stream

CHANGE = "repo string, id string, file string, json string, ord long"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def rows(spark, *found):
    return spark.createDataFrame([("r", *f) for f in found], "repo string, id string, file string, json string")


def shown(df):
    return sorted((r.id, r.file, r.json) for r in df.collect())


def files(df):
    return sorted(r.file for r in df.collect())


def test_touched_files_are_those_with_changed_records(spark, path):
    assert shown(store.read(spark, path)) == [] and store.current(spark, path) == []
    first = (("a", "f1", "1"), ("b", "f1", "2"), ("c", "f2", "3"))
    assert files(store.sync_table(spark, path, rows(spark, *first))) == ["f1", "f2"]
    assert files(store.sync_table(spark, path, rows(spark, *first))) == []
    assert files(store.sync_table(spark, path, rows(spark, first[0], ("b", "f3", "9"), first[2]))) == ["f1", "f3"]
    assert files(store.sync_table(spark, path, rows(spark, first[0], first[0]))) == ["f2", "f3"]
    assert shown(store.read(spark, path)) == [first[0]]
    assert shown(store.read(spark, path, 0)) == sorted(first)
    assert files(store.sync_table(spark, path, rows(spark))) == ["f1"] and shown(store.read(spark, path)) == []


def test_only_buckets_with_changes_are_written_and_none_grows_long(spark, path):
    draw, kept = random.Random(5), {}
    for step in range(7):
        batch = [(f"k{draw.randrange(40)}", f"f{draw.randrange(5)}", None if draw.random() < 0.3 else str(step)) for _ in range(6)]
        found = spark.createDataFrame([("r", *b, step) for b in batch], CHANGE)
        before = {(r.bucket, r.version) for r in store.current(spark, path)}
        store.commit(spark, path, found, buckets=4, most=2)
        for k in {b[0] for b in batch}:
            last = max((b for b in batch if b[0] == k), key=lambda b: (b[2] is None, b[2] or "", b[1]))
            kept[k] = last
        listed = [(r.bucket, r.version) for r in store.current(spark, path)]
        assert max(sum(b == a for b, _ in listed) for a in range(4)) <= 2
        assert all(v == step for b, v in set(listed) - before)
        assert shown(store.read(spark, path)) == sorted(v for v in kept.values() if v[2] is not None)
    want = shown(store.read(spark, path))
    store.expire(spark, path)
    assert shown(store.read(spark, path)) == want and store.snapshots(spark, path).select("snapshot").distinct().count() == 1


def test_late_null_and_repeated_changes(spark, path):
    one = lambda *r: spark.createDataFrame(list(r), CHANGE)
    store.commit(spark, path, one(("r", "a", "f", "new", 5), ("r", "b", "f", None, 5), (None, "c", "f", "x", 1), ("r", None, "f", "x", 1), ("r", "d", None, "y", None)), label="1")
    assert shown(store.read(spark, path)) == [("a", "f", "new"), ("d", None, "y")]
    assert files(store.commit(spark, path, one(("r", "a", "f", "late", 4), ("r", "b", "f", "late", 4)), label="2")) == []
    assert files(store.commit(spark, path, one(("r", "a", "g", "other", 6)), label="2")) == []
    assert files(store.commit(spark, path, one(("r", "a", "g", "new", 6)), label="3")) == ["f", "g"]
    assert files(store.commit(spark, path, one(), label="4")) == []
    assert shown(store.read(spark, path)) == [("a", "g", "new"), ("d", None, "y")]


def test_a_version_without_its_snapshot_does_not_count(spark, path):
    store.sync_table(spark, path, rows(spark, ("a", "f", "1")))
    rows(spark, ("a", "f", "broken")).write.parquet(f"{path}/rows/version=1/bucket=0")
    assert shown(store.read(spark, path)) == [("a", "f", "1")]
    store.sync_table(spark, path, rows(spark, ("b", "f", "2")))
    assert shown(store.read(spark, path)) == [("b", "f", "2")]


def test_a_restarted_stream_gives_the_table_of_one_batch(spark, path, tmp_path):
    draw = random.Random(3)
    found = [("r", f"k{draw.randrange(12)}", f"f{n % 3}", None if n % 4 == 0 else str(n), draw.randrange(30)) for n in range(30)]
    for part in range(2):
        spark.createDataFrame(found[part::3], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(source(), path, str(tmp_path / "log")).awaitTermination()
    spark.createDataFrame(found[2::3], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = max((tmp_path / "log" / "commits").glob("[0-9]*"))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    upsert_stream(source(), path, str(tmp_path / "log")).awaitTermination()
    whole = str(tmp_path / "whole")
    store.commit(spark, whole, spark.createDataFrame(found, CHANGE))
    assert shown(store.read(spark, path)) == shown(store.read(spark, whole)) != []
    labels = [r.label for r in store.snapshots(spark, path).select("snapshot", "label").distinct().orderBy("snapshot").collect()]
    assert labels == ["batch 0", "batch 1", "batch 2"]
