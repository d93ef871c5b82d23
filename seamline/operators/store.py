"""A stored index of records by key: a version for each change, with deletes, old versions and bounded reads.

A table is a folder. ``rows/version=V/bucket=B`` has the records that version V changed in bucket B of the keys, and
``snapshots/snapshot=V`` lists the (bucket, version) pairs whose rows make up the table after V. A reader takes the newest
row of each key. Once a bucket has ``most`` versions, the next change rewrites it as one; other buckets aren't read or
written by a change. A version counts from the moment its snapshot, one file, is there: a job that dies before leaves rows
that no snapshot names, which the next try overwrites. One writer at a time.

Records are (repo, id, file, json, ord); ``json`` is null for a deleted one, which stays so that an older change that comes
late can't bring it back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.index import compared
from seamline.plans.lineage import stored

KEYS = ["repo", "id"]
ROW = "repo string, id string, file string, json string, ord long"
SNAPSHOT = "bucket int, version long, buckets int, label string"
#: Buckets of a new table, and versions of a bucket before it is rewritten.
BUCKETS, MOST = 64, 4


def _order(p: str = "") -> Column:
    """Changes of one key by ``ord``, of equal ones a deletion last, then by (json, file): the result doesn't hang on arrival."""
    c = lambda n: F.col(p + n)
    return F.struct(F.coalesce(c("ord"), F.lit(-(2**63))).alias("a"), c("json").isNull().alias("b"), F.coalesce(c("json"), F.lit("")).alias("c"), F.coalesce(c("file"), F.lit("")).alias("d"))


def newest(rows: DataFrame) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("file", "json", "ord"), _order()).alias("_r")).select(*KEYS, "_r.*")


def snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """(snapshot, bucket, version, buckets, label) of all versions; None before the first."""
    try:
        return spark.read.schema(f"{SNAPSHOT}, snapshot long").parquet(f"{path}/snapshots")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The rows of the newest snapshot, or of ``version``: at most buckets x most of them."""
    found = snapshots(spark, path)
    if found is None:
        return []
    at = found.agg(F.max("snapshot")).first()[0] if version is None else version
    return found.where(F.col("snapshot") == at).collect()


def records(spark: SparkSession, path: str, listed: list) -> DataFrame:
    """The newest row of each key in the listed (bucket, version) pairs, deleted ones too."""
    folders = [f"{path}/rows/version={r.version}/bucket={r.bucket}" for r in listed if r.bucket is not None]
    rows = spark.read.schema(ROW).parquet(*folders) if folders else spark.createDataFrame([], ROW)
    return newest(rows)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(repo, id, file, json, ord) after the newest version or after ``version``; empty before the first."""
    return records(spark, path, current(spark, path, version)).where("json IS NOT NULL")


def commit(spark: SparkSession, path: str, changes: DataFrame, label: str = "", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """Apply ``changes`` (repo, id, file, json, ord) and return (repo, file), the files that had or have a changed record.

    Of changes to one key the newest counts; changes that are older than the stored record or leave it as it is are passed
    over, and so are those without repo or id. A null ``ord`` is older than all others. A label that a snapshot has already isn't applied again: a repeated batch of a stream returns the same files.
    """
    listed = current(spark, path)
    done = {r.label: r.snapshot for r in snapshots(spark, path).select("label", "snapshot").distinct().collect()} if label and listed else {}
    if label in done:
        return touched(spark, path, done[label])
    n = listed[0].buckets if listed else buckets
    version = listed[0].snapshot + 1 if listed else 0
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(n)).cast("int")
    wanted = stored(newest(changes.where("repo IS NOT NULL AND id IS NOT NULL")).withColumn("bucket", bucket))
    at = {r.bucket for r in wanted.select("bucket").distinct().collect()}
    near = [r for r in listed if r.bucket in at]
    old = records(spark, path, near).select(*KEYS, F.col("file").alias("old_file"), F.col("json").alias("old_json"), F.col("ord").alias("old_ord"))
    fresh = stored(wanted.join(old.withColumn("met", F.lit(True)), KEYS, "left").where(F.col("met").isNull() | (_order() > _order("old_"))))
    depth = {b: sum(r.bucket == b for r in near) for b in at}
    full = sorted(b for b in at if depth[b] >= most)
    rows = fresh.select(*KEYS, "file", "json", "ord", "bucket")
    if full:
        kept = records(spark, path, [r for r in near if r.bucket in full]).join(fresh.select(*KEYS), KEYS, "left_anti")
        rows = rows.unionByName(kept.withColumn("bucket", bucket))
    rows.repartitionByRange("bucket", *KEYS).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={version}")
    changed = fresh.where("NOT json <=> old_json OR NOT file <=> old_file")
    sides = changed.select("repo", F.explode(F.array("old_file", F.when(F.col("json").isNotNull(), F.col("file")))).alias("file"))
    sides.where("file IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{path}/touched/version={version}")
    wrote = {r.bucket for r in fresh.select("bucket").distinct().collect()} | set(full)
    pairs = [(r.bucket, r.version) for r in listed if r.bucket is not None and r.bucket not in full] + [(b, version) for b in sorted(wrote)]
    snapshot = spark.createDataFrame([(b, v, n, label) for b, v in pairs] or [(None, None, n, label)], SNAPSHOT)
    snapshot.coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshots/snapshot={version}")
    return touched(spark, path, version)


def touched(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(repo, file): the files with a record that ``version`` changed."""
    return spark.read.schema("repo string, file string").parquet(f"{path}/touched/version={version}")


def sync_table(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """Make the table equal to ``new`` (repo, id, file, json), deleting what it lacks; returns the touched files.

    Keep a table either by whole snapshots or by a stream: a snapshot's changes have its version as ``ord``.
    """
    version = max((r.snapshot for r in current(spark, path)), default=-1) + 1
    old = read(spark, path).select(*KEYS, "file", "json")
    found = compared(old, new.select(*KEYS, "file", "json"), KEYS)
    changes = found.select(*KEYS, F.coalesce("new_file", "old_file").alias("file"), F.col("new_json").alias("json"), F.lit(version).cast("long").alias("ord"))
    return commit(spark, path, changes, buckets=buckets, most=most)


def expire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the last ``keep`` versions: their snapshots first, then rows that no kept snapshot names."""
    found = snapshots(spark, path)
    if found is None or keep < 1:
        return
    rows = found.collect()
    last = sorted({r.snapshot for r in rows})[-keep:]
    kept = {(r.bucket, r.version) for r in rows if r.snapshot in last}
    gone = [f"snapshots/snapshot={n}" for n in sorted({r.snapshot for r in rows} - set(last))]
    gone += [f"rows/version={v}/bucket={b}" for b, v in sorted({(r.bucket, r.version) for r in rows if r.bucket is not None} - kept)]
    for folder in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
