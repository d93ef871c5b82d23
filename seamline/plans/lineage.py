"""Cutting lineage in iterative jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files of an execution go when it ends, rather than when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder that its context has.

    Without one, a session with a local master gets a folder of its own (tests); on a cluster this is an error, as
    executors elsewhere couldn't read a folder of the driver's machine.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where:
        current = context._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint: it survives lost executors and ends the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind: for writes whose rows are read from the table from then on."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder, which goes when the application ends.

    For larger tables than ``cut``: columnar, compressed, and later reads take only the columns they need. The shuffles
    that made the rows are removed once they are written, so a job of many steps holds those of one step at a time.
    """
    where = fresh_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def fresh_folder(spark: SparkSession) -> str:
    """A folder for a table, in the shared folder; it goes when the application ends."""
    where = f"{shared_folder(spark).rstrip('/')}/seamline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


class Pile:
    """Rows that a loop adds round by round, stored like ``stored`` does. No round is written again, and all of them are read
    as one scan, so the plan stays as small as in the first round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.rounds, self.schema = spark, fresh_folder(spark), [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Store ``df`` and return it as a table."""
        self.schema = self.schema or df.schema
        self.rounds.append(f"{self.root}/{len(self.rounds)}")
        with shuffles_removed(self.spark):
            df.write.parquet(self.rounds[-1])
        return self.spark.read.schema(self.schema).parquet(self.rounds[-1])

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.rounds)
