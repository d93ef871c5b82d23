"""Row numbers without sorting a group in one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.plans.lineage import stored


def numbered(rows: DataFrame, by: str, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the row's number (from 1) within ``by`` in ``order``, which should leave no ties.

    Rows are dealt to ``parts`` ranges (default: the session's shuffle partitions) of (``by``, ``order``) and stored when
    this is called, so that their ranges stay; each range is numbered by itself, on top of the rows of ``by`` in the ranges
    before it. Only these counts, one for each range and each end of a group, are summed group by group.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, F.col(by), *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range", by).orderBy(*order))
    met = dealt.withColumn("_within", within).join(offsets, F.col("_range").eqNullSafe(F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    return met.select(*rows.columns, (F.col("_within") + F.col("_before")).cast("long").alias(name))


def numbered_as_stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``, the row's place in its table, from 0: files by name (parts of a Spark job by number), and rows
    as they stand in their file.

    Rows that aren't read from files are stored first, which keeps the order of their partitions. Texts aren't shuffled:
    one count for each file is summed up, and these are broadcast (the driver lists the files anyway).
    """
    try:
        rows.select(rows.metadataColumn("_metadata"))
    except AnalysisException:
        rows = stored(rows)
    file = rows.metadataColumn("_metadata")
    counts = rows.select(file["file_path"].alias("_path")).groupBy("_path").agg(F.count("*").alias("_n"))
    part = F.expr(r"try_cast(regexp_extract(_path, 'part-([0-9]+)[^/]*$', 1) AS long)")
    earlier = W.orderBy(part, F.length("_path"), "_path").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_path", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = rows.select("*", file["file_path"].alias("_path"), file["row_index"].alias("_row")).join(F.broadcast(offsets), "_path")
    return met.select(*rows.columns, (F.col("_before") + F.col("_row")).alias(name))
