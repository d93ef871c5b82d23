"""Keeping an index of facts: full sync by id, persisted tables, touched files and APIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.usage import file_apis


def with_payload(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the whole record as JSON text."""
    return rows.select(*keys, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def compared(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, old_file, old_json, new_file, new_json of the records that differ; of rows that repeat a key the first by (json, file)."""
    first = lambda rows, p: rows.groupBy(*keys).agg(F.min(F.struct("json", "file")).alias("r")).select(*keys, F.col("r.file").alias(f"{p}_file"), F.col("r.json").alias(f"{p}_json"))
    return first(stored, "old").join(first(new, "new"), keys, "full_outer").where("NOT old_json <=> new_json")


def sync(stored: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(repo, id, action, old_file, new_file): insert, update or delete by (repo, id); equal rows are left out.

    Both sides have ``file`` and ``json``. Of rows that repeat an id the first by (json, file) counts; a full snapshot
    deletes what it lacks.
    """
    on = keys or ["repo", "id"]
    action = F.when(F.col("old_json").isNull(), "insert").when(F.col("new_json").isNull(), "delete").otherwise("update")
    return compared(stored, new, on).select(*on, action.alias("action"), "old_file", "new_file")


def touched_files(changes: DataFrame) -> DataFrame:
    return changes.select("repo", F.explode(F.array("old_file", "new_file")).alias("file")).where("file IS NOT NULL").distinct()


def touched_apis(changes: DataFrame, linked: DataFrame, reads: DataFrame) -> DataFrame:
    """(repo, api_key): APIs that the touched files use."""
    return file_apis(linked, reads).join(touched_files(changes), ["repo", "file"], "left_semi").select("repo", "api_key").distinct()


def write_table(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Lookup columns and payload, one folder per repository; only the repositories at hand are overwritten."""
    with_payload(rows, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of a persisted table, typed by ``schema``."""
    return spark.read.parquet(path).select(F.from_json("json", schema).alias("r")).select("r.*")
