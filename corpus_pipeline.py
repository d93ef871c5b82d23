"""A corpus pipeline over documents: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents, and further columns of any name as they are: inside a
stage all columns have names of their own. Rows without a doc_id are carried through; null and empty texts have no
language; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm import crossparse, decontamination, mixing, sharding, superminhash
from seamline.llm.common import narrowed, without
from seamline.plans.lineage import cut, stored
from seamline.plans.ranks import numbered_as_stored
from seamline.sources.tables import table


def _neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., which no operator's own columns can clash with, and the new name of each old one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on: a text with a letter. Fitted on labelled rows that aren't held out."""
    model = crossparse.fit(docs.where(crossparse.learnable()))
    plain, at = _neutral(docs)
    found = crossparse.identify(plain, model, at["doc_id"], at["text"], carry=True)
    return found.where("lang_pred <> 'und'").select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least doc_id; of rows that repeat its doc_id, the first by text."""
    found = cut(superminhash.near_duplicates(docs.where("doc_id IS NOT NULL")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    gone = found.where("NOT kept OR n > 1").select("doc_id")
    again = found.where("kept AND n > 1").select("doc_id")
    plain, at = _neutral(docs)
    key = at["doc_id"]
    again, gone = again.toDF(key), gone.toDF(key)
    several = narrowed(plain, again, key).join(again, key, "left_semi")
    one = several.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(at["text"]))).where("_n = 1").drop("_n")
    return without(plain, gone, key).unionByName(one).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    plain, at = _neutral(docs)
    gone = cut(found.where("contaminated AND doc_id IS NOT NULL").select(F.col("doc_id").alias(at["doc_id"])).distinct())
    return without(plain, gone, at["doc_id"]).select(*plain.columns).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the files by name, and the rows in them, follow the schedule. ``sharded``
    reads this order and returns it as ``position``.

    Null sources are a source of their own; rows that repeat a doc_id, or have none, stand by text, lang and n_chars.
    """
    plain, at = _neutral(docs)
    ties = [at[c] for c in ("text", "lang", "n_chars") if c in at]
    placed = mixing.mix(plain, mixing.target_weights(plain, at["source"]), at["source"], at["doc_id"], ties=ties)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "position").sortWithinPartitions("position").select(*plain.columns).toDF(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with slot, shard and position; a null doc_id has the shard of the empty text, and rows of one doc_id share one.

    ``position`` is the row's place in the mixture, from 0, as the files of ``docs`` have it: rows of a shard are to be read
    by it. This last stage adds its columns: a column slot, shard or position that was there before is replaced.
    """
    plain, at = _neutral(docs)
    placed = sharding.place(numbered_as_stored(plain, "position"), sharding.lookup_table(sharding.shard_names(spark)), at["doc_id"])
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard", "position")]
    return placed.select(*(F.col(at[c]).alias(c) for c in kept), "slot", "shard", "position")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]

#: The first three stages can't be expressed in SQL at all sizes; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
