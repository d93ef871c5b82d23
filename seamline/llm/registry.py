"""The queries opN_<name> and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import chunking, crossparse, decontamination, licenses, matroska, mixing, neighbours, periodic, segments, sharding, spelling, superminhash, warc
from seamline.llm.crossparse import held_out, learnable
from seamline.sources.tables import table


def op1_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, folder, "pages"))).select(*warc.COLUMNS)


def op2_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(learnable())
    model = segments.fit(documents, labels)
    scored = segments.score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_segments", "top_score")


def op3_gear_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.repeated_passages(table(spark, folder, "documents"))


def op4_matroska_packets(spark: SparkSession, folder: str) -> DataFrame:
    return matroska.read_back(matroska.store(table(spark, folder, "documents")))


def op5_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"), width=3, percent=85, bands=20)


def op6_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = crossparse.fit(documents.where(learnable()))
    return crossparse.identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), slop=decontamination.SLOP)


def op8_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id")
    return sharding.place(documents, sharding.lookup_table(sharding.shard_names(spark)))


def op9_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(table(spark, folder, "documents")))


def op10_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix(documents, mixing.target_weights(documents))


def op11_stable_projections(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(table(spark, folder, "documents"))))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_toxic_segments, op3_gear_chunks, op4_matroska_packets, op5_superminhash, op6_cross_parsing, op7_positional_index, op8_lookup_sharding, op9_licence_scan, op10_pfair_mixing, op11_stable_projections, op12_periodic_runs, op13_spelling_variants)}
ORACLES = {"op1_warc_derivatives": warc.ORACLE, "op7_positional_index": decontamination.ORACLE, "op8_lookup_sharding": sharding.ORACLE, "op9_licence_scan": licenses.ORACLE, "op10_pfair_mixing": mixing.ORACLE, "op13_spelling_variants": spelling.ORACLE}
