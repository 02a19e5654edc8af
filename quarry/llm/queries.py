"""Catalogue queries of this package: (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, embed_dedup, langid, line_dedup, merkle, mixing, ngram_join, packing, pii, quality, spelling, toxicity, warc
from quarry.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_site_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_text(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_tokens_and_topic(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    drawn = mixing.mix_to_targets(docs)
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", (F.round("p", 6) + F.lit(0.0)).alias("p"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_source_mixing": op10_source_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_warc": warc.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
