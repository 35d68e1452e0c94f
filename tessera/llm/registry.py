"""Queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, html_text, language_id, language_model, license_scan, mixing, near_dedup, packing, toxicity, vector_search
from .common import crc_mod, read, small_batches


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    return language_id.identify(docs, ~F.col("held_out"), carry=["doc_id", "held_out"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    scored = language_model.score(read(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.recognise(read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return toxicity.toxicity(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, carry=["doc_id", "held_out"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), digest=True)


def whole(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: whole(f) for f in (op1_language_id, op2_license_scan, op3_near_dedup, op4_html_text, op5_mixing, op6_vector_search, op7_language_model, op8_audio, op9_toxicity, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.sql()}
