"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, filter_audit, language, licences, near_join, oracles, packing, quality, repeats, resampling, secrets, simhash, threads, token_files
from weft.llm.common import documents, shared_dir


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/weft-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return token_files.digest(token_files.read_token_files(spark, path))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_units(documents(spark, sf_dir), line_words=1).drop("text_key", "kept_key")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratios = quality.log_ratios(docs, quality.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.quality(docs, ratios).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return decontaminate.matches(docs, decontaminate.build(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op9_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_licences, op2_packing, op3_token_files, op4_repeats, op5_quality, op6_near_join, op7_decontaminate, op8_secrets, op9_threads, op10_language, op11_filter_audit, op12_resampling, op13_simhash)
}
ORACLES: dict[str, str] = {"op4_repeats": oracles.REPEATS, "op6_near_join": oracles.NEAR_JOIN, "op8_secrets": oracles.SECRETS, "op11_filter_audit": oracles.FILTER_AUDIT, "op12_resampling": oracles.RESAMPLING}
