"""From raw documents to packed sequences: language, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, language, near_join, packing, secrets
from weft.llm.common import discard, documents, few, free, written
from weft.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which have no language, go."""
    found = language.identify(docs, language.fit(docs))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows the one with the smallest id stays (null ids come last, then the text's hash decides); of equal rows one.

    Rows are told apart by id and text, so of two texts under one id only the linked one goes. Wordless and null texts stay.
    """
    rows = near_join.linked_rows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    kept = written(rows.filter("root is not null").groupBy("root").agg(F.min(place).alias("kept")), "kept")
    linked = written(rows.filter("root is not null").groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")), "linked").join(kept, "root")
    marked = written(linked.select("doc_id", "key", "n", (F.col("key").eqNullSafe(F.col("kept.key")) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))).alias("stays")).filter("n > 1 or not stays"), "marked")
    own_id, own_key, stays, text = free(docs, "__id", "__key", "__stays", "__text")
    named = few(marked).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("stays").alias(stays))
    found = docs.withColumn(text, F.xxhash64("text")).join(named, (F.col(text) == F.col(own_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left")
    once = found.filter(F.col(stays).isNull()).select(*docs.columns)
    again = found.filter(F.col(stays)).select(*docs.columns, own_key)
    return once.unionByName(again.dropDuplicates(["doc_id", own_key]).select(*docs.columns)) if not marked.filter("stays").isEmpty() else once


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, decontaminate.build(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; every document stays."""
    (held,) = free(docs, "__held")
    masked = secrets.redact(secrets.scan(docs).withColumn(held, F.size("secrets") > 0))
    return masked.withColumn("n_chars", F.when(F.col(held), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack_documents(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language", known_language),
    ("near copies", one_of_each_group),
    ("benchmark", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]

#: Language, retrieval and packing are beyond SQL; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            if before is not None:  # no later plan reads it
                discard(before)
            before = docs
    return docs
