"""Quality rules: base counts and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

DataFrame functions only. Unigrams and bigrams are hashed into a fixed number of buckets. One pass counts the
buckets of all documents and, of those, of the trusted ones; the table of log ratios has one number a bucket, so
its size never grows with the data. A document's score is the mean log ratio of its n-grams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Trusted documents are a sample of labelled rows of at most this size (by the smallest hash of the id).
TARGET_DOCS = 20_000
#: Mean log ratio (nats an n-gram) from which a document is kept.
THRESHOLD = -0.12
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _grams(hashes: Column) -> Column:
    """Hash of each word and of each pair of neighbours. hashes must be a column made before, or it is computed for every use."""
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.concat(hashes, pairs)


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def trusted(labels: DataFrame, *, id_col: str = "doc_id", most: int = TARGET_DOCS) -> DataFrame:
    """Ids of at most `most` documents labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    return good.select(F.col(id_col).cast("long").alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def log_ratios(df: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Log of target over raw probability of each bucket, add-one smoothed; raw counts cover every document.

    target_ids: column trusted_id, at most TARGET_DOCS rows (so that it may be broadcast).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flagged = rows.join(F.broadcast(target_ids), F.col("id") == F.col("trusted_id"), "left").select(
        F.col("trusted_id").isNotNull().cast("long").alias("good"), _hashes(F.col("text")).alias("h")
    )
    grams = flagged.select("good", F.explode(_grams(F.col("h"))).alias("x")).select("good", F.pmod("x", F.lit(buckets)).cast("int").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()  # one row a bucket
    raw, target = [1] * buckets, [1] * buckets
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    all_raw, all_target = sum(raw), sum(target)
    if all_target == buckets:  # nothing trusted: no evidence either way
        return [0.0] * buckets
    return [math.log(t / all_target) - math.log(r / all_raw) for t, r in zip(target, raw)]


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window of five words found twice or more."""
    n = F.size(hashes)
    windows = F.when(
        n >= 6,
        F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    ranked = F.array_sort(F.transform(F.col("w"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.filter(
        F.transform(F.col("r"), lambda x, k: F.when((F.get(F.col("r"), k - 1).h == x.h) | (F.get(F.col("r"), k + 1).h == x.h), x.i)), lambda x: x.isNotNull()
    )
    covered = F.aggregate(
        F.array_sort(F.col("t")),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a.n + i + 5 - F.greatest(i, a.end)).alias("n"), (i + 5).alias("end")),
    ).n
    return windows, ranked, twins, covered


def quality(
    df: DataFrame, ratios: list[float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row a row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    A null text has no words: counts 0, base_failed, not kept, score 0. Repeated rows give repeated results; other columns are
    ignored; an empty table gives no rows. Five-word windows and n-grams compare by 64-bit hashes.
    """
    buckets = len(ratios)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")  # folded into one literal
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.select(
        "doc_id",
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
        _hashes(F.col("text")).alias("hashes"),
    )
    windows, ranked, twins, covered = _repeat_words(F.col("hashes"))
    scored = counted.select(
        "doc_id",
        F.size("hashes").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("w"),
        F.transform(_grams(F.col("hashes")), lambda h: F.pmod(h, F.lit(buckets)).cast("int")).alias("b"),
    ).select(
        "*",
        (F.aggregate("b", F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.greatest(F.size("b"), F.lit(1))).alias("score"),
        (F.size(F.array_distinct("w")) < F.size("w")).alias("repeats"),
    )
    repeated = (
        scored.select("*", F.when(F.col("repeats"), ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("r"))
        .select("*", twins.alias("t"))
        .select("*", covered.cast("long").alias("n_repeat_words"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return repeated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score").select(
        "*", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept")
    )
