"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are counted by a byte automaton over the Arrow buffers of texts: a lookup table gives each byte's class (its lower-case byte, or 0 outside words),
differences of the classes give the words' bounds, and table-driven CRCs are advanced from all words' starts at once, byte by byte, on from one word
to the next for pairs and triples. One pass counts the buckets of all documents, a second one adds up each document's gains; then documents are
drawn by their weight with Gumbel noise that depends on the id alone.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import partitions, prepare, scratch, written

BUCKETS = 10_000
#: Longest run of words that is a feature.
ORDERS = 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of text that are worked on at a time, and bytes of a word after which its CRC goes on alone.
BLOCK, LONGEST = 1 << 18, 48
_ONES, _BYTE, _EIGHT = np.uint32(0xFFFFFFFF), np.uint32(255), np.uint32(8)


@functools.cache
def classes() -> np.ndarray:
    """For each byte its lower-case byte if words hold it (digits, letters, and all bytes of characters beyond ASCII), else 0."""
    out = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[low : high + 1] = np.arange(low, high + 1)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


@functools.cache
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def word_bounds(low: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of classified bytes. cuts: where texts begin or end, which also ends a word."""
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    within = cuts[(cuts > 0) & (cuts < len(low))]
    begins[within] = inside[within]
    ends[within - 1] = inside[within - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def run_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray, orders: int = ORDERS) -> list[np.ndarray]:
    """For k = 1.. the CRC-32 of each run of k words (joined by one space), at the place of the run's first word."""
    table, length = crc_table(), end - start
    order = np.argsort(-np.minimum(length, LONGEST + 1).astype(np.int16), kind="stable")
    going = np.searchsorted(-length[order], -np.arange(min(LONGEST, int(length.max(initial=0)))), "left").tolist()  # how many words are longer than k
    at = start[order]
    long = np.flatnonzero(length > LONGEST).tolist()
    out, state = [], np.full(len(start), _ONES)
    for k in range(min(orders, len(start))):
        if k:  # on to the next word: state of the run that ends before it, and a space
            state = table[(state[:-1] ^ np.uint32(32)) & _BYTE] ^ (state[:-1] >> _EIGHT)
            state = np.concatenate([np.zeros(1, np.uint32), state])  # at the place of the run's last word; the first k words end no run
        s = state[order]
        for step, n in enumerate(going):
            head = s[:n]
            s[:n] = table[(head ^ low[at[:n] + step]) & _BYTE] ^ (head >> _EIGHT)
        state = np.empty_like(s)
        state[order] = s
        for w in long:
            state[w] = zlib.crc32(low[start[w] + LONGEST : end[w]].tobytes(), int(state[w] ^ _ONES)) ^ 0xFFFFFFFF
        out.append(state[k:] ^ _ONES)
    return out


def features(texts: pa.Array, buckets: int = BUCKETS, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of a column of texts: (row of each word), (row of each feature), (bucket of each feature)."""
    texts = texts.fill_null("")
    if not len(texts) or texts.buffers()[2] is None:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    values, table = np.frombuffer(texts.buffers()[2], np.uint8), classes()

    def told(low: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, firsts: int):
        """Features whose first word is one of the `firsts` first."""
        rows, found = [], []
        for k, crc in enumerate(run_crcs(low, start, end, orders)):
            same = row[: len(row) - k] == row[k:]
            same[firsts:] = False
            rows.append(row[: len(row) - k][same])
            found.append((crc[same] % np.uint32(buckets)).astype(np.int64))
        return (row[:firsts], np.concatenate(rows), np.concatenate(found)) if rows else None

    k = 0
    while k < len(texts):
        m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1)
        a, b = offsets[k], offsets[m]
        if m > k + 1 or b - a <= 2 * BLOCK:
            low = table[values[a:b]]
            start, end = word_bounds(low, offsets[k : m + 1] - a)
            row = np.searchsorted(offsets[k + 1 : m + 1] - a, start, "right") + k
            if block := told(low, start, end, row, len(row)):
                yield block
        else:  # one long text, window by window; the next one begins with the words whose runs were not whole
            size = BLOCK
            while a < b:
                low = table[values[a : min(a + size, b)]]
                start, end = word_bounds(low, np.zeros(0, np.int64))
                last = a + size >= b
                if not last and len(end) and end[-1] == len(low):
                    start, end = start[:-1], end[:-1]
                firsts = len(start) if last else len(start) - orders + 1
                if not last and firsts < 1:
                    size *= 2
                    continue
                if block := told(low, start, end, np.full(len(start), k), firsts):
                    yield block
                a, size = (b if last else a + start[firsts]), BLOCK
        k = m


def bucket_counts(df: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts each bucket holds. A task gives a row for each of its buckets, so what comes together is bounded."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], schema=schema)

    prepare(df.sparkSession)
    out = [0] * buckets
    for row in df.select(F.col(text_col).alias("text")).mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[row.bucket] = row.n
    return out


def gains(raw: Sequence[int], target: Sequence[int]) -> list[int]:
    """For each bucket floor(1000 ln(target share / raw share)), add-one smoothed."""
    b = len(raw)
    all_raw, all_target = sum(raw) + b, sum(target) + b
    return [math.floor(1000 * math.log(float(t + 1) * float(all_raw) / (float(s + 1) * float(all_target)))) for s, t in zip(raw, target)]


def weights(df: DataFrame, gain: Sequence[int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a row of df: doc_id, n_words, n_features, weight (the sum of its features' gains)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, np.int64)
        for batch in batches:
            words, number, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for of_words, rows, found in features(batch.column(1), len(worth)):
                first = int(rows[0])  # a block's rows follow each other
                words[first:] += np.bincount(of_words - first, minlength=batch.num_rows - first)
                number[first:] += np.bincount(rows - first, minlength=batch.num_rows - first)
                weight[first:] += np.bincount(rows - first, weights=worth[found], minlength=batch.num_rows - first).astype(np.int64)  # whole numbers far below 2^53
            yield pa.record_batch([batch.column(0), *map(pa.array, (words, number, weight))], schema=schema)

    prepare(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


def with_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """weighed with score: weight and Gumbel noise (in thousandths) from the first 32 bits of sha256(seed:id)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("long"))


def draw(scored: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, .. for the highest scores of rows with enough words, as many as the percentage of these gives; null for others.

    Rows are dealt by ranges of (score, id) and numbered where they lie; the parts' sizes, one number each, give the offsets.
    """
    spark = scored.sparkSession
    enough = F.col("n_words") >= least_words
    many = scored.filter(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    dealt = scored.filter(enough).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumns({"__part": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("__part").agg(F.max("__i") + 1).collect())):  # a row a partition
        offsets.append((part, before))
        before += n
    at = F.broadcast(spark.createDataFrame(offsets, "__part int, __before long"))
    rank = F.col("__before") + F.col("__i") + 1
    ranked = placed.join(at, "__part").withColumn("rank", F.when(rank <= many, rank)).drop("__part", "__i", "__before")
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row a row of df: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    A null text has no words (weight 0). A null id has the noise of the empty id and comes last among equal scores; repeated rows of one id are ranked
    each, rows alike in no order. Other columns are not read. An empty target leaves the weights to smoothing; an empty table gives no rows.
    """
    with scratch() as keep:
        gain = gains(bucket_counts(df, text_col=text_col, buckets=buckets), bucket_counts(target, text_col=target_col, buckets=buckets))
        scored = written(with_score(weights(df, gain, id_col=id_col, text_col=text_col), seed), "scored")
        return keep(written(draw(scored, percent=percent, least_words=least_words), "drawn"))
