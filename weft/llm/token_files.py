"""Token-id files with directly addressable codes.

A shard holds the ids of consecutive documents. Each id is cut into chunks of fixed widths: level 0 has the lowest
chunk of every id, level k the next chunk of those ids that go on. A continuation bitmap beside each level but the last says which
ids go on, and a rank directory (set bits before each block of 512) finds an id's place in the next level, so that any
token is read without decoding a block.

Shard bytes, little-endian: b"WDAC1", u8 levels, u8 width of each level, u64 documents, u64 tokens, document ids (i64), null flags
(u8), offsets (u64, documents + 1); then per level: u64 values, the values (u8, u16 or u32), and, except for the last level, the
bitmap (least bit first, padded to 64 bytes) and the directory (u32 per block).
Shards are rows of Parquet files in ascending document order; Spark's commit protocol makes a lost task's files whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import partitions, prepare
from weft.llm.tokens import encoder

MAGIC = b"WDAC1"
BLOCK = 512
#: Ids in a shard before it is closed; a longer document makes a longer shard.
SHARD_IDS = 250_000
_TYPES = {8: "<u1", 16: "<u2", 32: "<u4"}


def encode_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, widths: tuple[int, ...] = (8, 16)) -> bytes:
    if sum(widths) < 32 and len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError("an id needs more bits than the levels have")
    out = [MAGIC, struct.pack("<B", len(widths)), bytes(widths), struct.pack("<QQ", len(doc_ids), len(ids))]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes()]
    out.append(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<u8").tobytes())
    rest = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32((1 << width) - 1)).astype(_TYPES[width]).tobytes()]
        if k + 1 < len(widths):
            more = (rest >> np.uint32(width)).astype(np.uint32)
            on = more > 0
            bits = np.packbits(np.concatenate([on, np.zeros(-len(on) % BLOCK, bool)]), bitorder="little")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1))])
            out += [bits.tobytes(), ranks.astype("<u4").tobytes()]
            rest = more[on]
    return b"".join(out)


class Shard:
    """Reads a shard: token(i), ids(document) or everything."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a token shard")
        at = 6 + data[5]
        self.widths = tuple(data[6:at])
        self.n_docs, self.n_tokens = struct.unpack_from("<QQ", data, at)
        at += 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.offsets = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for k, width in enumerate(self.widths):
            n = int(take("<u8", 1)[0])
            values = take(_TYPES[width], n)
            blocks = -(-n // BLOCK)
            last = k + 1 == len(self.widths)
            self.levels.append((width, values, None if last else take("u1", blocks * BLOCK // 8), None if last else take("<u4", blocks + 1)))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, values, bits, ranks in self.levels:
            value |= int(values[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += width
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n_tokens, "<u4")
        at, shift = None, 0
        for width, values, bits, _ in self.levels:
            part = values.astype(np.uint32) << np.uint32(shift)
            if at is None:
                out[:] = part
            else:
                out[at] |= part
            if bits is None:
                break
            on = np.flatnonzero(np.unpackbits(bits, count=len(values), bitorder="little"))
            at = on if at is None else at[on]
            shift += width
        return out


def write_token_files(
    df: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, blanks: bool = True, widths: tuple[int, ...] | None = None
) -> None:
    """Encode every text, add end_id, and write the shards in ascending document order (null ids first, equal ids by text).

    widths: bits of the levels; by default two of 8 bits where the vocabulary's ids need no more, else one of 8 and one of 16.

    Null or empty texts are the end id alone; repeated rows stay; other columns are ignored; an empty table gives files without shards.
    """
    prepare(df.sparkSession)
    n = partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer, blanks), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        levels = widths or ((8, 8) if max(end_id, coder.tokenizer.get_vocab_size() - 1, *coder.tokenizer.get_added_tokens_decoder()) < 1 << 16 else (8, 16))
        docs, counts, parts, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.record_batch([[part], [before], [len(docs)], [len(ids)], pa.array([encode_shard(docs, counts, ids, levels)], pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = coder.encode(text or "") + end
                docs.append(doc_id)
                counts.append(len(ids) // 4)
                parts.append(ids)
                size += len(ids) // 4
                if size >= SHARD_IDS:
                    yield closed()
                    docs, counts, parts, size, before = [], [], [], 0, before + size
        if docs:
            yield closed()

    # not compressed, so that a shard's bytes lie in the file as they are
    ordered.mapInArrow(task, "part long, before long, n_docs long, n_tokens long, data binary").write.option("compression", "none").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each part. One number a written part, as many as the writer's range partitions."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, before = {}, 0
    for row in sorted(totals, key=lambda r: r.part):
        starts[row.part], before = before, before + row.n
    return starts


def token(spark: SparkSession, path: str, i: int) -> int:
    """Token i of all, from the one shard that holds it; the others are skipped by their file statistics."""
    starts = shard_starts(spark, path)
    part = max((p for p, n in starts.items() if n <= i), key=lambda p: (starts[p], p), default=None)
    if part is None or i < 0:
        raise IndexError(i)
    here = i - starts[part]
    row = spark.read.parquet(path).filter((F.col("part") == part) & (F.col("before") <= here) & (F.col("before") + F.col("n_tokens") > here)).select("before", "data").first()
    if row is None:
        raise IndexError(i)
    return Shard(bytes(row.data)).token(here - row.before)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    starts = shard_starts(spark, path)
    rows = spark.read.parquet(path).select("part", "before", "data")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(k) for k in range(3))):
                shard = Shard(data.as_py())
                raw, edges = shard.all().tobytes(), shard.offsets
                first = starts[part.as_py()] + before.as_py()
                for at in range(0, shard.n_docs, 2000):
                    cut = edges[at : at + 2001]
                    ids = [raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:])]
                    yield pa.record_batch(
                        [pa.array(shard.doc_ids[at : at + 2000], pa.int64()), pa.array(first + cut[:-1]), pa.array(np.diff(cut)), pa.array(ids, pa.binary())], schema=schema
                    )

    return rows.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
