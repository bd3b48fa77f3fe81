"""What each filter removes in every order of filters, by lattice edges.

A document's failures are a set of filters, a node of the lattice of subsets. It contributes to each edge (filters already applied, next filter) by that
set alone, so documents are counted by part, failures and labels first, these few counts are added up edge by edge (80 edges for five filters), and the
steps of all orders (600) are joined to the edges as the lattice paths that they are. Work after the first count does not grow with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import prepare

#: A: few words. B: few distinct words. C: many capitals. D: a mark. E: the text of a smaller id.
NAMES = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
_CAPITALS, _INNER, _BLANKS = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0)), b" \t\n\r\x0b\x0c"
#: Bytes of a text whose words are listed at a time.
_PIECE = 1 << 20


def pieces(data: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """Parts of a text of about `size` bytes, cut at blanks only (a longer word stays whole)."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(blank, at, at + size) for blank in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            cut = next((k for k in range(at + size, len(data)) if data[k] in _BLANKS), len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def failures_of(data: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    n, seen = 0, set()
    for piece in pieces(data):
        words = piece.split()  # of bytes: at ASCII blanks
        n += len(words)
        seen.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data) - (0 if data.isascii() else len(data) - len(data.translate(None, _INNER)))
    marked = len(data) != len(data.translate(None, MARKS))
    return (n < LEAST_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2 | marked << 3


def text_failures(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row a row of df: doc_id, part, failing (bits of A to D) and the text's 128-bit digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failing", pa.int32()), ("digest", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(map(failures_of, texts)), pa.int32()), pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary())], schema=schema)

    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(task, "doc_id long, part string, failing int, digest binary")


def counted(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failing, good, toxic, n): failures with filter E, the text of a smaller id anywhere in the table, as bit 4.

    Rows of one text are counted by part and label before they meet, so a text of a third of all rows is a few rows a task. A null id is larger than any
    other and equal to other nulls. An id with several labels is good, or toxic, if one of them says so.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = failures.join(known, "doc_id", "left").select("doc_id", "part", "failing", "digest", no("good"), no("toxic"))
    once = rows.groupBy("doc_id", "digest", "part", "failing", "good", "toxic").agg(F.count("*").alias("n"))
    alike = once.groupBy("digest", "part", "failing", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    least = F.min("first").over(W.partitionBy("digest"))
    told = alike.select("part", "failing", "good", "toxic", "n", F.when(F.col("first").eqNullSafe(least), F.col("n") - F.coalesce("at_first", "n")).otherwise(F.col("n")).alias("again"))
    both = F.array(F.struct("failing", (F.col("n") - F.col("again")).alias("n")), F.struct(F.col("failing").bitwiseOR(F.lit(16)).alias("failing"), F.col("again").alias("n")))
    split = told.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.failing", "good", "toxic", "x.n").filter("n > 0")
    return split.groupBy("part", "failing", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """(part, applied, next, removed, redundant, unique_fails, good_lost, toxic_lost, kept): a row an edge of the lattice, for every part of counts."""
    every = [(s, k) for s in range(1 << len(names)) for k in range(len(names)) if not s >> k & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(k).alias("next"), F.lit(1 << k).alias("bit")) for s, k in every])).alias("e")
    fails: Column = F.col("failing").bitwiseAND(F.col("bit")) != 0
    earlier: Column = F.col("failing").bitwiseAND(F.col("applied")) != 0
    told = {
        "kept": ~earlier & ~fails,
        "removed": ~earlier & fails,
        "redundant": earlier & fails,
        "unique_fails": F.col("failing") == F.col("bit"),
        "good_lost": ~earlier & fails & F.col("good"),
        "toxic_lost": ~earlier & fails & F.col("toxic"),
    }
    return counts.select("*", edge).select("*", "e.*").groupBy("part", "applied", "next").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in told.items()])


def steps(spark: SparkSession, names: str = NAMES) -> DataFrame:
    """(filter_order, step, applied, next): a row a step of each order, 600 of five filters."""
    rows = [("".join(names[k] for k in order), i + 1, sum(1 << k for k in order[:i]), order[i]) for order in permutations(range(len(names))) for i in range(len(names))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def paths(edge_counts: DataFrame, names: str = NAMES) -> DataFrame:
    """Every step of every order with the figures of its edge. shapley: what the step's filter removes, over all orders: each edge lies on |applied|! (others)! of them."""
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), F.bit_count("applied") + 1)
    weighed = edge_counts.withColumn("shapley", F.sum(F.col("removed") * orders).over(W.partitionBy("part", "next")))
    joined = weighed.join(F.broadcast(steps(edge_counts.sparkSession, names)), ["applied", "next"])
    return joined.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row a part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null part the empty string; repeated rows count as often as they stand and do not fail E by each other; other columns of df
    are not read; an empty table gives no rows. Texts compare by 128-bit digests.
    """
    return paths(edges(counted(text_failures(df, id_col=id_col, text_col=text_col, part_col=part_col), labels)))


def shares(rows: DataFrame, names: Sequence[str] = tuple(NAMES)) -> DataFrame:
    """(part, filter, share): each filter's mean number of removed documents over all orders, its Shapley value."""
    first = rows.filter("step = 1").select("part", F.substring("filter_order", 1, 1).alias("filter"), (F.col("shapley") / factorial(len(names))).alias("share"))
    return first.distinct()
