"""Packing of tokenised documents into fixed-length sequences (vector bin packing, dot-product heuristic).

Each item demands (tokens, one segment, loss-bearing tokens); a sequence offers limits on all three. The next item
of an open sequence is the one whose demand has the largest dot product with what is left, among those that fit
whole; where none does, the best item is cut to fill the gap. A sequence that must close early is cut back to a power
of two, a length that needs no padding. Tasks pack their own rows: no shuffle, one bounded buffer, no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import prepare
from weft.llm.tokens import encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


#: Items the heuristic chooses among; the rest of the buffer waits in order.
POOL = 128
#: Ids a task buffers before it packs them (4 bytes each).
BUFFER_IDS = 2_000_000


class Packer:
    """add() items in order, flush() to get (item, start, length, sequence, offset, loss) pieces."""

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("every limit must be at least 1")
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.limits, self.sequence, self.waiting = limits, 0, []
        self.pieces: list[tuple[int, int, int, int, int, int]] = []

    def add(self, item: int, length: int, loss_from: int = 0) -> None:
        """loss_from: tokens of the item from this position on bear loss."""
        start, cap, most = 0, self.limits.tokens, self.limits.loss_tokens
        while length - start >= cap:
            take = cap
            loss = max(0, start + take - max(start, loss_from))
            if loss > most:  # as long a power of two as the loss limit allows
                take = 1 << (max(1, start + cap - loss - start + most).bit_length() - 1)
                take = min(take, 1 << (cap.bit_length() - 1))
                loss = max(0, start + take - max(start, loss_from))
            self.pieces.append((item, start, take, self.sequence, 0, loss))
            self.sequence += 1
            start += take
        if start < length:
            self.waiting.append((item, start, length - start, loss_from))

    def flush(self, last: bool) -> list[tuple[int, int, int, int, int, int]]:
        """Pack what waits; before the end of the input the last, unfilled sequence is kept waiting."""
        queue, todo = self.waiting[::-1], sum(x[2] for x in self.waiting)
        pool: list[tuple[int, int, int, int]] = []
        tokens, loss = np.zeros(POOL), np.zeros(POOL)
        cap_t, cap_s, cap_l = self.cap
        while todo and (last or todo >= self.limits.tokens):
            left_t, left_s, left_l, bin_ = cap_t, cap_s, cap_l, []
            while left_t and left_s and todo:
                while queue and len(pool) < POOL:
                    item, start, length, loss_from = queue.pop()
                    tokens[len(pool)], loss[len(pool)] = length, max(0, start + length - max(start, loss_from))
                    pool.append((item, start, length, loss_from))
                n = len(pool)
                t, b = tokens[:n], loss[:n]
                score = t * (left_t / cap_t**2) + b * (left_l / cap_l**2) + left_s / cap_s**2
                fits = (t <= left_t) & (b <= left_l)
                best = int(np.argmax(np.where(fits, score, -1.0) if fits.any() else score))
                item, start, length, loss_from = pool[best]
                take = int(min(length, left_t))
                bears = max(0, start + take - max(start, loss_from))
                if bears > left_l:
                    take -= int(bears - left_l)
                    bears = int(left_l)
                if take <= 0:
                    break
                bin_.append((item, start, take, loss_from))
                left_t, left_s, left_l, todo = left_t - take, left_s - 1, left_l - bears, todo - take
                if take < length:
                    pool[best] = (item, start + take, length - take, loss_from)
                    tokens[best] = length - take
                    loss[best] = max(0, start + length - max(start + take, loss_from))
                else:
                    pool[best], tokens[best], loss[best] = pool[-1], tokens[n - 1], loss[n - 1]
                    pool.pop()
            todo += self._close(bin_, queue)
        self.waiting = pool + queue[::-1]
        out, self.pieces = self.pieces, []
        return out

    def _close(self, bin_: list, queue: list) -> int:
        """Number a sequence; one that is not full is first cut back to a power of two. Returns tokens given back."""
        total = sum(x[2] for x in bin_)
        keep = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        offset = 0
        for item, start, take, loss_from in bin_:
            put = min(take, keep - offset)
            if put:
                bears = max(0, start + put - max(start, loss_from))
                self.pieces.append((item, start, put, self.sequence, offset, bears))
                offset += put
            if put < take:
                queue.append((item, start + put, take - put, loss_from))
        self.sequence += 1
        return total - keep


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    limits: Limits = Limits(),
    end_id: int = 1,
    blanks: bool = False,
) -> DataFrame:
    """Pieces of all documents with their ids, sequence and place in it.

    tokenizer: path of a vocabulary of the tokenizers library, which must be the same on every executor.
    loss_col: a count of leading tokens that bear no loss (prompts); absent or null: every token bears loss.
    Columns: doc_id, start, length, doc_tokens, sequence_id, offset, loss_tokens, ids (little-endian unsigned 32-bit).
    A null or empty text is the end id alone; repeated rows and ids are packed as they come; other columns are
    ignored; an empty table gives no rows. Sequence numbers are unique, and the same when a lost task runs again.
    """
    prepare(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.coalesce(F.col(loss_col).cast("long"), F.lit(0)) if loss_col else F.lit(0).cast("long")).alias("loss_from"),
    )
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens")]
        + [("ids", pa.binary())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer, blanks), Packer(limits)
        base, end = TaskContext.get().partitionId() << 33, int(end_id).to_bytes(4, "little")
        held: dict[int, tuple] = {}
        number = held_ids = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = packer.flush(last)
            for at in range(0, len(pieces), 4000):
                cols: list[list] = [[] for _ in schema]
                for item, start, length, sequence, offset, bears in pieces[at : at + 4000]:
                    doc_id, ids = held[item]
                    values = (doc_id, start, length, len(ids) // 4, base + sequence, offset, bears, ids[4 * start : 4 * (start + length)])
                    for col, value in zip(cols, values):
                        col.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            kept = {x[0] for x in packer.waiting}
            for item in [x for x in held if x not in kept]:
                del held[item]

        for batch in batches:
            for doc_id, text, loss_from in zip(*(c.to_pylist() for c in batch.columns)):
                ids = coder.encode(text or "") + end
                held[number] = (doc_id, ids)
                packer.add(number, len(ids) // 4, loss_from)
                number, held_ids = number + 1, held_ids + len(ids) // 4
                if held_ids >= BUFFER_IDS:
                    yield from out(False)
                    held_ids = sum(len(ids) // 4 for _, ids in held.values())
        yield from out(True)

    return rows.mapInArrow(task, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
