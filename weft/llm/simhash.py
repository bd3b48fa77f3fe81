"""Near copies by SimHash fingerprints and a covering code.

A document's fingerprint has, for each of 64 bits, the majority of its shingles' hashes. Two fingerprints within a distance of 4 are within 1 on one of the
three parts of their bits (pigeonhole). On each part the words of a covering code, a product of perfect Hamming codes and free bits, are the anchors. A fingerprint's home is
its nearest anchor, within the covering radius; whatever differs from it in one bit of the part finds that anchor within the radius and one
more, so fingerprints are copied to all anchors which they come to by at most one changed bit, and each anchor compares its guests with those at home. One code over all
64 bits, with the radius and four more, would copy a fingerprint more than a thousand times; the parts make about thirty.

Equal fingerprints count once, anchors with many fingerprints are compared in cells of bounded size, and a task hands on a spanning forest of what it links.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import few, partitions, prepare, scratch, written
from weft.llm.components import components
from weft.llm.filter_audit import pieces

WORDS, SEED, DIFFERENT = 4, 42, 4
#: The factors of each part's code: Hamming codes of 15, 7 and 3 bits, and free bits; 22 + 22 + 20 bits.
PARTS = ((15, 7), (15, 7), (15, 3, 1, 1))
#: Rows of an anchor that are compared together at least before it is cut into cells, and distances that are computed at a time.
CELL, AT_ONCE = 4096, 1 << 22
_LANES = np.uint64(0x0001000100010001)


def _hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of `size` words of a text, in lower case (A-Z) and joined by single spaces; of all words if they are fewer."""
    digest, held, any_run = xxhash.xxh64_intdigest, [], False
    for piece in pieces(data):
        words = held + piece.lower().split()  # of bytes: ASCII only
        held = words[max(0, len(words) - size + 1) :]
        if len(words) < size:
            continue
        any_run = True
        joined = b" ".join(words)
        end = np.cumsum([len(w) + 1 for w in words]) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(start) - size + 1].tolist(), end[size - 1 :].tolist())], np.uint64)
    if held and not any_run:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes | None, size: int = WORDS) -> int:
    """64 bits: those that more than half of the shingles' hashes have. 0 without words."""
    count, n = np.zeros((16, 4), np.int64), 0
    shifts = np.arange(16, dtype=np.uint64)
    for hashes in _hashes(text or b"", size):
        n += len(hashes)
        for k in range(0, len(hashes), 8192):  # four counters of 16 bits in a number
            lanes = ((hashes[k : k + 8192, None] >> shifts) & _LANES).sum(axis=0)
            count += lanes.view(np.uint16).reshape(16, 4)
    bits = np.flatnonzero((2 * count > n).T.ravel())  # lane j of shift i is bit 16 j + i
    return sum(1 << int(b) for b in bits)


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """A row a row of df: doc_id, print (as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    prepare(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(task, "doc_id long, print long")


@functools.cache
def _code(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a perfect code of 2^r - 1 bits (1: every word is a code word): each word's nearest code word, and the other ones that its neighbours have (-1: none)."""
    words = np.arange(1 << bits)
    if bits == 1:
        return words, (words ^ 1)[:, None]
    syndrome = np.zeros(1 << bits, np.int64)
    for k in range(bits):
        syndrome ^= np.where(words >> k & 1, k + 1, 0)
    nearest = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    others = np.sort(np.stack([nearest[words ^ (1 << k)] for k in range(bits)], axis=1), axis=1)
    others[(others == nearest[:, None]) | np.concatenate([np.zeros((1 << bits, 1), bool), others[:, 1:] == others[:, :-1]], axis=1)] = -1
    others = -np.sort(-others, axis=1)
    return nearest, others[:, (others >= 0).any(axis=0)]


def anchors(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, place in prints, home) for prints (unsigned): each print's home and the anchors that it visits, on each part."""
    everyone, shift = np.arange(len(prints)), 0
    for part, factors in enumerate(PARTS):
        value = ((prints >> np.uint64(shift)) & np.uint64((1 << sum(factors)) - 1)).astype(np.int64)
        home, at, pieces_of = np.full(len(prints), part << 22), 0, []
        for bits in factors:
            word = (value >> at) & ((1 << bits) - 1)
            home |= _code(bits)[0][word] << at
            pieces_of.append((word, at, bits))
            at += bits
        yield home, everyone, True
        for word, at, bits in pieces_of:
            own, others = _code(bits)
            for k in range(others.shape[1]):
                other = others[word, k]
                there = np.flatnonzero(other >= 0)
                if len(there):
                    yield home[there] ^ ((own[word[there]] ^ other[there]) << at), there, False
        shift += sum(factors)


def _counted(prints: DataFrame) -> dict[int, int]:
    """Fingerprints at each anchor; there are under three times 2^22 anchors, of which 3 x 2^15 at most are code words."""
    schema = pa.schema([("anchor", pa.int32()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(PARTS) << 22, np.int32)
        for batch in batches:
            for anchor, _, _ in anchors(batch.column(0).to_numpy().view(np.uint64)):
                np.add.at(total, anchor, 1)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held].astype(np.int64))], schema=schema)

    rows = prints.select("print").mapInArrow(task, "anchor int, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return {r.anchor: r.n for r in rows.collect()}


def _celled(prints: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """(cell, print, home). An anchor of `cuts` is cut into so many chunks by the fingerprint's hash; a cell is a pair of chunks, a fingerprint comes to all cells of its chunk."""
    schema = pa.schema([("cell", pa.int64()), ("print", pa.int64()), ("home", pa.bool_())])
    held = prints.sparkSession.sparkContext.broadcast(cuts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(held.value), np.int64)
        many = np.array([held.value[a] for a in hot.tolist()], np.int64)

        def batch_of(cell: np.ndarray, found: np.ndarray, home: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array(cell), pa.array(found), pa.array(np.full(len(cell), home))], schema=schema)

        for batch in batches:
            signed = batch.column(0).to_numpy()
            chunk = (signed.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
            for anchor, place, home in anchors(signed.view(np.uint64)):
                cell = anchor.astype(np.int64) << 40
                if not len(hot):
                    yield batch_of(cell, signed[place], home)
                    continue
                found = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                cut = np.where(hot[found] == anchor, many[found], 1)
                yield batch_of(cell[cut == 1], signed[place[cut == 1]], home)
                for k in np.flatnonzero(cut > 1).tolist():
                    s = int(cut[k])
                    own = int(chunk[place[k]]) % s
                    other = np.arange(s)
                    cells = cell[k] | np.minimum(own, other) << 20 | np.maximum(own, other)
                    yield batch_of(cells, np.full(s, signed[place[k]]), home)

    return prints.select("print").mapInArrow(task, "cell long, print long, home boolean")


def _forest(prints: np.ndarray, home: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a large cell that join what its links of homes and guests join: what a home reaches leaves the others before the next one is compared."""
    left = np.arange(len(prints))
    while True:
        seeds = left[home[left]]
        if not len(seeds):
            return
        front, left = seeds[:1], left[left != seeds[0]]
        while len(front) and len(left):
            size = max(1, AT_ONCE // len(left))
            one, front = front[:size], front[size:]
            near = np.bitwise_count(prints[one][:, None] ^ prints[left][None, :]) <= most
            hit = near.any(axis=0)
            if hit.any():
                yield prints[one[near[:, hit].argmax(axis=0)]], prints[left[hit]]
                front = np.concatenate([front, left[hit]])
                left = left[~hit]


def _links(celled: DataFrame, many: int, most: int) -> DataFrame:
    """(a, b): links of fingerprints, a spanning forest of each task's."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        cell, prints, home = map(np.concatenate, zip(*parts))
        parts.clear()
        order = np.lexsort((~home, cell))  # those at home first
        cell, prints, home = cell[order], prints[order].view(np.uint64), home[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, len(cell)))
        homes = np.add.reduceat(home, first, dtype=np.int64)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        def join(one: np.ndarray, two: np.ndarray) -> None:
            for a, b in zip(one.view(np.int64).tolist(), two.view(np.int64).tolist()):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)

        large = size * homes > AT_ONCE
        for at, n in zip(first[large].tolist(), size[large].tolist()):
            for one, two in _forest(prints[at : at + n], home[at : at + n], most):
                join(one, two)
        first, size, homes = first[~large], size[~large], homes[~large]
        work = np.cumsum(size * homes)
        lo = 0
        while lo < len(first):  # many small cells at once
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + 2 * AT_ONCE, "right")))
            times = np.repeat(size[lo:hi], homes[lo:hi])  # for each home its cell's rows
            begin = np.repeat(first[lo:hi], homes[lo:hi])
            rank = np.arange(len(times)) - np.repeat(np.cumsum(homes[lo:hi]) - homes[lo:hi], homes[lo:hi])
            one = np.repeat(begin + rank, times)
            two = np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            linked = np.flatnonzero((np.bitwise_count(prints[one] ^ prints[two]) <= most) & (one != two))
            join(prints[one[linked]], prints[two[linked]])
            lo = hi
        nodes = [x for x in up if top(x) != x]
        for k in range(0, len(nodes), 50_000):
            some = nodes[k : k + 50_000]
            yield pa.record_batch([pa.array([top(x) for x in some], pa.int64()), pa.array(some, pa.int64())], schema=schema)

    return celled.repartition(many, "cell").mapInArrow(task, "a long, b long")


def near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, most: int = DIFFERENT) -> DataFrame:
    """One row a row of df: doc_id, fingerprint (16 hex digits), n_prints (different fingerprints in its component), component_id (the smallest id reachable by links).

    Texts without words (null, empty, blank) have fingerprint zero and are linked like others. Null ids take part in links; a component of null ids
    only has a null component_id. Repeated rows give repeated results; other columns are not read; an empty table gives no rows. most: 5 at most, which the three parts allow.
    """
    if not 0 <= most <= 5:
        raise ValueError("three parts with one changed bit each find links of up to 5 bits")
    with scratch() as keep:
        prints = written(fingerprints(df, id_col=id_col, text_col=text_col, size=size), "prints")
        classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
        at = _counted(classes)
        rows = sum(at.values())
        chunk = max(CELL, rows // (2 * partitions(df.sparkSession)))
        cuts = {a: -(-n // chunk) for a, n in at.items() if n > chunk}
        many = max(partitions(df.sparkSession), rows // 2_000_000)
        found = components(_links(_celled(classes, cuts), many, most))
        linked = written(classes.join(found, classes["print"] == found["node"]).select("print", "root", "first"), "linked")
        least = written(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_prints")), "least")
        named = linked.join(few(least), "root").select("print", "component_id", "n_prints")
        alone = classes.filter("n > 1").join(linked.select("print"), "print", "left_anti").select("print", F.col("first").alias("component_id"), F.lit(1).cast("long").alias("n_prints"))
        told = few(written(named.unionByName(alone), "named"))
        return keep(
            written(
                prints.join(told, "print", "left").select(
                    "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.coalesce("n_prints", F.lit(1)).alias("n_prints"), F.coalesce("component_id", "doc_id").alias("component_id")
                ),
                "near-copies",
            )
        )
