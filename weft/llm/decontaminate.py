"""Benchmark decontamination by latent semantic retrieval.

Passages (blocks of PASSAGE words of documents, and benchmark items) are TF-IDF vectors over hashed words. One pass writes the
words' buckets and counts in how many passages each occurs; a second one, over the buckets, multiplies the passages' Gram matrix with a random matrix, task by task, and a Nystroem
step turns that product into the leading right singular vectors. Documents' windows and benchmark items are projected onto them; windows whose
cosine with an item is high enough are candidates. Only windows that hold as many of an item's words as any match must are projected, which loses none; those that
hold as many as a copy must are candidates whatever their cosine. A candidate counts if the longest common subsequence of words holds most of the
item, or, for paraphrases, a good part of it and of the item's answer (the part after its last question, or else its last sentence).
Matrices have a fixed size; the benchmark is the query set and must be small enough to be held by each task (checked).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import discard, free, partitions, prepare, written
from weft.llm.hashing import M3, PIECE, odd_values, runs

BUCKETS = 1 << 14
#: Rank of the latent space; columns more that the random start has, and products with the Gram matrix after the first.
RANK, OVERSAMPLING, POWERS = 32, 8, 1
PASSAGE = 64
#: Windows begin at each block of STEP words; an item is looked for in windows of the first size that holds it wherever in the first block it starts.
STEP = 16
COSINE = 0.3
#: Share of an item's words in the longest common subsequence; for paraphrases, and of the answer's words then.
SAME, PARAPHRASE, ANSWER = 0.75, 0.6, 0.9
#: The share for a window whose cosine is at least CLOSE: a paraphrase in other words, of an item whose answer has so many words.
LOOSE, CLOSE, LOOSE_ANSWER = 0.4, 0.65, 5
#: Cells of a matrix that a search holds at a time, and characters of texts that are searched together.
CELLS = 1_000_000
CHARACTERS_AT_ONCE = 500_000
#: A match's words lie within so many times the item's length.
SPREAD = 1.4
#: Shortest item, in words, that is looked for by similarity; a shorter one is looked up by its whole word sequence.
LEAST_WORDS = 8
#: The most benchmark bytes that are sent to each task.
BENCHMARK_BYTES = 64_000_000
SEED = 7

_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s")


def _plain(token: str) -> str:
    return "".join(_WORD.findall(token))


def words_of(text: str | None) -> list[str]:
    return [w for w in map(_plain, (text or "").lower().split()) if w]


@functools.cache
def _characters() -> np.ndarray:
    """For each code point 1: of a word, 2: white space, 0: dropped."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.zeros(len(every), np.uint8)
    kind[[m.start() for m in re.finditer(r"[^\W_]", every)]] = 1
    kind[[m.start() for m in re.finditer(r"\s", every)]] = 2
    return kind


def _piece(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first code point) of each word of a lower-case text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _characters()[codes]
    at = np.flatnonzero(kind == 1)
    if not len(at):
        return np.empty(0, np.uint16), at
    token = np.cumsum(kind == 2, dtype=np.int32)[at]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    of = codes[at]
    value = odd_values(1 << 16, 17)[of & np.uint32(0xFFFF)] + (of >> np.uint32(16)) * M3
    return (runs(value, start, np.append(start[1:], len(at))) & np.uint64(BUCKETS - 1)).astype(np.uint16), at[start]


def buckets_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word of all texts, number of words of each text). The words are those of words_of."""
    ids, counts, held, n = [], [], [], 0

    def together() -> None:
        got, at = _piece("\n".join(held))
        ids.append(got)
        counts.append(np.diff(np.searchsorted(at, np.cumsum([0, *[len(x) + 1 for x in held]]))))

    for text in texts:
        low = (text or "").lower()
        if n + len(low) > PIECE and held:
            together()
            held, n = [], 0
        if len(low) <= 2 * PIECE:
            held.append(low)
            n += len(low)
            continue
        at, size = 0, 0
        while at < len(low):
            space = _SPACE.search(low, at + PIECE)
            ids.append(_piece(low[at : space.start() if space else len(low)])[0])
            size += len(ids[-1])
            at = space.start() if space else len(low)
        counts.append(np.array([size]))
    if held:
        together()
    return np.concatenate([np.empty(0, np.uint16), *ids]), np.concatenate([np.empty(0, np.int64), *counts])


def _ids(words: list[str]) -> np.ndarray:
    return buckets_of([" ".join(words)])[0]


def _chunks(batches: Iterator[pa.RecordBatch], step: int, most: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each word, first word of each block) of many texts at a time."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for k in range(0, len(texts), most):
            ids, counts = buckets_of(texts[k : k + most])
            if len(ids):
                counts = counts[counts > 0]
                blocks = -(-counts // step)
                place = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                yield ids, np.repeat(np.cumsum(counts) - counts, blocks) + place * step


def tokenised(texts: DataFrame) -> DataFrame:
    """Every text of the one column once: rows (bucket, n), passages that hold it (bucket BUCKETS: passages in all), and rows (ids, first) of words and blocks."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("first", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(BUCKETS, np.int64), 0
        for ids, first in _chunks(batches, PASSAGE):
            order = np.argsort(ids, kind="stable")
            of, passage = ids[order], _passages(len(ids), first)[order]
            fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (passage[1:] != passage[:-1])])
            total += np.bincount(of[fresh], minlength=BUCKETS)
            passages += len(first)
            yield pa.record_batch([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([first.astype("<i4").tobytes()], pa.binary())], schema=schema)
        if passages:
            held = [*np.flatnonzero(total).tolist(), BUCKETS]
            yield pa.record_batch([pa.array(held, pa.int32()), pa.array([*total[held[:-1]].tolist(), passages], pa.int64()), pa.nulls(len(held), pa.binary()), pa.nulls(len(held), pa.binary())], schema=schema)

    return texts.mapInArrow(task, "bucket int, n long, ids binary, first binary")


def _passages(n: int, first: np.ndarray) -> np.ndarray:
    """Number of the passage of each of n words."""
    out = np.zeros(n, np.int32)
    out[first[1:]] = 1
    return np.cumsum(out, dtype=np.int32)


def passage_counts(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each bucket, and passages in all."""
    rows = tokens.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket
    counts = np.zeros(BUCKETS + 1, np.int64)
    for row in rows:
        counts[row.bucket] = row.n
    return counts[:BUCKETS], int(counts[BUCKETS])


def _with_none(rows: np.ndarray) -> np.ndarray:
    """rows and one of zeros."""
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])


def _sums(rows: np.ndarray, pick: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Sums of the picked rows over runs of the given lengths, by small products of `width` rows. The last of rows is zero."""
    blocks = -(-lengths // width)
    base = np.cumsum(blocks) - blocks
    index = np.full(int(blocks.sum()) * width, len(rows) - 1, np.int32)
    index[np.repeat(base * width - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(pick))] = pick
    out = np.empty((len(index) // width, rows.shape[1]), np.float32)
    ones, step = np.ones((1, width), np.float32), max(1, 32_768 // width)
    for at in range(0, len(out), step):
        held = rows.take(index[at * width : (at + step) * width], axis=0)
        out[at : at + step] = np.matmul(ones, held.reshape(-1, width, rows.shape[1]))[:, 0]
    return out if len(out) == len(lengths) else np.add.reduceat(out, base)


def _gram(ids: np.ndarray, first: np.ndarray, weights: np.ndarray, weighted: np.ndarray, out: np.ndarray) -> None:
    """out += A' A random for the passages' unit rows A; weighted: the random matrix, each row by its bucket's weight, and a row of zeros."""
    w = weights[ids]
    rows = _sums(weighted, ids, np.diff(np.append(first, len(ids))), PASSAGE)
    rows /= np.maximum(np.add.reduceat(w * w, first), 1e-9)[:, None]
    order = np.argsort(ids, kind="stable")
    of = ids[order]
    there = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    out[of[there]] += _sums(_with_none(rows), _passages(len(ids), first)[order], np.diff(np.append(there, len(of))), 8) * weights[of[there]][:, None]


def singular_vectors(tokens: DataFrame, items: list[list[str]], weights: np.ndarray, passages: int, *, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """Leading right singular vectors (buckets x rank) of all passages, documents and benchmark weighing alike in sum.

    Randomised subspace iteration: the Gram matrix of the passages times a random matrix of some columns more than the rank, the result made orthonormal and multiplied again,
    each time by one pass over all passages; a Nystroem step on the last product gives the vectors.
    """
    start = np.random.default_rng(seed).standard_normal((BUCKETS, rank + OVERSAMPLING)).astype(np.float32)
    for _ in range(POWERS):
        start = np.linalg.qr(_gram_times(tokens, items, weights, passages, start))[0].astype(np.float32)
    product = _gram_times(tokens, items, weights, passages, start)
    shift = 1e-7 * np.linalg.norm(product) + 1e-12
    shifted = product + shift * start
    core = start.T.astype(np.float64) @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    factor = shifted @ (vectors / np.sqrt(np.maximum(values, 1e-9 * max(values.max(), 1e-12))))
    return np.linalg.svd(factor, full_matrices=False)[0][:, :rank].astype(np.float32)


def _gram_times(tokens: DataFrame, items: list[list[str]], weights: np.ndarray, passages: int, matrix: np.ndarray) -> np.ndarray:
    """The passages' Gram matrix times a matrix; tasks add up their passages, parts of rows are added up by tasks again."""
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
    size, columns = 512, matrix.shape[1]
    weighted = _with_none(matrix * weights[:, None])
    held = tokens.sparkSession.sparkContext.broadcast((weights, weighted))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BUCKETS, columns), np.float32)
        for batch in batches:
            for ids, first in zip(*batch.columns):
                _gram(np.frombuffer(ids.as_buffer(), "<u2"), np.frombuffer(first.as_buffer(), "<i4"), *held.value, out)
        parts = range(BUCKETS // size)
        yield pa.record_batch([pa.array(list(parts), pa.int32()), pa.array([out[p * size : (p + 1) * size].tobytes() for p in parts], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, np.float32).astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], schema=schema)

    product = np.zeros((BUCKETS, columns))
    chunks = tokens.filter("bucket is null").select("ids", "first")
    summed = chunks.mapInArrow(task, "part int, data binary").repartition(min(32, partitions(tokens.sparkSession)), "part").mapInArrow(add, "part int, data binary")
    for row in summed.collect():  # the fixed size of one matrix
        product[row.part * size : (row.part + 1) * size] = np.frombuffer(row.data).reshape(size, columns)
    product /= max(1, passages)
    own = np.zeros((BUCKETS, columns), np.float32)
    for words in items:
        if words:
            _gram(_ids(words), np.array([0]), weights, weighted, own)
    return product + own / max(1, len(items))


def common(one: Sequence, two: Sequence) -> int:
    """Length of the longest common subsequence, by bits of one."""
    places: dict = {}
    for k, word in enumerate(one):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(one)) - 1
    state = full
    for word in two:
        hit = state & places.get(word, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(one) - state.bit_count()


def answer_of(text: str | None) -> list[str]:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if words_of(p)]
    if not parts:
        return []
    asked = [k for k, p in enumerate(parts) if p.rstrip().endswith("?")]
    return words_of(" ".join(parts[asked[-1] + 1 :])) if asked and asked[-1] + 1 < len(parts) else words_of(parts[-1])


@dataclass(frozen=True)
class Item:
    id: int | None
    words: tuple[str, ...]
    answer: tuple[str, ...]
    #: Buckets of the words, the distinct ones, and how many of these a candidate must show, by the share of the words that it must hold
    buckets: tuple[int, ...]
    distinct: frozenset[int]
    fewest: dict[float, int]
    #: Distinct buckets of the answer's words, and how many of them hold ANSWER of these
    ending: frozenset[int]
    fewest_ending: int

    @property
    def size(self) -> int:
        """Words within which a match lies."""
        return int(SPREAD * len(self.words)) + 1


@dataclass(frozen=True)
class Index:
    """What a search needs: projection of each bucket (and a row of zeros), the items and their projections."""

    projection: np.ndarray
    items: tuple[Item, ...]
    vectors: np.ndarray
    #: (blocks of a window, blocks that hold a match which begins in the first of them, places of the items for which this holds)
    sizes: tuple[tuple[int, int, np.ndarray], ...]
    #: For each bucket the range of its entries in holders (places of items that count it), and how many counted words a loose match (none, if the answer is too
    #: short for one), a paraphrase and a copy hold at least
    ranges: np.ndarray
    holders: np.ndarray
    loose: np.ndarray
    least: np.ndarray
    copies: np.ndarray
    #: Items of fewer than LEAST_WORDS words, by their words, and the buckets of their first ones
    short: dict[tuple[str, ...], tuple[int | None, ...]]
    short_slots: np.ndarray

    def search(self, text: str | None) -> list[tuple[int | None, float, int, int, int, int]]:
        """(item, cosine, common words, first and last word of the window, words of the item) of each item found, by its best window."""
        return [x[1:] for x in self.search_all([text])]

    def search_all(self, texts: list[str | None], cosine: float = COSINE) -> list[tuple]:
        """The same for many texts, each row with its text's place in front. Many texts share the array work; a longer text is searched alone."""
        out: list[tuple] = []
        places, n = [], 0
        for k, text in enumerate(texts):
            if text:
                places.append(k)
                n += len(text)
            if n >= CHARACTERS_AT_ONCE:
                out += self._together(texts, places, cosine)
                places, n = [], 0
        return out + self._together(texts, places, cosine) if places else out

    def _together(self, texts: list[str | None], places: list[int], cosine: float) -> list[tuple]:
        ids, counts = buckets_of([texts[k] for k in places])
        held = np.flatnonzero(counts)
        lengths, places = counts[held], [places[k] for k in held.tolist()]
        out = []
        if self.short and len(ids):
            start = np.cumsum(lengths) - lengths
            at = np.flatnonzero(self.short_slots[ids])
            text = np.searchsorted(start, at, "right") - 1
            for d in np.unique(text).tolist():
                out += self._exact(places[d], texts[places[d]], (at[text == d] - start[d]).tolist())
        return out + self._search(texts, places, ids, lengths, cosine) if len(ids) and self.items else out

    def _exact(self, k: int, text: str | None, at: list[int]) -> list[tuple]:
        """Rows of the short items that stand word for word in a text, by their first place. at: places of words that may begin one."""
        words = words_of(text)
        found: dict[tuple[str, ...], int] = {}
        for size in sorted({len(x) for x in self.short}):
            for place in at:
                own = tuple(words[place : place + size])
                if own in self.short:
                    found.setdefault(own, place)
        return [(k, item, 1.0, len(own), place, place + len(own), len(own)) for own, place in found.items() for item in self.short[own]]

    def _search(self, texts: list[str | None], places: list[int], ids: np.ndarray, lengths: np.ndarray, least: float) -> list[tuple]:
        start = np.cumsum(lengths) - lengths  # first word of each text
        blocks_of = -(-lengths // STEP)
        begin = np.cumsum(blocks_of) - blocks_of  # its first block
        doc = np.repeat(np.arange(len(lengths)), blocks_of)
        first = start[doc] + (np.arange(len(doc)) - begin[doc]) * STEP
        best: dict[tuple[int, int], tuple] = {}
        text_words, of = [], -1
        for k, d, low, near in zip(*(x.tolist() for x in self._candidates(ids, first, begin[doc] + blocks_of[doc], doc, least))):
            item, at = self.items[k], int(start[d])
            high = min(at + int(lengths[d]), low + STEP + item.size)
            shown = ids[low:high].tolist()
            share = self._share(item, near, shown)
            if len(item.distinct.intersection(shown)) < item.fewest[share] or common(item.buckets, shown) < share * len(item.words):
                continue
            if of != d:
                text_words, of = words_of(texts[places[d]]), d
            step = max(1, len(item.words) // 8)
            for place in range(low - at, max(low - at + 1, high - at - item.size + step), step):
                part = text_words[place : min(high - at, place + item.size)]
                same = common(item.words, part)
                if same >= SAME * len(item.words) or same >= share * len(item.words) and common(item.answer, part) >= ANSWER * len(item.answer):
                    found = (same, near, -place, place + len(part))
                    if (d, k) not in best or found > best[d, k]:
                        best[d, k] = found
        return [(places[d], self.items[k].id, c, same, -lo, hi, len(self.items[k].words)) for (d, k), (same, c, lo, hi) in sorted(best.items())]

    @staticmethod
    def _share(item: Item, cosine: float, shown: list[int]) -> float:
        """Share of an item's words that a window must hold in order: less with the item's answer than without, and least if it is close."""
        if len(item.answer) < 3 or len(item.ending.intersection(shown)) < item.fewest_ending:
            return SAME
        return LOOSE if cosine >= CLOSE and len(item.answer) >= LOOSE_ANSWER else PARAPHRASE

    def _candidates(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """(item, text, first word, cosine) of windows near an item. end, doc: of each block, the end of its text's blocks and the text.

        All windows are projected and compared with all items; those close enough to an item are its candidates. Windows that hold so many of an item's words that they may be a copy are
        candidates whatever their cosine. What could not pass the comparison word by word is left out of the candidates by exact counts: a match keeps a share of an item's words, and
        of its commonest words, which are not counted, all may be among them.
        """
        sums = _sums(self.projection, ids, np.diff(np.append(first, len(ids))), STEP)
        total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
        every = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        reach, rows, n = max(x[1] for x in self.sizes), max(64, min(4096, CELLS // len(self.items))), len(self.items)
        for at in range(0, len(first), rows):
            last = min(len(first), at + rows + reach)
            cells = np.zeros((last - at + 1, n), np.int32)
            for b in range(at, last, 512):
                top = min(b + 512, last)
                lo, hi = first[b], first[top] if top < len(first) else len(ids)
                words = ids[lo:hi].astype(np.int64)
                count = self.ranges[words + 1] - self.ranges[words]
                entry = np.arange(int(count.sum())) + np.repeat(self.ranges[words] - (np.cumsum(count) - count), count)
                row = np.repeat(np.arange(top - b), np.diff(np.append(first[b:top], hi)))
                cells[b - at + 1 : top - at + 1] = np.bincount(np.repeat(row * n, count) + self.holders[entry], minlength=(top - b) * n).reshape(-1, n)
            np.cumsum(cells, axis=0, out=cells)
            starts = np.arange(min(rows, len(first) - at))
            for blocks, held, members in self.sizes:
                windows = (total[np.minimum(at + starts + blocks, end[at + starts])] - total[at + starts]).astype(np.float32)
                windows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", windows, windows)), 1e-9)[:, None]
                cosine = windows @ self.vectors[members].T
                shown = cells[np.minimum(starts + held, end[at + starts] - at)][:, members] - cells[starts][:, members]
                w, m = np.nonzero((cosine >= least) & (shown >= self.least[members]) | (cosine >= CLOSE) & (shown >= self.loose[members]) | (shown >= self.copies[members]))
                every.append((members[m], at + w, cosine[w, m]))
        item, block, cosine = (np.concatenate(x) for x in zip(*every))
        order = np.argsort(block, kind="stable")
        return item[order], doc[block[order]], first[block[order]], cosine[order]


def _fewest(ids: np.ndarray, words: float) -> int:
    """The least number of distinct buckets that can hold so many of an item's words."""
    held = np.cumsum(np.sort(np.unique(ids, return_counts=True)[1])[::-1])
    return int(np.searchsorted(held, words - 1e-9) + 1) if len(held) else 0


def make_index(items: list[tuple[int | None, list[str], list[str]]], projection: np.ndarray, counts: np.ndarray | None = None, short: tuple[tuple[int | None, list[str]], ...] = ()) -> Index:
    """Index of items (id, words, words of the answer) and of short ones (id, words). counts: passages that hold each bucket, to tell common words."""
    ids = [_ids(words) for _, words, _ in items]
    of = np.array([projection[x].sum(axis=0) for x in ids], np.float32).reshape(len(items), projection.shape[1])
    of /= np.maximum(np.linalg.norm(of, axis=1, keepdims=True), 1e-9)
    ends = [_ids(answer) for _, _, answer in items]
    held = tuple(
        Item(i, tuple(w), tuple(a), tuple(x.tolist()), frozenset(x.tolist()), {share: _fewest(x, share * len(w)) for share in (LOOSE, PARAPHRASE, SAME)}, frozenset(y.tolist()), _fewest(y, ANSWER * len(a)))
        for (i, w, a), x, y in zip(items, ids, ends)
    )
    sizes: dict[tuple[int, int], list[int]] = {}
    for k, item in enumerate(held):
        sizes.setdefault((-(-len(item.words) // STEP) + 1, -(-item.size // STEP) + 1), []).append(k)
    counted, left = [], []
    for x in ids:
        distinct, times = np.unique(x, return_counts=True)
        common_first = np.argsort(-(times if counts is None else counts[distinct]), kind="stable")
        most = 2 * int(np.ceil(LOOSE * len(x) - 1e-9)) // 3  # so that a third of what a match must hold is counted
        gone = int(np.searchsorted(np.cumsum(times[common_first]), most, "right"))
        counted.append(distinct[common_first[gone:]].astype(np.int64))
        left.append(int(times[common_first[:gone]].sum()))
    bucket = np.concatenate([np.empty(0, np.int64), *counted])
    order = np.argsort(bucket, kind="stable")
    holders = np.repeat(np.arange(len(held)), [len(x) for x in counted])[order]
    lengths = np.array([len(x) for x in ids], np.int64)
    loose, least, copies = (np.maximum(1, np.ceil(share * lengths - 1e-9).astype(np.int64) - np.array(left, np.int64)) for share in (LOOSE, PARAPHRASE, SAME))
    loose[[len(x.answer) < LOOSE_ANSWER for x in held]] = 1 << 40
    few: dict[tuple[str, ...], tuple[int | None, ...]] = {}
    for item, words in short:
        few[tuple(words)] = (*few.get(tuple(words), ()), item)
    short_slots = np.zeros(BUCKETS, bool)
    short_slots[[int(_ids(list(w[:1]))[0]) for w in few]] = True
    return Index(_with_none(projection), held, of, tuple((*k, np.array(m)) for k, m in sorted(sizes.items())), np.searchsorted(bucket[order], np.arange(BUCKETS + 1)), holders, loose, least, copies, few, short_slots)


def build(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Index:
    """Fit on all documents and items. Items under LEAST_WORDS words are looked up word for word, wordless ones not at all; equal ids with different texts are items apart."""
    prepare(docs.sparkSession)
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError("the benchmark is too large to be sent to each task; pass it in parts")
    items = sorted(((r.item, words_of(r.text), answer_of(r.text)) for r in asked.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    short = tuple((x[0], x[1]) for x in items if 0 < len(x[1]) < LEAST_WORDS)
    items = [x for x in items if len(x[1]) >= LEAST_WORDS]
    tokens = written(tokenised(docs.select(F.col(text_col).alias("text"))), "tokens")
    counts, passages = passage_counts(tokens)
    weights = (np.log((1 + passages) / (1 + counts)) + 0.1).astype(np.float32)
    vectors = singular_vectors(tokens, [x[1] for x in items], weights, passages)
    discard(tokens)
    return make_index(items, vectors * weights[:, None], counts, short)


def matches(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document and item found: doc_id, item_id, cosine, common_words, item_words, first_word, last_word.

    Null and wordless texts match nothing; repeated rows repeat theirs; null ids stay null; other columns are ignored; an empty table or benchmark gives none.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common_words", pa.int32()), ("item_words", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, item, cosine, same, size, lo, hi)
                for ids, texts in [[c.to_pylist() for c in batch.columns]]
                for k, item, cosine, same, lo, hi, size in held.value.search_all(texts)
                for doc_id in [ids[k]]
            ]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(task, "doc_id long, item_id long, cosine double, common_words int, item_words int, first_word int, last_word int")


def clean(docs: DataFrame, index: Index, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which nothing of the benchmark is found (null texts stay)."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def leaks(texts):
        import pandas as pd

        out = [False] * len(texts)
        for k, *_ in held.value.search_all([x if isinstance(x, str) else None for x in texts]):
            out[k] = True
        return pd.Series(out, dtype=bool)

    (told,) = free(docs, "__leaks")
    return docs.withColumn(told, leaks(F.col(text_col))).filter(~F.col(told)).drop(told)
