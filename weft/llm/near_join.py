"""Exact n-gram Jaccard self-join by parity sketches.

A document is the set of its word shingles, as 64-bit hashes. Equal sets form one class; classes are joined:

1. Sketch. The shingles of a class are dealt by hash to blocks, and a block's word is the XOR of its shingles' hashes. A shingle
   that only one of two sets has changes one word, so the number of words that differ is a lower bound of the
   symmetric difference, as is the Hamming distance of a parity sketch (each shingle flips one of two to four bits a shingle).
2. Pigeonhole. Sets with Jaccard similarity s >= 0.8 differ in at most (sum of their sizes)/9 shingles, a quarter of a set's size n
   at most. Sets of one size band have the same blocks. Of a set's occupied words at most t = n/4 are not those of a similar set, so in any
   order of words its first t+1 hold the first word that both have (a prefix filter). Words go in order of rarity: those that are
   found to be frequent in a pass over all classes come last. A set with no more than t occupied words also joins by single shingles.
   A set also joins the band below, where that reaches up to its size.
3. Groups. Words meet in hash buckets. All pairs of a small group are candidates. A large group makes a star: its hub is the member most of whose words are
   frequent, so the text that the others are copies of. Candidates must pass size and sketch.
4. Verify. Candidates are compared by their whole shingle sets, each class with its nearest candidate first, then what is not yet in one component.
5. Stars. Two members of a large group have the same star. Members outside a star's largest component are compared with all others of it by size and
   sketch, in chunks of bounded size: first a chunk hands on a spanning forest of what may be similar, then, with the components that these links make, all that is left.

Copies in one task count once before anything is shuffled. No all-pairs of a large group, no cap on partners.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import discard, few, partitions, prepare, scratch, written
from weft.llm.components import components
from weft.llm.hashing import M2, M3, PIECE, S32, mix, odd_values, runs

WORDS = 5
#: Largest group of a word whose pairs are all candidates.
SMALL = 24
BAND_RATIO = 1.6
#: Blocks of a band for each shingle of its least set: about twice as many as can differ, so that two shingles share a block and few unrelated sets a word.
BLOCKS = 0.55
LEAST_BITS = 512
#: Members of a star, and bytes of their sketches, that are compared at a time.
CHUNK, CHUNK_BYTES = 256, 4_000_000
#: Entries a task gathers before it hands them on (about 10 bytes each), and words of a bucket that are grouped at a time.
FLUSH, AT_ONCE = 1_000_000, 4_000_000
#: Frequent words that order all others: held by so many classes as counted, and so many words at most (16 bytes each), the most frequent.
#: They only order a set's words, so the bound changes no result.
FREQUENT, FREQUENT_WORDS = 32, 1 << 18
_S44 = np.uint64(44)
_BLANK = b" \t\n\r\x0b\x0c"


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte (0 for blanks), and whether it is one."""
    blank = np.zeros(256, bool)
    blank[list(_BLANK)] = True
    return np.where(blank, np.uint64(0), odd_values(256, 11)), blank


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of data."""
    value, blank = _letters()
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~blank[raw]
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return runs(value[raw], turn[::2], turn[1::2]), turn[::2]


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut where words end."""
    at = 0
    while len(data) - at > 2 * PIECE:
        cut = min((x for x in (data.find(b, at + PIECE, at + 2 * PIECE) for b in (b" ", b"\n", b"\t")) if x >= 0), default=-1)
        if cut < 0:
            cut = next((k for k in range(at + PIECE, len(data)) if data[k] in _BLANK), len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def _shingled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    factor = odd_values(size, 13)
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * factor[k]
    return mix(rolled)


def _sorted_set(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes if len(hashes) < 2 or (fresh := hashes[1:] != hashes[:-1]).all() else hashes[np.concatenate([[True], fresh])]


def shingle_sets(texts: list[str | None], size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of all runs of `size` words; with fewer words one hash of them all; without words none."""

    def of_words(words: np.ndarray) -> np.ndarray:
        return _sorted_set(_shingled(words, min(size, len(words)))) if len(words) else words

    def together(held: list[bytes]) -> Iterator[np.ndarray]:
        words, at = _word_hashes(b"\n".join(held))
        edges = np.searchsorted(at, np.cumsum([0, *[len(x) + 1 for x in held]])).tolist()
        every = _shingled(words, size) if len(words) >= size else words[:0]
        for lo, hi in zip(edges, edges[1:]):
            yield _sorted_set(every[lo : hi - size + 1]) if hi - lo >= size else of_words(words[lo:hi])

    held, n = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()  # ASCII case only, as are blanks
        if n + len(data) > PIECE and held:
            yield from together(held)
            held, n = [], 0
        if len(data) > 2 * PIECE:
            yield of_words(np.concatenate([_word_hashes(x)[0] for x in _pieces(data)]))
        else:
            held.append(data)
            n += len(data)
    if held:
        yield from together(held)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], size))


def node_of(hashes: np.ndarray) -> int:
    """Class of a shingle set: an even signed 64-bit digest (the lowest bit serves as a mark)."""
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()) & ~1, np.uint64).astype(np.int64))


@functools.cache
def band_starts() -> tuple[int, ...]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(int(np.ceil(out[-1] * BAND_RATIO)))
    return tuple(out)


def bands_of(n: int) -> list[int]:
    """Own band, then those below whose sets can be as little as 0.8 times as large."""
    starts = band_starts()
    own = int(np.searchsorted(starts, n, "right")) - 1
    out = [own]
    while out[-1] > 0 and 4 * n <= 5 * (starts[out[-1]] - 1):
        out.append(out[-1] - 1)
    return out


def differing(n: int, band: int) -> int:
    """The most shingles in which a set of n differs from a similar one that meets it in the band."""
    if n < band_starts()[band + 1]:
        return n // 4  # the other has 5n/4 at most
    return (n + band_starts()[band + 1] - 1) // 9  # a guest: the other is of the band


def block_words(hashes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit word for each occupied block (there are so many as the band's least size, times BLOCKS), and, only if they are too few for a join by them, one for each shingle."""
    blocks = max(1, int(BLOCKS * band_starts()[band]))
    values = mix(hashes ^ M3)
    block = ((hashes >> S32) * np.uint64(blocks)) >> S32  # hashes are sorted, and so blocks are
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    words = mix((np.bitwise_xor.reduceat(values, first) ^ mix(block[first] + np.uint64(1))) + np.uint64((band + 1) * int(M3) % 2**64))
    if len(words) > differing(len(hashes), band):
        return words, words[:0]
    return words, mix(values ^ mix(np.full(1, (band + 1) * int(M2) % 2**64, np.uint64)))


class Frequent:
    """Frequent words, sorted, and how many classes hold each."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.slots = np.zeros(1 << 20, bool)  # quickly tells most others
        self.slots[words >> _S44] = True

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Counts of words; 0 of those that are not frequent."""
        out = np.zeros(len(words), np.int64)
        at = np.flatnonzero(self.slots[words >> _S44])
        if len(at):
            place = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
            out[at] = np.where(self.words[place] == words[at], self.counts[place], 0)
        return out


def first_words(words: np.ndarray, number: int, frequent: Frequent) -> tuple[np.ndarray, float]:
    """The first of the words in order of rarity, then of value, and the share of frequent ones among all."""
    rank = frequent.ranks(words)
    rare = rank == 0
    first = np.sort(words[rare])[:number]
    if len(first) < number:
        rest, of = words[~rare], rank[~rare]
        first = np.concatenate([first, rest[np.lexsort((rest, of))[: number - len(first)]]])
    return first, 1 - float(rare.mean())


def join_words(hashes: np.ndarray, band: int, frequent: Frequent) -> tuple[np.ndarray, float]:
    """The words by which a set is joined in a band, and its share of frequent words."""
    number = differing(len(hashes), band) + 1
    words, single = block_words(hashes, band)
    if not len(single):
        return first_words(words, number, frequent)
    # a similar set with enough blocks shares one of these; one with as few shares a shingle
    few, share = first_words(single, number, frequent)
    return np.concatenate([words, few]), share


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Each shingle flips one of 2n to 4n bits (512 at least), a power of two; halves fold by XOR to the sketch of half the bits."""
    bits = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _far(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches (rows of 64-bit words), the wider folded."""
    while one.shape[-1] > two.shape[-1]:
        one = one[..., : one.shape[-1] // 2] ^ one[..., one.shape[-1] // 2 :]
    while two.shape[-1] > one.shape[-1]:
        two = two[..., : two.shape[-1] // 2] ^ two[..., two.shape[-1] // 2 :]
    return np.bitwise_count(one ^ two).sum(axis=-1, dtype=np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")


class _Seen:
    """Classes that a task has had; forgets all now and then, which costs repeated work only."""

    def __init__(self, most: int = 500_000):
        self.nodes: set[int] = set()
        self.most = most

    def __call__(self, node: int) -> bool:
        if node in self.nodes:
            return True
        if len(self.nodes) >= self.most:
            self.nodes.clear()
        self.nodes.add(node)
        return False


def _frequent(df: DataFrame, text_col: str, size: int) -> Frequent:
    """The words that many classes hold. A task counts those that it meets more than once."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            words = np.sort(np.concatenate(parts))
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            times = np.diff(np.append(first, len(words)))
            first, times = first[times > 1], times[times > 1]
            for k in range(0, len(first), 50_000):
                yield pa.record_batch([pa.array(words[first[k : k + 50_000]].view(np.int64)), pa.array(times[k : k + 50_000].astype(np.int64))], schema=schema)

        seen, parts, n = _Seen(), [], 0
        for batch in batches:
            for h in shingle_sets(batch.column(0).to_pylist(), size):
                if not len(h) or seen(node_of(h)):
                    continue
                for band in bands_of(len(h)):
                    parts += block_words(h, band)
                    n += len(parts[-1]) + len(parts[-2])
                if n >= 2 * FLUSH:
                    yield from counted(parts)
                    parts, n = [], 0
        if parts:
            yield from counted(parts)

    counts = written(df.select(F.col(text_col).alias("text")).mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "frequent")
    # by powers of two the least count that leaves few enough
    sizes = sorted(((r.p, r.n) for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 62, 0
    for p, n in sizes:
        if held + n > FREQUENT_WORDS:
            break
        least, held = 1 << p, held + n
    rows = counts.filter(F.col("n") >= least).toArrow()
    discard(counts)
    return Frequent(rows.column("word").to_numpy().astype(np.int64).view(np.uint64), rows.column("n").to_numpy())


_DEALT = "bucket int, words binary, owners binary, sizes binary, scores binary, doc_id long, key long, node long, n long, sketch binary"


def _dealt(df: DataFrame, id_col: str, text_col: str, size: int, frequent: Frequent, buckets: int) -> DataFrame:
    """Rows (bucket, words, owners, sizes, scores): words by hash bucket, each with its class, the class's size and its share of frequent words. And a row for
    each row of df, with a negative bucket: doc_id, key, node (null for empty sets), n and, where a task first meets a class, its sketch."""
    held = df.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("words", "owners", "sizes", "scores")], ("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def batch_of(columns: dict[str, list], rows: int) -> pa.RecordBatch:
        made = lambda x, kind: x if isinstance(x, pa.Array) else pa.array(x, kind)
        return pa.record_batch([made(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def flush(owners: list[tuple[int, int, int]], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(parts)
        times = [len(p) for p in parts]
        bucket = (((words & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> S32).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        columns = [(words >> S32).astype("<u4")[order], *(np.repeat(np.array(x, t), times)[order] for x, t in zip(zip(*owners), ("<i8", "<u2", "u1")))]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        there = np.flatnonzero(np.diff(edges)).tolist()
        for k in range(0, len(there), 256):
            out = {c: [x[edges[b] : edges[b + 1]].tobytes() for b in there[k : k + 256]] for c, x in zip(("words", "owners", "sizes", "scores"), columns)}
            yield batch_of({"bucket": there[k : k + 256], **out}, len(there[k : k + 256]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, owners, parts, n = _Seen(), [], [], 0
        dealt = 64 * 31 * TaskContext.get().partitionId()  # each task begins with another bucket
        for batch in batches:
            nodes, counts, sketches = [], [], []
            for h in shingle_sets(batch.column(2).to_pylist(), size):
                node = node_of(h) if len(h) else None
                nodes.append(node)
                counts.append(len(h))
                if node is None or seen(node):
                    sketches.append(None)
                    continue
                sketches.append(parity_sketch(h))
                for k, band in enumerate(bands_of(len(h))):
                    words, share = join_words(h, band, held.value)
                    parts.append(words)
                    owners.append((node | int(k > 0), round(2000 * np.log(len(h))), int(255 * share)))
                    n += len(words)
                if n >= FLUSH:
                    yield from flush(owners, parts)
                    owners, parts, n = [], [], 0
            yield batch_of({"bucket": [-1 - (dealt + k) // 64 % buckets for k in range(len(nodes))], "doc_id": batch.column(0), "key": batch.column(1), "node": nodes, "n": counts, "sketch": sketches}, len(nodes))
            dealt += len(nodes)
        if parts:
            yield from flush(owners, parts)

    return _texts(df, id_col, text_col).mapInArrow(task, _DEALT)


def _grouped(dealt: DataFrame, parts: int) -> DataFrame:
    """kind 0: the rows of df. kind 1: candidate pairs (a, b) of small groups. kind 2: (a, b) hub and member of a large one. Sizes allow the similarity of kind 1."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    slack = 2000 * np.log(1.25) + 2

    def pairs_of(kind: int, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.unique(found, axis=1)
        for k in range(0, found.shape[1], 50_000):
            a, b = found[:, k : k + 50_000]
            yield pa.record_batch([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), *[pa.nulls(len(a), f.type) for f in list(schema)[3:]]], schema=schema)

    def groups(word: np.ndarray, owner: np.ndarray, size: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(word, kind="stable")
        twin = word[order][1:] == word[order][:-1]
        pick = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]
        if not len(pick):
            return
        pick = pick[np.lexsort((owner[pick], word[pick]))]
        word, owner, size, score = word[pick], owner[pick], size[pick].astype(np.int64), score[pick]
        fresh = np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])])
        word, owner, size, score = word[fresh], owner[fresh], size[fresh], score[fresh]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        members = np.diff(np.append(first, len(word)))
        near = [np.empty((2, 0), np.int64)]
        for k in range(2, SMALL + 1):
            at = first[members == k]
            for lo in range(0, len(at), 4096):
                here = at[lo : lo + 4096]
                i, j = np.triu_indices(k, 1)
                x, y = (here[:, None] + i).ravel(), (here[:, None] + j).ravel()
                use = ((owner[x] & owner[y] & 1) == 0) & (np.abs(size[x] - size[y]) <= slack)  # two guests of a lower band meet in their own
                a, b = owner[x[use]] & ~1, owner[y[use]] & ~1
                near.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1))
        yield from pairs_of(1, np.concatenate(near, axis=1))
        stars = [np.empty((2, 0), np.int64)]
        for lo, k in zip(first[members > SMALL].tolist(), members[members > SMALL].tolist()):
            node = owner[lo : lo + k] & ~1
            hub = node[np.lexsort((node, -score[lo : lo + k].astype(np.int64)))[0]]
            stars.append(np.stack([np.full(k, hub), node]))
            if sum(x.shape[1] for x in stars) > AT_ONCE:
                stars = [np.unique(np.concatenate(stars, axis=1), axis=1)]
        yield from pairs_of(2, np.concatenate(stars, axis=1))

    def bucket_of(rows: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        """A large bucket is grouped by ranges of its words."""
        total = sum(len(r[0]) for r in rows) // 4
        ranges = -(-total // AT_ONCE)
        for k in range(ranges):
            of: list[list[np.ndarray]] = [[], [], [], []]
            for row in rows:
                arrays = [np.frombuffer(x, t) for x, t in zip(row, ("<u4", "<i8", "<u2", "u1"))]
                if ranges > 1:
                    mine = (arrays[0].astype(np.uint64) * np.uint64(ranges) >> S32) == k
                    arrays = [x[mine] for x in arrays]
                for column, value in zip(of, arrays):
                    column.append(value)
            yield from groups(*(np.concatenate(x) for x in of))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            plain = int(np.searchsorted(bucket, 0))  # rows of df come first
            if plain:
                own = batch.slice(0, plain)
                yield pa.record_batch([pa.array(np.zeros(plain, np.int8)), own.column(7), pa.nulls(plain, pa.int64()), own.column(5), own.column(6), own.column(8), own.column(9)], schema=schema)
            for b, *row in zip(*(c.to_pylist() for c in batch.slice(plain).columns[:5])):
                if b != now and rows:
                    yield from bucket_of(rows)
                    rows = []
                now = b
                rows.append(row)
        if rows:
            yield from bucket_of(rows)

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(task, "kind tinyint, a long, b long, doc_id long, key long, n long, sketch binary")


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, over) of the pairs whose sizes and parity sketches allow the similarity (differences <= (sizes)/9); over: the bound less the difference, negated."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
            far = np.fromiter((int(_far(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))) for x, y in zip(batch.column(4), batch.column(5))), np.int64, len(a))
            use = 9 * far <= n_a + n_b
            if use.any():
                yield pa.record_batch([pa.array(a[use]), pa.array(b[use]), pa.array((9 * far - n_a - n_b)[use] / (n_a + n_b)[use])], names=["a", "b", "over"])

    return both.mapInArrow(task, "a long, b long, over double")


def _sets(nodes: DataFrame, df: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, hashes) of the classes, from the text of one row each."""
    wanted = written(nodes.join(classes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key")), "node"), "wanted")
    rows = _texts(df, id_col, text_col)  # dealt by key if many are wanted
    rows = rows.join(few(wanted), (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "text")
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                node, text = (c.to_pylist() for c in batch.slice(at, 100).columns)
                kept = [(k, h.tobytes()) for k, h in zip(node, shingle_sets(text, size)) if len(h) and node_of(h) == k and not seen(k)]
                if kept:
                    yield pa.record_batch([pa.array([k for k, _ in kept]), pa.array([h for _, h in kept], pa.binary())], schema=schema)

    return rows.mapInArrow(task, "node long, hashes binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 80 * union of their whole sets."""
    side = lambda c: sets.join(few(written(pairs.select(F.col(c).alias("node")).distinct(), "ends")), "node", "left_semi").select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, of_a, of_b in zip(*batch.columns):
                one, two = np.frombuffer(of_a.as_buffer(), np.uint64), np.frombuffer(of_b.as_buffer(), np.uint64)
                small, large = (one, two) if len(one) < len(two) else (two, one)
                same = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * same >= 80 * (len(one) + len(two) - same):
                    found.append((a.as_py(), b.as_py()))
            if found:
                yield pa.record_batch([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _across(rooted: DataFrame, classes: DataFrame, parts: int, forest: bool) -> DataFrame:
    """Plausible pairs (a, b) of one star and different roots. rooted: (hub, node, root).

    A star's members are dealt to chunks; those outside its largest root visit every chunk, which holds a bounded number. forest: of the pairs that a chunk
    finds only as many as join its roots, the most similar first.
    """
    roots = rooted.groupBy("hub", "root").agg(F.count("*").alias("n"))
    most = written(roots.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1").select("hub", F.col("m.root").alias("main")), "most")
    members = written(rooted.join(few(most), "hub"), "members")
    nodes = written(members.select("node").distinct(), "nodes")
    sized = members.join(classes.join(few(nodes), "node", "left_semi").select("node", "n", "sketch"), "node")
    sized = written(sized.select("hub", "node", "root", "main", "n", "sketch"), "open")
    chunks = written(sized.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.octet_length("sketch")) / CHUNK_BYTES)).cast("int").alias("chunks")), "chunks")
    open_ = sized.join(few(chunks), "hub")
    columns = ("hub", "chunk", "probe", "node", "root", "n", "sketch")
    targets = open_.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("probe", F.lit(0)).select(*columns)
    probes = open_.filter("root <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("probe", F.lit(1)).select(*columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, target, laid = None, [], None
        found: list[tuple[float, int, int, int, int]] = []

        def lay() -> dict[int, tuple]:
            """Members by the width of their sketch, in order of size."""
            by: dict[int, list] = {}
            for m in sorted(target, key=lambda m: m[2]):
                by.setdefault(len(m[3]) // 8, []).append(m)
            return {w: (*(np.array(x, np.int64) for x in list(zip(*ms))[:3]), np.stack([np.frombuffer(m[3], "<u8") for m in ms])) for w, ms in by.items()}

        def meet(node: int, root: int, n: int, sketch: bytes) -> None:
            own = np.frombuffer(sketch, "<u8")
            for nodes, roots, ns, sketches in laid.values():
                lo, hi = np.searchsorted(ns, -(-4 * n // 5)), np.searchsorted(ns, 5 * n // 4, "right")
                pick = lo + np.flatnonzero(roots[lo:hi] != root)
                for k in range(0, len(pick), 4096):
                    part = pick[k : k + 4096]
                    far = _far(sketches[part], own)
                    for x in np.flatnonzero(9 * far <= n + ns[part]).tolist():
                        other = int(part[x])
                        found.append(((9 * int(far[x]) - n - int(ns[other])) / (n + int(ns[other])), min(node, int(nodes[other])), max(node, int(nodes[other])), root, int(roots[other])))

        def pairs() -> list[tuple[int, int]]:
            if not forest:
                return list({(a, b) for _, a, b, _, _ in found})
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            out = []
            for _, a, b, r, s in sorted(set(found)):
                if (r := top(r)) != (s := top(s)):
                    up[max(r, s)] = min(r, s)
                    out.append((a, b))
            return out

        def handed() -> Iterator[pa.RecordBatch]:
            out = pairs()
            found.clear()
            if out:
                yield pa.record_batch([pa.array([a for a, _ in out]), pa.array([b for _, b in out])], names=["a", "b"])

        for batch in batches:
            for hub, chunk, probe, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, chunk) != key:
                    yield from handed()
                    key, target, laid = (hub, chunk), [], None
                if probe:
                    if laid is None:
                        laid = lay() if target else {}
                    meet(*member)
                    if len(found) > 200_000:
                        yield from handed()
                else:
                    target.append(member)
        yield from handed()

    laid = targets.unionByName(probes).repartition(parts, "hub", "chunk").sortWithinPartitions("hub", "chunk", "probe")
    return laid.mapInArrow(compare, "a long, b long").distinct()


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components; joined: (node, root)."""
    root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def linked_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """One row a row of df: doc_id, key (xxhash64 of the text), n, node (class; null without shingles) and root (class that names the component)."""
    with scratch() as keep:
        return keep(_linked_rows(df, id_col, text_col, size))


def _linked_rows(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    spark = df.sparkSession
    prepare(spark)
    parts = partitions(spark)
    frequent = _frequent(df, text_col, size)
    staged = written(_grouped(_dealt(df, id_col, text_col, size, frequent, 4 * parts), parts), "groups")  # several buckets a partition are more even
    rows = staged.filter("kind = 0").select("doc_id", "key", "n", F.col("a").alias("node"))
    of_class = staged.filter("kind = 0 and a is not null").groupBy(F.col("a").alias("node"))
    stars = staged.filter("kind = 2").select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct()
    pairs = staged.filter("kind > 0 and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    classes = written(of_class.agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "classes")
    first = written(_plausible(pairs, classes), "pairs")
    ends = lambda x: x.select(F.col("a").alias("node")).unionByName(x.select(F.col("b").alias("node"))).distinct()
    sets = written(_sets(ends(first), df, classes, id_col, text_col, size), "sets")
    # each class with its nearest candidate first; a pair inside a component that these make needs no comparison
    nearest = first.select(F.col("a").alias("x"), F.struct("over", F.col("b").alias("y")).alias("m")).unionByName(first.select(F.col("b").alias("x"), F.struct("over", F.col("a").alias("y")).alias("m"))).groupBy("x").agg(F.min("m").alias("m"))
    nearest = written(nearest.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct(), "nearest")
    links = written(_verified(nearest, sets), "links")
    joined = components(links)
    apart = written(_apart(first.select("a", "b").join(nearest, ["a", "b"], "left_anti"), joined), "apart")
    if not apart.isEmpty():
        links = written(links.unionByName(_verified(apart, sets)), "links")
        joined = components(links)
    if not stars.isEmpty():
        stars = written(stars.unionByName(stars.select("hub", F.col("hub").alias("node")).distinct()).distinct(), "stars")
        tried = first.select("a", "b")
        for forest in (True, False):
            rooted = stars.join(joined, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root"))
            found = written(_across(rooted, classes, parts, forest).join(tried, ["a", "b"], "left_anti"), "across")
            if found.isEmpty():
                continue
            more = ends(found).join(sets.select("node"), "node", "left_anti")
            sets = written(sets.unionByName(_sets(more, df, classes, id_col, text_col, size)), "sets") if not more.isEmpty() else sets
            links = written(links.unionByName(_verified(found, sets)), "links")
            joined = components(links)
            tried = written(tried.unionByName(found), "tried")
    return written(rows.join(joined, "node", "left").select("doc_id", "key", "n", "node", F.coalesce("root", "node").alias("root")), "linked")


def near_join(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """One row a row of df: doc_id, n_shingles, component_id (smallest id reachable by links; itself where there are none).

    Words are runs without ASCII white space, A-Z lower-cased. Null and wordless texts have no shingles and no links. Rows with equal ids
    stay apart and may link. Null ids take part; a component of null ids alone has a null component_id. Other columns
    are ignored; an empty table gives no rows. Sets compare by 64-bit shingle hashes and classes by a 63-bit digest.
    """
    rows = linked_rows(df, id_col=id_col, text_col=text_col, size=size)
    lowest = written(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("lowest")), "lowest")  # so that the join deals both sides anew and can split a hot root
    named = rows.join(lowest, "root", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))
