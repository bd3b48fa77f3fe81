"""Edit distances of many names at once, in numpy, for use in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Letters are counted by their code modulo this (ASCII stays apart), one by one up to LEVELS, the rest in one sum.
BUCKETS, LEVELS = 96, 16
#: Pairs whose letters are compared at once, pairs whose distances are computed at once, words of 64 places of letters held at once.
CELLS, PAIRS, PLACES = 1 << 20, 1 << 14, 1 << 22

_ALL, _ONE, _TOP = np.uint64(2**64 - 1), np.uint64(1), np.uint64(63)


class Names:
    """Names by length, the longest first: order (of the given places), lengths, and their code points one after another."""

    def __init__(self, names: list[str]):
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer("".join([names[k] for k in self.order]).encode("utf-32-le"), "<u4")
        of = np.repeat(np.arange(len(names)), self.lengths)
        self.counts = np.bincount(of * BUCKETS + self.flat % BUCKETS, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
        self.over = np.maximum(self.counts - LEVELS, 0).sum(1).astype(np.float32)

    def unary(self, most: np.ndarray) -> np.ndarray:
        """0 and 1 by name: for each bucket, whether it is there once, twice, ... up to its `most`. The product of two names' rows is the number of letters they share."""
        return np.concatenate([np.empty((len(self.lengths), 0), bool), *[self.counts[:, b, None] >= np.arange(1, most[b] + 1) for b in np.nonzero(most)[0]]], axis=1).astype(np.float32)


def _places(names: Names, first: int, last: int, letters: np.ndarray) -> np.ndarray:
    """By letter (and one that is none), word and name: the places of the letter in the name, as bits."""
    words = -(-int(names.lengths[first]) // 64)
    out = np.zeros((len(letters) + 1, words, last - first), np.uint64)
    codes = np.searchsorted(letters, names.flat[names.starts[first] : names.starts[last - 1] + names.lengths[last - 1]])
    lengths, starts = names.lengths[first:last], names.starts[first:last] - names.starts[first]
    for j in range(int(lengths[0])):
        n = int(np.searchsorted(-lengths, -j))  # those longer than j
        out[codes[starts[:n] + j], j >> 6, np.arange(n)] |= np.uint64(1 << (j & 63))
    return out


def _distances(places: np.ndarray, lengths: np.ndarray, p: np.ndarray, codes: np.ndarray, t: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """Edit distances of pairs (text t, pattern p), the longest texts first, by bit vectors (Myers, Hyyrö): a column of the table of distances is held as its
    steps up and down, 64 in a word, for all pairs at once.

    codes: by place and text, the row of `places` of the letter there. longs: the texts' lengths by pair.
    """
    _, words, many = places.shape
    flat, n = places.reshape(-1), len(p)
    up, down = np.full((words, n), _ALL), np.zeros((words, n), np.uint64)
    steps = int(longs[0])
    active = n - np.searchsorted(longs[::-1], np.arange(steps), side="right")
    for j in range(steps):
        a = active[j]
        at = codes[j].take(t[:a])
        at *= words * many
        at += p[:a]
        plus, minus = _ONE, None
        for w in range(words):
            u, d = up[w, :a], down[w, :a]
            same = flat.take(at)
            vertical = same | d
            if minus is not None:
                same |= minus
            x = same & u
            x += u
            x ^= u
            x |= same
            rise = x | u
            np.invert(rise, out=rise)
            rise |= d
            x &= u
            if w + 1 < words:
                carried = rise >> _TOP, x >> _TOP
                at += many
            rise <<= _ONE
            rise |= plus
            x <<= _ONE
            if minus is not None:
                x |= minus
            np.bitwise_and(rise, vertical, out=d)
            vertical |= rise
            np.invert(vertical, out=vertical)
            np.bitwise_or(x, vertical, out=u)
            if w + 1 < words:
                plus, minus = carried
    out, long = longs.copy(), lengths[p]
    for w in range(words):
        held = np.clip(long - 64 * w, 0, 64)
        mask = np.where(held > 0, _ALL >> (64 - np.maximum(held, 1)).astype(np.uint64), np.uint64(0))
        out += np.bitwise_count(up[w] & mask)
        out -= np.bitwise_count(down[w] & mask)
    return out


def close(texts: Names, patterns: Names | None, least: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(t, p, score) in pieces: the pairs of a likeness of at least `least`, by places in `texts.order` and `patterns.order`. Without patterns: pairs of texts, t before p.

    Names in k edits share all letters but k of the longer one's. A product of matrices counts the shared letters of all pairs, and only pairs with enough of them are compared.
    wanted: of slices of places, which pairs are asked for.
    """
    own = patterns is None
    patterns = texts if own else patterns
    if not len(texts.lengths) or not len(patterns.lengths):
        return
    longest = max(int(texts.lengths[0]), int(patterns.lengths[0]))
    edits = np.floor(np.arange(longest + 1) * (1 - least) + 1e-9).astype(np.int64)
    need = (np.arange(longest + 1) - edits).astype(np.float32)  # never falls with the length
    most = np.minimum(np.minimum(texts.counts.max(0), patterns.counts.max(0)), LEVELS)
    left, right = texts.unary(most), patterns.unary(most).T
    need_t, need_p = need[texts.lengths], need[patterns.lengths]
    first = 0
    while first < len(patterns.lengths):
        words = -(-int(patterns.lengths[first]) // 64)
        last = min(len(patterns.lengths), first + max(1, PLACES // (words * 128)))
        while True:  # fewer names, if they have many letters
            letters = np.unique(patterns.flat[patterns.starts[first] : patterns.starts[last - 1] + patterns.lengths[last - 1]])
            if last - first == 1 or (len(letters) + 1) * words * (last - first) <= PLACES:
                break
            last = first + (last - first) // 2
        places, lengths = _places(patterns, first, last, letters), patterns.lengths[first:last]
        found = np.minimum(np.searchsorted(letters, texts.flat), len(letters) - 1)
        row = np.where(letters[found] == texts.flat, found, len(letters))
        tall = max(1, CELLS // (last - first))
        for s in range(0, len(texts.lengths), tall):
            e = min(len(texts.lengths), s + tall)
            low = int(np.searchsorted(-lengths, -(texts.lengths[s] / least + 1e-6)))
            high = int(np.searchsorted(-lengths, -(texts.lengths[e - 1] * least - 1e-6), side="right"))
            low = max(low, s + 1 - first) if own else low
            if low >= high:
                continue
            shared = left[s:e] @ right[:, first + low : first + high]
            if texts.over[s:e].any() and patterns.over[first + low : first + high].any():
                shared += np.minimum(texts.over[s:e, None], patterns.over[None, first + low : first + high])
            hold = shared >= np.maximum(need_t[s:e, None], need_p[None, first + low : first + high])
            if own:
                hold &= np.arange(first + low, first + high)[None] > np.arange(s, e)[:, None]
            if wanted is not None:
                hold &= wanted(slice(s, e), slice(first + low, first + high))
            t, p = np.nonzero(hold)
            if not len(t):
                continue
            p += low
            width = int(texts.lengths[s])
            codes = np.zeros((e - s, width), np.int64)
            codes[np.arange(width) < texts.lengths[s:e, None]] = row[texts.starts[s] : texts.starts[e - 1] + texts.lengths[e - 1]]
            codes = np.ascontiguousarray(codes.T)
            longs = texts.lengths[s:e][t]
            step = max(1, PAIRS // words)
            for k in range(0, len(t), step):
                here = slice(k, k + step)
                d = _distances(places, lengths, p[here], codes, t[here], longs[here])
                long = np.maximum(longs[here], lengths[p[here]])
                good = d <= edits[long]
                yield t[here][good] + s, p[here][good] + first, 1 - d[good] / long[good]
        first = last
