"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its letters' vectors, each rotated by its place; a text
bundles (adds) the vectors of its trigrams; a language's prototype is the sum of its training texts. A text gets the
language with the largest cosine. Runs of other characters count as one blank, so words have a start and an end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import free, prepare

DIMENSIONS = 1024
SEED = 20240607
#: Labelled documents that the prototypes are made of, at most (about: the rows whose hash is small enough).
TRAIN_DOCS = 20_000
#: Trigrams whose vectors a Python worker keeps (one byte a dimension each); rarer ones are made again.
CACHE_TRIGRAMS = 30_000
UNKNOWN = "und"

_ROWS: dict[tuple[int, int], _Vectors] = {}
_LETTER: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point below 0x20000 its lower-case letter, or 0 if it is no letter."""
    if not _LETTER:
        table = np.zeros(0x20000, np.int64)
        for c in range(len(table)):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a text's letter trigrams, every one; empty arrays without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    table = _folded()
    low = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0)
    far = np.flatnonzero(points >= len(table))
    for k in far:
        low[k] = points[k] if chr(points[k]).isalpha() else 0
    low = np.concatenate([[0], low, [0]])
    low = low[np.concatenate([[True], (low[1:] != 0) | (low[:-1] != 0)])]
    if not low.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((low[:-2] << 42) | (low[1:-1] << 21) | low[2:], return_counts=True)


class _Vectors:
    """Trigram vectors by key."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) >= 10_000:
                self.letters.clear()
            self.letters[c] = (np.random.default_rng([self.seed, c]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[c]

    def bound(self, key: int) -> np.ndarray:
        mask = (1 << 21) - 1
        return np.roll(self.letter(key >> 42), 2) * np.roll(self.letter(key >> 21 & mask), 1) * self.letter(key & mask)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of the keys, one row each."""
        if len(self.place) + len(keys) > CACHE_TRIGRAMS:
            self.place.clear()
        if len(keys) > CACHE_TRIGRAMS:
            return np.stack([self.bound(int(k)) for k in keys])
        places = np.empty(len(keys), np.int64)
        for n, key in enumerate(keys.tolist()):
            at = self.place.get(key)
            if at is None:
                at = self.place[key] = len(self.place)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[at] = self.bound(key)
            places[n] = at
        return self.table[places]


def _vectors(dimensions: int, seed: int) -> _Vectors:
    if (dimensions, seed) not in _ROWS:
        _ROWS[dimensions, seed] = _Vectors(dimensions, seed)
    return _ROWS[dimensions, seed]


#: Texts bundled by one matrix product, and distinct trigrams in it.
GROUP, GROUP_TRIGRAMS = 64, 20_000


def bundles(texts: list[str | None], dimensions: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, one vector a text) for groups of texts."""
    vectors = _vectors(dimensions, seed)
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and len(group) < GROUP and size < 4 * GROUP_TRIGRAMS:
            group.append(trigram_counts(texts[at + len(group)]))
            size += len(group[-1][0])
        out = np.zeros((len(group), dimensions), np.float32)
        keys = np.unique(np.concatenate([k for k, _ in group]))
        for part in range(0, len(keys), GROUP_TRIGRAMS):
            own = keys[part : part + GROUP_TRIGRAMS]
            counts = np.zeros((len(group), len(own)), np.float32)
            for n, (k, c) in enumerate(group):
                lo, hi = np.searchsorted(k, [own[0], own[-1] + 1])
                counts[n, np.searchsorted(own, k[lo:hi])] = c[lo:hi]
            out += counts @ vectors.rows(own).astype(np.float32)
        yield at, out
        at += len(group)


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray = field(repr=False)
    seed: int = SEED

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and cosines (0 to 1); UNKNOWN and 0 for a text without a letter."""
        names, scores = [], np.zeros(len(texts))
        unit = self.prototypes / np.maximum(np.linalg.norm(self.prototypes, axis=1, keepdims=True), 1e-12)
        for at, out in bundles(texts, self.prototypes.shape[1], self.seed):
            norm = np.linalg.norm(out, axis=1)
            cosine = (out @ unit.T) / np.maximum(norm, 1e-12)[:, None] if len(unit) else np.zeros((len(out), 1))
            best = np.argmax(cosine, axis=1)
            for n, (b, size) in enumerate(zip(best, norm)):
                known = size > 0 and len(unit) > 0
                names.append(self.languages[b] if known else UNKNOWN)
                scores[at + n] = min(1.0, max(0.0, float(cosine[n, b]))) if known else 0.0
        return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes from at most about `most` rows with a language that are not held out; sums by task, then by language.

    Rows without text or language teach nothing. Ties between languages go to the first by name.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id")
    )
    n = rows.select("id", "lang").count() if most else 0
    bound = int(2**32 * min(1.0, most / max(1, n)))
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(2**32)) < bound).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("total", pa.list_(pa.float64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, out in bundles(batch.column(1).to_pylist(), dimensions, seed):
                for lang, vector in zip(langs[at : at + len(out)], out):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], schema=schema)

    parts = chosen.mapInArrow(task, "lang string, total array<double>")
    summed = parts.select("lang", F.posexplode("total").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v"))
    table: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages x dimensions
        table.setdefault(row.lang, np.zeros(dimensions))[row.d] = row.v
    names = tuple(sorted(table))
    return Profiles(names, np.array([table[x] for x in names]).reshape(len(names), dimensions), seed)


def identify(df: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """df with lang_pred and lang_score (columns of those names are replaced). Null texts and texts without a letter: UNKNOWN, 0."""
    prepare(df.sparkSession)

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        names, scores = profiles.predict([x if isinstance(x, str) else None for x in texts])
        return pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": scores})

    (told,) = free(df, "__p")
    found = df.withColumn(told, predict(F.col(text_col)))
    return found.withColumns({"lang_pred": F.col(f"{told}.lang"), "lang_score": F.col(f"{told}.score")}).drop(told)
