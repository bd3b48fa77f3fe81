"""Substring deduplication by hashed units.

Texts are cut at line ends and after sentence marks. Units are normalised (ASCII case folded, white space as one blank,
outer punctuation dropped) and hashed to 128 bits; digests are grouped over all documents. The occurrence of lowest rank (id, then place) stays, the
others are repeats. A line that repeats as a whole goes, all its units with it (and so does a paragraph, which is lines). Inside other lines
only runs of neighbouring repeats of at least MIN_WORDS words go, so that short common phrases of sentences stay.
Removed spans keep their offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import free, prepare, written

#: Words that a run of neighbouring repeats must have in all to be removed where they are not whole lines.
MIN_WORDS = 25
#: Words that a whole line must have to be removed: every repeated line goes unless a caller chooses a floor.
LINE_WORDS = 1
#: Digests that occur so often that their first place is broadcast instead of dealt, the most frequent, and how many at most (40 bytes each).
HOT, HOT_DIGESTS = 1000, 100_000
_STOP = re.compile(r"(?<![.!?])[.!?]++(?=\s|\Z)")
_EDGE = " \t\r\x0b\x0c|-*#>\"'.,;:!?()[]"


def units(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of each unit with a word; offsets in code points."""
    out = []
    line = 0
    while line <= len(text):
        line_end = text.find("\n", line)
        line_end = len(text) if line_end < 0 else line_end
        at = line
        for end in [*(m.end() for m in _STOP.finditer(text, line, line_end)), line_end]:
            part = text[at:end]
            words = part.split()
            plain = " ".join(words).strip(_EDGE).lower()
            if plain:
                out.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip()), len(words), plain))
            at = end
        line = line_end + 1
    return out


def rows_of(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(unit, units, start, end, words, normalised) of each unit, and of each line of several units by its first one.

    units: how many make up the whole line; 0 for a unit that is only a part of its line. A line is normalised unit by unit, so where lines
    are alike their units are.
    """
    out: list[tuple[int, int, int, int, int, str]] = []
    line: list[tuple[int, int, int, str]] = []
    found = units(text)
    for k, unit in enumerate(found):
        line.append(unit)
        if k + 1 < len(found) and text.find("\n", unit[1], found[k + 1][0]) < 0:
            continue
        first = k + 1 - len(line)
        if len(line) > 1:
            out.append((first, len(line), line[0][0], unit[1], sum(u[2] for u in line), "\n".join(u[3] for u in line)))
        out += [(first + j, int(len(line) == 1), *u) for j, u in enumerate(line)]
        line = []
    return out


def unit_table(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (xxhash64 of the text), unit (number from 0), units, start, end, words, and the digest as two longs; rows as of rows_of."""
    prepare(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("unit", pa.int32()), ("units", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema]
        for batch in batches:
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for *place, plain in rows_of(text or ""):
                    digest = xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))
                    for col, value in zip(cols, (doc_id, key, *place, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True))):
                        col.append(value)
                if len(cols[0]) >= 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = [[] for _ in schema]
        if cols[0]:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(task, "doc_id long, key long, unit int, units int, start int, end int, words int, d1 long, d2 long")


def repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a unit, or whole line of several units, that stands in an earlier place too: the columns of unit_table and kept (doc_id, key, start).

    A digest's count and first place are made by partial sums. Digests that occur very often then meet their units by a broadcast, so that no
    task gets all the places of one; the others by a shuffle.
    """
    table = written(unit_table(df, id_col=id_col, text_col=text_col), "units")
    firsts = written(table.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("kept")).filter("n > 1"), "firsts")
    # by powers of two the least count that leaves few enough
    sizes = sorted(((r.p, r.n) for r in firsts.filter(F.col("n") >= HOT).groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 62, 0
    for p, n in sizes:
        if held + n > HOT_DIGESTS:
            break
        least, held = max(HOT, 1 << p), held + n
    hot = F.broadcast(firsts.filter(F.col("n") >= least).select("d1", "d2", "kept"))
    rest = table.join(hot.select("d1", "d2"), ["d1", "d2"], "left_anti").join(firsts.filter(F.col("n") < least).select("d1", "d2", "kept"), ["d1", "d2"])
    both = table.join(hot, ["d1", "d2"]).unionByName(rest)
    return both.filter(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("key") == F.col("kept.key")) & (F.col("start") == F.col("kept.start")))).drop("d1", "d2")


def repeated_units(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """One row a removed unit: doc_id, unit, start_char, end_char, n_words, run_words, kept_doc_id, kept_start, text_key, kept_key (xxhash64 of the texts).

    A unit is removed in a repeated line of line_words words or more, or in a run of min_words.
    Null, empty and wordless texts have no units. Ranks: lowest id first (null first), then the text's key, then place. Rows that
    repeat, of one id or of null ids, with one text, are one document and keep or lose the same; rows of one id, or of null ids, with different texts are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    again = repeats(df, id_col=id_col, text_col=text_col).repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "unit", "units"])
    # the end of the last repeated line that begins at or before a unit; lines come before their units
    line = F.when((F.col("units") > 0) & (F.col("words") >= line_words), F.col("unit") + F.col("units"))
    marked = again.withColumn("line", F.max(line).over(W.partitionBy("doc_id", "key").orderBy("unit", F.desc("units")).rowsBetween(W.unboundedPreceding, W.currentRow))).filter("units < 2")
    placed = marked.withColumn("run", F.col("unit") - F.row_number().over(W.partitionBy("doc_id", "key").orderBy("unit")))
    summed = placed.withColumn("run_words", F.sum("words").over(W.partitionBy("doc_id", "key", "run")))
    return summed.filter((F.col("run_words") >= min_words) | (F.col("line") > F.col("unit"))).select(
        "doc_id", "unit", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("words").alias("n_words"), "run_words",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), F.col("key").alias("text_key"), F.col("kept.key").alias("kept_key"),
    )


def remove(df: DataFrame, removed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the removed spans cut from its texts; a null text stays null."""
    own_id, own_key, cuts = free(df, "__id", "__key", "__spans")
    spans = removed.groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(F.array_sort(F.collect_list(F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e")))).alias(cuts))
    text = F.col(text_col)
    cut = F.aggregate(
        cuts,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s.e.alias("at"), F.concat(a.out, F.substring(text, a.at + 1, s.s - a.at)).alias("out")),
        lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.char_length(text))),
    )
    found = df.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_key)), "left")
    return found.withColumn(text_col, F.when(F.col(cuts).isNull(), text).otherwise(cut)).drop(cuts, own_id, own_key)
