"""Secret scans with a trigram index. DataFrame functions only.

From every rule's expression follows a Boolean query over the trigrams that a match must hold: alternatives (any) of sets (all). The expression is
parsed; what can only be one of a few texts in a row gives the trigrams of each, and what can be many things, or nothing, gives none.
The index lists, for each trigram that some query needs, the documents that hold it (in lower case); a rule's candidates
are those whose postings intersect for one alternative. Candidates are verified with the rule's expression; a rule without
a mandatory trigram scans every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import few, free, written


@dataclass(frozen=True)
class Rule:
    """pattern: regular expression of Java and Python alike. least: characters that the match, or its group, must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which spans with one start are listed; the first three are the base kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")


#: Texts that a stretch of an expression may be, and alternatives of a query, before it counts as anything.
CHOICES = 64


def _choices(nodes) -> list[list[str] | None]:
    """An expression as stretches in a row: the few texts that one can be (lower case), or None for anything."""
    out: list[list[str] | None] = []

    def put(texts: list[str] | None) -> None:
        if texts is not None and out and out[-1] is not None and len(out[-1]) * len(texts) <= CHOICES:
            out[-1] = sorted({a + b for a in out[-1] for b in texts})
        else:
            out.append(texts)

    for kind, what in nodes:
        if kind is op.LITERAL:
            put([chr(what).lower()])
        elif kind is op.IN:
            put(_members(what))
        elif kind is op.SUBPATTERN:
            for x in _choices(what[3]):
                put(x)
        elif kind is op.ATOMIC_GROUP:
            for x in _choices(what):
                put(x)
        elif kind is op.BRANCH:
            ways = [_choices(x) or [[""]] for x in what[1]]
            put(sorted({t for w in ways for t in w[0]}) if all(len(w) == 1 and w[0] is not None for w in ways) else None)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = what
            each = _choices(inner) or [[""]]
            whole = each[0] if len(each) == 1 else None
            if whole is not None and most <= 4 and len(whole) ** most <= CHOICES:
                put(sorted({"".join(x) for n in range(least, most + 1) for x in product(whole, repeat=n)}))
                continue
            for _ in range(min(least, 4)):  # at least so often, then anything
                for x in each:
                    put(x)
            put(None)
        elif kind is not op.AT:  # a place takes up no text; all else may be anything
            put(None)
    return out


def _members(items) -> list[str] | None:
    found: set[str] = set()
    for kind, what in items:
        if kind is op.LITERAL:
            found.add(chr(what).lower())
        elif kind is op.RANGE and what[1] - what[0] < CHOICES:
            found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
        else:
            return None
    return sorted(found) if len(found) <= 8 else None


def trigrams(rule: Rule) -> list[frozenset[str]]:
    """Alternatives of trigram sets, derived from the pattern; an empty list if it has no mandatory trigram."""
    options: set[frozenset[str]] = {frozenset()}
    for texts in _choices(parser.parse(rule.pattern)):
        grams = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts} if texts else {frozenset()}
        more = {a | b for a in options for b in grams}
        options = more if len(more) <= CHOICES else options
    if frozenset() in options:
        return []
    return sorted((o for o in options if not any(p < o for p in options)), key=sorted)


def index(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "row_key", text_col: str = "text") -> DataFrame:
    """Postings (trigram, key): the documents that hold each trigram of the rules' queries."""
    needed = sorted({t for r in rules for option in trigrams(r) for t in option})
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(key, low.alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in needed]), lambda t: t.isNotNull())
    return rows.select(F.explode(held).alias("trigram"), key)


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "row_key") -> DataFrame:
    """(key, kinds): the rules for which all postings of one alternative meet in the document."""
    queries = [(r.kind, option) for r in rules for option in trigrams(r)]
    by_trigram = sorted({t for _, option in queries for t in option})
    # each trigram names the alternatives that it counts for, with its own bit: a fixed table of a few hundred entries
    member = lambda t: F.array(*[F.struct(F.lit(k).alias("query"), F.lit(1 << sorted(o).index(t)).cast("long").alias("bit")) for k, (_, o) in enumerate(queries) if t in o])
    members = F.create_map(*[x for t in by_trigram for x in (F.lit(t), member(t))])
    masks = F.array(*[F.lit((1 << len(o)) - 1).cast("long") for _, o in queries])
    kinds = F.array(*[F.lit(k) for k, _ in queries])
    met = postings.select(key, F.explode(members[F.col("trigram")]).alias("q")).groupBy(key, "q.query").agg(F.bit_or("q.bit").alias("bits"))
    return met.filter(F.col("bits") == F.get(masks, F.col("query"))).groupBy(key).agg(F.collect_set(F.get(kinds, F.col("query"))).alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as (start, end), code points, without those that are too short."""
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    match = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.char_length(x))
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.char_length(x)) if rule.group else match
    zipped = F.zip_with(F.arrays_zip(F.slice(between, 1, F.size(match)).alias("b"), match.alias("m")), counted, lambda x, c: F.struct(x.b.alias("b"), x.m.alias("m"), c.alias("c")))
    placed = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a.at + x.b + x.m).alias("at"),
            F.when(x.c >= rule.least, F.concat(a.out, F.array(F.struct((a.at + x.b).alias("start"), (a.at + x.b + x.m).alias("end"))))).otherwise(a.out).alias("out"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), placed.out).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """df with a column `secrets`: array of (kind, start, end) in order of start, then of the rules.

    Null texts have none. Rows keep all their columns (a column called secrets is replaced). The index goes by the hash of the text, so that equal
    texts share an entry and no id, null or not, matters; every row is verified by itself. An empty table stays empty.
    """
    key, found, *spans = free(df, "__key", "__kinds", *[f"__s{k}" for k in range(len(rules))])
    keyed = df.withColumn(key, F.xxhash64(text_col))
    met = written(candidates(index(keyed.select(key, text_col), rules, key=key, text_col=text_col), rules, key=key), "candidates")
    joined = keyed.join(few(met.withColumnRenamed("kinds", found)), key, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    for k, rule in enumerate(rules):
        got = spans_of(text, rule)
        joined = joined.withColumn(spans[k], got if not trigrams(rule) else F.when(F.array_contains(found, rule.kind), got).otherwise(none))
    numbered = lambda k: F.transform(F.col(spans[k]), lambda s: F.struct(s.start.alias("start"), F.lit(k).alias("rule"), s.end.alias("end")))
    every = F.concat(*[numbered(k) for k in range(len(rules))])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    out = F.transform(F.array_sort(every), lambda s: F.struct(F.get(kinds, s.rule).alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return joined.withColumn("secrets", out).drop(key, found, *spans)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and every span."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    base = F.filter("secrets", lambda s: s.kind.isin(*BASE))
    return scanned.select(
        F.col(id_col).alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def redact(scanned: DataFrame, *, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """Texts with every secret replaced (overlapping spans as one) and without the column `secrets`; null texts stay null."""
    text = F.col(text_col)
    folded = F.aggregate(
        "secrets",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s.start >= a.at, F.struct(s.end.alias("at"), F.concat(a.out, F.substring(text, a.at + 1, s.start - a.at), F.lit(mask)).alias("out"))
        ).otherwise(F.struct(F.greatest(a.at, s.end).alias("at"), a.out.alias("out"))),
        lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.char_length(text))),
    )
    return scanned.withColumn(text_col, F.when(text.isNull() | (F.size("secrets") == 0), text).otherwise(folded)).drop("secrets")
