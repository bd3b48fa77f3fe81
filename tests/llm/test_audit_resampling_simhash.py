"""Filter audit, importance resampling and SimHash copies against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import filter_audit, resampling, simhash
from weft.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    words = [f"Wort{i}é" if i % 9 == 0 else f"word{i}" for i in range(300)]
    base = [" ".join(random.choices(words, k=n)) for n in (1, 2, 3, 4, 5, 30, 210, 400, 900)]
    out = [(k, t, f"s{k % 3}") for k, t in enumerate(base)] + [(100 + k, t, "s1") for k, t in enumerate(base)]
    for k, t in enumerate(base * 8):
        w = t.split()
        for _ in range(random.randint(0, 2)):
            w[random.randrange(len(w))] = random.choice(words)
        out.append((200 + k, random.choice((" ", "\n\t ")).join(w), "s2"))
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    out += [(900, None, None), (901, "", ""), (902, " \n\t", "s0"), (903, long, "s0"), (904, long + " end", "s0"), (0, base[0], "s0"), (0, base[0], "s0"), (None, base[7], "s1"), (None, base[7], "s1")]
    out += [(None, "only null ids " * 8, "s1"), (None, "only null ids " * 8, "s0"), (905, "AAAA BBBB cccc #", "s0"), (906, "x" * 700_000 + " y " + "Z" * 600_000 + " end of it", "s0"), (907, "日本語 の 文    x\x1cy", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("part", "failing", "n", "good", "print", "rank", "score", "next", "component_id"):
        df = df.withColumn(name, F.lit("mine"))
    return df.repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 210)] + [(3, 1, 1), (901, None, None), (None, 1, 1), (5555, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))


def test_filter_audit(docs, rows, labels):
    good, toxic = ({r.doc_id for r in labels.collect() if r[k] == 1 and r.doc_id is not None} for k in ("quality", "toxic"))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    failing = []
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        e = t in least and (d is None or d > least[t])
        failing.append((s or "", d, {x for x, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), e)) if f}))
    want = {}
    for part in {p for p, _, _ in failing}:
        here = [(d, f) for p, d, f in failing if p == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [d for d, f in here if not f & before and x in f]
                removed_by[x] += len(removed)
                want[part, "".join(order), k + 1] = [
                    sum(not f & (before | {x}) for _, f in here), len(removed), sum(bool(f & before) and x in f for _, f in here), sum(f == {x} for _, f in here), sum(d in good for d in removed), sum(d in toxic for d in removed)
                ]
        for (p, order, k), v in want.items():
            if p == part:
                v.append(removed_by[order[k - 1]])
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = got.collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in found} == want and len(found) == len(want) == 600 * len({p for p, _, _ in failing})
    told = {(r.part, r.filter): r.share for r in filter_audit.shares(got).collect()}
    assert len(told) == 5 * len({p for p, _, _ in failing}) and all(math.isclose(told[p, o[0]] * 120, v[-1]) for (p, o, k), v in want.items() if k == 1)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)


def test_failures_by_pieces():
    random.seed(1)
    text = " ".join(random.choices([f"w{k}" for k in range(9000)], k=40_000)).encode()
    parts = list(filter_audit.pieces(text, 1000))
    assert b"".join(parts) == text and len(parts) > 100 and [w for p in parts for w in p.split()] == text.split()
    assert list(filter_audit.pieces(b"x" * 50 + b" y", 10)) == [b"x" * 50, b" y"]


def grams(text, orders=3):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return w, [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def test_features_are_exact(rows, monkeypatch):
    texts = [t for _, t, _ in rows if t is None or len(t) < 100_000] + ["a", "a b", "é9_Z", "x" * 300 + " " + "y" * 49 + " z", "-", "q" * 48 + " " + "r" * 47]
    for block in (1 << 18, 64, 7):
        monkeypatch.setattr(resampling, "BLOCK", block)
        for column in (pa.array(texts, pa.string()), pa.array([None, "skipped", *texts], pa.large_string())[2:]):
            found, words = collections.defaultdict(collections.Counter), collections.Counter()
            for of_words, of, buckets in resampling.features(column):
                words.update(of_words.tolist())
                for r, b in zip(of.tolist(), buckets.tolist()):
                    found[r][b] += 1
            for k, t in enumerate(texts):
                w, want = grams(t)
                assert found[k] == collections.Counter(zlib.crc32(x.encode()) % 10_000 for x in want) and words[k] == len(w)
    assert list(resampling.features(pa.array([None, ""], pa.string()))) == []


def test_resampling(spark, docs, rows):
    target = [t for _, t, _ in rows[3:6]]
    raw, aim = collections.Counter(), collections.Counter()
    each = [(d, *grams(t)) for d, t, _ in rows]
    crc = {}
    bucket = lambda x: crc.setdefault(x, zlib.crc32(x.encode()) % 10_000)
    for _, _, f in each:
        raw.update(map(bucket, f))
    for t in target:
        aim.update(map(bucket, grams(t)[1]))
    all_raw, all_aim = sum(raw.values()) + 10_000, sum(aim.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * all_raw / ((raw[b] + 1) * all_aim)))
    want = []
    for d, w, f in each:
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append([d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ranked = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2], -r[3]))
    for percent in (5, 50, 100, 0):
        drawn = ranked[: percent * len(ranked) // 100]
        expected = [tuple(r) + (k + 1 if k < len(drawn) else None,) for k, r in enumerate(ranked)] + [tuple(r) + (None,) for r in want if r[1] < 20]
        got = resampling.resample(docs, spark.createDataFrame([(t,) for t in [*target, None]], "text string"), percent=percent)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert resampling.resample(docs.limit(0), docs.select("text")).count() == 0
    assert resampling.resample(docs, docs.select("text").limit(0)).count() == len(rows)


def print_of(text):
    w = WORD.findall(lower(text))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(rows, monkeypatch):
    for size in (1 << 20, 50):
        monkeypatch.setattr(simhash, "pieces", lambda data, size=size: filter_audit.pieces(data, size))
        for _, t, _ in rows:
            assert simhash.fingerprint(None if t is None else t.encode()) == print_of(t)


def test_anchors_cover():
    random.seed(2)
    for _ in range(60):
        one = random.getrandbits(64)
        two = one
        for b in random.sample(range(64), random.randint(0, 5)):
            two ^= 1 << b
        found = [collections.defaultdict(set), collections.defaultdict(set)]
        for anchor, place, home in simhash.anchors(np.array([one, two], np.uint64)):
            for a, p in zip(anchor.tolist(), place.tolist()):
                assert a not in found[p] or True not in found[p][a]
                found[p][a].add(home)
        homes = {a for a, h in found[0].items() if True in h}
        assert len(homes) == 3 and homes & set(found[1]) and len(found[0]) < 50
    for bits, radius in ((15, 1), (7, 1), (3, 1), (1, 0)):  # perfect codes: every word has one nearest code word, within the radius
        nearest, others = simhash._code(bits)
        assert (np.bitwise_count(nearest ^ np.arange(1 << bits)) <= radius).all()
        for w in random.sample(range(1 << bits), min(50, 1 << bits)):
            assert {nearest[w ^ 1 << k] for k in range(bits)} | {nearest[w]} == {nearest[w]} | {x for x in others[w].tolist() if x >= 0}


def components_of(prints, most=4):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                root[top(a)] = top(b)
    return [top(x) for x in range(len(prints))]


def reached(ids, prints):
    of = components_of(prints)
    least = collections.defaultdict(list)
    for d, c in zip(ids, of):
        if d is not None:
            least[c].append(d)
    return [(d, f"{p:016x}", min(least[c], default=None)) for d, p, c in zip(ids, prints, of)]


def test_near_copies(docs, rows):
    want = reached([d for d, _, _ in rows], [print_of(t) for _, t, _ in rows])
    assert len({c for _, _, c in want}) < len(want) - 10
    got = simhash.near_copies(docs)
    assert sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()))) == sorted(map(repr, want))
    assert simhash.near_copies(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_copies(docs, most=6)


@pytest.mark.parametrize("cell, at_once", [(4096, 1 << 22), (16, 1 << 22), (4096, 500), (64, 2000)])
def test_links_of_dense_prints(spark, monkeypatch, cell, at_once):
    """Chains and clusters of fingerprints; with anchors cut into many cells and cells searched by spanning forests."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    monkeypatch.setattr(simhash, "partitions", lambda spark: 1 << 20 if cell < 4096 else 8)
    rng = random.Random(4)
    prints = [0]
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
        for _ in range(20):  # a chain
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.append(centre)
    prints += [rng.getrandbits(64) for _ in range(100)] + prints[:30]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    made = spark.createDataFrame(list(enumerate(signed)), "doc_id long, print long")
    monkeypatch.setattr(simhash, "fingerprints", lambda df, **_: made)
    links, cells = simhash._links, []
    monkeypatch.setattr(simhash, "_links", lambda c, many, most: cells.append(c.groupBy("cell").count().agg(F.max("count"), F.count("*")).first()) or links(c, 8, most))
    got = simhash.near_copies(made)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == sorted(reached(range(len(prints)), prints))
    if cell == 16:
        assert cells[0][0] < 60


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
