"""Connected components of an edge table.

Few edges are joined by one task's union-find (bounded); more by alternating large and small stars, where nothing is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import written

#: The most edges (16 bytes each) that one task joins.
IN_ONE_TASK = 250_000


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.record_batch([pa.array(np.array(part, np.int64)), pa.array(np.array([top(x) for x in part], np.int64))], names=["node", "root"])


def components(edges: DataFrame, *, rounds: int = 60, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the smallest node of its component.

    By stars each round needs two aggregations with partial sums and one join on the node, whose hot keys Spark can split.
    """
    e = written(edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).filter("x < y"), "edges")
    if e.count() <= in_one_task:
        return written(e.coalesce(1).mapInArrow(_found, "node long, root long"), "components")
    e = e.distinct()
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("m").alias("x"), "y").distinct()
        small = large.groupBy("y").agg(F.min("x").alias("m"))
        moved = large.join(small, "y").select(F.col("m"), "x", "y")
        e = written(
            moved.select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("y").alias("y")), F.struct(F.col("m").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.x", "p.y").filter("x <> y").distinct(),
            "edges",
        )
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.pmod(F.xxhash64("y", "x"), F.lit(1 << 30)))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("y").alias("node"), F.col("x").alias("root")).unionByName(e.select(F.col("x").alias("node"), F.col("x").alias("root")).distinct())
