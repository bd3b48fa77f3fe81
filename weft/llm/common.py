"""Shared helpers: folders every executor can reach, written tables, column hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts can be long, so far below Spark's 10,000.
ARROW_ROWS = 1000
#: Rows of a narrow table (some tens of bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and all runs in one process (tests) a local one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of long texts unless the session already chose a smaller size."""
    shared_dir(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back.written_to = path
    if (scope := _SCOPE.get()) is not None:
        scope.append(back)
    return back


#: What the innermost scratch() of this thread has made.
_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside is deleted at the end, but for what goes through the function given: with scratch() as keep: out = keep(written(...))."""
    made: list[DataFrame] = []
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    token = _SCOPE.set(made)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for df in made:
            if id(df) not in kept:
                discard(df)


def discard(df: DataFrame) -> None:
    """Delete what written() wrote for df, when no later plan reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has few."""
    return F.broadcast(df) if df.count() <= most else df


def free(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for helper columns that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    return tuple(next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
