"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One warm-up query, then each query RUNS times, the median counts. value: the sum over HEADLINE, the same queries in every round; queries: these,
files, and, if they are there, the training-data operators (once each).
"""

import contextlib
import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("append_union", "append_manual", "filter_contains", "dedup_row", "dedup_key_first", "consolidate_first", "consolidate_sum_int", "consolidate_text_join", "join_full", "join_three_way_coalesce", "sheet_split")
FILES = ("csv_roundtrip", "xlsx_roundtrip")
RUNS = 3


def main() -> None:
    from weft.plans.catalogue import QUERIES

    queries, names = dict(QUERIES), [*HEADLINE, *FILES]
    with contextlib.suppress(ModuleNotFoundError):
        from weft.llm.queries import QUERIES as LLM

        queries |= LLM
        names += list(LLM)
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def run(name: str) -> float:
        began = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.time() - began

    run(HEADLINE[0])
    for name in names:
        took[name] = round(median(run(name) for _ in range(RUNS if name in HEADLINE else 1)), 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
