"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each query runs once to
warm up and then ``BENCH_RUNS`` times; the median counts. Results go to Spark's ``noop`` sink,
so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from textloom.catalogue import QUERIES
from textloom.session import local_session

HEADLINE = [
    "chunk_scores", "bleu", "sacrebleu", "rouge_1_2", "rouge_l", "rouge_lsum", "generation_scores", "answer_scores",
    "macro_scores", "dialogue_truncated_history", "encode_text", "layout_bart", "layout_gpt2", "tagging_batches",
    "best_epoch", "masked_loss",
]


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, folder, name)
        seconds[name] = round(statistics.median(timed(spark, folder, name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
