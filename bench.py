"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import queries  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))  # the median counts
LONG = 30  # seconds; a longer query runs once
HEADLINE = [
    "rule_title_scn", "apply_rules", "rule_coverage", "dedup_first", "stratified_split",
    "category_text", "department_word_text", "lemma_join",
    "vocab_top_n", "tfidf_l2", "feature_union",
    "weighted_knn_dense", "weighted_knn_text", "department_svm", "predict_full",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.time()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
            if runs[0] > LONG:
                break
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
