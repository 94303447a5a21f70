"""Time the headline queries and print one JSON line.

Each query is written in full to a sink that keeps nothing. The first run of a
query warms up the JVM; the reported time is the median of the runs after it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from cohortlens.plans import catalog  # noqa: E402
from cohortlens.session import get_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = [
    "cohort_ids",
    "cohort_labs",
    "first_non_null",
    "high_low_counts",
    "chi2_ranked",
    "price_histogram",
    "encode_text",
    "fingerprint_last",
    "fingerprint_sum",
    "fingerprint_nested",
    "pca_fingerprint",
    "cluster_ward",
    "silhouette_exact",
    "knn_exact",
    "overlay_counts",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = get_session(
        "bench", master=f"local[{CPUS}]", spark__driver__memory="16g", spark__ui__enabled="false", spark__sql__shuffle__partitions=CPUS,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("OFF")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds = {}
    for name in names:
        run(spark, name)
        seconds[name] = round(statistics.median(run(spark, name) for _ in range(REPEATS)), 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
