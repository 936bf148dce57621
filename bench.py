"""Time the headline queries; prints one JSON line.

Every query is built and run in full into the no-op sink, so nothing is pruned away and no result is
collected. Tables come from ``$BENCH_SF_DIR``, cores from ``$BENCH_CPUS``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from clickloom.plans.queries import QUERIES
from clickloom.session import local_session

HEADLINE = [
    "seq_length", "domain_coverage", "vocab_coverage", "domain_overlap", "ts_detect",
    "scalar_stats", "scalar_stats_pop", "missing_le0", "null_rate", "top_values",
    "array_stats", "array_length_stats", "string_stats", "iqr_outliers", "correlations",
    "seq_prep", "flat_vector", "time_bucket", "pad_int", "oov_report",
    "recent_k", "target_topk", "mean_pool", "embedding_lookup", "unified_timeline",
    "tail_split", "stratified_split", "exact_sample",
    "auc", "logloss", "class_report", "last_prediction",
    "full_report", "incremental_profile",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
