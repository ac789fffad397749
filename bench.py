"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the threads; each query
runs twice into a sink that drops its rows, and the faster run counts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from quern.plans.registry import QUERIES
from quern.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [f"tpch_q{n}" for n in range(1, 23)] + ["agg_count_distinct", "agg_dense_count", "join_asof_events", "join_band", "knn_l2", "knn_join", "top_n", "win_ranks", "stream_tumbling"]


def main() -> None:
    settings = {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quern-bench-"),
    }
    spark = build_session("quern-bench", f"local[{CPUS}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, total of the faster of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
