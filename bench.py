"""Times the headline queries and prints one JSON line.

Every query runs three times and the better of the last two runs counts, so that JIT
compilation and the start of Python workers are not measured; results go to Spark's
no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from plumbline.catalog import REGISTRY  # noqa: E402
from plumbline.plans.dataset import Dataset  # noqa: E402

HEADLINE = (
    "a2_threshold_scan_lines",  # 15 thresholds over all order lines
    "v2_top_k_per_query",  # one top-k per class centroid
    "w1_rank_orders",  # a position for every order
    "w3_first_per_key",  # first record per key
    "h5_flagged",  # integrity rules over nested records
    "h5_flagged_orders",  # integrity rules over orders and their lines
    "k8_ranked_output",  # filter, score, rank, explain: the reference's main run
    "e12_report",  # all ranking metrics and checks
    "c1_full_grid",  # 83 configurations in one job
    "q7_all_violations",  # all output constraints over all orders
    "j14_near_duplicate",  # exact near-duplicate test over all documents
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs several JVM calls per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            plan = REGISTRY[name].plan(Dataset(spark, folder))
            plan.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
