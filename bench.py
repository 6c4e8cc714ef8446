"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the tables (default sf0.1), BENCH_CPUS the local cores. Every query is
run once to warm up code generation and file caches, then timed to completion with a sink
that discards the rows. BENCH_SECONDS bounds the whole run; queries that do not fit are listed as unfinished.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ratelens.plans import catalog  # noqa: E402
from ratelens.session import local_session  # noqa: E402

HEADLINE = [
    "dq1_quality_report", "dq10_category_report", "dq13_numeric_summary", "cl8_clean_loads", "fe_all_columns",
    "ex1_describe", "ex4_histogram_60", "ex7_density_curve", "ex9_box_by_equipment", "ex11_correlation_matrix",
    "ex14_equipment_profile", "ex20_calendar_labels", "ex25_outlier_summary", "ex28_top_routes",
    "ex28_route_profile", "ex29_top_rate_routes", "ml6_column_medians", "ml8_one_hot", "ml20_fold_report",
    "sc3_coordinates", "va1_6_prediction_rules", "ml12_extra_trees",
]
# Model fits are dominated by work, not warm-up: one run is enough.
FITS = {"ml12_extra_trees"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"), partitions=int(cores))
    queries = catalog.all_queries()
    names = sys.argv[1:] or HEADLINE

    def timed(name: str) -> float:
        start = time.time()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    cold, warm, unfinished = {}, {}, []
    deadline = time.time() + float(os.environ.get("BENCH_SECONDS", "1650"))

    def watch(done: threading.Event) -> None:
        # A query that would cost the figures of all others is cancelled and listed.
        if not done.wait(max(1.0, deadline - time.time())):
            while not done.wait(2):
                spark.sparkContext.cancelAllJobs()

    for name in names:
        done = threading.Event()
        threading.Thread(target=watch, args=(done,), daemon=True).start()
        try:
            first = round(timed(name), 3)
            cold[name], warm[name] = first, first if name in FITS else round(timed(name), 3)
            print(f"{name} cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
        except Exception:
            if time.time() < deadline:
                raise
            unfinished.append(name)
            print(f"{name} cancelled", file=sys.stderr, flush=True)
        finally:
            done.set()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "unfinished": unfinished,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cores),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
