"""Time the headline queries: one JSON line on stdout."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import catalog
from stopclock.session import build_session

HEADLINE = [
    "prediction_in_force",
    "agency_accuracy",
    "headline_all",
    "headline_pm_rush",
    "routes_compared",
    "error_distribution",
    "compare_p90",
    "segment_stats_short",
    "anchors_short_trips",
    "anchors_long_trips",
    "training_pairs",
    "route_conditions",
    "feature_matrix",
    "tracks_folded",
    "arrivals_inferred",
    "inference_log",
    "change_only_batch",
    "stop_sequences_aligned",
    "success_gaps",
    "recent_at_stops",
    "upcoming_at_stops",
    "service_days_applied",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    catalog.load_all()
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["polls_by_status"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
