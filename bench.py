"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to the end (all rows to the no-op sink).  The first, untimed query only
starts the engine.  Then what is maintained between questions, the alert state and a trained model, is made
once; its times stand apart under ``prepared``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from embertrace.plans.catalog import QUERIES, prepare  # noqa: E402
from embertrace.session import build_session  # noqa: E402

HEADLINE = (
    "pair_rarity_topk",
    "feature_matrix",
    "zscores",
    "top3_features",
    "percentile_rank_avg",
    "normalise_events",
    "normalise_alerts",
    "ip_extract_logs",
    "current_alerts",
    "alert_queue",
    "parse_reply",
    "detections_90s",
    "detection_scorecard",
    "drift_w1",
    "quality_profile",
    "lof_scores",
    "iforest_scores",
    "iforest_incremental",
    "stream_detections",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "embertrace-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="20g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["category_counts"](spark, sf_dir).collect()
    seconds, prepared = {}, {}
    for name, make in prepare(spark, sf_dir).items():
        start = time.perf_counter()
        make()
        prepared[name] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "prepared": prepared,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
