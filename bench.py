"""Time the headline stages at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each entry is one stage computed from its stored inputs and written to its table, in run order, so the
sum is the wall time of a whole analytics run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from themelens.plans.stages import Stages  # noqa: E402
from themelens.session import build_session, scratch_dir  # noqa: E402
from themelens.sources import driver_tables  # noqa: E402

STAGES = (
    "snapshots",
    "metadata",
    "facts",
    "totals",
    "themes",
    "top_ten",
    "structure",
    "growth",
    "dimensions",
    "leaders",
    "scores",
    "grid",
    "horizons",
    "seasonality",
    "summaries",
    "outcomes",
    "ranked_pairs",
    "feature_metrics",
    "segment_metrics",
    "profiles",
    "proxies",
    "fits",
    "assessed",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "themelens-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = Stages(
        spark,
        driver_tables.market_snapshots(spark, sf_dir),
        driver_tables.app_metadata(spark, sf_dir),
        scratch_dir(spark),
    )
    timings: dict[str, float] = {}
    for name in STAGES:
        started = time.perf_counter()
        run.table(name)
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "analytics_run_wall_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
