"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = [
    "contacts_by_cell_status", "leads_queue", "coverage_status", "within_radius_distinct", "nearest_report", "band_join_space_time", "grid_block_join_counts",
    "clutter_zone", "persistence_on_other_days", "components_light_sites", "greedy_assignment", "optimal_assignment", "sessionise_gap_30m", "interval_merge",
    "bracket_interpolate", "nearest_in_time", "look_probability_7d", "bh_qvalues", "weighted_deciles", "theme_by_year", "dedupe_works", "anchor_passages",
]


def main() -> None:
    from pelagos.plans.registry import QUERIES
    from pelagos.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()  # starts the engine
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
