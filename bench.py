"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores.  Every query
runs to the end of its plan (no rows are fetched); the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import CHECKS  # noqa: E402
from run_checks import session  # noqa: E402
from sigtrail.session import drop_stages  # noqa: E402

HEADLINE = [
    "values_at",
    "values_at_times",
    "boundary_values",
    "state_intervals",
    "changed_only",
    "search_substring",
    "page_with_total",
    "index_of_time",
    "time_tree",
    "transitions",
    "transition_stats",
    "duration_histogram",
    "transfer_heatmap",
    "heatmap_margins",
    "unit_status_playback",
    "carrier_locations",
    "dedupe_adjacent",
    "resolve_types_any",
    "ingest_plc_debug",
    "ingest_mcs",
    "secs_messages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(2):
            begin = time.time()
            CHECKS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - begin
            best = took if best is None else min(best, took)
        drop_stages(spark)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
