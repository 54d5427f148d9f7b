"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (folder of tables), BENCH_CPUS (cores) and BENCH_QUERIES (comma list, or ``all``) may
be set in the environment. Every query runs once cold (not counted) and once timed, and all its
columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import catalog  # noqa: E402
from jobmeter.session import local_session  # noqa: E402

HEADLINE = (
    "enrich_by_day", "feature_table", "by_user", "by_day_hour", "summary_stats", "missingness",
    "runtime_describe", "state_counts", "top_users", "jobs_per_day", "analyze_jobs", "insights",
    "parse_sbatch", "forecast_batch", "intensity_asof", "job_emissions", "label_encode",
    "group_folds", "sample_cap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
