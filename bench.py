"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cambium.plans.queries import QUERIES  # noqa: E402
from cambium.session import local_session  # noqa: E402

HEADLINE = [
    "site_age",
    "bai_dense",
    "tree_trend",
    "detrend_spline",
    "chronology",
    "others_chronology",
    "interseries_cor",
    "interseries_prewhitened",
    "pointer_years",
    "negative_pointer_years",
    "resilience_site",
    "climate_correlation",
    "bootstrap_ci",
    "climate_response",
    "month_distribution",
    "sample_grid",
    "resample_bilinear",
    "site_covariates",
    "catalogue_explode",
    "ring_text_round_trip",
    "tree_year_growth",
    "site_year_resilience",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    run(spark, "site_age", sf_dir)
    timings = {name: round(median(run(spark, name, sf_dir) for _ in range(3)), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
