"""Headline queries, timed; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rasterspark import registry  # noqa: E402
from rasterspark.session import local_session  # noqa: E402

HEADLINE = [
    "render_ndvi_pixels",
    "asof_latest",
    "latest_in_interval",
    "frames",
    "tiles_for_footprints",
    "bbox_join",
    "materialization_plan",
    "rolling_quantiles",
    "cumulative_mix",
    "latency_report",
    "build_pyramid",
    "hillshade",
    "warp_nearest",
    "warp_bilinear",
    "warp_nearest_chunks",
    "warp_bilinear_chunks",
    "compare_manifests",
    "zonal_stats",
    "tile_content_key",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    registry.load()
    spark = local_session(cpus, shuffle_partitions=cpus, app="bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
