"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_road_links", "j02_range_pairs_wide", "j03_nearest_skeleton", "j05_curves_off_intersections", "j20_single_road_share",
    "j22_j23_skeleton_tests", "e01_skeleton_importance", "e02_local_density", "e14_e15_link_statistics", "e19_coverage", "w01_w02_steps",
    "w05_frame_curves", "d01_greedy_spacing", "d04_best_of_cluster", "d06_pairwise_thinning", "d11_skeleton_degree_filter",
    "g02_g03_components", "g08_bounded_paths", "r03_neighbour_counts", "m05_three_class_labels", "t06_current_points",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from roadpoints.plans import all_queries
    from roadpoints.session import local_session
    spark = local_session(cores, os.environ.get("BENCH_MEMORY", "16g"), "roadpoints-bench")
    found, _ = all_queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
