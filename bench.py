"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cellframe.plans import all_queries
from cellframe.plans.session import local_session

HEADLINE = (
    "a1_stats_table", "f11_filter_by_stat", "f13_filter_by_cutoffs", "c2_division_summary", "c4_elongation_rate",
    "c9_bilinear_fit", "l2_ancestors", "l5_lineages_of_length", "l9_lineage_export", "l10_pole_age", "l13_trace_connectors",
    "y2_initiation_size", "y5_segregation", "a2_stats_by_fov", "a4_histogram_line", "a6_time_trend", "a9_instantaneous_rate",
    "a11_correlation_matrix", "a11_rank_correlation_matrix", "g7_consensus_masks", "g17_crop_channels", "b9_region_intensity",
    "m1_otsu_threshold", "m3_connected_components", "r2_feret_size", "k5_lineage_tracker", "k7_candidate_edges",
    "k9_greedy_tracks", "k12_region_events", "p5_link_foci", "p8_axis_profile", "p12_size_ensemble")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark, queries, seconds = local_session(), all_queries(), {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms up code generation and file caches
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum of median warm wall seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
