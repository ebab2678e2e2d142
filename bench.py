"""Headline timings: python bench.py prints one JSON line.

The first group works at the scale of the published numbers: 30 days x 5 detectors of
1 Hz data (13 million grid rows) derived from the events table. The second group runs
the registered headline queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from chronoflux.operators import grid as G  # noqa: E402
from chronoflux.operators import rolling as R  # noqa: E402
from chronoflux.plans.catalogue import QUERIES  # noqa: E402
from chronoflux.plans.q_grid import fractional  # noqa: E402
from chronoflux.plans.tables import Tables  # noqa: E402
from chronoflux.session import local_session  # noqa: E402

HEADLINE = (
    "f6_detected_runs", "b1_bin_samples", "b2_dense_grid", "b3_gti_mask", "c6_asof_backward", "c8_greedy_match_counts",
    "d3_phases", "d4_peak_distances", "e5_label_free_background", "e8_trailing_stats", "f10_detect_events",
    "f13_master_events", "g1_feature_matrix", "h8_best_threshold", "h16_block_bootstrap", "i2_merged_spans", "q5_significance",
)


def second_grid(t: Tables):
    """1 Hz grid of all detectors and days; every sample holds for its minute."""
    held = fractional(t).withColumn("t", F.explode(F.sequence(F.rint("t").cast("bigint"), F.rint("t").cast("bigint") + 59)))
    cells = G.bin_samples(held, ["detector"], "t", "rate", "event_id")
    extent = G.extents(fractional(t), ["detector"], "t")
    dense = G.densify(cells, ["detector"], "t", ["rate"], 86_400, extent, chunk_as="day_no")
    return dense.withColumn("gti", F.col("rate").isNotNull())


def build_days(t: Tables):
    """150 detector days of light curve: bin, stitch, mask, densify."""
    return second_grid(t).groupBy("detector", "day_no").agg(F.count("*").alias("n"), F.count("rate").alias("n_seen"))


def excess_days(t: Tables):
    """Smoothing, rolling quantile background and excess of 150 detector days at 1 Hz."""
    ex = R.compute_excess(second_grid(t), ["detector", "day_no"], "t", "rate", "gti", None)
    return ex.groupBy("detector", "day_no").agg(F.max("excess").alias("peak"), F.avg("background").alias("level"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    t = Tables(spark, folder)
    t.read("events").count()
    timings: dict[str, float] = {}

    def run(name, make):
        started = time.time()
        make().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)

    run("build_30_days_1hz", lambda: build_days(t))
    run("excess_30_days_1hz", lambda: excess_days(t))
    for name in HEADLINE:
        run(name, lambda name=name: QUERIES[name](spark, folder))
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": folder.rsplit("sf", 1)[-1].strip("/"),
    }))


if __name__ == "__main__":
    main()
