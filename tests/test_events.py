"""Event extraction, fusion and matching against plain sequential loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoflux.operators import events as V
from chronoflux.operators import matching as M

RUN = ["s", "run_start", "run_end"]


def run_frame(spark, values):
    rows = [("a", 0, len(values), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, run_start bigint, run_end bigint, k bigint, v double")


def peaks_of(df):
    return sorted(r.peak for r in df.collect())


def test_plateau_ends_and_nulls(spark):
    df = run_frame(spark, [5.0, 1.0, 3.0, 3.0, 3.0, 1.0, None, 4.0, None, 2.0, 9.0])
    assert peaks_of(V.local_maxima(df, RUN, "k", "v", None)) == [3, 7]


def brute_peaks(v, distance, prominence):
    v = np.where(np.isnan(v), V.LOWEST, v)
    found = []
    i = 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda q: (-v[q], -q)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in kept:
        a = p
        while a > 0 and v[a - 1] <= v[p]:
            a -= 1
        b = p
        while b < len(v) - 1 and v[b + 1] <= v[p]:
            b += 1
        if v[p] - max(v[a:p + 1].min(), v[p:b + 1].min()) >= prominence:
            out.append(p)
    return sorted(out) or [int(np.argmax(v))]


def test_peak_chain_and_fused_step_agree_with_a_loop(spark):
    rng = np.random.default_rng(7)
    for trial in range(3):
        v = np.round(rng.normal(0, 2, 80).cumsum() / 3 + rng.normal(0, 1, 80), 1)
        want = brute_peaks(v, 5, 1.0)
        df = run_frame(spark, [float(x) for x in v])
        fused = V.peaks_in_runs(df, RUN, "k", "v", 5, 1.0)
        assert peaks_of(fused) == want
        if trial == 0:
            chain = V.prominent_peaks(V.spaced_peaks(V.local_maxima(df, RUN, "k", "v", None), RUN, 5, None), df, RUN, "k", "v", 1.0)
            assert peaks_of(chain) == want


def test_short_runs_are_dropped_before_merging(spark):
    ks = [0, 1, 2, 5, 8, 9, 10]
    df = spark.createDataFrame([("a", k) for k in ks], "s string, k bigint")
    runs = V.persistence_runs(df, ["s"], "k", F.lit(True), 2, None)
    assert sorted((r.run_start, r.run_end) for r in runs.collect()) == [(0, 3), (8, 11)]
    assert V.merge_runs(runs, ["s"], 4, None).count() == 2
    assert V.merge_runs(runs, ["s"], 5, None).count() == 1


def brute_anchor(times, window, span):
    out, anchor, prev = {}, None, None
    for t in sorted(set(times)):
        if anchor is None or t - prev > window or t - anchor > span:
            anchor = t
        out[t] = anchor
        prev = t
    return out


def test_bounded_linkage(spark):
    rng = np.random.default_rng(5)
    times = [0, 150, 300, 1000, 1240, 2000, 2241, *map(int, 5000 + np.sort(rng.integers(0, 6000, 120)))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i bigint, t bigint")
    got = {r.t: r.anchor for r in V.link_clusters(df, [], "t", "i", 180, 240, 3600).collect()}
    assert got == brute_anchor(times, 180, 240)
    assert got[300] == 300 and got[1240] == 1240


def brute_match(det, cat, tol):
    free = {i: t for i, t in enumerate(det)}
    hit = 0
    for c in sorted(cat):
        near = sorted((abs(t - c), t, i) for i, t in free.items() if abs(t - c) <= tol)
        if near:
            del free[near[0][2]]
            hit += 1
    return hit, len(free), len(cat) - hit


@pytest.mark.parametrize("size", [3600, 400])
def test_greedy_match(spark, size):
    rng = np.random.default_rng(6)
    det = [int(x) for x in rng.integers(0, 9000, 90)]
    cat = [int(x) for x in rng.integers(0, 9000, 70)]
    d = spark.createDataFrame([(t,) for t in det], "t bigint")
    c = spark.createDataFrame([(t,) for t in cat], "t bigint")
    r = M.match_counts(M.greedy_match(d, c, [], "t", "t", 180, size), []).collect()[0]
    assert (r.tp, r.fp, r.fn) == brute_match(det, cat, 180)


def brute_rows(det, cat, tol):
    """(side, t) -> (rows, matched), by counts."""
    free, out = dict(det), {("det", t): [n, 0] for t, n in det.items()} | {("cat", t): [n, 0] for t, n in cat.items()}
    for c in sorted(cat):
        for d in sorted((t for t in free if abs(t - c) <= tol), key=lambda t: (abs(t - c), t)):
            take = min(free[d], cat[c] - out["cat", c][1])
            free[d] -= take
            out["cat", c][1] += take
            out["det", d][1] += take
    return {k: tuple(v) for k, v in out.items()}


def counted(spark, groups):
    rows = [(g, int(t)) for g, found in groups.items() for t, n in found.items() for _ in range(n)]
    return spark.createDataFrame(rows, "g string, t bigint")


@pytest.mark.parametrize("batch", [10_000, 7])
def test_match_of_one_island_over_the_whole_range(spark, batch):
    """Pieces that hand on what is taken: crowded, scarce and shifting lines, in several groups."""
    rng = np.random.default_rng(9)
    det, cat = {}, {}
    for g, (nd, nc) in {"even": (300, 300), "scarce": (60, 400), "rich": (500, 80)}.items():
        det[g] = {int(t): int(n) for t, n in zip(rng.choice(4000, nd, replace=False), rng.integers(1, 4, nd), strict=True)}
        cat[g] = {int(t): int(n) for t, n in zip(rng.choice(4000, nc, replace=False), rng.integers(1, 4, nc), strict=True)}
    # every catalogue row takes the detection after the one that the row before took: no piece settles alone
    det["shift"], cat["shift"] = {10 * i + 6: 1 for i in range(400)}, {10 * i: 1 for i in range(1, 400)}
    del det["shift"][6]
    cat["shift"][1] = 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = M.greedy_match(counted(spark, det), counted(spark, cat), ["g"], "t", "t", 17, 50).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in det:
        assert {(r.side, r.t): (r.n, r.matched) for r in rows if r.g == g} == brute_rows(det[g], cat[g], 17)


def test_match_of_a_hot_second(spark):
    """10^5 rows of each side in one second are two counts."""
    hot = spark.range(100_000).select(F.lit(500).cast("bigint").alias("t"))
    more = spark.createDataFrame([(490,), (505,), (700,)], "t bigint")
    rows = M.greedy_match(hot.union(more), hot.union(spark.createDataFrame([(505,), (506,), (690,)], "t bigint")), [], "t", "t", 10, 50).collect()
    got = {(r.side, r.t): (r.n, r.matched) for r in rows}
    assert got == {("det", 490): (1, 0), ("det", 500): (100_000, 100_000), ("det", 505): (1, 1), ("det", 700): (1, 1),
                   ("cat", 500): (100_000, 100_000), ("cat", 505): (1, 1), ("cat", 506): (1, 0), ("cat", 690): (1, 1)}


def test_member_flags_keep_every_row(spark):
    rows = spark.createDataFrame([(1, [10, 500], "a"), (2, [300], "b"), (3, [], "c"), (4, None, "d")], "i int, times array<bigint>, hit string")
    cat = spark.createDataFrame([(505,), (320,)], "c bigint")
    out = M.near_any_member(rows, cat, ["i"], "times", "c", 10, 100, "near")
    assert {r.i: (r.hit, r.near) for r in out.collect()} == {1: ("a", True), 2: ("b", False), 3: ("c", False), 4: ("d", False)}


def test_match_ties_take_the_earlier_detection(spark):
    d = spark.createDataFrame([(90,), (110,)], "t bigint")
    c = spark.createDataFrame([(100,)], "t bigint")
    rows = M.greedy_match(d, c, [], "t", "t", 50, 3600).filter("side = 'det'").collect()
    assert {r.t: r.matched for r in rows} == {90: 1, 110: 0}


def test_confidence_and_median(spark):
    rows = [(1, "x", 100, 50, 200, 4.0, 1.0, 7), (2, "y", 103, 60, 250, 9.0, 2.0, 7)]
    df = spark.createDataFrame(rows, "i int, detector string, peak_t bigint, start_t bigint, end_t bigint, max_significance double, peak_rate double, anchor bigint")
    r = V.fuse_clusters(df, [], "anchor").collect()[0]
    assert (r.master_peak, r.master_start, r.master_end, r.n_detectors) == (101, 50, 250, 2)
    assert r.confidence == pytest.approx(2 / 5 * 6.0)


def test_a_hot_second_of_detections_is_one_count(spark):
    """10^5 detections of one second and a few others: bounded members, median by counts."""
    hot = spark.range(100_000).select(F.lit(1000).cast("bigint").alias("peak_t"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("detector"))
    some = spark.createDataFrame([(900, "c"), (1100, "a"), (1200, "c"), (5000, "a")], "peak_t bigint, detector string")
    rows = hot.union(some).withColumns({"i": F.monotonically_increasing_id(), "start_t": F.col("peak_t") - 5, "end_t": F.col("peak_t") + 5,
                                        "max_significance": F.lit(4.0), "peak_rate": F.lit(1.0)})
    linked = V.link_clusters(rows, [], "peak_t", "i", 180, 240, 3600)
    got = {r.anchor: r for r in V.fuse_clusters(linked, [], "anchor").collect()}
    assert sorted(got) == [900, 1200, 5000]
    first = got[900]
    assert (first.master_peak, first.n_members, first.n_detectors, first.member_peaks, first.member_counts) == (1000, 100_002, 3, [900, 1000, 1100], [1, 100_000, 1])
    assert (got[1200].master_peak, got[5000].detectors) == (1200, "a")
