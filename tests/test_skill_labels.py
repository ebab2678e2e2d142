"""Scores, thresholds, calibration, labels and text sources on small hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoflux.functions import scalars as S
from chronoflux.operators import audit as U
from chronoflux.operators import features as X
from chronoflux.operators import joins as J
from chronoflux.operators import labels as L
from chronoflux.operators import skill as K
from chronoflux.sources import files as A


def test_zero_contingency_scores_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "tp bigint, fp bigint, fn bigint, tn bigint")
    r = K.scores(df).collect()[0]
    assert all(r[c] == 0 for c in ("pod", "far", "pofd", "precision", "tss", "hss"))


def test_reliability_bins_keep_one_and_empty(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (1.0, 0), (0.55, 1)], "p double, y int")
    rows = {r.bin: r for r in K.reliability(df, [], "p", "y").collect()}
    assert len(rows) == 10 and rows[9].n == 2 and rows[9].obs_freq == 0.5
    assert rows[3].n == 0 and rows[3].mean_pred is None


def test_best_threshold_matches_a_scan(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(600) < 0.2).astype(int)
    p = np.round(np.clip(rng.normal(0.3 + 0.2 * y, 0.15), 0, 1), 2)
    best, best_tss = 0.5, -1.0
    for t in np.unique(np.quantile(p, np.array(K.QUANTILE_GRID))):
        a = p >= t
        tss = (a & (y == 1)).sum() / (y == 1).sum() - (a & (y == 0)).sum() / (y == 0).sum()
        if tss > best_tss + 1e-12:
            best, best_tss = t, tss
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    r = K.best_threshold(df, [], "p", F.col("y") == 1).collect()[0]
    assert r.threshold == pytest.approx(best) and r.tss == pytest.approx(best_tss)


def test_bootstrap_draws_resample_whole_days(spark):
    days = spark.createDataFrame([(f"d{i}",) for i in range(7)], "day string")
    draws = K.bootstrap_draws(days, 50)
    assert draws.groupBy("b").count().filter("count <> 7").count() == 0
    assert draws.select("day").distinct().count() == 7
    assert draws.exceptAll(K.bootstrap_draws(days, 50)).count() == 0


def test_drift_guard_raises(spark):
    measured = spark.createDataFrame([("m", 1.0)], "metric string, measured double")
    frozen = spark.createDataFrame([("m", 2.0, 0.1)], "metric string, frozen double, tolerance double")
    checked = K.drift_check(measured, frozen)
    assert not checked.collect()[0].ok
    with pytest.raises(Exception, match="drifted"):
        K.assert_no_drift(checked).collect()


EVENTS = "flare_id bigint, start_t bigint, peak_t bigint, end_t bigint, letter string, rnk int, mag double"


def seconds(spark, n):
    return spark.range(n).withColumnRenamed("id", "t")


def test_phases_precedence_and_61_peak_seconds(spark):
    ev = spark.createDataFrame([(1, 2000, 2600, 3600, "C", 2, 1.0), (2, 3000, 3300, 3400, "X", 4, 2.0)], EVENTS)
    phase = {r.t: r.phase for r in L.phases(seconds(spark, 5000), ev, "t").collect()}
    assert sum(v == "peak" for v in phase.values()) == 122
    assert phase[199] == "quiet" and phase[200] == "pre" and phase[2000] == "rise" and phase[2700] == "decay"
    assert phase[3100] == "rise" and phase[3350] == "decay" and phase[3500] == "decay" and phase[3601] == "quiet"


def test_owner_is_the_higher_class_and_unclassed_gives_the_id_only(spark):
    ev = spark.createDataFrame([(1, 10, 12, 20, "M", 3, 1.5), (2, 15, 16, 25, "C", 2, 9.0), (3, 30, 31, 32, None, 0, None)], EVENTS)
    got = {r.t: (r.is_flare, r.owner_id, r.owner_letter) for r in L.active_events(seconds(spark, 40), ev, "t").collect()}
    assert got[18] == (1, 1, "M") and got[22] == (1, 2, "C") and got[31] == (1, 3, None) and got[26][0] == 0


def test_forward_target_bounds(spark):
    ev = spark.createDataFrame([(1, 1000, 1200, 1300, "C", 2, 1.0)], EVENTS)
    rows = {r.t: r for r in L.peak_distances(seconds(spark, 1500), ev, "t", 500, (15,)).collect()}
    assert rows[299].flare_in_next_15min == 0 and rows[300].flare_in_next_15min == 1
    assert rows[1199].flare_in_next_15min == 1 and rows[1200].flare_in_next_15min == 0
    assert rows[1200].time_since_last_peak == 0 and rows[1199].time_to_next_peak == 1


def test_buffered_slice_edges(spark):
    ev = spark.createDataFrame([(1, 0, 86400 - 21600, 0, "C", 2, 1.0), (2, 0, 86400 + 108000, 0, "C", 2, 1.0), (3, 0, 86400 - 21601, 0, "C", 2, 1.0)], EVENTS)
    days = spark.createDataFrame([(1,)], "day_no bigint")
    assert sorted(r.flare_id for r in L.buffered_slice(days, ev).collect()) == [1, 2]


def test_class_location_and_quantile_functions(spark):
    df = spark.createDataFrame([("m3.2",), ("X10",), ("A1.0",), ("C1.2.3",), (None,)], "c string")
    got = [(r[0], r[1]) for r in df.select(S.class_letter("c"), S.class_magnitude("c")).collect()]
    assert got == [("M", 3.2), ("X", 10.0), (None, None), (None, None), (None, None)]
    r = spark.range(1).select(S.latitude(F.lit("S05E70")), S.longitude(F.lit("S05E70")), S.normal_upper_quantile(F.lit(0.025)), S.human_bytes(F.lit(1536))).collect()[0]
    assert (r[0], r[1], r[3]) == (-5.0, -70.0, "1.5 KB") and r[2] == pytest.approx(1.959964, abs=1e-6)


REPORT = """:Issued: x
I.  Regions with Sunspots.  Locations Valid at 02/2400Z
Nmbr Location  Lo  Area  Z   LL   NN Mag Type
3500 N15W23    120 0200 Dso  08   10 Beta-Gamma
3501 S07E61    200 0050 Hsx  03   01
bad  row
IA. H-alpha Plages without Spots.
Nmbr  Location  Lo
3490  N20W50    180
"""


def test_region_reports(spark):
    empty = "I. Regions with Sunspots.\nNmbr Location Lo\nII. Regions Due to Return\n"
    df = spark.createDataFrame([("20240103SRS.txt", REPORT), ("20240104SRS.txt", empty), ("notes.txt", REPORT)], "name string, content string")
    rows = sorted(A.parse_reports(df).collect(), key=lambda r: r.noaa_ar)
    assert [(str(r.date), r.noaa_ar, r.lat_hg, r.lon_hg, r.mag_class) for r in rows] == [
        ("2024-01-03", 3500, 15.0, 23.0, "Beta-Gamma"), ("2024-01-03", 3501, -7.0, -61.0, "")]


def test_negative_subsample_is_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    out = X.subsample_negatives(df, "y", "k", 4).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in out} == {1: 100, 0: 400}


def test_bootstrap_draws_are_random(spark):
    days = spark.range(60).select(F.col("id").alias("day"))
    rows = K.bootstrap_draws(days, 400).groupBy("b").agg(F.count("*").alias("n"), F.count_distinct("day").alias("d"), F.avg("day").alias("m")).collect()
    assert all(r["n"] == 60 for r in rows)
    assert abs(sum(r["d"] for r in rows) / 400 / 60 - (1 - math.exp(-1))) < 0.01
    mean = sum(r["m"] for r in rows) / 400
    spread = math.sqrt(sum((r["m"] - mean) ** 2 for r in rows) / 400)
    assert abs(spread / (math.sqrt((60**2 - 1) / 12) / math.sqrt(60)) - 1) < 0.12


def test_subsample_takes_large_keys(spark):
    rows = spark.range(200).select((F.col("id") + 4_000_000_000).alias("k"), (F.col("id") % 20 == 0).cast("int").alias("y"))
    assert X.subsample_negatives(rows, "y", "k", 4).groupBy("y").count().orderBy("y").collect()[0]["count"] == 40


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.0), (2, 2.0, 3.9, 0.0), (3, 3.5, None, 0.0), (4, None, 9.0, 0.0)], "k int, x double, y double, flat double")
    got = {r.feature: r for r in U.target_correlations(df, ["x", "y"], "flat").collect()}
    assert all(math.isnan(got[f].r) and got[f].suspicious for f in ("x", "y"))
    r = U.target_correlations(df.withColumn("z", -F.col("x") ** 2), ["x"], "z").first().r
    assert r == pytest.approx(abs(np.corrcoef([1, 2, 3.5], [-1, -4, -12.25])[0, 1]))
    assert U.target_correlations(df.filter("k > 4"), ["x"], "y").first().r is None
    left, right = df.select("k", "x"), df.select("k", "flat")
    out = J.correlate_pairs(left, right, ["k"], "x", "flat", minimum=2).first()
    assert out.n_common == 3 and out.correlation is None
