"""Periodicity, models, streaming and the registry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from chronoflux.operators import models as M
from chronoflux.operators import periodic as P
from chronoflux.operators import skill as K
from conftest import SMALL


def windows(spark, arrays):
    rows = [(w, j, len(y), float(v)) for w, y in arrays.items() for j, v in enumerate(y)]
    return spark.createDataFrame(rows, "wid string, j int, n bigint, y double")


def test_detrend_equals_local_quadratic_fits(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(0, 1, 31) + np.linspace(0, 3, 31) ** 2
    m = (15 - 1) // 2
    want = []
    for j in range(31):
        c = min(max(j, m), 30 - m)
        i = np.arange(c - m, c + m + 1)
        want.append(y[j] - np.polyval(np.polyfit(i - c, y[i], 2), j - c))
    got = P.detrend(windows(spark, {"w": y}), "wid").orderBy("j").toPandas()["x"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_periodogram_equals_fft(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 40)
    rows = windows(spark, {"w": x}).withColumnRenamed("y", "x")
    got = P.periodogram(rows, "wid").orderBy("i").toPandas()["power"]
    want = np.abs(np.fft.rfft(x - x.mean())[1:-1]) ** 2 / 40
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_injected_wave_is_found_and_red_noise_is_not(spark):
    rng = np.random.default_rng(3)
    n, j = 240, np.arange(240)
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = 0.9 * ar[i - 1] + rng.normal(0, 1)
    rows = windows(spark, {"wave": 8 * np.sin(2 * np.pi * j / 30) + rng.normal(0, 3, n), "red": ar})
    residual, _, _, tested = P.search(rows, "wid")
    signals = P.periodic_signals(tested, "wid").collect()
    assert {r.wid for r in signals} == {"wave"}
    assert min(abs(r.period - 30) for r in signals) <= 4
    assert all(r.sigma > 1.9 for r in signals)


def test_isotonic_is_monotone_and_lowers_the_brier_score(spark):
    rng = np.random.default_rng(4)
    p = rng.random(2000)
    y = (rng.random(2000) < p ** 3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    out = M.fit_isotonic(df, "p", "y").apply(df, "p", "q").cache()
    q = out.orderBy("p").toPandas()["q"].to_numpy()
    assert (np.diff(q) >= -1e-12).all() and q.min() >= 0 and q.max() <= 1
    before, after = (K.brier_and_ece(out, [], c, "y").collect()[0] for c in ("p", "q"))
    assert after.brier < before.brier and after.ece < before.ece


def test_logistic_beats_climatology(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x + 1))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "part": np.arange(1500) % 3}))
    train, val, test = (F.col("part") == i for i in range(3))
    r = M.evaluate(M.predict(M.fit_logistic(df, ["x"], "y", train, 50), df), "p", "y", val, test).collect()[0]
    assert r.tss > 0.3


def test_registry_is_consistent(spark):
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150
    assert entry_module.entry(spark).count() >= 0


@pytest.mark.parametrize("name", ["b2_dense_grid", "f13_master_events", "h2_scores", "t1_streaming_decimation", "k9_record_validation"])
def test_queries_run_on_the_smallest_tables(spark, name):
    assert entry_module.queries()[name](spark, SMALL).count() > 0


def test_boosting_waits_before_it_stops():
    falling = [1.0, 0.9, 0.95, 0.93, 0.8, 0.85, 0.84, 0.83, 0.82]
    assert M.least_loss(falling, 3) == (5, True) and M.least_loss(falling, 5) == (5, False)
    assert M.least_loss([float("nan")] * 4, 2) == (4, False)


def test_models_are_trained_in_full(spark, monkeypatch):
    from chronoflux.plans import q_models as Q

    asked = []

    class Asked(Exception):
        pass

    def note(*args, **kw):
        asked.append((args, kw))
        raise Asked

    monkeypatch.setattr(Q, "prepared", lambda t: None)
    monkeypatch.setattr(Q, "horizon_rows", lambda t: spark.range(1))
    for name in ("fit_trees", "fit_logistic", "ablation"):
        monkeypatch.setattr(M, name, note)
    for name in ("g6_logistic_regression", "g7_boosted_trees", "g8_feature_importance", "g13_score_series", "g14_feature_ablation"):
        with pytest.raises(Asked):
            entry_module.queries()[name](spark, SMALL)
    assert all(not kw for _, kw in asked) and [len(a) for a, _ in asked] == [4, 5, 5, 4, 6]
    assert list(asked[-1][0][2]) == ["y_15min", "y_30min", "y_60min"]


def test_decimation_closes_its_tail_once(spark, tmp_path):
    """Unsorted and late files, a stop in the middle of windows, and a second run with more input."""
    from chronoflux.streaming import jobs

    folder = {n: str(tmp_path / n) for n in ("in", "out", "tail", "ckpt")}

    def arrive(rows):
        df = spark.createDataFrame([(float(s), k, float(v)) for s, k, v in rows], "s double, k string, value double")
        df.selectExpr("timestamp_seconds(s) AS ts", "k", "value").coalesce(1).write.mode("append").parquet(folder["in"])

    def run():
        stream = jobs.sample_stream(spark, folder["in"], "ts timestamp, k string, value double")
        means = jobs.decimated(stream, "ts", ["k"], "value", "10 seconds", "1 minute")
        out = jobs.decimate_all(means, ["k"], "value", folder["out"], folder["tail"], folder["ckpt"])
        return {(r.k, r.bin_t): (r.value, r.n) for r in out.collect()}, out.count()

    first = [(t, "a" if t % 3 else "b", t) for t in (3, 1, 12, 9, 45, 47, 30, 31, 44, 2)]
    arrive(first)
    bins, n = run()
    want = {}
    for t, k, v in first:
        want.setdefault((k, t // 10 * 10), []).append(v)
    assert n == len(bins) == len(want) and all(bins[w] == (sum(v) / len(v), len(v)) for w, v in want.items())
    # a sample within the watermark joins its open window; far ones move the watermark on, later ones than it are dropped
    second = [(48, "b", 4), (200, "a", 7), (201, "a", 9)]
    arrive(second)
    for t, k, v in second:
        want.setdefault((k, t // 10 * 10), []).append(v)
    bins, n = run()
    assert n == len(bins) == len(want) and all(bins[w] == (sum(v) / len(v), len(v)) for w, v in want.items())
    arrive([(5, "a", 1000)])
    again, n = run()
    assert again == bins and n == len(bins)


def test_replay_chunks_hold_bounded_lists(spark):
    from chronoflux.operators import serve as V

    points = spark.createDataFrame([("d1", t, float(t)) for t in range(0, 100, 5)] + [("d2", 130, 1.0)], "day string, t bigint, p double")
    events = spark.createDataFrame([("d1", 12, "M"), ("d1", 95, "X"), ("d3", 200, "C")], "day string, t bigint, letter string")
    chunks, manifest = V.replay_days({"series": points, "events": events}, "day", "t", 50, ["series"])
    got = {(r.day, r.chunk): r for r in chunks.collect()}
    assert set(got) == {("d1", 0), ("d1", 1), ("d2", 2), ("d3", 4)} and [x.t for x in got["d1", 1].series] == list(range(50, 100, 5))
    assert [x.letter for x in got["d1", 0].events] == ["M"] and got["d2", 2].events == []
    assert {r.day: (r.n_chunks, r.n_series, r.n_events) for r in manifest.collect()} == {"d1": (2, 20, 2), "d2": (1, 1, 0)}


def test_files_are_listed_and_reports_read(spark, tmp_path):
    from chronoflux.sources import files as S

    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "one.fits.gz").write_bytes(b"12345")
    (tmp_path / "deep" / "two.zip").write_bytes(b"123")
    (tmp_path / "deep" / "er" / "two (1).zip").write_bytes(b"1")
    listed = S.list_files(spark, str(tmp_path))
    assert {(r.folder, r.name, r.size) for r in listed.collect()} == {(tmp_path.name, "one.fits.gz", 5), ("deep", "two.zip", 3), ("er", "two (1).zip", 1)}
    found = {r.extension: (r.n_files, r.n_bytes, r.n_copies) for r in S.inventory(listed, "name", "size").collect()}
    assert found == {".fits.gz": (1, 5, 0), ".zip": (1, 3, 1)}
    report = "I.  Regions with Sunspots.\nNmbr Location  Lo  Area  Z   LL   NN Mag Type\n3576 N10W20 100 0040 Dso 05 03 Beta\nbad line\nII. Regions\n"
    (tmp_path / "20240105SRS.txt").write_text(report)
    (tmp_path / "20240106SRS.txt").write_text("I. Regions with Sunspots.\nNmbr Location Lo Area Z LL NN Mag Type\nNone\nII. Rest\n")
    (tmp_path / "notes.txt").write_text(report)
    (row,) = S.parse_reports(S.read_reports(spark, f"{tmp_path}/*.txt")).collect()
    assert (str(row.date), row.noaa_ar, row.lat_hg, row.lon_hg, row.num_spots, row.mag_class) == ("2024-01-05", 3576, 10.0, 20.0, 3, "Beta")


def test_daily_archives_are_dated(spark):
    from chronoflux.sources import files as S

    names = ["AL1_SLX_L1_20240105_v1.0.zip", "al1_slx_l1_20240106_v1.0", "AL1_SLX_L1_20240105_v1.1.zip", "AL1_SLX_L1_2024_v1.0.zip", "other.zip"]
    rows = S.discover_days(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert sorted((str(r.date), r.name) for r in rows) == [("2024-01-05", names[2]), ("2024-01-06", names[1])]


def test_wavelet_power_equals_the_direct_sum(spark):
    rng = np.random.default_rng(7)
    arrays = {"short": rng.normal(0, 1, 40), "long": rng.normal(0, 1, 333)}
    rows = windows(spark, arrays).withColumnRenamed("y", "x")
    wanted = spark.createDataFrame([(w, r, p) for w in arrays for r, p in enumerate((4.0, 9.7, 13.0))], "wid string, r int, period double")
    found = P.wavelet_power(rows, wanted, "wid").collect()
    assert len(found) == 6
    for row in found:
        x = arrays[row.wid]
        u = (np.arange(len(x))[None, :] - np.arange(len(x))[:, None]) / row.period
        wave = np.exp(-u * u / P.BANDWIDTH + 2j * np.pi * u) * (np.abs(u) * row.period <= np.ceil(row.period * P.REACH))
        np.testing.assert_allclose(row.power, np.abs(wave @ x) ** 2 / (np.pi * P.BANDWIDTH * row.period), rtol=1e-9, atol=1e-12)


def test_wavelet_of_a_whole_rise(spark):
    """1,800 samples at all 48 periods: one row a window and period, the largest power where the wave is."""
    j = np.arange(1800)
    x = np.where(np.abs(j - 1200) < 150, np.sin(2 * np.pi * j / 60), 0.0)
    rows = windows(spark, {"w": x}).withColumnRenamed("y", "x")
    wanted = P.period_rows(spark.createDataFrame([("w", 1800)], "wid string, n bigint")).select("wid", "r", "period")
    power = P.wavelet_power(rows, wanted, "wid").collect()
    best = max(power, key=lambda r: max(r.power))
    assert len(power) == 48 and abs(best.period - 60) < 6 and abs(int(np.argmax(best.power)) - 1200) < 100


def test_whittle_fit_reaches_the_optimum():
    """Never above the grid's likelihood, and at the least of a dense search around it."""
    rng = np.random.default_rng(12)
    f = np.arange(1, 120) / 240

    def nll(power, beta, lr):
        g = f**-beta + (0.0 if lr == P.NO_FLOOR else 10.0**lr)
        return np.log((power / g).mean()) + np.log(g).mean()

    for beta, ratio in ((0.0, 1.0), (1.3, 0.0), (2.0, 5.0), (2.8, 0.3), (1.0, 50.0)):
        power = (f**-beta + ratio) * rng.exponential(1, len(f))
        b, lr, a = P.whittle_fit(f, power)
        found = nll(power, b, lr)
        grid = [nll(power, x, y) for x in P.COARSE_BETA for y in (P.NO_FLOOR, *P.COARSE_LOG_RATIO)]
        around = [nll(power, x, y) for x in np.clip(b + np.linspace(-0.3, 0.3, 121), 0, 5) for y in ([lr] if lr == P.NO_FLOOR else lr + np.linspace(-0.5, 0.5, 101))]
        assert found <= min(grid) + 1e-9 and found <= min(around) + 1e-6 * abs(min(around))
        assert a == pytest.approx((power / (f**-b + (0.0 if lr == P.NO_FLOOR else 10.0**lr))).mean())


def test_windows_travel_packed(spark):
    """Windows across bucket borders, with holes and repeated names, without a shuffle of single samples."""
    rng = np.random.default_rng(6)
    cells = {(d, int(k)): float(rng.normal()) for d in "ab" for k in range(-20, 200) if rng.random() < 0.9}
    spans = [("a", "one", -5, 40), ("b", "two", 38, 95), ("a", "short", 10, 20), ("b", "twice", 0, 50), ("b", "twice", 0, 50),
             ("a", "moved", 120, 160), ("a", "moved", 30, 70), ("a", "gone", 500, 600), ("c", "none", 0, 60), ("a", None, 60, 110)]
    samples = spark.createDataFrame([(d, k, v, True) for (d, k), v in cells.items()] + [("a", 45, None, True), ("a", 201, 1.0, False)], "d string, k bigint, r double, g boolean")
    events = spark.createDataFrame(spans, "d string, w string, s bigint, p bigint")
    out = P.impulsive_windows(events, samples, ["d"], "w", "s", "p", "k", "r", "g", 37, 30, 16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "posexplode" in plan
    want = {}
    for d, w, s, p in spans:
        if p - s >= 30:
            want.setdefault(w, []).extend((k, v) for (e, k), v in cells.items() if e == d and s <= k <= p)
    want = {w: [v for _, v in sorted(x)] for w, x in want.items() if len(x) >= 16}
    got = {}
    for r in out.orderBy("j").collect():
        assert r.j == len(got.setdefault(r.w, [])) and r.n == len(want[r.w])
        got[r.w].append(r.y)
    assert got == want


def test_windows_fitted_together_equal_single_fits(spark):
    rng = np.random.default_rng(7)
    arrays = {f"w{i}": np.cumsum(rng.normal(0, 1, n)) for i, n in enumerate([31, 32, 40, 40, 40, 57, 58])} | {"flat": np.full(33, 2.0)}
    series = P.gather(windows(spark, arrays), "wid", "y")
    spectrum = P.periodogram(P.detrend(windows(spark, arrays), "wid"), "wid")
    want = P.significance(spectrum, P.red_noise_fit(spectrum, "wid"), "wid").toPandas().sort_values(["wid", "i"])
    packed = P.fit_series(P.spectrum_series(P.detrend_series(series, "wid"), "wid"), "wid")
    got = P.against_fit(P.spectrum_rows(packed, "wid", "beta", "lr", "a")).toPandas().sort_values(["wid", "i"])
    assert list(got["wid"]) == list(want["wid"]) and "flat" not in set(got["wid"]) and got["wid"].nunique() == 7
    np.testing.assert_allclose(got["gamma"], want["gamma"], rtol=1e-9)
    for w, part in want.groupby("wid"):
        single = P.whittle_fit(part["f"].to_numpy(), part["power"].to_numpy())
        np.testing.assert_allclose(part[["beta", "lr", "a"]].iloc[0].astype(float), single, rtol=1e-6)
