"""Time-line primitives against pandas, with chunks far smaller than the frames need."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoflux.functions.frames import centred
from chronoflux.operators import rolling as R
from chronoflux.operators import timeline as T
from chronoflux.operators.grid import bin_samples, densify


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    rows = []
    for s in ("a", "b"):
        x = rng.normal(50, 10, 300)
        x[rng.random(300) < 0.2] = np.nan
        rows.append(pd.DataFrame({"s": s, "k": np.arange(300) - 50, "x": x}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, series):
    df = spark.createDataFrame(series)
    return df.withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).cache()


def back(df, column):
    return df.orderBy("s", "k").toPandas()[column].astype("float64").to_numpy()


@pytest.mark.parametrize("width", [4, 5, 70])
@pytest.mark.parametrize("size", [None, 16])
def test_boxcar_matches_centred_rolling_mean(series, frame, width, size):
    got = back(R.boxcar(frame, ["s"], "k", "x", "m", width, size), "m")
    want = series.groupby("s")["x"].transform(lambda v: v.rolling(width, center=True, min_periods=max(1, width // 4)).mean())
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_even_window_is_one_longer_on_the_left():
    assert centred(4) == (2, 1) and centred(5) == (2, 2) and centred(1800) == (900, 899)


@pytest.mark.parametrize("before,after", [(24, 23), (200, 199)])
@pytest.mark.parametrize("size", [None, 40])
def test_rolling_quantile_both_paths(series, frame, before, after, size):
    out = T.rolling_quantile(frame, ["s"], "k", "x", "q", 0.1, before, after, 8, size)
    def one(v):
        padded = pd.concat([v, pd.Series([np.nan] * after)], ignore_index=True)
        return padded.rolling(before + after + 1, min_periods=8).quantile(0.1).to_numpy()[after:]
    want = np.concatenate([one(g["x"]) for _, g in series.groupby("s")])
    np.testing.assert_allclose(back(out, "q"), want, rtol=1e-9)


def test_long_trailing_stats_equal_short_path(series, frame):
    out = R.trailing_stats(frame, ["s"], "k", "x", {"w": 100}, 40, R.TRAILING_STATS)
    roll = lambda f: series.groupby("s")["x"].transform(lambda v: getattr(v.rolling(100, min_periods=50), f)())
    for stat in R.TRAILING_STATS:
        np.testing.assert_allclose(back(out, f"{stat}_w"), roll(stat), rtol=1e-7)


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(5)
    k = np.sort(np.concatenate([np.arange(0, 130), np.arange(1000, 1090), rng.choice(np.arange(2000, 2300), 90, replace=False)]))
    df = pd.DataFrame({"s": "a", "k": k, "x": rng.normal(50, 10, len(k)), "gti": True})
    df.loc[rng.random(len(k)) < 0.1, "gti"] = False
    return df, spark.createDataFrame(df).cache()


def framed(df, before, after, f, least):
    """``f`` of the values whose positions lie in each row's frame."""
    k, x = df["k"].to_numpy(), df["x"].to_numpy()
    found = [x[(k >= p - before) & (k <= p + after)] for p in k]
    return np.array([f(v) if len(v) >= least else np.nan for v in found])


@pytest.mark.parametrize("size", [None, 50])
@pytest.mark.parametrize("width", [20, 90])
@pytest.mark.parametrize("always_long", [False, True])
def test_frames_follow_positions_across_holes(gappy, monkeypatch, size, width, always_long):
    pdf, df = gappy
    if always_long:
        monkeypatch.setattr(R, "SHORT_FRAME", 0)
        monkeypatch.setattr(T, "NATIVE_FRAME", 0)
    out = R.trailing_stats(df, ["s"], "k", "x", {"w": width}, size, R.TRAILING_STATS)
    stats = {"mean": np.mean, "std": lambda v: np.std(v, ddof=1), "max": np.max, "median": np.median, "sum": np.sum}
    rows = out.orderBy("k").toPandas()
    for stat in R.TRAILING_STATS:
        np.testing.assert_allclose(rows[f"{stat}_w"], framed(pdf, width - 1, 0, stats[stat], width // 2), rtol=1e-9)
    before, after = centred(width)
    smooth = back(R.boxcar(df, ["s"], "k", "x", "m", width, size), "m")
    np.testing.assert_allclose(smooth, framed(pdf, before, after, np.mean, width // 4), rtol=1e-9)


@pytest.mark.parametrize("size", [None, 50])
@pytest.mark.parametrize("window", [48, 120])
def test_background_stays_in_its_segment(gappy, size, window):
    """Windows whose widened frame is below and above the native limit, against a loop."""
    pdf, df = gappy
    got = back(R.background(df, ["s"], "k", "x", "gti", "b", window, 8, size), "b")
    good, k = pdf["gti"].to_numpy(), pdf["k"].to_numpy()
    starts = good & ~np.concatenate(([False], good[:-1] & (np.diff(k) == 1)))
    segment, want = np.where(good, np.cumsum(starts), 0), np.full(len(k), np.nan)
    for i in np.flatnonzero(good):
        own = segment == segment[i]
        for width, least in ((window, 8), (window * 4, 4), (10**6, 1)):
            before, after = centred(width)
            seen = pdf["x"][own & (k >= k[i] - before) & (k <= k[i] + after)]
            if len(seen) >= least:
                want[i] = seen.quantile(0.1)
                break
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.fixture(scope="module")
def long_day(spark):
    """A long segment with a padded event, one that is an event throughout, one without values, short ones."""
    rng = np.random.default_rng(11)
    n = 16_000
    pdf = pd.DataFrame({"s": "a", "k": np.arange(n) - 300, "x": np.round(rng.normal(100, 20, n), 1), "gti": True, "hot": False})
    pdf.loc[(pdf.index >= 4000) & (pdf.index < 4200), "hot"] = True
    pdf.loc[(pdf.index >= 9000) & (pdf.index < 11_500), "hot"] = True
    for a, b in ((7000, 7050), (7100, 7110), (7170, 7175), (8900, 8910), (13_500, 13_600), (13_650, 13_660)):
        pdf.loc[a:b, "gti"] = False
    pdf.loc[13_601:13_649, "x"] = np.nan
    pdf.loc[rng.random(n) < 0.03, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    return pdf, df.cache()


@pytest.mark.parametrize("flag", [None, "hot"])
@pytest.mark.parametrize("size", [None, 2500])
@pytest.mark.parametrize("window,least,pad", [(1800, 120, 1800), (400, 120, 900), (400, 1500, 10)])
def test_background_at_its_own_settings(long_day, size, flag, window, least, pad):
    """Windows of seconds, segments longer than a chunk, event-only segments, against single frames."""
    pdf, df = long_day
    got = back(R.background(df, ["s"], "k", "x", "gti", "b", window, least, size, flag, pad), "b")
    good, k, x = pdf["gti"].to_numpy(), pdf["k"].to_numpy(), pdf["x"].to_numpy()
    near = np.convolve(pdf["hot"], np.ones(2 * pad + 1), "same") > 0 if flag else np.zeros(len(k), bool)
    quiet, q = np.where(good & ~near, x, np.nan), 0.5 if flag else 0.1
    border = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(int), [0]))))
    rows = np.unique(np.concatenate([np.arange(0, len(k), 61), *(np.arange(b - 2, b + 2) for b in border), np.arange(7000, 7200)]))
    for i in rows[(rows >= 0) & (rows < len(k))]:
        want = np.nan
        if good[i]:
            a = border[border <= i][-1]
            z = border[border > i][0]
            frames = [(max(a, i - w // 2), min(z, i + w - w // 2), m) for w, m in ((window, least), (window * 4, least // 2))]
            for lo, hi, m in [*frames, (a, z, 1)]:
                seen = quiet[lo:hi][~np.isnan(quiet[lo:hi])]
                if len(seen) >= m:
                    want = np.quantile(seen, q)
                    break
            else:
                want = np.nanmedian(x[a:z]) if (~np.isnan(x[a:z])).any() else np.nan
        np.testing.assert_allclose(got[i], want, rtol=1e-12, err_msg=str(i))


def test_rank_tree_matches_sorting():
    rng = np.random.default_rng(6)
    for n in (1, 2, 63, 500):
        x = np.round(rng.normal(0, 3, n), 1)
        tree = T.RankTree(x)
        low = rng.integers(0, n, 200)
        high = rng.integers(low + 1, n + 1)
        for q in (0.0, 0.1, 0.5, 1.0):
            np.testing.assert_allclose(tree.quantile(low, high, q), [np.quantile(x[a:b], q) for a, b in zip(low, high, strict=True)], atol=1e-12)


@pytest.mark.parametrize("size", [None, 7])
def test_carry_is_forward_fill(series, frame, size):
    got = back(T.carry_forward(frame, ["s"], "k", {"f": F.col("x")}, size), "f")
    np.testing.assert_allclose(got, series.groupby("s")["x"].ffill())
    got = back(T.carry_back(frame, ["s"], "k", {"f": F.col("x")}, size), "f")
    np.testing.assert_allclose(got, series.groupby("s")["x"].bfill())


@pytest.mark.parametrize("size", [None, 7])
def test_flag_runs(series, frame, size):
    out = T.flag_runs(frame, ["s"], "k", F.col("x").isNotNull(), size)
    def one(g):
        ok = g["x"].notna()
        start = ok & ~ok.shift(fill_value=False)
        return g["k"].where(start).ffill().where(ok)
    want = pd.concat([one(g) for _, g in series.groupby("s")])
    np.testing.assert_array_equal(back(out, "run"), want.to_numpy())


@pytest.mark.parametrize("size", [None, 20])
def test_gap_runs_with_and_without_ends(spark, size):
    rng = np.random.default_rng(0)
    t = np.sort(rng.choice(2000, 150, replace=False))
    e = t + rng.integers(1, 40, 150)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e}))
    run = T.gap_runs(df, [], "t", 9, size).orderBy("t").toPandas()["run"].to_numpy()
    merged = T.gap_runs(df, [], "t", 9, size, end="e").orderBy("t").toPandas()["run"].to_numpy()
    want, want_m, last, high = [], [], None, None
    for a, b in zip(t, e):
        want.append(a if last is None or a - last > 9 else want[-1])
        want_m.append(a if high is None or a - high > 9 else want_m[-1])
        last, high = a, b if high is None else max(high, b)
    assert run.tolist() == want and merged.tolist() == want_m


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_against_merge_asof(spark, direction, strict):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"t": np.sort(rng.integers(0, 500, 80)), "i": np.arange(80)})
    right = pd.DataFrame({"u": np.sort(rng.choice(500, 40, replace=False)).astype("int64"), "v": np.arange(40)})
    out = T.asof(spark.createDataFrame(left), spark.createDataFrame(right), [], "t", "u", ["v"], 25, direction, strict)
    got = out.orderBy("i").toPandas()["v"].astype("float64")
    want = pd.merge_asof(left, right, left_on="t", right_on="u", direction=direction, allow_exact_matches=not strict)["v"]
    np.testing.assert_array_equal(got, want.astype("float64"))


def test_asof_both_equals_two_lookups(spark):
    rng = np.random.default_rng(2)
    left = spark.createDataFrame(pd.DataFrame({"t": rng.integers(0, 500, 80), "i": np.arange(80)}))
    right = spark.createDataFrame(pd.DataFrame({"u": rng.integers(100, 400, 30), "v": np.arange(30)}))
    both = T.asof_both(left, right, [], "t", "u", ["v"], 25, True, ["v"]).orderBy("i").toPandas()
    b = T.asof(left, right, [], "t", "u", ["v"], 25, "backward", order=["v"]).orderBy("i").toPandas()
    f = T.asof(left, right, [], "t", "u", ["v"], 25, "forward", True, ["v"]).orderBy("i").toPandas()
    pd.testing.assert_series_equal(both["back_v"], b["v"], check_names=False)
    pd.testing.assert_series_equal(both["ahead_v"], f["v"], check_names=False)


def test_exact_quantiles_with_a_hot_key_and_many_ties(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": ["hot"] * 4000 + ["cold"] * 7 + ["one"], "x": np.round(rng.exponential(5, 4008), 1)})
    qs = [0.0, 0.1, 0.5, 0.975, 1.0]
    out = T.exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", qs).toPandas()
    assert len(out) == 15
    for r in out.itertuples():
        assert r.quantile == pytest.approx(np.quantile(pdf.loc[pdf["g"] == r.g, "x"], r.q), abs=1e-9)


def test_half_even_binning_and_dense_grid(spark):
    rows = [("a", 0.5, 1.0, 1), ("a", 1.5, 2.0, 2), ("a", 2.4, 3.0, 3), ("b", 9.0, 4.0, 4)]
    binned = bin_samples(spark.createDataFrame(rows, "s string, t double, x double, o int"), ["s"], "t", "x", "o")
    assert {(r.s, r.t): r.x for r in binned.collect()} == {("a", 0): 1.0, ("a", 2): 3.0, ("b", 9): 4.0}
    dense = densify(binned, ["s"], "t", ["x"], 5).toPandas()
    assert len(dense) == 20 and dense["x"].notna().sum() == 3
    assert sorted(dense[dense.s == "a"].t) == list(range(10))


@pytest.mark.parametrize("size", [7, 64])
def test_interval_sweeps_equal_painting(spark, size):
    """Nested, touching, equal, empty and chunk-crossing intervals of two series, cell by cell."""
    rng = np.random.default_rng(8)
    lo = rng.integers(-60, 400, 120)
    rows = [("a" if i % 3 else "b", int(x), int(x + rng.integers(-3, 90)), int(rng.integers(0, 9)), i) for i, x in enumerate(lo)]
    df = spark.createDataFrame(rows, "s string, lo bigint, hi bigint, rank int, i int")
    best, union = {}, set()
    for s, a, z, rank, i in rows:
        for p in range(a, z + 1):
            best[s, p] = max(best.get((s, p), (-1, -1)), (rank, i))
            union.add((s, p))
    segments = T.best_segments(df, ["s"], F.col("lo"), F.col("hi"), F.struct("rank", "i"), size).collect()
    found = [((r.s, p), tuple(r.best)) for r in segments for p in range(r.low, r.high + 1)]
    assert len(found) == len(best) and dict(found) == best
    spans = T.covered(df, ["s"], F.col("lo"), F.col("hi"), size).collect()
    cells = [(r.s, p) for r in spans for p in range(r.low, r.high + 1)]
    assert len(cells) == len(union) and set(cells) == union
    assert all((r.s, r.high + 1) not in union for r in spans)


def test_a_hot_stretch_of_equal_intervals_is_one_cut(spark):
    hot = spark.range(50_000).select(F.lit(10).alias("lo"), F.lit(200).alias("hi"), "id")
    segments = T.best_segments(hot, [], F.col("lo"), F.col("hi"), F.col("id"), 64).collect()
    assert sorted((r.low, r.high, r.best) for r in segments) == [(10, 63, 49_999), (64, 127, 49_999), (128, 191, 49_999), (192, 200, 49_999)]


def test_trailing_counts_run_instead_of_sliding(spark):
    """A sliding frame is summed anew for every row; running sums cost the same for any width."""
    rng = np.random.default_rng(8)
    at, events = np.arange(0, 400, 3), rng.integers(-20, 400, 300)
    grid = spark.createDataFrame([(int(t),) for t in at] + [(None,)], "t bigint")
    marks = spark.createDataFrame([(int(p),) for p in events] + [(None,)], "p bigint")
    out = R.trailing_counts(grid, marks, [], "t", "p", {"n_5": 5, "n_90": 90}, 50)
    frames = out._jdf.queryExecution().analyzed().toString().split("specifiedwindowframe(")[1:]
    assert frames and all(f.startswith("RangeFrame, unboundedpreceding$()") for f in frames)
    for r in out.filter("t IS NOT NULL").collect():
        assert r.n_5 == int(((events > r.t - 5) & (events <= r.t)).sum())
        assert r.n_90 == int(((events > r.t - 90) & (events <= r.t)).sum())
