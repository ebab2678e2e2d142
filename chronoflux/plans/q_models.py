"""Queries: feature matrix, baselines, models and calibration (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.operators import features as X
from chronoflux.operators import models as M
from chronoflux.operators import skill as K
from chronoflux.operators.rolling import trailing_counts
from chronoflux.operators.timeline import asof
from chronoflux.plans.q_joins import daily_events
from chronoflux.plans.q_serve import tiers
from chronoflux.plans.registry import query
from chronoflux.plans.tables import CTES, EVENT_CHUNK, GRID_CHUNK, HOUR
from chronoflux.session import cut_lineage

DETS = ("click", "error", "purchase", "signup", "view")
WINDOWS = {"3": 3, "6": 6, "12": 12, "24": 24}
DDT = ("3", "6", "12")
RATES = {"1h": 3600, "3h": 10800, "6h": 21600}
SOFT, HARD = "view", "click"


def matrix(t):
    periodic = tiers(t).select(F.col("peak_t").alias("t_event"), "regime", "det_id")
    periodic = periodic.groupBy("t_event").agg(F.min_by("regime", "det_id").alias("regime"))
    master = t.master().select(F.col("master_peak").alias("t_event"), F.col("peak_rate_max").alias("rate"), "n_detectors", F.col("anchor").alias("id"))
    return X.feature_matrix(
        t.grid(), "k", HOUR, DETS, WINDOWS, 2, "24", 1, GRID_CHUNK, SOFT, HARD, DDT, master, periodic,
        daily_events(t), ["n_events", "total_value"], t.flare(), EVENT_CHUNK, RATES,
    )


_stats = ", ".join(
    f"CASE WHEN count(rate) OVER w{w}>={max(1, w // 2)} THEN {a} OVER w{w} END AS {n}_{w}"
    for w in WINDOWS.values() for n, a in (("mean", "avg(rate)"), ("std", "stddev_samp(rate)"), ("max", "max(rate)")))
CTES["tr1"] = ("grid", f"""SELECT detector, k, rate, {_stats}, CASE WHEN count(rate) OVER w2>=1 THEN avg(rate) OVER w2 END AS ma,
  CASE WHEN count(rate) OVER w24>=12 THEN quantile_cont(rate, 0.5) OVER w24 END AS bg FROM grid WINDOW w2 AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), """
  + ", ".join(f"w{w} AS (PARTITION BY detector ORDER BY k ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in WINDOWS.values()))
CTES["tr2"] = ("tr1", """SELECT *, lag(ma, 3) OVER w AS ml3, lag(ma, 6) OVER w AS ml6, lag(ma, 12) OVER w AS ml12,
  CASE WHEN count(ab) OVER w24>=12 THEN sum(ab) OVER w24 END AS xcross FROM (
    SELECT *, CASE WHEN rate IS NULL THEN NULL WHEN rate > bg+3*sqrt(greatest(bg, 1)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ab FROM tr1)
  WINDOW w AS (PARTITION BY detector ORDER BY k), w24 AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
KEPT = [f"{s}_{w}" for w in WINDOWS for s in X.STATS] + ["xcross"]
DET_COLS = [f"{d}_{c}" for d in DETS for c in KEPT] + ["hard_rate", "hard_bgsub", "soft_ddt_3", "soft_ddt_6", "soft_ddt_12", "hardness_ratio", "hardness_ddt"]


def pick(d, c):
    return f"max({c}) FILTER (detector='{d}')"


CTES["wide"] = ("tr2", "SELECT k, " + ", ".join(f"{pick(d, c)} AS {d}_{c}" for d in DETS for c in KEPT) + f""",
  {pick('click', 'ma')} AS hard_rate, {pick('click', 'ma')}-{pick('click', 'bg')} AS hard_bgsub,
  ({pick('view', 'ma')}-{pick('view', 'ml3')})/3 AS soft_ddt_3, ({pick('view', 'ma')}-{pick('view', 'ml6')})/6 AS soft_ddt_6, ({pick('view', 'ma')}-{pick('view', 'ml12')})/12 AS soft_ddt_12,
  {pick('click', 'ma')}/nullif({pick('view', 'ma')}, 0) AS hardness_ratio,
  ({pick('click', 'ma')}/nullif({pick('view', 'ma')}, 0)-{pick('click', 'ml6')}/nullif({pick('view', 'ml6')}, 0))/6 AS hardness_ddt,
  coalesce(bool_or(mean_3 IS NOT NULL), FALSE)::INT AS in_gti_any FROM tr2 GROUP BY k""")
CTES["qpp"] = ("det_other", """SELECT peak_t AS t, arg_min(CASE WHEN max_significance>=16 THEN 'classic' WHEN max_significance>=11 THEN 'intermediate' ELSE 'short' END, det_id) AS regime FROM det_other GROUP BY 1""")
CTES["m1"] = ("master", "SELECT master_peak AS t, arg_max(peak_rate_max, anchor) AS rate, arg_max(n_detectors, anchor) AS n_detectors FROM master GROUP BY 1")
CTES["hist"] = ("wide m1 master qpp", """
  SELECT w.k, w.k*3600-m1.t AS time_since_last_det_s, m1.rate AS last_det_peak_rate, m1.n_detectors AS last_det_n_detectors,
    (SELECT count(*) FROM master x WHERE x.master_peak > w.k*3600-3600 AND x.master_peak <= w.k*3600) AS det_rate_1h,
    (SELECT count(*) FROM master x WHERE x.master_peak > w.k*3600-10800 AND x.master_peak <= w.k*3600) AS det_rate_3h,
    (SELECT count(*) FROM master x WHERE x.master_peak > w.k*3600-21600 AND x.master_peak <= w.k*3600) AS det_rate_6h,
    (SELECT count(*) FROM qpp q WHERE q.t > w.k*3600-3600 AND q.t <= w.k*3600) AS qpp_count,
    (SELECT count(*) FROM qpp q WHERE q.t > w.k*3600-3600 AND q.t <= w.k*3600 AND regime='classic') AS qpp_count_classic,
    (SELECT count(*) FROM qpp q WHERE q.t > w.k*3600-3600 AND q.t <= w.k*3600 AND regime='intermediate') AS qpp_count_intermediate,
    (SELECT count(*) FROM qpp q WHERE q.t > w.k*3600-3600 AND q.t <= w.k*3600 AND regime='short') AS qpp_count_short
  FROM wide w ASOF LEFT JOIN m1 ON w.k*3600 >= m1.t""")
HIST_COLS = ["time_since_last_det_s", "last_det_peak_rate", "last_det_n_detectors", "det_rate_1h", "det_rate_3h", "det_rate_6h",
             "qpp_count", "qpp_count_classic", "qpp_count_intermediate", "qpp_count_short"]
YS = ["y_15min", "y_30min", "y_60min"]


@query("g1_feature_matrix", "SELECT w.k, " + ", ".join(f"round({c}, 7) AS {c}" for c in DET_COLS) + ", " + ", ".join(HIST_COLS) + """,
  (qpp_count > 0)::INT AS qpp_present, d.n_events AS n_events_lag1, d.total_value AS total_value_lag1, """ + ", ".join(
    f"(EXISTS (SELECT 1 FROM flare f WHERE f.peak_t > w.k*3600 AND f.peak_t <= w.k*3600+{m * 60}))::INT AS y_{m}min" for m in (15, 30, 60)) + """,
  (SELECT (['B','C','M','X'])[max(rnk)] FROM flare f WHERE f.peak_t > w.k*3600 AND f.peak_t <= w.k*3600+1800) AS y_class30
FROM wide w JOIN hist h USING (k) LEFT JOIN (SELECT t//86400 AS day_no, count(*) AS n_events, round(sum(value), 6) AS total_value FROM ev GROUP BY 1) d ON w.k//24 = d.day_no+1""",
       "wide hist flare ev", "time_since_last_det_s last_det_n_detectors n_events_lag1")
def _(t):
    m = matrix(t)
    return m.select(
        "k", *[F.round(c, 7).alias(c) for c in DET_COLS], *HIST_COLS, "qpp_present", "n_events_lag1", "total_value_lag1", *YS, "y_class30",
    )


def detector_part(t):
    return X.detector_features(t.grid(), "k", "detector", "rate", "gti", DETS, WINDOWS, 2, "24", 1, GRID_CHUNK, SOFT, HARD, DDT)


@query("g2_observability_flag", "SELECT k, in_gti_any FROM wide", "wide")
def _(t):
    return detector_part(t).select("k", F.col("in_gti_any").cast("int").alias("in_gti_any"))


TRAIN_K = 19738 * 24  # 2024-01-16


@query("g3_response_slope", f"""
WITH s AS (SELECT CASE WHEN count(*)>=100 THEN regr_slope(hard_rate, soft_ddt_3) ELSE 0 END AS slope FROM wide WHERE k<{TRAIN_K} AND hard_rate IS NOT NULL AND soft_ddt_3>0)
SELECT k, round(hard_rate-slope*soft_ddt_3, 7) AS residual FROM wide, s""", "wide")
def _(t):
    rows = cut_lineage(detector_part(t).select("k", "hard_rate", "soft_ddt_3"))
    slope = X.response_slope(rows, "hard_rate", "soft_ddt_3", F.col("k") < TRAIN_K)
    return X.response_residual(rows, slope, "hard_rate", "soft_ddt_3", "residual").select("k", F.round("residual", 7).alias("residual"))


CTES["mt"] = ("ev pred det_other", """
  SELECT p.event_id, p.t, p.y, p.split, e.value AS f1, CASE WHEN e.user_id%10<>0 THEN (e.user_id%7)::DOUBLE END AS f2, (p.t-d.peak_t)::DOUBLE AS age,
    (SELECT count(*) FROM det_other x WHERE x.peak_t > p.t-3600 AND x.peak_t <= p.t) AS n_1h,
    (SELECT count(*) FROM det_other x WHERE x.peak_t > p.t-10800 AND x.peak_t <= p.t) AS n_3h,
    (SELECT count(*) FROM det_other x WHERE x.peak_t > p.t-21600 AND x.peak_t <= p.t) AS n_6h
  FROM pred p JOIN ev e USING (event_id) ASOF LEFT JOIN (SELECT DISTINCT peak_t FROM det_other) d ON p.t >= d.peak_t""")
FEATURES = ["f1", "f2", "age", "n_1h", "n_3h", "n_6h"]


def model_rows(t):
    """One labelled row per event with trailing features; grows with the events table."""
    ev = t.ev().select("event_id", F.col("value").alias("f1"), F.when(F.col("user_id") % 10 != 0, (F.col("user_id") % 7).cast("double")).alias("f2"))
    rows = t.pred().select("event_id", "t", "y", "split").join(ev, "event_id")
    det = t.det_other().select("peak_t", "det_id")
    at = t.ev().select("t").distinct()
    counts = trailing_counts(at, det, [], "t", "peak_t", {"n_1h": 3600, "n_3h": 10800, "n_6h": 21600}, EVENT_CHUNK)
    last = asof(at, det, [], "t", "peak_t", ["peak_t"], EVENT_CHUNK, order=["det_id"])
    age = last.select("t", (F.col("t") - F.col("peak_t")).cast("double").alias("age"))
    return X.beside(rows, "t", counts, age)


def train():
    return F.col("split") == "TRAIN"


def val():
    return F.col("split") == "VAL"


def test():
    return F.col("split") == "TEST"


@query("g4_standardise", "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURES)
       + " FROM mt WHERE split='TRAIN') SELECT event_id, " + ", ".join(
    f"round(coalesce(({c}-m_{c})/CASE WHEN s_{c}>0 THEN s_{c} ELSE 1 END, 0), 7) AS {c}" for c in FEATURES) + " FROM mt, s", "mt")
def _(t):
    out = X.standardise(cut_lineage(model_rows(t)), FEATURES, train())
    return out.select("event_id", *[F.round(c, 7).alias(c) for c in FEATURES])


@query("g5_median_impute", """
WITH m AS (SELECT quantile_disc(f2, 0.5) AS f2m, quantile_disc(age, 0.5) AS agem FROM mt WHERE split='TRAIN')
SELECT event_id, coalesce(f2, f2m) AS f2 FROM mt, m""", "mt")
def _(t):
    from pyspark.ml.feature import Imputer

    rows = cut_lineage(model_rows(t).select("event_id", "split", "f2"))
    model = Imputer(strategy="median", inputCol="f2", outputCol="filled", relativeError=0.0001).fit(rows.filter(train()))
    return model.transform(rows).select("event_id", F.col("filled").alias("f2"))


def prepared(t):
    return cut_lineage(model_rows(t))


def report(scored):
    return M.evaluate(scored, "p", "y", val(), test())


@query("g6_logistic_regression")
def _(t):
    rows = prepared(t)
    model = M.fit_logistic(rows, FEATURES, "y", train())
    return report(M.predict(model, rows))


def trees(rows):
    return M.fit_trees(rows, FEATURES, "y", train(), val())


@query("g7_boosted_trees")
def _(t):
    rows = prepared(t)
    return report(M.predict(trees(rows), rows))


@query("g8_feature_importance")
def _(t):
    rows = prepared(t)
    return M.importances(trees(rows), FEATURES, rows)


@query("g9_climatology", "SELECT round(avg(y), 9) AS p FROM pred WHERE split='TRAIN'", "pred")
def _(t):
    return M.climatology(t.pred(), "y", train()).select(F.round("p", 9).alias("p"))


_q = ", ".join(str(q) for q in K.QUANTILE_GRID)


@query("g10_persistence_baseline", f"""
WITH l AS (SELECT y, split, unnest(['n_1h','n_3h','n_6h']) AS score, unnest([n_1h, n_3h, n_6h])::DOUBLE AS x FROM mt),
g AS (SELECT DISTINCT score, unnest(quantile_cont(x, [{_q}])) AS thr FROM l WHERE split='VAL' GROUP BY score),
s AS (SELECT score, thr, coalesce(tp/nullif(tp+fn, 0), 0)-coalesce(fp/nullif(fp+tn, 0), 0) AS tss FROM (
  SELECT g.score, g.thr, count(*) FILTER (y=1 AND x>=thr)::DOUBLE AS tp, count(*) FILTER (y=0 AND x>=thr)::DOUBLE AS fp, count(*) FILTER (y=1 AND x<thr)::DOUBLE AS fn,
    count(*) FILTER (y=0 AND x<thr)::DOUBLE AS tn FROM g JOIN l ON l.score=g.score WHERE l.split='VAL' GROUP BY 1, 2)),
b AS (SELECT score, thr FROM s ORDER BY round(tss, 12) DESC, score, thr LIMIT 1)
SELECT b.score, round(b.thr, 9) AS threshold, count(*) FILTER (y=1 AND x>=thr) AS tp, count(*) FILTER (y=0 AND x>=thr) AS fp, count(*) FILTER (y=1 AND x<thr) AS fn, count(*) FILTER (y=0 AND x<thr) AS tn
FROM b JOIN l USING (score) WHERE split='TEST' GROUP BY 1, 2""", "mt")
def _(t):
    out = M.persistence_baseline(prepared(t), ["n_1h", "n_3h", "n_6h"], "y", val(), test())
    return out.select("score", F.round("threshold", 9).alias("threshold"), "tp", "fp", "fn", "tn")


@query("g11_isotonic_calibration", """
WITH s AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(y) OVER (ORDER BY p) AS hits, sum(n) OVER (ORDER BY p) AS rows
  FROM (SELECT p, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS n FROM pred WHERE split='VAL' GROUP BY p)),
-- the fit at i is the largest over a <= i of the least mean of rows a to b over b >= i
m AS (SELECT a.i AS a, b.i AS b, (b.hits-coalesce(z.hits, 0))/(b.rows-coalesce(z.rows, 0)) AS mean FROM s a LEFT JOIN s z ON z.i = a.i-1 JOIN s b ON b.i >= a.i),
w AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m),
f AS (SELECT p, i, lead(p) OVER (ORDER BY p) AS next_p, v, lead(v) OVER (ORDER BY p) AS next_v FROM (SELECT b AS i, max(least) AS v FROM w GROUP BY b) JOIN s USING (i)),
e AS (SELECT min(p) AS p0, arg_min(v, p) AS v0 FROM f)
SELECT t.event_id, t.p, round(CASE WHEN t.p < e.p0 THEN e.v0 WHEN f.next_p IS NULL OR t.p = f.p THEN f.v
  ELSE f.v + (f.next_v-f.v)*(t.p-f.p)/(f.next_p-f.p) END, 9) AS p_cal, t.y
FROM (SELECT * FROM pred WHERE split='TEST') t ASOF LEFT JOIN f ON t.p >= f.p, e""", "pred")
def _(t):
    rows = t.pred()
    out = M.fit_isotonic(rows.filter(val()), "p", "y").apply(rows.filter(test()), "p", "p_cal")
    return out.select("event_id", "p", F.round("p_cal", 9).alias("p_cal"), "y")


@query("g12_negative_subsample", """
WITH tr AS (SELECT *, (event_id*2654435761)%4294967296 AS h FROM pred WHERE split='TRAIN')
SELECT event_id, y FROM (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY h, event_id) AS rn FROM tr)
WHERE y=1 OR rn <= 2*(SELECT count(*) FROM tr WHERE y=1)""", "pred")
def _(t):
    return X.subsample_negatives(t.pred().filter(train()), "y", "event_id", 2).select("event_id", "y")


@query("g13_score_series")
def _(t):
    rows = prepared(t)
    model = M.fit_logistic(rows, FEATURES, "y", train())
    scored = M.predict(model, rows.filter(val()), "p_raw")
    calibration = M.fit_isotonic(scored, "p_raw", "y")
    return M.score_series(model, calibration, rows.filter(test()), F.col("event_id") % 9 != 0).select("event_id", "t", "p", "p_lo", "p_hi")


def horizon_rows(t):
    """Model rows with one target per horizon: a peak in (t, t + minutes]."""
    ahead = asof(t.ev().select("t").distinct(), t.flare(), [], "t", "peak_t", ["peak_t"], EVENT_CHUNK, "forward", strict=True, order=["flare_id"])
    soon = {y: F.col("peak_t") <= F.col("t") + 60 * int(y[2:4]) for y in YS}
    return X.beside(model_rows(t), "t", ahead.select("t", *[F.when(c, 1).otherwise(0).alias(y) for y, c in soon.items()]))


@query("g14_feature_ablation")
def _(t):
    rows = cut_lineage(horizon_rows(t))
    groups = {"values": ["f1", "f2"], "history": ["age", "n_1h", "n_3h", "n_6h"], "combined": FEATURES}
    return M.ablation(rows, groups, YS, train(), val(), test())
