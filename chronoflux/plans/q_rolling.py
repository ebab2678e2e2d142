"""Queries: gap-aware rolling statistics (section E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.functions.scalars import floor_div
from chronoflux.operators import rolling as R
from chronoflux.operators.grid import densify, extents, fill_category
from chronoflux.operators.timeline import flag_runs, with_frames
from chronoflux.plans.registry import query
from chronoflux.plans.tables import CTES, GRID_CHUNK, MIN_QUIET, PAD, WINDOW

D = ["detector"]
FULL_CHUNK = 14_400  # five days of 30-second cells, and twice the wide window


def r9(c, name=None):
    return F.round(c, 9).alias(name or c)


@query("e1_boxcar_mean", """
SELECT detector, k, round(CASE WHEN count(rate) OVER w >= 1 THEN avg(rate) OVER w END, 9) AS smoothed FROM grid
WINDOW w AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""", "grid")
def _(t):
    return R.boxcar(t.grid(), D, "k", "rate", "smoothed", 6, GRID_CHUNK).select("detector", "k", r9("smoothed"))


@query("e2_mask_dilation", """
SELECT detector, k, CAST(max(CASE WHEN rate>=75 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS near_event FROM grid
WINDOW w AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""", "grid")
def _(t):
    rows = t.grid().withColumn("hot", F.col("rate") >= 75)
    out = R.dilate(rows, D, "k", "hot", "near_event", PAD, GRID_CHUNK)
    return out.select("detector", "k", F.col("near_event").cast("int").alias("near_event"))


@query("e3_gti_segments", """
SELECT detector, min(k) AS seg_start, max(k)+1 AS seg_end FROM (
  SELECT detector, k, k-row_number() OVER (PARTITION BY detector ORDER BY k) AS isl FROM grid WHERE gti)
GROUP BY detector, isl""", "grid")
def _(t):
    rows = flag_runs(t.grid(), D, "k", F.col("gti"), GRID_CHUNK, "seg_start").filter("seg_start IS NOT NULL")
    return rows.groupBy("detector", "seg_start").agg((F.max("k") + 1).alias("seg_end"))


@query("e4_label_aware_background", """
WITH lab AS (SELECT *, max(CASE WHEN rate>=90 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY k
               ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near FROM smooth),
q AS (SELECT *, CASE WHEN gti AND near=0 THEN smoothed END AS quiet FROM lab)
SELECT detector, k, round(CASE WHEN gti THEN coalesce(
    CASE WHEN count(quiet) OVER w1 >= 8 THEN quantile_cont(quiet, 0.5) OVER w1 END,
    CASE WHEN count(quiet) OVER w2 >= 4 THEN quantile_cont(quiet, 0.5) OVER w2 END,
    quantile_cont(quiet, 0.5) OVER w3, quantile_cont(smoothed, 0.5) OVER w3) END, 12) AS background
FROM q WINDOW w1 AS (PARTITION BY series, gti, seg ORDER BY k ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING),
  w2 AS (PARTITION BY series, gti, seg ORDER BY k ROWS BETWEEN 96 PRECEDING AND 95 FOLLOWING),
  w3 AS (PARTITION BY series, gti, seg)""", "smooth")
def _(t):
    rows = t.smoothed().withColumn("is_event", F.col("rate") >= 90)
    out = R.background(rows, ["series"], "k", "smoothed", "gti", "background", WINDOW, MIN_QUIET, None, "is_event", PAD)
    return out.select("detector", "k", F.round("background", 12).alias("background"))


@query("e5_label_free_background", "SELECT detector, k, background FROM ex", "ex")
def _(t):
    return t.excess().select("detector", "k", "background")


@query("e6_poisson_excess", """
SELECT detector, k, round(sqrt(greatest(n, 1)), 9) AS sigma, round((rate-n)/sqrt(greatest(n, 1)), 9) AS excess
FROM cells""", "cells")
def _(t):
    from chronoflux.operators.grid import cell_means

    rows = cell_means(t.sample(), D, "t", "rate", 3600)
    return rows.select("detector", "k", F.round(R.poisson_sigma("n"), 9).alias("sigma"),
                       F.round(R.excess("rate", "n"), 9).alias("excess"))


@query("e7_compute_excess", """
SELECT detector, k, smoothed, background, round(sigma, 9) AS sigma, excess FROM ex""", "ex")
def _(t):
    return t.excess().select("detector", "k", "smoothed", "background", r9("sigma"), "excess")


# The detector's own settings (70, 1,800, 7,200 and 1,800 cells), on a grid of 30 seconds: a sample
# holds for an hour at most, so segments last from hours to weeks. Rates are whole numbers, so sums are exact
# (and no level of up to 70 of them ends between two numbers of 7 digits).
FINE, HOLD = 30, 120
CTES["held"] = ("sample span dets", f"""
  SELECT detector, k, rate, rate IS NOT NULL AS gti FROM (
    SELECT detector, k, last_value(rate IGNORE NULLS) OVER (PARTITION BY detector ORDER BY k ROWS BETWEEN {HOLD} PRECEDING AND CURRENT ROW) AS rate
    FROM (SELECT detector, unnest(range(d0*{86400 // FINE}, (d1+1)*{86400 // FINE})) AS k FROM dets, span)
    LEFT JOIN (SELECT detector, t//{FINE} AS k, round(sum(round(rate*10))/count(*)) AS rate FROM sample GROUP BY 1, 2) USING (detector, k))""")
CTES["held_smooth"] = ("held", """
  SELECT *, k - row_number() OVER (PARTITION BY detector, gti ORDER BY k) AS seg, max(CASE WHEN rate>=1500 THEN 1 ELSE 0 END) OVER p AS near,
    CASE WHEN count(rate) OVER s >= 17 THEN sum(rate) OVER s / count(rate) OVER s END AS smoothed FROM held
  WINDOW s AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 35 PRECEDING AND 34 FOLLOWING), p AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 1800 PRECEDING AND 1800 FOLLOWING)""")
LEVEL_SQL = """CASE WHEN gti THEN coalesce(
    CASE WHEN count(quiet) OVER w1 >= 120 THEN quantile_cont(quiet, {q}) OVER w1 END, CASE WHEN count(quiet) OVER w2 >= 60 THEN quantile_cont(quiet, {q}) OVER w2 END,
    quantile_cont(quiet, {q}) OVER w3, quantile_cont(smoothed, 0.5) OVER w3) END"""
WINDOWS_SQL = """WINDOW w1 AS (PARTITION BY detector, gti, seg ORDER BY k ROWS BETWEEN 900 PRECEDING AND 899 FOLLOWING),
  w2 AS (PARTITION BY detector, gti, seg ORDER BY k ROWS BETWEEN 3600 PRECEDING AND 3599 FOLLOWING), w3 AS (PARTITION BY detector, gti, seg)"""


def held(t):
    """Five series of one cell per 30 seconds, each sample held for an hour at most."""
    sample = t.sample()
    cells = sample.groupBy("detector", floor_div("t", FINE).alias("k")).agg(F.round(F.sum(F.round(F.col("rate") * 10)) / F.count("*")).alias("rate"))
    dense = densify(cells, D, "k", ["rate"], 86_400 // FINE, extents(sample, D, "t", FINE))
    hold = {"held": lambda w: F.last("rate", ignorenulls=True).over(w.rowsBetween(-HOLD, 0))}
    rows = with_frames(dense, D, "k", hold, HOLD, 0, 86_400 // FINE)
    return rows.select("detector", "k", F.col("held").alias("rate"), F.col("held").isNotNull().alias("gti"))


@query("e4b_background_full_settings", f"""
SELECT detector, k, round({LEVEL_SQL.format(q=0.5)}, 7) AS background FROM (SELECT *, CASE WHEN gti AND near=0 THEN smoothed END AS quiet FROM held_smooth) {WINDOWS_SQL}""", "held_smooth", "background")
def _(t):
    rows = R.boxcar(held(t), D, "k", "rate", "smoothed", 70, FULL_CHUNK).withColumn("is_event", F.col("rate") >= 1500)
    out = R.background(rows, D, "k", "smoothed", "gti", "background", 1800, 120, FULL_CHUNK, "is_event", 1800)
    return out.select("detector", "k", F.round("background", 7).alias("background"))


@query("e7b_excess_full_settings", f"""
SELECT detector, k, round(smoothed, 7) AS smoothed, round(level, 7) AS background, round((smoothed-level)/sqrt(greatest(level, 1)), 7) AS excess
FROM (SELECT *, {LEVEL_SQL.format(q=0.1)} AS level FROM (SELECT *, CASE WHEN gti THEN smoothed END AS quiet FROM held_smooth) {WINDOWS_SQL})""", "held_smooth", "smoothed background excess")
def _(t):
    out = R.compute_excess(held(t), D, "k", "rate", "gti", FULL_CHUNK)
    return out.select("detector", "k", *[F.round(c, 7).alias(c) for c in ("smoothed", "background", "excess")])


TRAILING = {"3": 3, "6": 6, "12": 12, "24": 24}


@query("e8_trailing_stats", "SELECT detector, k, " + ", ".join(
    f"round(CASE WHEN count(rate) OVER w{w} >= {max(1, w // 2)} THEN {agg} OVER w{w} END, 8) AS {name}_{w}"
    for w in TRAILING.values()
    for name, agg in (("mean", "avg(rate)"), ("std", "stddev_samp(rate)"), ("max", "max(rate)"), ("median", "quantile_cont(rate, 0.5)"))
) + " FROM grid WINDOW " + ", ".join(
    f"w{w} AS (PARTITION BY detector ORDER BY k ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in TRAILING.values()), "grid")
def _(t):
    out = R.trailing_stats(t.grid(), D, "k", "rate", TRAILING, GRID_CHUNK, R.TRAILING_STATS)
    return out.select("detector", "k", *[F.round(c, 8).alias(c) for c in out.columns if c.rsplit("_", 1)[-1] in TRAILING])


FULL_TRAILING = (300, 900, 1800, 3600)
OFF_TIE = 3.3e-8  # means of whole numbers often end in 5 at any number of digits; both sides round off that tie


@query("e8b_trailing_full_windows", "SELECT detector, k, " + ", ".join(
    f"round(CASE WHEN count(rate) OVER w{w} >= {w // 2} THEN {agg} OVER w{w} END + {OFF_TIE}, 6) AS {name}_{w}"
    for w in FULL_TRAILING for name, agg in (("mean", "avg(rate)"), ("std", "stddev_samp(rate)"), ("max", "max(rate)"))
) + ", round(CASE WHEN count(rate) OVER w900 >= 450 THEN quantile_cont(rate, 0.5) OVER w900 END + 3.3e-8, 6) AS median_900 FROM held WINDOW " + ", ".join(
    f"w{w} AS (PARTITION BY detector ORDER BY k ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in FULL_TRAILING), "held",
    " ".join(f"{n}_{w}" for w in FULL_TRAILING for n in ("mean", "std", "max")) + " median_900")
def _(t):
    rows = R.trailing_stats(held(t).drop("gti"), D, "k", "rate", {str(w): w for w in FULL_TRAILING}, FULL_CHUNK)
    rows = R.trailing_stats(rows, D, "k", "rate", {"900": 900}, FULL_CHUNK, ["median"])
    return rows.select("detector", "k", *[F.round(F.col(c) + OFF_TIE, 6).alias(c) for c in rows.columns if c.split("_")[0] in ("mean", "std", "max", "median")])


@query("e9_threshold_crossings", """
WITH b AS (SELECT detector, k, rate, CASE WHEN count(rate) OVER w >= 12 THEN quantile_cont(rate, 0.5) OVER w END AS bg FROM grid
  WINDOW w AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, CASE WHEN rate IS NULL THEN NULL WHEN rate > bg + 3*sqrt(greatest(bg, 1)) THEN 1.0 ELSE 0.0 END AS above FROM b)
SELECT detector, k, CAST(CASE WHEN count(above) OVER w >= 12 THEN sum(above) OVER w END AS DOUBLE) AS crossings FROM a
WINDOW w AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""", "grid")
def _(t):
    return R.threshold_crossings(t.grid(), D, "k", "rate", 24, GRID_CHUNK, "crossings").select("detector", "k", "crossings")


@query("e10_trailing_derivative", """
SELECT detector, k, round((rate - lag(rate, 3) OVER w)/3, 9) AS d3, round((rate - lag(rate, 6) OVER w)/6, 9) AS d6
FROM grid WINDOW w AS (PARTITION BY detector ORDER BY k)""", "grid")
def _(t):
    out = R.trailing_change(t.grid(), D, "k", "rate", {"d3": 3, "d6": 6}, GRID_CHUNK)
    return out.select("detector", "k", r9("d3"), r9("d6"))


@query("e11_hardness_ratio", """
WITH p AS (SELECT k, max(rate) FILTER (detector='click') AS hard, max(rate-20) FILTER (detector='view') AS soft FROM grid GROUP BY k),
h AS (SELECT k, hard/nullif(soft, 0) AS hardness FROM p)
SELECT k, round(hardness, 9) AS hardness, round((hardness - lag(hardness, 6) OVER (ORDER BY k))/6, 9) AS hardness_ddt FROM h""", "grid")
def _(t):
    from chronoflux.operators.grid import to_wide

    wide = to_wide(t.grid(), ["k"], "detector", "rate", ["click", "view"]).withColumn("view", F.col("view") - 20)
    rows = wide.withColumn("hardness", R.hardness("click", "view"))
    out = R.trailing_change(rows, [], "k", "hardness", {"hardness_ddt": 6}, GRID_CHUNK)
    return out.select("k", r9("hardness"), r9("hardness_ddt"))


@query("e12_trailing_event_counts", """
SELECT k, CAST(coalesce(sum(e) OVER (ORDER BY p RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS n_1h,
       CAST(coalesce(sum(e) OVER (ORDER BY p RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS n_6h
FROM (SELECT k, k*3600 AS p, NULL AS e FROM (SELECT DISTINCT k FROM grid)
      UNION ALL SELECT NULL, peak_t, count(*) FROM flare GROUP BY peak_t) QUALIFY k IS NOT NULL""", "grid flare")
def _(t):
    rows = t.grid().select("k").distinct().withColumn("t", F.col("k") * 3600)
    out = R.trailing_counts(rows, t.flare(), [], "t", "peak_t", {"n_1h": 3600, "n_6h": 21600}, 86_400)
    return out.select("k", "n_1h", "n_6h")


@query("e13_central_difference", """
SELECT detector, k, round(CASE WHEN lag(k) OVER w IS NULL THEN lead(smoothed) OVER w - smoothed
   WHEN lead(k) OVER w IS NULL THEN smoothed - lag(smoothed) OVER w
   ELSE (lead(smoothed) OVER w - lag(smoothed) OVER w)/2 END, 12) AS slope
FROM smooth WINDOW w AS (PARTITION BY series ORDER BY k)""", "smooth")
def _(t):
    return R.central_difference(t.smoothed(), ["series"], "k", "smoothed", "slope", None).select("detector", "k", F.round("slope", 12).alias("slope"))


@query("e14_fill_category", """
WITH c AS (SELECT detector, k, CASE WHEN rate>=65 THEN 'high' WHEN rate<30 THEN 'low' END AS level FROM grid)
SELECT detector, k, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY detector ORDER BY k ROWS UNBOUNDED PRECEDING),
  first_value(level IGNORE NULLS) OVER (PARTITION BY detector ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
FROM c""", "grid")
def _(t):
    rows = t.grid().withColumn("level", F.when(F.col("rate") >= 65, "high").when(F.col("rate") < 30, "low"))
    return fill_category(rows, D, "k", "level", GRID_CHUNK, out="filled").select("detector", "k", F.col("filled").alias("level"))


@query("e15_persistence_prediction", """
SELECT detector, k, CAST(coalesce(max(CASE WHEN rate>=70 THEN 1 ELSE 0 END) OVER (PARTITION BY series, seg ORDER BY k
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS predicted FROM smooth WHERE gti""", "smooth")
def _(t):
    rows = flag_runs(t.smoothed(), ["series"], "k", F.col("gti"), None, "seg").filter("gti")
    rows = rows.withColumn("hot", F.col("rate") >= 70)
    return R.persistence(rows, ["series"], "k", "hot", "seg", "predicted", 5, None).select("detector", "k", "predicted")


@query("e16_window_across_midnight", """
SELECT detector, k, round(m, 9) AS mean_6 FROM (SELECT detector, k, avg(rate) OVER (PARTITION BY detector ORDER BY k
  ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM grid) WHERE k%24 < 2""", "grid")
def _(t):
    # Chunks of one day: every wanted row needs cells of the day before.
    frames = {"mean_6": lambda w: F.avg("rate").over(w.rangeBetween(-5, 0))}
    out = with_frames(t.grid(), D, "k", frames, 5, 0, 24)
    return out.filter(F.col("k") % 24 < 2).select("detector", "k", r9("mean_6"))


@query("e17_trailing_sequences", """
SELECT detector, k, seq FROM (SELECT detector, k, gti, count(*) OVER w AS n,
  string_agg(coalesce(CAST(CAST(round(rate*100) AS BIGINT) AS VARCHAR), '-'), ',') OVER w AS seq
  FROM grid WINDOW w AS (PARTITION BY detector, k//24 ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
WHERE n = 12 AND gti""", "grid")
def _(t):
    rows = t.grid().withColumn("day_no", floor_div("k", 24)).withColumn(
        "text", F.coalesce(F.round(F.col("rate") * 100).cast("bigint").cast("string"), F.lit("-"))
    )
    out = R.trailing_arrays(rows, ["detector", "day_no"], "k", ["text"], 12, 24, "seq").filter("gti")
    return out.select("detector", "k", F.array_join("seq.text", ",").alias("seq"))
