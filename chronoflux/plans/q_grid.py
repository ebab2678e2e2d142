"""Queries: gridding, masking and reshaping (section B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.functions.scalars import day_key, floor_div
from chronoflux.operators import grid as G
from chronoflux.operators.timeline import range_join
from chronoflux.plans.registry import query
from chronoflux.plans.tables import SPLITS

DETECTORS = ("click", "error", "purchase", "signup", "view")


def fractional(t):
    """Raw samples with fractional seconds, as a decoder would deliver them."""
    return t.read("events").select(
        "event_id", F.col("event_type").alias("detector"), F.col("value").alias("rate"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
    )


@query("b1_bin_samples", """
SELECT event_type AS detector, CAST(round_even(epoch_us(ts)/1e6, 0) AS BIGINT) AS t,
       arg_max(value, event_id) AS rate
FROM events GROUP BY 1, 2""")
def _(t):
    return G.bin_samples(fractional(t), ["detector"], "t", "rate", "event_id")


@query("b2_dense_grid", "SELECT detector, k, round(rate, 9) AS rate FROM grid", "grid")
def _(t):
    return t.grid().select("detector", "k", F.round("rate", 9).alias("rate"))


@query("b3_gti_mask", """
SELECT detector, sec//86400 AS day_no, count(*) AS good_seconds FROM (
  SELECT DISTINCT event_type AS detector,
    unnest(range(CAST(ceil(epoch_us(ts)/1e6) AS BIGINT), CAST(floor(epoch_us(ts)/1e6+value) AS BIGINT)+1)) AS sec
  FROM events) GROUP BY 1, 2""")
def _(t):
    intervals = fractional(t).withColumn("stop", F.col("t") + F.col("rate"))
    good = G.gti_seconds(intervals, ["detector"], "t", "stop")
    return good.groupBy("detector", floor_div("t", 86400).alias("day_no")).agg(F.count("*").alias("good_seconds"))


@query("b4_stitch_observations", """
SELECT detector, t//60 AS k, arg_min(rate, t*10000000+event_id) AS rate
FROM sample WHERE rate >= 10 GROUP BY 1, 2""", "sample")
def _(t):
    rows = t.sample().withColumn("k", floor_div("t", 60)).withColumn(
        "rate", F.when(F.col("rate") >= 10, F.col("rate"))
    )
    return G.stitch(rows, ["detector", "k"], "rate", ["t", "event_id"])


def wide(t):
    rows = t.grid()
    rates = G.to_wide(rows, ["k"], "detector", "rate", DETECTORS)
    masks = rows.withColumn("gname", F.concat("detector", F.lit("_gti")))
    masks = G.to_wide(masks, ["k"], "gname", "gti", [f"{d}_gti" for d in DETECTORS])
    return rates.join(masks, "k")


@query("b5_wide_to_tidy", """
SELECT k, 'det-' || detector AS detector, round(rate, 9) AS count_rate FROM grid
WHERE gti AND detector IN ('click', 'view')""", "grid")
def _(t):
    tidy = G.to_tidy(
        wide(t), ["k"], {f"det-{d}": d for d in ("click", "view")},
        {f"det-{d}": f"{d}_gti" for d in ("click", "view")},
    )
    return tidy.select("k", "detector", F.round("count_rate", 9).alias("count_rate"))


@query("b6_tidy_to_wide", "SELECT k, " + ", ".join(
    f"round(max(rate) FILTER (detector='{d}'), 9) AS {d}_total" for d in DETECTORS) + " FROM grid GROUP BY k", "grid")
def _(t):
    rows = t.grid().withColumn("name", F.concat(G.slug("detector"), F.lit("_total")))
    names = [f"{d}_total" for d in DETECTORS]
    return G.to_wide(rows, ["k"], "name", "rate", names).select("k", *[F.round(n, 9).alias(n) for n in names])


@query("b7_available_detectors", """
SELECT k//24 AS day_no, detector, CAST(bool_or(gti AND rate>=60) AS INTEGER) AS present
FROM grid GROUP BY 1, 2""", "grid")
def _(t):
    rows = t.grid().withColumn("rate", F.when(F.col("rate") >= 60, F.col("rate")))
    rows = rows.withColumn("day_no", floor_div("k", 24))
    return G.available(rows, ["day_no", "detector"], "rate", "gti").withColumn("present", F.col("present").cast("int"))


@query("b8_log_safe_mask", """
SELECT detector, k, CASE WHEN gti AND rate-45>0 THEN round(rate-45, 9) END AS safe FROM grid""", "grid")
def _(t):
    rows = t.grid().withColumn("rate", F.col("rate") - 45)
    return rows.select("detector", "k", F.round(G.log_safe("rate", "gti"), 9).alias("safe"))


@query("b9_event_window_slice", """
SELECT f.flare_id, g.detector, count(*) AS n_cells, count(g.rate) AS n_seen, round(avg(g.rate), 8) AS mean_rate
FROM flare f JOIN grid g ON g.k*3600 BETWEEN f.peak_t-10800 AND f.peak_t+10800 GROUP BY 1, 2""", "flare grid")
def _(t):
    events = t.flare().select(
        "flare_id", (F.col("peak_t") - 10800).alias("lo"), (F.col("peak_t") + 10800).alias("hi")
    )
    rows = t.grid().withColumn("t", F.col("k") * 3600)
    return range_join(events, rows, [], "lo", "hi", "t", 21600).groupBy("flare_id", "detector").agg(
        F.count("*").alias("n_cells"), F.count("rate").alias("n_seen"), F.round(F.avg("rate"), 8).alias("mean_rate")
    )


@query("b10_time_split", """
SELECT day, CASE WHEN day <= '20240115' THEN 'TRAIN' WHEN day <= '20240122' THEN 'VAL' ELSE 'TEST' END AS split,
       count(*) AS n FROM (SELECT strftime(make_timestamp(t*1000000), '%Y%m%d') AS day FROM ev) GROUP BY 1, 2""", "ev")
def _(t):
    rows = t.ev().select(day_key("t").alias("day"))
    return rows.groupBy("day", G.time_split("day", *SPLITS).alias("split")).agg(F.count("*").alias("n"))


@query("b11_decimate", """
SELECT detector, k//6*6 AS bin_t, round(avg(rate), 8) AS rate FROM grid10 GROUP BY 1, 2 HAVING count(*) = 6""", "grid10")
def _(t):
    return G.decimate(t.grid(600), ["detector"], "k", ["rate"], 6).withColumn("rate", F.round("rate", 8))


@query("b12_minute_marks", "SELECT event_id, t FROM ev WHERE t%86400%60 = 0", "ev")
def _(t):
    return G.minute_marks(t.ev(), "t").select("event_id", "t")


@query("b13_regrid_minutes", """
WITH src AS (SELECT event_type AS detector, t - t%20 AS t, arg_min(value, event_id) AS flux FROM ev GROUP BY 1, 2),
spine AS (SELECT detector, unnest(range(lo, hi+1))*60 AS t FROM
  (SELECT detector, min(t)//60 AS lo, (max(t)+59)//60 AS hi FROM src GROUP BY 1)),
g AS (SELECT s.detector, s.t, src.flux FROM spine s LEFT JOIN src USING (detector, t))
SELECT detector, t//86400 AS day_no, count(*) AS n_cells, count(flux) AS n_seen, round(sum(flux), 6) AS total
FROM g GROUP BY 1, 2""", "ev")
def _(t):
    src = t.ev().select(
        F.col("event_type").alias("detector"), (F.col("t") - F.col("t") % 20).alias("t"),
        F.col("value").alias("flux"), "event_id",
    )
    grid = G.regrid(src, ["detector"], "t", ["flux"], ["event_id"])
    return grid.groupBy("detector", floor_div("t", 86400).alias("day_no")).agg(
        F.count("*").alias("n_cells"), F.count("flux").alias("n_seen"), F.round(F.sum("flux"), 6).alias("total")
    )
