"""Time-series views over the generic test tables, for Spark and as SQL text.

``events`` is the only table with a time stamp of its own: its types act as
detectors, its values as count rates. All positions are whole unix seconds or cell
numbers derived from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.functions.scalars import class_rank, day_key, floor_div, unix_of
from chronoflux.operators.events import fuse_clusters, link_clusters
from chronoflux.operators.grid import cell_means, densify, extents, time_split
from chronoflux.operators.rolling import background, boxcar, excess, poisson_sigma
from chronoflux.operators.timeline import asof
from chronoflux.session import cut_lineage

HOUR = 3600
DAY_CELLS = 24
MATCH_TOL = 180
LINK_WINDOW = 180
MAX_SPAN = 240
# Chunk lengths: cells of the hourly grid, and seconds for event lists.
GRID_CHUNK = 240
EVENT_CHUNK = 86_400
SPLITS = ("20240115", "20240122", "20240131")

# Scaled settings of the hourly grid, in cells.
SMOOTH, WINDOW, MIN_QUIET, PAD = 6, 48, 8, 12
MIN_RUN, LINK_GAP, EDGE, PEAK_SEP, PRE_CELLS = 2, 2, 12, 3, 12
THRESHOLD, PROMINENCE = 2.0, 1.0

CTES: dict[str, tuple[str, str]] = {
    "ev": ("", "SELECT event_id, epoch_us(ts)//1000000 AS t, user_id, event_type, value FROM events"),
    "sample": ("ev", "SELECT event_id, event_type AS detector, t, value AS rate FROM ev"),
    "span": ("ev", "SELECT min(t)//86400 AS d0, max(t)//86400 AS d1 FROM ev"),
    "dets": ("sample", "SELECT DISTINCT detector FROM sample"),
    "cells": ("sample", "SELECT detector, t//3600 AS k, avg(rate) AS rate, count(*) AS n FROM sample GROUP BY 1, 2"),
    "grid": ("dets span cells", """
        SELECT s.detector, s.k, c.rate, c.rate IS NOT NULL AS gti
        FROM (SELECT detector, unnest(range(d0*24, (d1+1)*24)) AS k FROM dets, span) s
        LEFT JOIN cells c USING (detector, k)"""),
    "cells10": ("sample", "SELECT detector, t//600 AS k, avg(rate) AS rate, count(*) AS n FROM sample GROUP BY 1, 2"),
    "grid10": ("dets span cells10", """
        SELECT s.detector, s.k, c.rate, c.rate IS NOT NULL AS gti
        FROM (SELECT detector, unnest(range(d0*144, (d1+1)*144)) AS k FROM dets, span) s
        LEFT JOIN cells10 c USING (detector, k)"""),
    "flare": ("ev", """
        SELECT event_id AS flare_id, t AS peak_t, t-60*(1+user_id%30) AS start_t, t+60*(1+event_id%45) AS end_t,
               CASE WHEN value<120 THEN 'B' WHEN value<160 THEN 'C' WHEN value<220 THEN 'M' ELSE 'X' END AS letter,
               CASE WHEN value<120 THEN 1 WHEN value<160 THEN 2 WHEN value<220 THEN 3 ELSE 4 END AS rnk,
               value/100 AS mag
        FROM ev WHERE event_type='error' AND value>=100"""),
    "flare2": ("ev", "SELECT event_id AS flare_id, t AS peak_t FROM ev WHERE event_type='purchase' AND value>=80"),
    "det": ("ev", """
        SELECT event_id AS det_id, event_type AS detector, t AS peak_t, t-300 AS start_t, t+600 AS end_t,
               value/10 AS max_significance, value AS peak_rate FROM ev WHERE value>=90"""),
    "det_other": ("det", "SELECT * FROM det WHERE detector<>'error'"),
    # Excess of the hourly grid, label-free: smoothed 6, window 48, widened 192, segment level.
    # Everything resets with the period, as the second data does with the day.
    "smooth": ("grid", """
        SELECT detector || '/' || k//240 AS series, detector, k//240 AS period, k, rate, gti, round(avg(rate) OVER w, 9) AS smoothed,
               k - row_number() OVER (PARTITION BY detector, k//240, gti ORDER BY k) AS seg
        FROM grid WINDOW w AS (PARTITION BY detector, k//240 ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"""),
    "ex": ("smooth", """
        SELECT series, detector, period, k, rate, gti, smoothed, background, CASE WHEN background IS NOT NULL THEN sqrt(greatest(background, 1)) END AS sigma,
               round((smoothed-background)/sqrt(greatest(background, 1)), 9) AS excess
        FROM (SELECT *, CASE WHEN gti THEN round(coalesce(
                CASE WHEN count(smoothed) OVER w1 >= 8 THEN quantile_cont(smoothed, 0.1) OVER w1 END,
                CASE WHEN count(smoothed) OVER w2 >= 4 THEN quantile_cont(smoothed, 0.1) OVER w2 END,
                quantile_cont(smoothed, 0.1) OVER w3), 12) END AS background
              FROM smooth
              WINDOW w1 AS (PARTITION BY series, gti, seg ORDER BY k ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING),
                     w2 AS (PARTITION BY series, gti, seg ORDER BY k ROWS BETWEEN 96 PRECEDING AND 95 FOLLOWING),
                     w3 AS (PARTITION BY series, gti, seg))"""),
    "runs": ("ex", """
        SELECT series, min(k) AS run_start, max(k)+1 AS run_end, count(*) AS n FROM (
          SELECT series, k, k - row_number() OVER (PARTITION BY series ORDER BY k) AS isl
          FROM ex WHERE gti AND excess >= 2.0) GROUP BY series, isl HAVING count(*) >= 2"""),
    "merged": ("runs", """
        SELECT series, min(run_start) AS run_start, max(run_end) AS run_end FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY run_start) AS grp FROM (
            SELECT *, CASE WHEN run_start - lag(run_end) OVER (PARTITION BY series ORDER BY run_start) <= 2
                      THEN 0 ELSE 1 END AS fresh FROM runs)) GROUP BY series, grp"""),
    "run_rows": ("merged ex", """
        SELECT m.run_start, m.run_end, ex.* FROM merged m JOIN ex
          ON ex.series = m.series AND ex.k >= m.run_start AND ex.k < m.run_end"""),
    "maxima": ("run_rows", """
        SELECT series, run_start, run_end, (min(k)+max(k))//2 AS peak, any_value(v) AS height FROM (
          SELECT *, sum(chg) OVER (PARTITION BY series, run_start ORDER BY k) AS flat FROM (
            SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS chg, lag(v) OVER w AS b, lead(v) OVER w AS a
            FROM (SELECT *, coalesce(excess, -1e308) AS v FROM run_rows)
            WINDOW w AS (PARTITION BY series, run_start ORDER BY k)))
        GROUP BY series, run_start, run_end, flat
        HAVING arg_min(b, k) < any_value(v) AND arg_max(coalesce(a, 1e308), k) < any_value(v)"""),
    "spaced": ("maxima", """
        SELECT series, run_start, run_end, -kept.p AS peak, -kept.h AS height FROM (
          SELECT series, run_start, run_end, unnest(list_reduce(
            list([{'h': -height, 'p': -peak}] ORDER BY height DESC, peak DESC),
            lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: abs(q.p - x[1].p) < 3)) > 0
                           THEN acc ELSE list_concat(acc, x) END)) AS kept
          FROM maxima GROUP BY 1, 2, 3)"""),
    "prominent": ("spaced run_rows", """
        SELECT series, run_start, run_end, peak, height,
               height - greatest(min(v) FILTER (k <= peak AND k > lw), min(v) FILTER (k >= peak AND k < rw)) AS prominence
        FROM (SELECT s.*, r.k, coalesce(r.excess, -1e308) AS v,
                max(CASE WHEN r.k < s.peak AND r.excess > s.height THEN r.k ELSE -1 END) OVER p AS lw,
                min(CASE WHEN r.k > s.peak AND r.excess > s.height THEN r.k ELSE 999999999 END) OVER p AS rw
              FROM spaced s JOIN run_rows r ON r.series=s.series AND r.run_start=s.run_start
              WINDOW p AS (PARTITION BY s.series, s.run_start, s.peak))
        GROUP BY 1, 2, 3, 4, 5
        HAVING height - greatest(min(v) FILTER (k <= peak AND k > lw), min(v) FILTER (k >= peak AND k < rw)) >= 1.0"""),
    "peaks": ("prominent run_rows", """
        SELECT series, run_start, run_end, peak, height FROM prominent
        UNION ALL
        SELECT series, run_start, run_end, arg_max(k, excess*1e6-k*1e-9), max(excess) FROM run_rows r
        WHERE NOT EXISTS (SELECT 1 FROM prominent p WHERE p.series=r.series AND p.run_start=r.run_start)
        GROUP BY 1, 2, 3"""),
    "bounds": ("peaks ex", """
        SELECT p.series, p.run_start, p.run_end, p.peak,
          coalesce(arg_min(e.k, [e.smoothed, e.k]) FILTER (e.k <= p.peak AND e.smoothed IS NOT NULL), p.peak) AS start,
          coalesce(arg_min(e.k, [e.smoothed, e.k]) FILTER (e.k >= p.peak AND e.smoothed IS NOT NULL), p.peak) AS stop
        FROM (SELECT *, coalesce(lag(peak) OVER w, run_start) AS lb, coalesce(lead(peak) OVER w, run_end-1) AS rb
              FROM peaks WINDOW w AS (PARTITION BY series, run_start ORDER BY peak)) p
        JOIN ex e ON e.series=p.series AND e.k BETWEEN greatest(lb, peak-12) AND least(rb, peak+12)
        GROUP BY 1, 2, 3, 4"""),
    "refined": ("bounds ex", """
        SELECT b.*, coalesce(arg_max(e.k, [e.rate, -e.k]) FILTER (e.rate IS NOT NULL), any_value(b.peak)) AS best
        FROM bounds b JOIN ex e ON e.series=b.series AND e.k BETWEEN greatest(start, peak-3) AND least(stop, peak+3)
        GROUP BY b.series, b.run_start, b.run_end, b.peak, b.start, b.stop"""),
    "events_found": ("refined ex", """
        SELECT r.series, r.run_start, r.start, r.stop, r.best AS peak, r.stop-r.start AS duration,
          max(rate) FILTER (k=r.best) AS peak_rate,
          coalesce(CASE WHEN count(*) FILTER (k<r.start AND gti) > 0 THEN quantile_cont(rate, 0.5) FILTER (k<r.start AND gti)
                   ELSE max(background) FILTER (k=r.start) END, 0) AS preflare_bg,
          max(excess) FILTER (k>=r.start) AS max_significance,
          greatest(0, r.best-r.start) AS rise_time,
          CASE WHEN r.best > r.start THEN max(step) FILTER (k>r.start AND k<=r.best) ELSE 0 END AS max_derivative
        FROM refined r JOIN (SELECT *, smoothed - lag(smoothed) OVER (PARTITION BY series ORDER BY k) AS step FROM ex) e
          ON e.series=r.series AND e.k BETWEEN r.start-12 AND r.stop
        WHERE r.stop-r.start >= 2
        GROUP BY r.series, r.run_start, r.start, r.stop, r.best"""),
    "linked": ("det", """
        SELECT d.*, f.m.a AS anchor FROM det d JOIN (
          SELECT unnest(list_reduce(list([{'p': peak_t, 'a': peak_t}] ORDER BY peak_t),
            lambda acc, x: list_concat(acc, [{'p': x[1].p, 'a': CASE WHEN x[1].p - acc[len(acc)].a > 240
                           THEN x[1].p ELSE acc[len(acc)].a END}]))) AS m
          FROM (SELECT peak_t, sum(fresh) OVER (ORDER BY peak_t) AS isl FROM (
                  SELECT peak_t, CASE WHEN peak_t - lag(peak_t) OVER (ORDER BY peak_t) <= 180 THEN 0 ELSE 1 END AS fresh
                  FROM (SELECT DISTINCT peak_t FROM det)))
          GROUP BY isl) f ON f.m.p = d.peak_t"""),
    "master": ("linked", """
        SELECT anchor, floor(quantile_cont(peak_t, 0.5))::BIGINT AS master_peak, min(start_t) AS master_start,
               max(end_t) AS master_end, count(DISTINCT detector) AS n_detectors, count(*) AS n_members,
               string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, list(peak_t ORDER BY peak_t) AS member_peaks,
               max(max_significance) AS max_significance, max(peak_rate) AS peak_rate_max
        FROM linked GROUP BY anchor"""),
    "confidence": ("linked", """
        SELECT anchor, count(*)/5.0*exp(avg(ln(greatest(sig, 1e-6)))) AS confidence
        FROM (SELECT anchor, detector, max(max_significance) AS sig FROM linked GROUP BY 1, 2) GROUP BY 1"""),
    "pred": ("ev flare", """
        SELECT e.event_id, e.t, round(((e.event_id*7919+e.user_id*104729)%10007)/10007.0*0.5
                 + least(e.value, 200)/200*0.5, 4) AS p,
               CASE WHEN f.peak_t <= e.t+900 THEN 1 ELSE 0 END AS y,
               CASE WHEN f.peak_t <= e.t+900 THEN f.letter END AS letter,
               strftime(make_timestamp(e.t*1000000), '%Y%m%d') AS day,
               CASE WHEN e.t < 1705363200 THEN 'TRAIN' WHEN e.t < 1705968000 THEN 'VAL'
                    WHEN e.t < 1706745600 THEN 'TEST' END AS split
        FROM ev e LEFT JOIN (SELECT t, min(event_id) AS nid FROM
               (SELECT e2.t, f2.event_id FROM (SELECT DISTINCT t FROM ev) e2
                ASOF JOIN (SELECT peak_t, min(flare_id) AS event_id FROM flare GROUP BY 1) f2 ON e2.t < f2.peak_t)
               GROUP BY 1) nx ON nx.t = e.t
        LEFT JOIN flare f ON f.flare_id = nx.nid"""),
}


def with_ctes(names: Sequence[str], body: str) -> str:
    """Prefix ``body`` with the named views and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0].split():
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in ordered]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def ev(self) -> DataFrame:
        return self.read("events").select(
            "event_id", unix_of("ts").alias("t"), "user_id", "event_type", "value"
        )

    def sample(self) -> DataFrame:
        return self.ev().select(
            "event_id", F.col("event_type").alias("detector"), "t", F.col("value").alias("rate")
        )

    def grid(self, cell: int = HOUR) -> DataFrame:
        sample = self.sample()
        cells = cell_means(sample, ["detector"], "t", "rate", cell)
        dense = densify(cells, ["detector"], "k", ["rate"], 86_400 // cell, extents(sample, ["detector"], "t", cell))
        return dense.withColumn("gti", F.col("rate").isNotNull())

    def smoothed(self) -> DataFrame:
        """Hourly grid with the series key (detector/period) that bounds every group."""
        period = floor_div("k", GRID_CHUNK)
        rows = self.grid().withColumn("series", F.concat_ws("/", "detector", period.cast("string")))
        rows = rows.withColumn("period", period)
        return boxcar(rows, ["series"], "k", "rate", "smoothed", SMOOTH, None).withColumn(
            "smoothed", F.round("smoothed", 9)
        )

    def excess(self) -> DataFrame:
        """Excess of the hourly grid at a fixed number of digits, so that ties stay ties."""
        rows = self.smoothed()
        rows = background(rows, ["series"], "k", "smoothed", "gti", "background", WINDOW, MIN_QUIET, None)
        rows = rows.withColumn("background", F.round("background", 12))
        return rows.withColumn("sigma", poisson_sigma("background")).withColumn(
            "excess", F.round(excess("smoothed", "background"), 9)
        )

    def master(self) -> DataFrame:
        linked = link_clusters(self.det(), [], "peak_t", "det_id", LINK_WINDOW, MAX_SPAN, EVENT_CHUNK)
        return cut_lineage(fuse_clusters(linked, [], "anchor"))

    def flare(self) -> DataFrame:
        v = F.col("value")
        letter = F.when(v < 120, "B").when(v < 160, "C").when(v < 220, "M").otherwise("X")
        return (
            self.ev().filter((F.col("event_type") == "error") & (v >= 100))
            .select(
                F.col("event_id").alias("flare_id"), F.col("t").alias("peak_t"),
                (F.col("t") - 60 * (1 + F.col("user_id") % 30)).alias("start_t"),
                (F.col("t") + 60 * (1 + F.col("event_id") % 45)).alias("end_t"),
                letter.alias("letter"), (v / 100).alias("mag"),
            )
            .withColumn("rnk", class_rank("letter"))
        )

    def flare2(self) -> DataFrame:
        return (
            self.ev().filter((F.col("event_type") == "purchase") & (F.col("value") >= 80))
            .select(F.col("event_id").alias("flare_id"), F.col("t").alias("peak_t"))
        )

    def det(self) -> DataFrame:
        t = F.col("t")
        return self.ev().filter("value >= 90").select(
            F.col("event_id").alias("det_id"), F.col("event_type").alias("detector"), t.alias("peak_t"),
            (t - 300).alias("start_t"), (t + 600).alias("end_t"),
            (F.col("value") / 10).alias("max_significance"), F.col("value").alias("peak_rate"),
        )

    def det_other(self) -> DataFrame:
        return self.det().filter("detector <> 'error'")

    def pred(self) -> DataFrame:
        """One scored row per event: score, next-15-minute outcome, class, day, split."""
        hashed = F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 104729, F.lit(10007)) / 10007.0
        p = F.round(hashed * 0.5 + F.least(F.col("value"), F.lit(200.0)) / 200 * 0.5, 4)
        rows = self.ev().select("event_id", "t", p.alias("p"))
        rows = asof(rows, self.flare(), [], "t", "peak_t", ["peak_t", "letter"], EVENT_CHUNK,
                    "forward", strict=True, order=["flare_id"])
        soon: Column = F.col("peak_t") <= F.col("t") + 900
        day = day_key("t")
        return rows.select(
            "event_id", "t", "p", F.when(soon, 1).otherwise(0).alias("y"),
            F.when(soon, F.col("letter")).alias("letter"), day.alias("day"),
            time_split(day, *SPLITS).alias("split"),
        )
