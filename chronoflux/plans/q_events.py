"""Queries: event extraction and fusion (section F)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chronoflux.operators import events as V
from chronoflux.operators import rolling as R
from chronoflux.operators.matching import near_any_member
from chronoflux.plans.q_rolling import FULL_CHUNK, LEVEL_SQL, WINDOWS_SQL, held
from chronoflux.plans.registry import query
from chronoflux.session import stage_table
from chronoflux.plans.tables import (
    CTES, EDGE, EVENT_CHUNK, LINK_GAP, LINK_WINDOW, MATCH_TOL, MAX_SPAN, MIN_RUN, PEAK_SEP,
    PRE_CELLS, PROMINENCE, THRESHOLD,
)

D = ["series"]
RUN = ["series", "run_start", "run_end"]
BUCKET = 24
GRID_CHUNK = None  # the period in the series key bounds every group


def runs(t, ex=None):
    ex = ex if ex is not None else t.excess()
    return V.persistence_runs(ex, D, "k", F.col("gti") & (F.col("excess") >= THRESHOLD), MIN_RUN, GRID_CHUNK)


def run_rows(t):
    ex = stage_table(t.excess().select("series", "k", "excess", "gti"))
    found = V.persistence_runs(ex, D, "k", F.col("gti") & (F.col("excess") >= THRESHOLD), MIN_RUN, GRID_CHUNK)
    merged = V.merge_runs(found, D, LINK_GAP, GRID_CHUNK)
    return V.rows_in_runs(merged, ex.drop("gti"), D, "k", BUCKET)


@query("f1_persistence_runs", "SELECT series, run_start, run_end FROM runs", "runs")
def _(t):
    return runs(t)


@query("f2_merged_runs", "SELECT series, run_start, run_end FROM merged", "merged")
def _(t):
    return V.merge_runs(runs(t), D, LINK_GAP, GRID_CHUNK)


@query("f3_local_maxima", "SELECT * FROM maxima", "maxima")
def _(t):
    return V.local_maxima(run_rows(t), RUN, "k", "excess", GRID_CHUNK)


@query("f4_spaced_peaks", "SELECT * FROM spaced", "spaced")
def _(t):
    found = V.local_maxima(run_rows(t), RUN, "k", "excess", GRID_CHUNK)
    return V.spaced_peaks(found, RUN, PEAK_SEP, GRID_CHUNK)


@query("f5_prominent_peaks", """
SELECT series, run_start, run_end, peak, height, round(prominence, 8) AS prominence FROM prominent""", "prominent")
def _(t):
    rows = run_rows(t)
    found = V.spaced_peaks(V.local_maxima(rows, RUN, "k", "excess", GRID_CHUNK), RUN, PEAK_SEP, GRID_CHUNK)
    return V.prominent_peaks(found, rows, RUN, "k", "excess", PROMINENCE).withColumn(
        "prominence", F.round("prominence", 8)
    )


@query("f6_detected_runs", """
SELECT series, run_start, run_end, peak, max_significance FROM (
  SELECT series, run_start, run_end, k AS peak, excess AS max_significance,
    row_number() OVER (PARTITION BY series, run_start ORDER BY excess DESC NULLS LAST, k) AS rn FROM run_rows) WHERE rn = 1""", "run_rows")
def _(t):
    return V.first_argmax(run_rows(t), RUN, "k", "excess").withColumnRenamed("height", "max_significance")


def bounded(t):
    ex = stage_table(t.excess())
    merged = V.merge_runs(runs(t, ex), D, LINK_GAP, GRID_CHUNK)
    rows = V.rows_in_runs(merged, ex.select("series", "k", "excess"), D, "k", BUCKET)
    peaks = V.peaks_in_runs(rows, RUN, "k", "excess", PEAK_SEP, PROMINENCE)
    return ex, V.valley_bounds(peaks, ex, D, "k", "smoothed", EDGE, BUCKET)


@query("f7_valley_bounds", "SELECT series, run_start, peak, start, stop FROM bounds", "bounds")
def _(t):
    return bounded(t)[1].select("series", "run_start", "peak", "start", F.col("end").alias("stop"))


def measured(t):
    ex, found = bounded(t)
    return V.event_attributes(found, ex, D, "k", "rate", "gti", PEAK_SEP, PRE_CELLS, MIN_RUN, BUCKET)


@query("f8_refined_peaks", """
SELECT series, run_start, start, stop, best AS peak FROM refined WHERE stop-start >= 2""", "refined")
def _(t):
    return measured(t).select("series", "run_start", "start", F.col("end").alias("stop"), "peak")


ATTRIBUTES = ("peak_rate", "preflare_bg", "peak_bgsub", "max_significance", "max_derivative")
_ROUNDED = """round(peak_rate, 7) AS peak_rate, round(preflare_bg, 7) AS preflare_bg,
  round(peak_rate-preflare_bg, 7) AS peak_bgsub, round(max_significance, 7) AS max_significance,
  round(max_derivative, 11) AS max_derivative"""


@query("f9_event_attributes", f"""
SELECT series, run_start, start, stop, peak, duration, CAST(rise_time AS BIGINT) AS rise_time, {_ROUNDED} FROM events_found""", "events_found")
def _(t):
    return measured(t).select(
        "series", "run_start", "start", F.col("end").alias("stop"), "peak", "duration",
        F.col("rise_time").cast("bigint").alias("rise_time"), *[F.round(c, 11 if c == "max_derivative" else 7).alias(c) for c in ATTRIBUTES],
    )


def swept(t, thresholds):
    ex = stage_table(t.excess())
    return V.detect_from_excess(
        ex, D, "k", "rate", "gti", thresholds, MIN_RUN, LINK_GAP, EDGE, PEAK_SEP, PROMINENCE, PRE_CELLS, MIN_RUN, GRID_CHUNK, BUCKET
    )


@query("f10_detect_events", f"SELECT series, start, stop, peak, {_ROUNDED} FROM events_found", "events_found")
def _(t):
    return swept(t, [THRESHOLD]).select(
        "series", "start", F.col("end").alias("stop"), "peak", *[F.round(c, 11 if c == "max_derivative" else 7).alias(c) for c in ATTRIBUTES]
    )


SWEEP = (1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0)


@query("f11_threshold_sweep", """
SELECT thr, series, count(*) AS n_runs FROM (
  SELECT thr, series, isl FROM (
    SELECT thr, series, k, k - row_number() OVER (PARTITION BY thr, series ORDER BY k) AS isl
    FROM ex, (SELECT unnest([1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.0])::DOUBLE AS thr) WHERE gti AND excess >= thr)
  GROUP BY thr, series, isl HAVING count(*) >= 2) GROUP BY 1, 2""", "ex")
def _(t):
    steps = F.array(*[F.lit(x) for x in SWEEP])
    ex = t.excess().filter(F.col("gti") & (F.col("excess") >= min(SWEEP)))
    hits = ex.select("series", "k", F.explode(F.filter(steps, lambda x: x <= F.col("excess"))).alias("thr"))
    found = V.persistence_runs(hits, ["thr", "series"], "k", F.lit(True), MIN_RUN, GRID_CHUNK)
    return found.groupBy("thr", "series").agg(F.count("*").alias("n_runs"))


_CHAIN = ("ex", "runs", "merged", "run_rows", "maxima", "spaced", "prominent", "peaks", "bounds", "refined", "events_found")


def copy_chain(prefix, settings):
    """The views from excess to events once more, over ``<prefix>_ex``, with other constants: (old, new) per view."""
    for name in _CHAIN[1:]:
        needs, text = CTES[name]
        for old, new in settings.get(name, ()):
            if old not in text:
                raise ValueError(f"view {name} has no {old!r}")
            text = text.replace(old, new)
        text = re.sub(r"(?<=FROM |JOIN )(" + "|".join(_CHAIN) + r")\b(?! AS)", rf"{prefix}_\1", text)
        text = re.sub(rf"(?<=JOIN ){prefix}_ex\s+ON\s+ex\.", f"{prefix}_ex ex ON ex.", text)
        CTES[f"{prefix}_{name}"] = (" ".join(f"{prefix}_{n}" if n in _CHAIN else n for n in needs.split()), text)


CTES["sweep_ex"] = ("ex", f"SELECT ex.* REPLACE (thr || '@' || series AS series), thr FROM ex, (SELECT unnest({list(SWEEP)})::DOUBLE AS thr)")
copy_chain("sweep", {"runs": [("excess >= 2.0", "excess >= thr")]})


@query("f11b_swept_events", """
SELECT split_part(series, '@', 1)::DOUBLE AS thr, split_part(series, '@', 2) AS series, start, stop, peak, duration FROM sweep_events_found""", "sweep_events_found")
def _(t):
    return swept(t, SWEEP).select("thr", "series", "start", F.col("end").alias("stop"), "peak", "duration")


@query("f12_linked_clusters", "SELECT det_id, anchor FROM linked", "linked")
def _(t):
    return V.link_clusters(t.det(), [], "peak_t", "det_id", LINK_WINDOW, MAX_SPAN, EVENT_CHUNK).select("det_id", "anchor")


@query("f13_master_events", """
SELECT anchor, master_peak, master_start, master_end, n_detectors, n_members, detectors,
  array_to_string(member_peaks, ',') AS member_peaks, max_significance, peak_rate_max, round(confidence, 8) AS confidence
FROM master JOIN confidence USING (anchor)""", "master confidence")
def _(t):
    members = F.flatten(F.zip_with("member_peaks", "member_counts", lambda p, n: F.array_repeat(p.cast("string"), n.cast("int"))))
    rows = t.master().withColumn("member_peaks", F.array_join(members, ",")).drop("member_counts")
    return rows.withColumn("confidence", F.round("confidence", 8))


def with_status(t):
    rows = near_any_member(t.master(), t.flare(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "in_main")
    rows = near_any_member(rows, t.flare2(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "in_broad")
    status = F.when(F.col("in_main"), "CONFIRMED").when(F.col("in_broad"), "SUB-THRESHOLD").otherwise("CANDIDATE-NOVEL")
    return rows.withColumn("status", status)


@query("f14_three_way_status", """
WITH m AS (SELECT anchor, n_detectors, unnest(member_peaks) AS p FROM master),
s AS (SELECT anchor, n_detectors, bool_or(EXISTS (SELECT 1 FROM flare f WHERE f.peak_t BETWEEN p-180 AND p+180)) AS a,
        bool_or(EXISTS (SELECT 1 FROM flare2 f WHERE f.peak_t BETWEEN p-180 AND p+180)) AS b FROM m GROUP BY 1, 2)
SELECT CASE WHEN a THEN 'CONFIRMED' WHEN b THEN 'SUB-THRESHOLD' ELSE 'CANDIDATE-NOVEL' END AS status,
  count(*) AS n, count(*) FILTER (n_detectors=1) AS n_single, count(*) FILTER (n_detectors>1) AS n_multi
FROM s GROUP BY 1""", "master flare flare2")
def _(t):
    return with_status(t).groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_detectors") == 1).alias("n_single"),
        F.count_if(F.col("n_detectors") > 1).alias("n_multi"),
    )


@query("f15_cluster_diagnostics", """
SELECT n_detectors, count(*) AS n, max(master_end-master_start) AS max_duration,
  max(list_max(member_peaks)-list_min(member_peaks)) AS max_peak_span,
  count(*) FILTER (list_max(member_peaks)-list_min(member_peaks) > 240) AS n_span_violations,
  max(n_members) AS members_max, round(avg(n_members), 9) AS members_mean FROM master GROUP BY 1""", "master")
def _(t):
    span = F.array_max("member_peaks") - F.array_min("member_peaks")
    return t.master().groupBy("n_detectors").agg(
        F.count("*").alias("n"), F.max(F.col("master_end") - F.col("master_start")).alias("max_duration"),
        F.max(span).alias("max_peak_span"), F.count_if(span > MAX_SPAN).alias("n_span_violations"),
        F.max("n_members").alias("members_max"), F.round(F.avg("n_members"), 9).alias("members_mean"),
    )


# The same detection at its own settings: 60 cells of excess, links of 120, peaks 300 apart, valleys and
# pre-event levels within 1,800, on the 30-second grid of the background queries.
FULL = {"min_run": 60, "link_gap": 120, "edge": 1800, "sep": 300, "prominence": 1.0, "pre": 1800, "min_duration": 60}
CTES["full_ex"] = ("held_smooth", f"""
  SELECT detector AS series, k, rate, gti, round(smoothed, 7) AS smoothed, round(level, 7) AS background, round((smoothed-level)/sqrt(greatest(level, 1)), 7) AS excess
  FROM (SELECT *, {LEVEL_SQL.format(q=0.1)} AS level FROM (SELECT *, CASE WHEN gti THEN smoothed END AS quiet FROM held_smooth) {WINDOWS_SQL})""")
copy_chain("full", {
    "runs": [("HAVING count(*) >= 2", f"HAVING count(*) >= {FULL['min_run']}")], "merged": [("<= 2\n", f"<= {FULL['link_gap']}\n")],
    "spaced": [("< 3)", f"< {FULL['sep']})")], "bounds": [("peak-12", f"peak-{FULL['edge']}"), ("peak+12", f"peak+{FULL['edge']}")],
    "refined": [("peak-3)", f"peak-{FULL['sep']})"), ("peak+3)", f"peak+{FULL['sep']})")],
    "events_found": [("r.start-12", f"r.start-{FULL['pre']}"), (">= 2\n", f">= {FULL['min_duration']}\n")],
})


@query("f10b_detect_full_settings", """
SELECT series, start, stop, peak, round(peak_rate, 5) AS peak_rate, round(preflare_bg, 5) AS preflare_bg, round(max_significance, 5) AS max_significance FROM full_events_found""", "full_events_found")
def _(t):
    ex = R.compute_excess(held(t), ["detector"], "k", "rate", "gti", FULL_CHUNK).withColumnRenamed("detector", "series")
    ex = stage_table(ex.withColumns({c: F.round(c, 7) for c in ("smoothed", "background", "excess")}))
    found = V.detect_from_excess(ex, D, "k", "rate", "gti", [THRESHOLD], size=FULL_CHUNK, **FULL)
    return found.select("series", "start", F.col("end").alias("stop"), "peak", *[F.round(c, 5).alias(c) for c in ("peak_rate", "preflare_bg", "max_significance")])
