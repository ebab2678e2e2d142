"""Queries: coverage, data quality and leakage audits (sections I and J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoflux.functions.scalars import floor_div, unix_of
from chronoflux.operators import audit as A
from chronoflux.operators.rolling import trailing_stats
from chronoflux.operators.timeline import exact_quantiles, with_frames
from chronoflux.plans.registry import query
from chronoflux.plans.tables import CTES, GRID_CHUNK

CTES["obs_raw"] = ("", """SELECT o_orderkey AS obs_id, epoch_us(o_orderdate)//1000000 + (o_orderkey*7919)%86400 AS start_t,
  epoch_us(o_orderdate)//1000000 + (o_orderkey*7919)%86400 + (o_orderkey*104729)%20000 AS end_t, o_custkey FROM orders""")
CTES["pieces_d"] = ("obs_raw", """SELECT obs_id, day_no, greatest(start_t, day_no*86400) AS s, least(end_t, (day_no+1)*86400) AS e FROM (
  SELECT *, unnest(range(start_t//86400, (end_t-1)//86400+1)) AS day_no FROM obs_raw WHERE end_t > start_t)""")
CTES["coverage"] = ("pieces_d", "SELECT day_no, count(*) AS n_obs, CAST(sum(e-s) AS BIGINT) AS seconds, least(1.0, sum(e-s)/86400.0)::DOUBLE AS fraction FROM pieces_d GROUP BY 1")
CTES["spans"] = ("pieces_d", """SELECT day_no, min(s) AS span_start, max(e) AS span_end FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY day_no ORDER BY s) AS g FROM (
    SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY day_no ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 60 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT day_no, s, max(e) AS e FROM pieces_d GROUP BY 1, 2))) GROUP BY day_no, g""")
CTES["missing_d"] = ("pieces_d", """SELECT day_no FROM (SELECT unnest(range((SELECT min(day_no) FROM pieces_d), (SELECT max(day_no)+1 FROM pieces_d))) AS day_no)
  WHERE day_no NOT IN (SELECT day_no FROM pieces_d)""")


CTES["flare_days"] = ("", "SELECT DISTINCT d + d//5*3 AS day_no FROM (SELECT epoch_us(o_orderdate)//86400000000 AS d FROM orders)")


def raw_obs(t):
    """The orders as observations of up to five and a half hours."""
    k = F.col("o_orderkey")
    start = unix_of("o_orderdate") + (k * 7919) % 86400
    rows = t.read("orders")
    return rows.select(k.alias("obs_id"), start.alias("start_t"), (start + (k * 104729) % 20000).alias("end_t"), "o_custkey")


def pieces(t):
    return A.day_pieces(raw_obs(t), "start_t", "end_t").select("obs_id", "day_no", "s", "e")


@query("i1_split_at_midnight", "SELECT day_no, n_obs, seconds, round(fraction, 9) AS fraction FROM coverage", "coverage")
def _(t):
    return A.day_coverage(pieces(t)).withColumn("fraction", F.round("fraction", 9))


@query("i2_merged_spans", """
SELECT day_no, string_agg(strftime(make_timestamp(span_start*1000000), '%H:%M') || '-' || strftime(make_timestamp(span_end*1000000), '%H:%M'), '; ' ORDER BY span_start) AS time_spans
FROM spans GROUP BY 1""", "spans")
def _(t):
    return A.span_list(A.merged_spans(pieces(t)))


@query("i3_missing_parts", """
SELECT day_no, gap_start, gap_end FROM (
  SELECT day_no, coalesce(lag(span_end) OVER (PARTITION BY day_no ORDER BY span_start), day_no*86400) AS gap_start, span_start AS gap_end FROM spans
  UNION ALL SELECT day_no, max(span_end), (day_no+1)*86400 FROM spans GROUP BY 1) WHERE gap_end-gap_start > 300""", "spans")
def _(t):
    return A.missing_parts(A.merged_spans(pieces(t)))


OTHER = "SELECT DISTINCT epoch_us(l_shipdate)//86400000000 AS day_no FROM lineitem"


def other_days(t):
    return t.read("lineitem").select(floor_div(unix_of("l_shipdate"), 86400).alias("day_no")).distinct()


@query("i4_day_status", f"""
WITH o AS ({OTHER}), al AS (SELECT day_no FROM coverage UNION ALL SELECT day_no FROM o),
d AS (SELECT unnest(range((SELECT min(day_no) FROM al), (SELECT max(day_no)+1 FROM al))) AS day_no)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN c.n_obs IS NOT NULL AND c.fraction>=0.9 THEN 'FULL' WHEN c.n_obs IS NOT NULL AND c.fraction>0 THEN 'PARTIAL'
  WHEN o.day_no IS NOT NULL AND c.n_obs IS NULL THEN 'MISSING' WHEN c.n_obs IS NOT NULL AND o.day_no IS NULL THEN 'NO_SOLEXS' ELSE 'NEITHER' END AS status
  FROM d LEFT JOIN coverage c USING (day_no) LEFT JOIN o ON o.day_no=d.day_no) GROUP BY 1""", "coverage")
def _(t):
    return A.day_status(A.day_coverage(pieces(t)), other_days(t)).groupBy("status").agg(F.count("*").alias("n"))


@query("i5_missing_day_runs", """
WITH b AS (SELECT day_no FROM flare_days), m AS (SELECT unnest(range((SELECT min(day_no) FROM b), (SELECT max(day_no)+1 FROM b))) AS day_no)
SELECT min(day_no) AS run_start, max(day_no) AS run_end, count(*) AS length FROM (
  SELECT day_no, day_no-row_number() OVER (ORDER BY day_no) AS g FROM m WHERE day_no NOT IN (SELECT day_no FROM b)) GROUP BY g""", "flare_days")
def _(t):
    day = floor_div(unix_of("o_orderdate"), 86400)  # three days without data after each five
    days = t.read("orders").select((day + floor_div(day, 5) * 3).alias("day_no"))
    return A.day_runs(A.missing_days(days))


@query("i6_coverage_manifest", """
WITH a AS (SELECT DISTINCT t//86400+(t//86400%4=0)::INT AS day_no FROM sample WHERE detector='click'),
b AS (SELECT DISTINCT t//86400+(t//86400%5=0)::INT AS day_no FROM sample WHERE detector='view'),
g AS (SELECT k//24 AS day_no, count(*) AS n_rows, count(DISTINCT detector) FILTER (gti AND rate>=75) AS n_det,
   count(*) FILTER (gti AND detector='click')*3600 AS soft_gti, count(*) FILTER (gti AND detector<>'click')*3600 AS hard_gti FROM grid GROUP BY 1)
SELECT day_no, (a.day_no IS NOT NULL)::INT AS has_soft, (b.day_no IS NOT NULL)::INT AS has_hard, n_rows, n_det, soft_gti, hard_gti,
  CASE WHEN g.day_no%3<>0 AND n_det<5 THEN 'partial_coverage_'||n_det||'of5_detectors' WHEN g.day_no%3<>0 THEN ''
   WHEN a.day_no IS NOT NULL AND b.day_no IS NOT NULL THEN 'build_missing' WHEN a.day_no IS NOT NULL THEN 'solexs_only' WHEN b.day_no IS NOT NULL THEN 'hel1os_only' ELSE 'no_raw_data' END AS notes
FROM g LEFT JOIN a USING (day_no) LEFT JOIN b USING (day_no)""", "sample grid")
def _(t):
    def days(d, every, flag):
        # raw data of every ``every``-th day stands under the day after it, which leaves days without
        day = floor_div("t", 86400)
        rows = t.sample().filter(F.col("detector") == d).select((day + (day % every == 0).cast("int")).alias("day_no"))
        return rows.distinct().withColumn(flag, F.lit(True))
    cell = F.col("gti")
    g = t.grid().groupBy(floor_div("k", 24).alias("day_no"), "detector").agg(
        F.count("*").alias("r"), F.bool_or(cell & (F.col("rate") >= 75)).alias("p"), (F.count_if(cell) * 3600).alias("s")
    ).groupBy("day_no").agg(
        F.sum("r").alias("n_rows"), F.count_if("p").alias("n_det"),
        F.sum(F.when(F.col("detector") == "click", F.col("s")).otherwise(0)).alias("soft_gti"),
        F.sum(F.when(F.col("detector") != "click", F.col("s")).otherwise(0)).alias("hard_gti"),
    )
    rows = g.join(days("click", 4, "a"), "day_no", "left").join(days("view", 5, "b"), "day_no", "left").fillna(False, ["a", "b"])
    note = A.coverage_note(F.col("a"), F.col("b"), F.col("day_no") % 3 != 0, F.col("n_det"))
    return rows.select("day_no", F.col("a").cast("int").alias("has_soft"), F.col("b").cast("int").alias("has_hard"), "n_rows", "n_det", "soft_gti", "hard_gti", note.alias("notes"))


@query("i7_gti_statistics", """
SELECT o_custkey, count(*) AS n, CAST(sum(end_t-start_t) AS BIGINT) AS good_time, max(end_t)-min(start_t) AS elapsed, max(end_t-start_t) AS longest,
  min(end_t-start_t) AS shortest, round(sum(end_t-start_t)/nullif(max(end_t)-min(start_t), 0)::DOUBLE, 9) AS duty_cycle FROM obs_raw GROUP BY 1""", "obs_raw")
def _(t):
    return A.gti_statistics(raw_obs(t), ["o_custkey"], "start_t", "end_t").withColumn("duty_cycle", F.round("duty_cycle", 9))


@query("i8_histogram", """
WITH s AS (SELECT detector, min(rate) AS lo, max(rate) AS hi, quantile_cont(rate, 0.5) AS med FROM sample GROUP BY 1),
h AS (SELECT detector, least(floor((rate-lo)/((hi-lo)/10)), 9)::INT AS bin, count(*) AS n FROM sample JOIN s USING (detector) GROUP BY 1, 2)
SELECT s.detector, b.bin, s.lo, s.hi, round(s.med, 9) AS median, coalesce(h.n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(10))::INT AS bin) b
LEFT JOIN h ON h.detector=s.detector AND h.bin=b.bin""", "sample")
def _(t):
    rows = t.sample()
    med = exact_quantiles(rows, ["detector"], "rate", [0.5]).select("detector", F.round("quantile", 9).alias("median"))
    return A.equal_width_histogram(rows, ["detector"], "rate").join(med, "detector").select("detector", "bin", "lo", "hi", "median", "n")


@query("i9_anomalies", """
SELECT o_orderkey, reason FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice<2000 THEN 'zero_size' END, CASE WHEN o_orderkey%97=0 THEN 'zero_exposure' END,
  CASE WHEN o_custkey>o_orderkey THEN 'start_after_stop' END, CASE WHEN o_orderstatus='P' AND o_orderkey%50=0 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS reason FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    return A.anomalies(t.read("orders"), {
        "zero_size": F.col("o_totalprice") < 2000, "zero_exposure": k % 97 == 0, "start_after_stop": F.col("o_custkey") > k,
        "duplicate": (F.col("o_orderstatus") == "P") & (k % 50 == 0),
    }, "o_orderkey")


@query("i10_file_type_presence", """
SELECT types, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct, count(*) FILTER (has_a) AS n_with_a, CAST(sum(sz) AS BIGINT) AS total_size FROM (
  SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS types, bool_or(l_returnflag='A') AS has_a, sum(CAST(l_quantity AS BIGINT)) AS sz
  FROM lineitem GROUP BY 1) GROUP BY 1""")
def _(t):
    files = t.read("lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("size"))
    per = A.file_type_presence(files, "l_orderkey", "l_returnflag", "size", ["A", "N", "R"])
    out = per.groupBy("types").agg(F.count("*").alias("n"), F.count_if("has_A").alias("n_with_a"), F.sum("total_size").alias("total_size"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return out.select("types", "n", F.round(100.0 * F.col("n") / total, 6).alias("pct"), "n_with_a", "total_size")


@query("i11_series_summary", """
SELECT detector, count(*) AS n, count(rate) AS n_seen, count(*) FILTER (rate<>0) AS n_nonzero, round(min(rate), 9) AS low, round(max(rate), 9) AS high,
  round(avg(rate), 8) AS mean, min(k) AS first_t, max(k) AS last_t, round(quantile_cont(rate, 0.5), 8) AS median FROM grid GROUP BY 1""", "grid")
def _(t):
    out = A.series_summary(t.grid(), ["detector"], "k", "rate")
    return out.withColumns({"low": F.round("low", 9), "high": F.round("high", 9), "mean": F.round("mean", 8), "median": F.round("median", 8)})


@query("i12_well_covered_days", """
SELECT detector, count(*) FILTER (share>=0.9) AS n_days, count(*) AS n_total, round(any_value(med), 8) AS quiet_median FROM (
  SELECT detector, k//24 AS d, avg(gti::INT) AS share FROM grid GROUP BY 1, 2) JOIN (
  SELECT detector, quantile_cont(rate, 0.5) AS med FROM grid WHERE k//24 NOT IN (SELECT peak_t//86400 FROM flare WHERE letter='X') GROUP BY 1) USING (detector) GROUP BY 1""", "grid flare")
def _(t):
    rows = t.grid().withColumn("d", floor_div("k", 24))
    busy = t.flare().filter("letter = 'X'").select(floor_div("peak_t", 86400).alias("d")).distinct()
    med = exact_quantiles(rows.join(busy, "d", "left_anti"), ["detector"], "rate", [0.5])
    return A.well_covered_days(rows, ["detector"], "d", "gti").join(med, "detector").select(
        "detector", "n_days", "n_total", F.round("quantile", 8).alias("quiet_median"))


@query("i13_peak_lags", """
WITH p AS (SELECT f.flare_id, g.detector, arg_max(g.k, [g.rate, -g.k]) AS pos FROM flare f JOIN grid g ON g.k BETWEEN f.peak_t//3600-6 AND f.peak_t//3600+6
  WHERE f.letter='X' AND g.rate IS NOT NULL AND g.detector IN ('click','view') GROUP BY 1, 2)
SELECT a.flare_id, b.pos-a.pos AS lag, (b.pos>=a.pos)::INT AS ordered, (abs(b.pos-a.pos)<=3)::INT AS near FROM p a JOIN p b USING (flare_id) WHERE a.detector='click' AND b.detector='view'""", "flare grid")
def _(t):
    at = floor_div("peak_t", 3600)
    ev = t.flare().filter("letter = 'X'").select("flare_id", (at - 6).alias("lo"), (at + 6).alias("hi"))
    peaks = A.peak_lags(ev, t.grid().filter("detector IN ('click', 'view')"), "flare_id", "lo", "hi", "k", "detector", "rate", 12)
    wide = peaks.groupBy("flare_id").pivot("detector", ["click", "view"]).agg(F.first("peak_pos")).dropna()
    lag = F.col("view") - F.col("click")
    return wide.select("flare_id", lag.alias("lag"), (lag >= 0).cast("int").alias("ordered"), (F.abs(lag) <= 3).cast("int").alias("near"))


@query("i14_table_summary", """
WITH s AS (SELECT o_orderkey, epoch_us(o_orderdate)//1000000 AS t, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority FROM orders)
SELECT name, n_rows, first_t, last_t, n_null, n_distinct FROM (
  SELECT 'status' AS name, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t, count(*)-count(status) AS n_null, count(DISTINCT status) AS n_distinct FROM s
  UNION ALL SELECT 'priority', count(*), min(t), max(t), count(*)-count(priority), count(DISTINCT priority) FROM s)""")
def _(t):
    rows = t.read("orders").select(unix_of("o_orderdate").alias("t"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return A.table_summary(rows, "t", ["status", "priority"])


@query("i15_background_sanity", """
SELECT series, round(min(background), 8) AS floor, round(quantile_cont(background, 0.5) FILTER (NOT coalesce(excess>=2.5, FALSE)), 8) AS quiet_level,
  round(max(background) FILTER (excess>=2.5), 8) AS event_level, round(max(excess) FILTER (excess>=2.5), 8) AS event_excess FROM ex GROUP BY 1""", "ex")
def _(t):
    event = F.coalesce(F.col("excess") >= 2.5, F.lit(False))
    out = A.background_sanity(t.excess(), ["series"], "k", event, 6)
    return out.select("series", *[F.round(c, 8).alias(c) for c in ("floor", "quiet_level", "event_level", "event_excess")])


# --- leakage ------------------------------------------------------------------------
FEATS = ("mean_6", "std_6", "max_6")
CTES["feat"] = ("grid", """
  SELECT detector, k, rate, CASE WHEN count(rate) OVER w>=3 THEN avg(rate) OVER w END AS mean_6, CASE WHEN count(rate) OVER w>=3 THEN stddev_samp(rate) OVER w END AS std_6,
    CASE WHEN count(rate) OVER w>=3 THEN max(rate) OVER w END AS max_6, CASE WHEN lead(rate) OVER (PARTITION BY detector ORDER BY k) >= 80 THEN 1.0 ELSE 0.0 END AS y
  FROM grid WINDOW w AS (PARTITION BY detector ORDER BY k ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")


def features(t):
    rows = trailing_stats(t.grid(), ["detector"], "k", "rate", {"6": 6}, GRID_CHUNK)
    return with_frames(rows, ["detector"], "k", {"y": lambda w: F.when(F.lead("rate").over(w) >= 80, 1.0).otherwise(0.0)}, 0, 1, GRID_CHUNK)


@query("j1_trailing_recheck", "SELECT detector, count(*) AS n, count(*) AS n_same FROM grid GROUP BY 1", "grid")
def _(t):
    out = A.trailing_recheck(features(t), t.grid(), ["detector"], "k", "rate", "mean_6", 6, 3, 24)
    return out.groupBy("detector").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))


@query("j2_change_share", "SELECT feature, round(share, 9) AS share FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(({f} IS DISTINCT FROM p_{f})::INT) AS share FROM s WHERE has" for f in FEATS).join(
    ("WITH s AS (SELECT *, lag(k) OVER w IS NOT NULL AS has, " + ", ".join(f"lag({f}) OVER w AS p_{f}" for f in FEATS)
     + " FROM (SELECT detector, k, round(mean_6, 8) AS mean_6, round(std_6, 8) AS std_6, max_6 FROM feat) WINDOW w AS (PARTITION BY detector ORDER BY k)) ", ")")), "feat")
def _(t):
    rows = features(t).withColumns({"mean_6": F.round("mean_6", 8), "std_6": F.round("std_6", 8)})
    return A.change_share(rows, ["detector"], "k", FEATS, GRID_CHUNK).withColumn("share", F.round("share", 9))


@query("j3_target_correlation", "SELECT feature, round(r, 7) AS r, (r>0.9)::INT AS suspicious FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({f}, y)) AS r FROM feat" for f in FEATS) + ")", "feat")
def _(t):
    out = A.target_correlations(features(t), FEATS, "y")
    return out.select("feature", F.round("r", 7).alias("r"), F.col("suspicious").cast("int").alias("suspicious"))


@query("j4_gap_rule", """
SELECT count(*) FILTER (mean_6 IS NULL AND std_6 IS NOT NULL) AS n_broken, round(avg((mean_6 IS NULL)::INT), 9) AS null_share, count(*) AS n FROM feat""", "feat")
def _(t):
    return A.gap_rule(features(t), "mean_6", "std_6").withColumn("null_share", F.round("null_share", 9))
