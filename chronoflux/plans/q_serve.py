"""Queries: serving (section K) and streaming (section T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.functions.scalars import day_key, floor_div, utc_of
from chronoflux.operators import matching as M
from chronoflux.operators import serve as V
from chronoflux.operators import skill as K
from chronoflux.operators.matching import first_within
from chronoflux.plans.q_skill import ALL_EVENTS, COUNTS_SQL, EXPLAINED, SCORE_SQL, explained, observed_days
from chronoflux.plans.registry import query
from chronoflux.plans.tables import CTES, EVENT_CHUNK, MATCH_TOL
from chronoflux.session import scratch_folder
from chronoflux.sources.files import write_json
from chronoflux.streaming import jobs

WATCH, WARNING = 0.45, 0.60

CTES["cat_rows"] = ("master flare flare2", """
  SELECT m.anchor, m.master_peak AS peak, m.n_detectors, list_contains(string_split(detectors, ','), 'click')::INT AS saturation_flag,
    CASE WHEN EXISTS (SELECT 1 FROM flare f WHERE abs(f.peak_t-master_peak)<=180) THEN 'confirmed'
         WHEN EXISTS (SELECT 1 FROM flare2 f WHERE abs(f.peak_t-master_peak)<=180) THEN 'sub_threshold' ELSE 'candidate_novel' END AS status,
    (SELECT arg_min(f.letter, f.peak_t*10000000+f.flare_id) FROM flare f WHERE abs(f.peak_t-master_peak)<=180) AS goes_class FROM master m""")


def catalogue(t):
    """Master events with the median-peak status of the serving layer."""
    rows = t.master().withColumnRenamed("master_peak", "peak")
    cat = t.flare().select(F.col("peak_t").alias("c_t"), "letter", "flare_id")
    rows = first_within(rows, cat, [], "peak", "c_t", ["letter"], MATCH_TOL, EVENT_CHUNK, ["flare_id"], prefix="a_")
    broad = t.flare2().select(F.col("peak_t").alias("c_t"), "flare_id")
    rows = first_within(rows, broad, [], "peak", "c_t", [], MATCH_TOL, EVENT_CHUNK, ["flare_id"], prefix="b_")
    status = F.when(F.col("a_c_t").isNotNull(), "confirmed").when(F.col("b_c_t").isNotNull(), "sub_threshold").otherwise("candidate_novel")
    return rows.select("anchor", "peak", "n_detectors", V.has_member("detectors", "click").cast("int").alias("saturation_flag"),
                       status.alias("status"), F.col("a_letter").alias("goes_class"))


@query("k1_catalogue_page", """
SELECT c.anchor, c.peak, c.n_detectors, c.saturation_flag, c.goes_class, x.total, greatest(1, (x.total+49)//50) AS n_pages
FROM (SELECT * FROM cat_rows WHERE status='confirmed' ORDER BY peak DESC, anchor LIMIT 50 OFFSET 50) c, (SELECT count(*) AS total FROM cat_rows WHERE status='confirmed') x""", "cat_rows")
def _(t):
    page = V.catalogue_page(catalogue(t), "peak", "anchor", 2, 50, status="confirmed")
    return page.select("anchor", "peak", "n_detectors", "saturation_flag", "goes_class", "total", "n_pages")


@query("k1b_status_counts", "SELECT status, count(*) AS n FROM cat_rows GROUP BY 1", "cat_rows")
def _(t):
    return V.status_counts(catalogue(t))


def tiers(t):
    s = F.col("max_significance")
    rows = t.det_other().withColumn("regime", F.when(s >= 16, "classic").when(s >= 11, "intermediate").otherwise("short"))
    cat = t.flare().select(F.col("peak_t").alias("c_t"), "letter", "flare_id")
    return first_within(rows, cat, [], "peak_t", "c_t", ["letter"], MATCH_TOL, EVENT_CHUNK, ["flare_id"], prefix="").drop("c_t")


@query("k2_tier_and_class_query", """
SELECT det_id, regime FROM (SELECT det_id, CASE WHEN max_significance>=16 THEN 'classic' WHEN max_significance>=11 THEN 'intermediate' ELSE 'short' END AS regime,
  EXISTS (SELECT 1 FROM flare f WHERE abs(f.peak_t-d.peak_t)<=180) AS has_class FROM det_other d) WHERE regime='intermediate' AND NOT has_class""", "det_other flare")
def _(t):
    return V.by_tier_and_class(tiers(t), "intermediate", "none").select("det_id", "regime")


@query("k3_latest_alerts", "SELECT event_id, t, p FROM pred WHERE p>=0.45 ORDER BY t DESC, event_id LIMIT 20", "pred")
def _(t):
    return V.latest(t.pred().filter(F.col("p") >= WATCH).select("event_id", "t", "p"), "t", 20, ["event_id"])


LEAD15 = """
l AS (SELECT f.flare_id, f.peak_t, strftime(make_timestamp(f.peak_t*1000000), '%Y%m%d') AS day, bool_or(p.t IS NOT NULL) AS cov, min(p.t) FILTER (p.p>=0.6) AS first
  FROM flare f LEFT JOIN pred p ON p.t BETWEEN f.peak_t-900 AND f.peak_t GROUP BY 1, 2)"""


def lead15(t):
    rows = K.lead_times(t.flare().select("flare_id", "peak_t"), t.pred().select("t", "p"), "peak_t", "t", "p", {"w": WARNING}, 900, 900, EVENT_CHUNK)
    return V.bounded_leads(rows, "lead_w", "coverage").withColumn("day", day_key("peak_t"))


@query("k4_replay_days", f"""
WITH {LEAD15}, s AS (SELECT day, count(DISTINCT t//60) AS n_points FROM pred GROUP BY 1)
SELECT s.day, s.n_points, coalesce(x.n, 0)::INT AS n_flares, coalesce(d.n, 0)::INT AS n_detections, coalesce(x.fl, 0)::INT AS n_flagged, coalesce(x.nc, 0)::INT AS n_no_coverage
FROM s LEFT JOIN (SELECT day, count(*) AS n, count(first) AS fl, count(*) FILTER (first IS NULL AND NOT cov) AS nc FROM l GROUP BY 1) x USING (day)
LEFT JOIN (SELECT strftime(make_timestamp(master_peak*1000000), '%Y%m%d') AS day, count(*) AS n FROM master GROUP BY 1) d USING (day)""", "pred flare master")
def _(t):
    flares = t.flare().select(day_key("peak_t").alias("day"), "peak_t", "letter", "flare_id")
    found = t.master().select(day_key("master_peak").alias("day"), F.col("master_peak").alias("t"), "n_detectors", "detectors", "confidence")
    leads = lead15(t).select("day", "peak_t", "lead_w", "flagged", "reason", "flare_id")
    # Minute means bound the series of a day to 1,440 points.
    series = t.pred().groupBy("day", (floor_div("t", 60) * 60).alias("t")).agg(F.avg("p").alias("p"))
    parts = {"series": series, "flares": flares.withColumnRenamed("peak_t", "t"), "detections": found, "lead_times": leads.withColumnRenamed("peak_t", "t")}
    chunks, manifest = V.replay_days(parts, "day", "t", 3600, ["series"])
    leads_of = chunks.groupBy("day").agg(
        F.sum(F.size(F.filter("lead_times", lambda x: x["flagged"]))).alias("n_flagged"),
        F.sum(F.size(F.filter("lead_times", lambda x: x["reason"] == "no_coverage"))).alias("n_no_coverage"),
    )
    return manifest.join(leads_of, "day").select(
        "day", F.col("n_series").alias("n_points"), *[F.col(c).cast("int").alias(c) for c in ("n_flares", "n_detections", "n_flagged", "n_no_coverage")]
    )


@query("k5_day_manifest", """
SELECT day, coalesce(n, 0) AS n_flares, coalesce(x, FALSE)::INT AS has_x, coalesce(wa, 0) AS warning_minutes, coalesce(wt, 0) AS watch_minutes FROM
 (SELECT strftime(make_timestamp(peak_t*1000000), '%Y%m%d') AS day, count(*) AS n, bool_or(letter='X') AS x FROM flare GROUP BY 1)
 FULL JOIN (SELECT day, count(*) FILTER (p>=0.6) AS wa, count(*) FILTER (p>=0.45 AND p<0.6) AS wt FROM pred GROUP BY 1) USING (day)""", "flare pred")
def _(t):
    flares = t.flare().withColumn("day", day_key("peak_t"))
    return V.day_manifest(flares, t.pred(), "day", "p", WATCH, WARNING).withColumn("has_x", F.col("has_x").cast("int"))


@query("k6_snapshot", """
WITH n AS (SELECT t AS now FROM pred ORDER BY p DESC, t LIMIT 1)
SELECT now, detector, count(*) AS n, max(t) AS last_t FROM sample, n WHERE t > now-10800 AND t <= now GROUP BY 1, 2""", "pred sample")
def _(t):
    return V.snapshot(t.sample(), V.riskiest_time(t.pred(), "t", "p"), "t", "detector")


@query("k7_summary", """
SELECT (SELECT count(*) FROM master) AS n_master, (SELECT count(*) FROM flare) AS n_flares, (SELECT round(avg(y), 9) FROM pred) AS base_rate,
  (SELECT round(avg((p-y)*(p-y)), 9) FROM pred WHERE split='TEST') AS brier""", "master flare pred")
def _(t):
    path = scratch_folder(t.spark) + "/summary"
    parts = [
        t.master().agg(F.struct(F.count("*").alias("n_master")).alias("catalogue")),
        t.flare().agg(F.struct(F.count("*").alias("n_flares")).alias("events")),
        t.pred().agg(F.struct(F.round(F.avg("y"), 9).alias("base_rate"),
                              F.round(F.avg(F.when(F.col("split") == "TEST", (F.col("p") - F.col("y")) ** 2)), 9).alias("brier")).alias("forecast")),
    ]
    doc = parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))
    doc.write.mode("overwrite").json(path)
    back = t.spark.read.schema("catalogue struct<n_master:bigint>, events struct<n_flares:bigint>, forecast struct<base_rate:double,brier:double>").json(path)
    return back.select("catalogue.*", "events.*", "forecast.*")


@query("k7b_summary_artefact", f"""
WITH {ALL_EVENTS}, {EXPLAINED}, te AS (SELECT * FROM pred WHERE split='TEST'),
sk AS (SELECT {SCORE_SQL} FROM (SELECT {COUNTS_SQL} FROM (SELECT y=1 AS o, p>=0.45 AS p FROM te))),
bins AS (SELECT bin, avg(p) AS mp, avg(y) AS of, count(*) AS n FROM (SELECT *, least(floor(p*10), 9)::INT AS bin FROM te) GROUP BY 1),
cls AS (SELECT letter, count(*) FILTER (p>=0.45) AS hit, count(*) AS n FROM te WHERE y=1 AND letter IS NOT NULL GROUP BY 1),
c AS (SELECT count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fn FROM events),
o AS (SELECT count(DISTINCT k)*600 AS gs FROM grid10 WHERE gti),
f AS (SELECT 'strict' AS kind, count(*) FILTER (NOT a) AS fp FROM known UNION ALL SELECT 'aware', count(*) FILTER (NOT a AND NOT b) FROM known),
det2 AS (SELECT kind, {SCORE_SQL} FROM (SELECT kind, tp, fp, fn, greatest(0, greatest(0, gs//360-(tp+fn))-fp) AS tn FROM c, o, f)),
facts AS (
  SELECT 'forecast.tp' AS fact, tp::DOUBLE AS value FROM sk UNION ALL SELECT 'forecast.tss', tss FROM sk UNION ALL SELECT 'forecast.hss', hss FROM sk
  UNION ALL SELECT 'baselines.climatology', avg(y) FROM pred WHERE split='TRAIN'
  UNION ALL SELECT 'calibration.brier', avg((p-y)*(p-y)) FROM te UNION ALL SELECT 'calibration.ece', sum(abs(of-mp)*n)/sum(n) FROM bins
  UNION ALL SELECT 'reliability.obs.' || b.bin, of FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN bins USING (bin)
  UNION ALL SELECT 'per_class.' || letter, hit/n FROM cls UNION ALL SELECT 'detection.' || kind, tss FROM det2
  UNION ALL SELECT 'operating_points.far_at_watch', count(*) FILTER (p>=0.45 AND y=0)/nullif(count(*) FILTER (p>=0.45), 0) FROM te
  UNION ALL SELECT 'operating_points.precision_at_warning', count(*) FILTER (p>=0.6 AND y=1)/nullif(count(*) FILTER (p>=0.6), 0) FROM te
  UNION ALL SELECT 'counts.n_master', count(*) FROM master UNION ALL SELECT 'counts.n_flares', count(*) FROM flare)
SELECT fact, round(value, 6) AS value FROM facts""", "pred det flare flare2 master grid10")
def _(t):
    path = scratch_folder(t.spark) + "/summary"
    counts = M.match_counts(M.greedy_match(t.det(), t.flare(), [], "peak_t", "peak_t", MATCH_TOL, EVENT_CHUNK), []).select("tp", "fn")
    detection = K.both_contingencies(counts, explained(t), "a", "b", observed_days(t))
    split = F.col("split")
    doc = V.summary_document(t.pred(), split == "TRAIN", split == "TEST", "p", "y", "letter", WATCH, WARNING,
                             {"n_master": t.master(), "n_flares": t.flare()}, detection)
    write_json(doc, path)
    back = t.spark.read.schema(doc.schema).json(path)
    value = lambda name: F.array(F.struct(F.lit(name).alias("fact"), F.col(name).cast("double").alias("value")))
    plain = ("forecast.tp", "forecast.tss", "forecast.hss", "baselines.climatology", "calibration.brier", "calibration.ece",
             "operating_points.far_at_watch", "operating_points.precision_at_warning", "counts.n_master", "counts.n_flares")
    listed = {"reliability": ("reliability.obs.", "bin", "obs"), "per_class": ("per_class.", "letter", "rate"), "detection": ("detection.", "kind", "tss")}

    def entries(column, prefix, label, number):
        return F.transform(column, lambda x: F.struct(F.concat(F.lit(prefix), x[label].cast("string")).alias("fact"), x[number].cast("double").alias("value")))

    lists = [entries(c, *names) for c, names in listed.items()]
    return back.select(F.inline(F.concat(*[value(n) for n in plain], *lists)))


@query("k8_set_operations", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT peak_t FROM flare UNION ALL SELECT peak_t FROM flare2)
UNION ALL SELECT 'intersect_days', count(*) FROM (SELECT peak_t//86400 FROM flare INTERSECT SELECT peak_t//86400 FROM flare2)
UNION ALL SELECT 'except_hours', count(*) FROM (SELECT peak_t//3600 FROM flare EXCEPT SELECT peak_t//3600 FROM flare2)
UNION ALL SELECT 'distinct_users', count(DISTINCT user_id) FROM ev""", "flare flare2 ev")
def _(t):
    a, b = t.flare().select("peak_t"), t.flare2().select("peak_t")
    def n(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    def cell(df, w):
        return df.select(floor_div("peak_t", w).alias("c"))
    return (
        n("union", a.unionByName(b)).unionByName(n("intersect_days", cell(a, 86400).intersect(cell(b, 86400))))
        .unionByName(n("except_hours", cell(a, 3600).subtract(cell(b, 3600))))
        .unionByName(n("distinct_users", t.ev().dropDuplicates(["user_id"])))
    )


def records(t):
    i = F.col("event_id")
    return t.pred().select(
        "event_id", F.when(i % 17 == 0, F.lit(1.5)).otherwise(F.col("p")).alias("probability_15m"),
        F.when(i % 19 == 0, F.lit(None)).otherwise(F.col("p") * 0.9).alias("probability_30m"), (F.col("p") * 0.8).alias("probability_60m"),
        F.when(i % 3 == 0, "WATCH").alias("alert_level"), F.lit(None).cast("string").alias("source"),
    )


@query("k9_record_validation", """
SELECT event_id, CASE WHEN event_id%17=0 OR event_id%19=0 THEN 'rejected' WHEN event_id%3=0 THEN 'WATCH' ELSE 'ALL_CLEAR' END AS outcome FROM pred""", "pred")
def _(t):
    good, bad = V.valid_forecasts(records(t))
    return good.select("event_id", F.col("alert_level").alias("outcome")).unionByName(bad.select("event_id", F.lit("rejected").alias("outcome")))


@query("t1_streaming_decimation", """
SELECT event_type, t//600*600 AS bin_t, round(avg(value), 8) AS value, count(value) AS n FROM ev GROUP BY 1, 2""", "ev")
def _(t):
    root = scratch_folder(t.spark)
    src = t.ev().select(utc_of("t").alias("ts"), "event_type", "value")
    src.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(root + "/in")
    stream = jobs.sample_stream(t.spark, root + "/in", "ts timestamp, event_type string, value double")
    means = jobs.decimated(stream, "ts", ["event_type"], "value", "10 minutes")
    out = jobs.decimate_all(means, ["event_type"], "value", root + "/out", root + "/tail", root + "/ckpt")
    return out.withColumn("value", F.round("value", 8))


@query("t2_streaming_alert_feed", """
SELECT CASE WHEN event_id%17=0 OR event_id%19=0 THEN 'rejected' WHEN p>=0.6 THEN 'warning' WHEN p>=0.45 THEN 'watch' ELSE 'quiet' END AS level, count(*) AS n FROM pred GROUP BY 1""", "pred")
def _(t):
    root = scratch_folder(t.spark)
    rows = records(t)
    rows.write.parquet(root + "/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(root + "/in")
    jobs.run_alert_feed(stream, root + "/good", root + "/bad", root + "/ckpt", WATCH, WARNING).awaitTermination()
    good = t.spark.read.parquet(root + "/good").select(F.col("alert_level").alias("level"))
    bad = t.spark.read.parquet(root + "/bad").select(F.lit("rejected").alias("level"))
    return good.unionByName(bad).groupBy("level").agg(F.count("*").alias("n"))
