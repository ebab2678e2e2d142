"""Queries: sources, scans and sinks (section A). Files are first derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.functions.scalars import day_key, utc_of
from chronoflux.operators import labels as L
from chronoflux.plans.q_joins import OBS, observations
from chronoflux.plans.q_labels import minutes
from chronoflux.plans.registry import query
from chronoflux.session import scratch_folder
from chronoflux.sources import files as S

DAY_SQL = "strftime(make_timestamp(k*3600*1000000), '%Y%m%d')"


def day_grid(t):
    return t.grid().withColumn("day", day_key(F.col("k") * 3600))


@query("a1_partitioned_parquet", f"""
SELECT detector, k, round(rate, 9) AS rate FROM grid WHERE {DAY_SQL} BETWEEN '20240105' AND '20240111'""", "grid")
def _(t):
    path = scratch_folder(t.spark) + "/days"
    S.write_days(day_grid(t).withColumn("day", F.concat(F.lit("d"), "day")), path)
    days = F.col("day").between("d20240105", "d20240111")
    return S.read_days(t.spark, path, ["detector", "k", "rate"], days).withColumn("rate", F.round("rate", 9))


def archive(t):
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("obs_"), k, F.lit(".zip"))).when(kind == 1, F.concat(F.lit("obs_"), k, F.lit(" (1).zip")))
        .when(kind == 2, F.concat(F.lit("lc_"), k, F.lit(".fits"))).when(kind == 3, F.concat(F.lit("lc_"), k, F.lit(".fits.gz")))
        .when(kind == 4, F.concat(F.lit("gti_"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("README_"), k))
    )
    return t.read("orders").select("o_orderkey", name.alias("name"), F.floor("o_totalprice").cast("bigint").alias("size"))


@query("a2_archive_inventory", """
SELECT (['.zip','.zip','.fits','.fits.gz','.txt',''])[o_orderkey%6+1] AS extension, count(*) FILTER (o_orderkey%6<>1) AS n_files,
  CAST(coalesce(sum(floor(o_totalprice)) FILTER (o_orderkey%6<>1), 0) AS BIGINT) AS n_bytes, count(*) FILTER (o_orderkey%6=1) AS n_copies
FROM orders GROUP BY 1""")
def _(t):
    return S.inventory(archive(t), "name", "size")


@query("a2b_listed_files", f"SELECT DISTINCT 'day=d' || {DAY_SQL} AS folder, '.parquet' AS extension, TRUE AS has_bytes FROM grid", "grid")
def _(t):
    """The files of a written table, found again by listing its folders."""
    path = scratch_folder(t.spark) + "/days"
    S.write_days(day_grid(t).withColumn("day", F.concat(F.lit("d"), "day")), path)
    files = S.list_files(t.spark, path).filter(F.col("folder").startswith("day="))
    kinds = files.select("folder", S.extension("name").alias("extension"), "size").groupBy("folder", "extension")
    return kinds.agg((F.sum("size") > 0).alias("has_bytes"))


@query("a3b_daily_discovery", """
SELECT DISTINCT CAST(make_timestamp(t//86400*86400*1000000) AS DATE)::VARCHAR AS date, 'AL1_SLX_L1_' || strftime(make_timestamp(t*1000000), '%Y%m%d') || '_v1.' || version || '.zip' AS name
FROM (SELECT t, max(event_id%3) OVER (PARTITION BY t//86400) AS version FROM ev)""", "ev")
def _(t):
    stamp = F.concat(F.lit("AL1_SLX_L1_"), day_key("t"), F.lit("_v1."), (F.col("event_id") % 3).cast("string"), F.lit(".zip"))
    names = t.ev().select(F.explode(F.array(stamp, F.concat(F.lit("copy_of_"), stamp))).alias("name"))
    return S.discover_days(names, "name").select(F.col("date").cast("string").alias("date"), "name")


@query("a3_observation_discovery", f"""
WITH {OBS}, n AS (SELECT *, end_t-start_t AS dur FROM obs WHERE obs_id%10<>0)
SELECT start_t, duration_s, version FROM (SELECT start_t, dur AS duration_s, version,
  row_number() OVER (PARTITION BY start_t ORDER BY version DESC, dur::VARCHAR||'sec' DESC) AS rn FROM n) WHERE rn=1""")
def _(t):
    start = utc_of("start_t")
    name = F.concat(
        F.lit("HLS_"), F.date_format(start, "yyyyMMdd_HHmmss"), F.lit("_"), (F.col("end_t") - F.col("start_t")).cast("string"),
        F.lit("sec_lev1_V"), F.format_string("%03d", "version"), F.lit(".zip"),
    )
    files = observations(t).select(F.when(F.col("obs_id") % 10 == 0, F.lit("notes.zip")).otherwise(name).alias("name"))
    return S.discover(files, "name").select("start_t", "duration_s", "version")


@query("a4_event_csv", """
SELECT strftime(make_timestamp(peak_t*1000000), '%Y-%m-%d %H:%M:%S') AS peak, letter, CASE WHEN flare_id%7<>0 THEN round(mag, 2) END AS mag,
  end_t-start_t AS duration_seconds, CASE WHEN flare_id%4<>0 THEN flare_id%9000 END AS noaa_ar
FROM (SELECT * REPLACE (CASE WHEN flare_id%7<>0 THEN letter END AS letter) FROM flare) WHERE flare_id%5<>0""", "flare", "noaa_ar")
def _(t):
    path = scratch_folder(t.spark) + "/events"
    def stamp(c):
        return F.date_format(utc_of(c), "yyyy-MM-dd'T'HH:mm:ss")
    i = F.col("flare_id")
    raw = t.flare().select(
        stamp("start_t").alias("event_starttime"), F.when(i % 5 == 0, "unknown").otherwise(stamp("peak_t")).alias("event_peaktime"),
        stamp("end_t").alias("event_endtime"),
        F.when(i % 7 == 0, F.lit("?")).otherwise(F.concat(F.lower("letter"), F.round("mag", 2).cast("string"))).alias("fl_goescls"),
        F.lit("1e-5").alias("fl_peakflux"), F.when(i % 4 == 0, "none").otherwise((i % 9000).cast("string")).alias("ar_noaanum"),
        F.lit("12.5").alias("hgc_x"), F.lit("bad").alias("hgc_y"),
    )
    S.write_csv(raw, path)
    out = S.read_events(t.spark, path, S.BROAD_NAMES)
    return out.select(
        F.date_format("peak_utc", "yyyy-MM-dd HH:mm:ss").alias("peak"), F.col("goes_class_letter").alias("letter"),
        F.col("goes_class_magnitude").alias("mag"), "duration_seconds", "noaa_ar",
    )


@query("a4b_authoritative_csv", """
SELECT strftime(make_timestamp(peak_t*1000000), '%Y-%m-%d %H:%M:%S') AS peak, letter, round(mag, 2) AS mag, end_t-start_t AS duration_seconds,
  CASE WHEN flare_id%4<>0 THEN flare_id%9000 END AS noaa_ar, CASE WHEN flare_id%3<>0 THEN (flare_id%90)::DOUBLE END AS lat FROM flare""", "flare", "noaa_ar lat")
def _(t):
    path = scratch_folder(t.spark) + "/events"
    stamp = lambda c: F.date_format(utc_of(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    i = F.col("flare_id")
    raw = t.flare().select(
        stamp("start_t").alias("start"), stamp("peak_t").alias("peak"), stamp("end_t").alias("end"),
        F.concat("letter", F.round("mag", 2).cast("string")).alias("goes_class"), F.lit("1e-5").alias("peak_flux"),
        F.when(i % 4 != 0, (i % 9000).cast("string")).alias("noaa_ar"), F.lit("1").alias("lon"), F.when(i % 3 != 0, (i % 90).cast("string")).alias("lat"),
    )
    S.write_csv(raw, path)
    out = S.read_events(t.spark, path, S.AUTHORITATIVE_NAMES, drop_without_peak=False)
    return out.select(
        F.date_format("peak_utc", "yyyy-MM-dd HH:mm:ss").alias("peak"), F.col("goes_class_letter").alias("letter"),
        F.col("goes_class_magnitude").alias("mag"), "duration_seconds", "noaa_ar", "lat",
    )


@query("a5_index_csv", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(avg(value), 3) AS v FROM events GROUP BY 1)
SELECT date, n::DOUBLE AS ssn, v AS std, v AS observed_flux FROM d WHERE date BETWEEN '2024-01-05' AND '2024-01-20'""")
def _(t):
    root = scratch_folder(t.spark)
    day = F.to_date(utc_of("t"))
    daily = t.ev().groupBy(day.alias("d")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("v"))
    daily.select(
        F.year("d"), F.format_string("%02d", F.month("d")), F.format_string("%02d", F.dayofmonth("d")), F.lit(2024.5),
        F.format_string("%5d", "n"), "v", F.lit(10), F.lit(1),
    ).write.option("sep", ";").csv(root + "/ssn")
    daily.select((F.unix_date("d") + 2440587.5).alias("jd"), F.col("v").alias("o"), F.col("v").alias("a")).write.option("header", "true").csv(root + "/f107")
    ssn = S.read_sunspots(t.spark, root + "/ssn", "2024-01-05", "2024-01-20")
    flux = S.read_radio_flux(t.spark, root + "/f107", "2024-01-05", "2024-01-20")
    return ssn.join(flux, "date").select(F.col("date").cast("string").alias("date"), "ssn", "std", "observed_flux")


@query("a6_region_reports", """
SELECT strftime(make_timestamp(peak_t*1000000), '%Y-%m-%d') AS date, 10000+flare_id%3000 AS noaa_ar,
  CASE WHEN flare_id%2=0 THEN 1.0 ELSE -1.0 END*(flare_id%80) AS lat_hg, CASE WHEN flare_id%3=0 THEN 1.0 ELSE -1.0 END*(flare_id%70) AS lon_hg,
  flare_id%500 AS area_millionths, 1+flare_id%20 AS num_spots, CASE WHEN flare_id%5=0 THEN '' ELSE 'Beta-Gamma' END AS mag_class
FROM flare WHERE flare_id%7<>0""", "flare")
def _(t):
    i = F.col("flare_id")
    row = F.concat_ws(
        " ", (10000 + i % 3000).cast("string"),
        F.concat(F.when(i % 2 == 0, "N").otherwise("S"), F.format_string("%02d", i % 80), F.when(i % 3 == 0, "W").otherwise("E"), F.format_string("%02d", i % 70)),
        F.lit("123"), F.when(i % 7 == 0, "n/a").otherwise((i % 500).cast("string")), F.lit("Dso"), F.lit("5"), (1 + i % 20).cast("string"),
        F.when(i % 5 != 0, "Beta-Gamma"),
    )
    head = ":Product: Daily Summary\nI.  Regions with Sunspots.  Locations Valid at 2400Z\nNmbr Location  Lo  Area  Z   LL   NN Mag Type\n"
    tail = "\nIA. H-alpha Plages without Spots.\nNmbr  Location  Lo\n9999 N10W10 100 10 Axx 1 1 Alpha\nII. Regions Due to Return\n"
    # Ten minutes per report keep each text small.
    docs = t.flare().groupBy(day_key("peak_t").alias("day"), F.floor(F.col("peak_t") / 600)).agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    docs = docs.select(F.concat("day", F.lit("SRS.txt")).alias("name"), F.concat(F.lit(head), "body", F.lit(tail)).alias("content"))
    out = S.parse_reports(docs)
    return out.select(F.col("date").cast("string").alias("date"), "noaa_ar", "lat_hg", "lon_hg", "area_millionths", "num_spots", "mag_class")


@query("a7_json_export", f"""
SELECT {DAY_SQL} || '-' || detector AS day, count(*) AS n_points, count(rate) AS n_seen, round(sum(round(rate, 9)), 5) AS total FROM grid GROUP BY 1""", "grid")
def _(t):
    path = scratch_folder(t.spark) + "/json"
    S.write_json(S.day_documents(day_grid(t).withColumn("day", F.concat_ws("-", "day", "detector")), "day", "k", ["rate"], 9), path)
    back = t.spark.read.schema("day string, n_points bigint, points array<struct<k:bigint,rate:double>>").json(path)
    rates = F.filter("points.rate", lambda x: x.isNotNull())
    return back.select("day", "n_points", F.size(rates).cast("bigint").alias("n_seen"),
                       F.round(F.aggregate(rates, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("a8_csv_sink", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t):
    path = scratch_folder(t.spark) + "/csv"
    S.write_csv(t.read("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path)
    return t.spark.read.option("header", "true").schema("o_orderpriority string, n bigint, total double").csv(path)


@query("a9_idempotent_build", f"""
SELECT 'd' || {DAY_SQL} AS day, CASE WHEN {DAY_SQL} <= '20240110' THEN 'first' ELSE 'second' END AS pass, count(*) AS n FROM grid GROUP BY 1, 2""", "grid")
def _(t):
    path = scratch_folder(t.spark) + "/built"
    rows = day_grid(t).withColumn("day", F.concat(F.lit("d"), "day"))
    S.write_days(rows.filter("day <= 'd20240110'").withColumn("pass", F.lit("first")), path)
    S.build_missing(rows.withColumn("pass", F.lit("second")), path)
    return t.spark.read.parquet(path).groupBy("day", "pass").agg(F.count("*").alias("n"))


@query("a10_build_report", """
WITH o AS (SELECT strftime(make_timestamp(m*60*1000000), '%Y%m%d') AS day, * FROM own)
SELECT coalesce(day, 'total') AS day, count(*) AS n_rows, CAST(sum(hit::INT) AS BIGINT) AS flare_rows, count(DISTINCT owner_id) AS n_events,
  count(*) FILTER (owner_letter='B') AS n_b, count(*) FILTER (owner_letter='C') AS n_c, count(*) FILTER (owner_letter='M') AS n_m,
  count(*) FILTER (owner_letter='X') AS n_x FROM o GROUP BY GROUPING SETS ((day), ())""", "own")
def _(t):
    rows = L.active_events(minutes(t), t.flare(), "m", 60).withColumn("day", day_key(F.col("m") * 60))
    return S.build_report(rows, "day", "is_flare", "owner_id", "owner_letter").withColumn("day", F.coalesce("day", F.lit("total")))
