"""Queries: scalar functions (section S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.functions import scalars as S
from chronoflux.plans.registry import query


@query("s1_mjd_to_unix", """
SELECT event_id, round((40587 + t/86400.0 - 40587)*86400, 3) AS unix_t FROM ev""", "ev")
def _(t):
    mjd = F.lit(40587) + F.col("t") / 86400.0
    return t.ev().select("event_id", F.round(S.mjd_to_unix(mjd), 3).alias("unix_t"))


@query("s2_j2000_to_timestamp", """
SELECT event_id, strftime(make_timestamp(t*1000000), '%Y-%m-%d %H:%M:%S') AS utc FROM ev""", "ev")
def _(t):
    ts = S.j2000_to_timestamp(F.col("t") - 946728000)
    return t.ev().select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("s3_day_parts", """
SELECT event_id, t AS unix_t, t%86400 AS sod, t//86400 AS day_no, strftime(make_timestamp(t*1000000), '%Y%m%d') AS day FROM ev""", "ev")
def _(t):
    return t.ev().select(
        "event_id", S.unix_of(S.utc_of("t")).alias("unix_t"), S.second_of_day("t").alias("sod"),
        S.day_index("t").alias("day_no"), S.day_key("t").alias("day"),
    )


@query("s4_julian_to_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def _(t):
    jd = S.day_index(S.unix_of("o_orderdate")) + F.lit(2440587.5) + F.lit(0.25)
    return t.read("orders").select("o_orderkey", S.julian_to_date(jd).cast("string").alias("day"))


def class_text():
    letter = F.element_at(F.array(*[F.lit(x) for x in ("b", "C", "M", "X", "Q", "")]), (F.col("event_id") % 6 + 1).cast("int"))
    number = F.when(F.col("event_id") % 11 == 0, "1.2.3").otherwise(F.format_string("%.1f", F.col("event_id") % 97 / 10))
    return F.when(F.col("event_id") % 13 == 0, None).otherwise(F.concat(letter, number))


CLASS_SQL = """
WITH c AS (SELECT event_id, CASE WHEN event_id%13=0 THEN NULL ELSE
    (['b','C','M','X','Q',''])[event_id%6+1] ||
    CASE WHEN event_id%11=0 THEN '1.2.3' ELSE format('{:.1f}', (event_id%97)/10.0) END END AS txt FROM ev),
m AS (SELECT event_id, txt, CASE WHEN regexp_matches(txt, '(?i)^[BCMX][0-9.]+$') THEN TRY_CAST(substr(txt, 2) AS DOUBLE) END AS mag FROM c)
"""


@query("s5_class_parse", CLASS_SQL + """
SELECT event_id, CASE WHEN mag IS NOT NULL THEN upper(substr(txt, 1, 1)) END AS letter, mag FROM m""", "ev")
def _(t):
    rows = t.ev().withColumn("txt", class_text())
    return rows.select("event_id", S.class_letter("txt").alias("letter"), S.class_magnitude("txt").alias("mag"))


@query("s6_class_rank", CLASS_SQL + """
, l AS (SELECT event_id, CASE WHEN mag IS NOT NULL THEN upper(substr(txt, 1, 1)) END AS letter FROM m)
SELECT event_id, coalesce(CAST(position(letter IN 'BCMX') AS INTEGER), 0) AS rnk, letter FROM l""", "ev")
def _(t):
    rows = t.ev().withColumn("txt", class_text()).withColumn("rnk", S.class_rank(S.class_letter("txt")))
    return rows.select("event_id", F.col("rnk").cast("int").alias("rnk"), S.rank_letter("rnk").alias("letter"))


@query("s7_location_parse", """
SELECT c_custkey, CASE WHEN c_custkey%10=0 THEN NULL WHEN c_custkey%2=0 THEN 1.0 ELSE -1.0 END*(c_custkey%90) AS lat,
  CASE WHEN c_custkey%10=0 THEN NULL WHEN c_custkey%3=0 THEN 1.0 ELSE -1.0 END*(c_custkey%70) AS lon FROM customer""")
def _(t):
    k = F.col("c_custkey")
    text = F.concat(
        F.when(k % 2 == 0, "N").otherwise("S"), F.format_string("%02d", k % 90),
        F.when(k % 3 == 0, "W").otherwise("E"), F.format_string("%02d", k % 70),
    )
    text = F.when(k % 10 == 0, F.lit("unknown")).otherwise(text)
    return t.read("customer").select("c_custkey", S.latitude(text).alias("lat"), S.longitude(text).alias("lon"))


@query("s8_json_round", """
SELECT event_id, CASE WHEN event_id%7=0 OR value=0 THEN NULL ELSE round(ln(value)/3, 4) END AS v FROM ev""", "ev")
def _(t):
    bad = F.when(F.col("event_id") % 14 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf"))
    v = F.coalesce(bad, F.log("value") / 3)
    return t.ev().select("event_id", S.json_round(v, 4).alias("v"))


@query("s9_geometric_grid", """
WITH b AS (SELECT event_type, min(value)+1 AS lo, max(value)+2 AS hi FROM ev GROUP BY 1)
SELECT event_type, i, round(lo*exp(i/47.0*ln(hi/lo)), 8) AS x FROM b, (SELECT unnest(range(48)) AS i)""", "ev")
def _(t):
    b = t.ev().groupBy("event_type").agg((F.min("value") + 1).alias("lo"), (F.max("value") + 2).alias("hi"))
    return b.select("event_type", F.posexplode(S.geometric_grid(F.col("lo"), F.col("hi"), 48)).alias("i", "x")).select(
        "event_type", F.col("i").cast("bigint").alias("i"), F.round("x", 8).alias("x")
    )


@query("s10_day_key_to_date", """
SELECT DISTINCT strftime(make_timestamp(t*1000000), '%Y%m%d') AS day, strftime(make_timestamp(t*1000000), '%Y-%m-%d') AS iso FROM ev""", "ev")
def _(t):
    days = t.ev().select(S.day_key("t").alias("day")).distinct()
    return days.select("day", S.day_key_to_date("day").cast("string").alias("iso"))


@query("s11_satellite_number", """
SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN NULL ELSE 10+p_partkey%9 END AS satellite FROM part""", nullable="satellite")
def _(t):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.lit("notes.txt")).otherwise(F.format_string("sci_xrsf-l2-avg1m_g%d_d20240101_v2.nc", k % 9 + 10))
    return t.read("part").select("p_partkey", S.satellite_number(name).alias("satellite"))


@query("s12_human_bytes", """
WITH b AS (SELECT o_orderkey, floor(CAST(o_totalprice AS DOUBLE)*pow(10, o_orderkey%12-3)) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n<1024 THEN format('{:.1f} B', n) WHEN n/1024<1024 THEN format('{:.1f} KB', n/1024)
 WHEN n/1048576<1024 THEN format('{:.1f} MB', n/1048576) WHEN n/1073741824<1024 THEN format('{:.1f} GB', n/1073741824)
 WHEN n/1099511627776<1024 THEN format('{:.1f} TB', n/1099511627776) ELSE format('{:.1f} PB', n/1125899906842624) END AS size
FROM b""")
def _(t):
    n = F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 12 - 3)
    rows = t.read("orders").select("o_orderkey", F.floor(n).cast("double").alias("n"))  # sizes are whole bytes
    return rows.select("o_orderkey", S.human_bytes("n").alias("size"))
