"""Queries: joins and matching (section C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoflux.functions.scalars import floor_div, unix_of
from chronoflux.operators import joins as J
from chronoflux.operators import matching as M
from chronoflux.operators.timeline import asof
from chronoflux.plans.registry import query
from chronoflux.plans.tables import EVENT_CHUNK, MATCH_TOL


def observations(t):
    """Observations from orders: start within the order day, up to two days long, with versions."""
    k = F.col("o_orderkey")
    start = unix_of("o_orderdate") + (k * 7919) % 86400
    return t.read("orders").select(
        k.alias("obs_id"), start.alias("start_t"), (start + (k * 104729) % 172800).alias("end_t"), (k % 3 + 1).alias("version")
    )


OBS = """obs AS (SELECT o_orderkey AS obs_id, epoch_us(o_orderdate)//1000000 + (o_orderkey*7919)%86400 AS start_t,
  epoch_us(o_orderdate)//1000000 + (o_orderkey*7919)%86400 + (o_orderkey*104729)%172800 AS end_t, o_orderkey%3+1 AS version FROM orders)"""


@query("c1_overlap_days", f"""
WITH {OBS}, days AS (SELECT unnest(range((SELECT min(start_t)//86400 FROM obs), (SELECT max(end_t)//86400+1 FROM obs))) AS day_no)
SELECT day_no, count(*) AS n_obs, CAST(sum(least(end_t, (day_no+1)*86400)-greatest(start_t, day_no*86400)) AS BIGINT) AS seconds
FROM obs JOIN days ON start_t < (day_no+1)*86400 AND end_t > day_no*86400 GROUP BY 1""")
def _(t):
    day = F.col("day_no") * 86400
    rows = J.overlap_days(observations(t), "start_t", "end_t")
    part = F.least(F.col("end_t"), day + 86400) - F.greatest(F.col("start_t"), day)
    return rows.groupBy("day_no").agg(F.count("*").alias("n_obs"), F.sum(part).alias("seconds"))


def daily_events(t):
    return t.ev().groupBy(floor_div("t", 86400).alias("day_no")).agg(
        F.count("*").alias("n_events"), F.round(F.sum("value"), 6).alias("total_value")
    )


DAILY = "daily AS (SELECT t//86400 AS day_no, count(*) AS n_events, round(sum(value), 6) AS total_value FROM ev GROUP BY 1)"


@query("c2_daily_outer_join", f"""
WITH {DAILY}, o AS (SELECT epoch_us(o_orderdate)//86400000000 + 8766 - 2000 AS day_no, avg(o_totalprice) AS f107 FROM orders GROUP BY 1)
SELECT day_no, n_events, total_value, round(f107, 6) AS f107 FROM daily FULL JOIN o USING (day_no)""", "ev", "n_events")
def _(t):
    # Shifted so that the two calendars overlap in part.
    orders = t.read("orders").select((floor_div(unix_of("o_orderdate"), 86400) + 6766).alias("day_no"), F.col("o_totalprice").alias("f107"))
    return J.merge_daily(daily_events(t), orders, "day_no", ["f107"]).withColumn("f107", F.round("f107", 6))


@query("c3_minute_context", """
WITH g AS (SELECT t//60 AS m, arg_max(value, t*100000000+event_id) AS flux FROM ev WHERE event_type='view' GROUP BY 1)
SELECT e.event_id, g.flux FROM ev e LEFT JOIN g ON e.t//60 = g.m WHERE e.event_type='click'""", "ev")
def _(t):
    context = t.ev().filter("event_type = 'view'").select("t", "event_id", F.col("value").alias("flux"))
    rows = t.ev().filter("event_type = 'click'").select("event_id", "t")
    return J.minute_context(rows, context, "t", ["flux"], "event_id").select("event_id", "flux")


@query("c4_day_context", f"""
WITH {DAILY} SELECT event_id, n_events, total_value FROM ev LEFT JOIN daily ON ev.t//86400 = daily.day_no""", "ev")
def _(t):
    return J.day_context(t.ev().select("event_id", "t"), daily_events(t), "t", ["n_events", "total_value"]).drop("t")


@query("c5_lagged_day_context", f"""
WITH {DAILY} SELECT event_id, n_events, total_value FROM ev LEFT JOIN daily ON ev.t//86400 = daily.day_no+1""", "ev", "n_events")
def _(t):
    return J.day_context(t.ev().select("event_id", "t"), daily_events(t), "t", ["n_events", "total_value"], 1).drop("t")


@query("c6_asof_backward", """
WITH m AS (SELECT peak_t, arg_max(flare_id, flare_id) AS flare_id, arg_max(mag, flare_id) AS mag FROM flare GROUP BY 1)
SELECT e.event_id, m.flare_id, m.mag, e.t-m.peak_t AS age FROM ev e ASOF LEFT JOIN m ON e.t >= m.peak_t""", "ev flare", "flare_id age")
def _(t):
    rows = asof(t.ev().select("event_id", "t"), t.flare(), [], "t", "peak_t", ["flare_id", "mag", "peak_t"], EVENT_CHUNK,
                order=["flare_id"])
    return rows.select("event_id", "flare_id", "mag", (F.col("t") - F.col("peak_t")).alias("age"))


@query("c7_asof_forward", """
WITH m AS (SELECT peak_t, min(flare_id) AS flare_id FROM flare GROUP BY 1)
SELECT e.event_id, CASE WHEN m.peak_t-e.t <= 21600 THEN m.flare_id END AS flare_id,
  CASE WHEN m.peak_t-e.t <= 21600 THEN m.peak_t-e.t END AS wait FROM ev e ASOF LEFT JOIN m ON e.t < m.peak_t""", "ev flare", "flare_id wait")
def _(t):
    rows = asof(t.ev().select("event_id", "t"), t.flare(), [], "t", "peak_t", ["flare_id", "peak_t"], EVENT_CHUNK,
                "forward", strict=True, order=["flare_id"])
    wait = F.col("peak_t") - F.col("t")
    return rows.select("event_id", F.when(wait <= 21600, F.col("flare_id")).alias("flare_id"), F.when(wait <= 21600, wait).alias("wait"))


GREEDY = """
WITH cat AS (SELECT t, sum(nd) AS nd, sum(nc) AS nc FROM (SELECT peak_t AS t, 1 AS nd, 0 AS nc FROM det_other
              UNION ALL SELECT peak_t, 0, 1 FROM flare) GROUP BY t),
isl AS (SELECT *, sum(fresh) OVER (ORDER BY t) AS island FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t) <= 180 THEN 0 ELSE 1 END AS fresh FROM cat)),
d AS (SELECT island, list({'t': t, 'n': nd, 'u': 0::BIGINT} ORDER BY t) AS ds FROM isl WHERE nd > 0 GROUP BY 1),
c AS (SELECT island, t, unnest(range(nc::BIGINT)) AS j FROM isl WHERE nc > 0),
steps AS (SELECT c.island, list_concat([{'ds': coalesce(any_value(d.ds), []), 'c': NULL::BIGINT, 'hits': []::BIGINT[]}],
    list({'ds': []::STRUCT(t BIGINT, n HUGEINT, u BIGINT)[], 'c': c.t, 'hits': []::BIGINT[]} ORDER BY c.t)) AS xs
  FROM c LEFT JOIN d USING (island) GROUP BY 1),
folded AS (SELECT island, list_reduce(xs, lambda acc, x: {
    'ds': list_transform(acc.ds, lambda q: {'t': q.t, 'n': q.n, 'u': q.u + CASE WHEN q.t = list_min(list_transform(
        list_filter(acc.ds, lambda z: z.u < z.n AND abs(z.t - x.c) <= 180), lambda z: {'a': abs(z.t - x.c), 't': z.t})).t THEN 1 ELSE 0 END}),
    'c': x.c, 'hits': list_concat(acc.hits, [CASE WHEN len(list_filter(acc.ds, lambda z: z.u < z.n AND abs(z.t - x.c) <= 180)) > 0
        THEN 1 ELSE 0 END::BIGINT])}) AS f FROM steps)
"""


def greedy(t):
    return M.greedy_match(t.det_other(), t.flare(), [], "peak_t", "peak_t", MATCH_TOL, EVENT_CHUNK)


@query("c8_greedy_match_counts", GREEDY + """
SELECT CAST(sum(list_sum(f.hits)) AS BIGINT) AS tp,
  (SELECT count(*) FROM det_other) - CAST(sum(list_sum(f.hits)) AS BIGINT) AS fp,
  (SELECT count(*) FROM flare) - CAST(sum(list_sum(f.hits)) AS BIGINT) AS fn FROM folded""", "det_other flare")
def _(t):
    return M.match_counts(greedy(t), [])


@query("c8b_greedy_match_rows", GREEDY + """,
times AS (SELECT island, list(t ORDER BY t) AS ts FROM c GROUP BY 1),
cats AS (SELECT unnest(ts) AS t, unnest(f.hits) AS hit FROM folded JOIN times USING (island)),
dets AS (SELECT q.t, q.u FROM (SELECT unnest(f.ds) AS q FROM folded))
SELECT 'cat' AS side, t, count(*) AS n, CAST(sum(hit) AS BIGINT) AS matched FROM cats GROUP BY t
UNION ALL SELECT 'det', t, CAST(nd AS BIGINT), coalesce(u, 0) FROM isl LEFT JOIN dets USING (t) WHERE nd > 0""", "det_other flare")
def _(t):
    return greedy(t)


@query("c9_member_match", """
SELECT anchor, bool_or(EXISTS (SELECT 1 FROM flare2 f WHERE f.peak_t BETWEEN p-180 AND p+180))::INTEGER AS matched
FROM (SELECT anchor, unnest(member_peaks) AS p FROM master) GROUP BY 1""", "master flare2")
def _(t):
    rows = t.master().select("anchor", "member_peaks")
    out = M.near_any_member(rows, t.flare2(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "hit")
    return out.select("anchor", F.col("hit").cast("int").alias("matched"))


@query("c10_nearest_within", """
SELECT d.det_id, arg_min(f.letter, abs(f.peak_t-d.peak_t)*1e12+f.peak_t*100+f.flare_id/1e9) AS letter,
  CAST(min(abs(f.peak_t-d.peak_t)) AS BIGINT) AS dt
FROM det_other d LEFT JOIN (SELECT peak_t, min(flare_id) AS flare_id, arg_min(letter, flare_id) AS letter FROM flare GROUP BY 1) f
  ON f.peak_t BETWEEN d.peak_t-180 AND d.peak_t+180 GROUP BY 1""", "det_other flare", "dt")
def _(t):
    rows = t.det_other().select("det_id", "peak_t")
    cat = t.flare().select(F.col("peak_t").alias("c_t"), "letter", "flare_id")
    out = M.nearest_within(rows, cat, [], "peak_t", "c_t", ["letter"], MATCH_TOL, EVENT_CHUNK, ["flare_id"])
    return out.select("det_id", F.col("m_letter").alias("letter"), F.abs(F.col("m_c_t") - F.col("peak_t")).alias("dt"))


@query("c11_first_within", """
SELECT d.det_id, min(f.peak_t) AS first_peak FROM det_other d LEFT JOIN flare f
  ON f.peak_t BETWEEN d.peak_t-180 AND d.peak_t+180 GROUP BY 1""", "det_other flare", "first_peak")
def _(t):
    rows = t.det_other().select("det_id", "peak_t")
    cat = t.flare().select(F.col("peak_t").alias("c_t"), "flare_id")
    out = M.first_within(rows, cat, [], "peak_t", "c_t", [], MATCH_TOL, EVENT_CHUNK, ["flare_id"])
    return out.select("det_id", F.col("m_c_t").alias("first_peak"))


@query("c12_nearest_row", """
WITH v AS (SELECT t, min(event_id) AS event_id FROM ev WHERE event_type='view' GROUP BY 1),
b AS (SELECT f.flare_id, f.peak_t, v.t AS bt, v.event_id AS bid FROM flare f ASOF LEFT JOIN v ON f.peak_t >= v.t),
a AS (SELECT f.flare_id, v.t AS ft, v.event_id AS fid FROM flare f ASOF LEFT JOIN v ON f.peak_t <= v.t)
SELECT flare_id, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR peak_t-bt <= ft-peak_t) THEN bid ELSE fid END AS event_id
FROM b JOIN a USING (flare_id)""", "ev flare")
def _(t):
    views = t.ev().filter("event_type = 'view'").select("t", "event_id")
    out = J.nearest_row(views, t.flare().select("flare_id", "peak_t"), "t", "peak_t", ["event_id"], EVENT_CHUNK, ["event_id"])
    return out.select("flare_id", F.col("near_event_id").alias("event_id"))


@query("c13_observable_events", """
SELECT f.flare_id FROM flare f SEMI JOIN (SELECT k FROM grid10 WHERE gti AND detector<>'error') g ON f.peak_t//600 = g.k""", "flare grid10")
def _(t):
    good = t.grid(600).filter("gti AND detector <> 'error'").select("k")
    return t.flare().withColumn("k", floor_div("peak_t", 600)).join(good, "k", "left_semi").select("flare_id")


@query("c14_candidate_novel", """
SELECT anchor, n_members FROM master WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(member_peaks) AS p) m,
  (SELECT peak_t FROM flare UNION ALL SELECT peak_t FROM flare2) f WHERE f.peak_t BETWEEN m.p-180 AND m.p+180)""", "master flare flare2")
def _(t):
    known = t.flare().select("peak_t").unionByName(t.flare2().select("peak_t"))
    rows = t.master().select("anchor", "n_members", "member_peaks")
    out = M.near_any_member(rows, known, ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "hit")
    return out.filter(~F.col("hit")).select("anchor", "n_members")


@query("c15_day_set_algebra", """
WITH a AS (SELECT DISTINCT peak_t//86400 AS d FROM flare WHERE letter='X'), b AS (SELECT DISTINCT peak_t//86400 AS d FROM flare2)
SELECT 'both' AS kind, d AS day_no FROM (SELECT d FROM a INTERSECT SELECT d FROM b)
UNION ALL SELECT 'either', d FROM (SELECT d FROM a UNION SELECT d FROM b)
UNION ALL SELECT 'second_only', d FROM (SELECT d FROM b EXCEPT SELECT d FROM a)""", "flare flare2")
def _(t):
    a = t.flare().filter("letter = 'X'").select(floor_div("peak_t", 86400).alias("day_no"))
    b = t.flare2().select(floor_div("peak_t", 86400).alias("day_no"))
    def kind(name, df):
        return df.select(F.lit(name).alias("kind"), "day_no")
    return (
        kind("both", a.intersect(b)).unionByName(kind("either", a.union(b).distinct()))
        .unionByName(kind("second_only", b.subtract(a)))
    )


@query("c16_pair_correlation", """
WITH p AS (SELECT k, max(rate) FILTER (detector='click') AS x, max(rate) FILTER (detector='view') AS y FROM grid GROUP BY k)
SELECT count(*) AS n_common, round(corr(x, y), 8) AS correlation FROM p WHERE x IS NOT NULL AND y IS NOT NULL""", "grid")
def _(t):
    g = t.grid()
    x = g.filter("detector = 'click'").select("k", F.col("rate").alias("x"))
    y = g.filter("detector = 'view'").select("k", F.col("rate").alias("y"))
    return J.correlate_pairs(x, y, ["k"], "x", "y").withColumn("correlation", F.round("correlation", 8))
