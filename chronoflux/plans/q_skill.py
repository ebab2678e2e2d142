"""Queries: skill, calibration and uncertainty (section H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoflux.functions.scalars import day_key, floor_div
from chronoflux.operators import matching as M
from chronoflux.operators import skill as K
from chronoflux.operators.rolling import persistence
from chronoflux.plans.registry import query
from chronoflux.plans.tables import CTES, EVENT_CHUNK, MATCH_TOL
from chronoflux.session import cut_lineage

WATCH, WARNING = 0.45, 0.60
DETS = ("click", "error", "purchase", "signup", "view")
SCORES = ("pod", "far", "pofd", "precision", "tss", "hss")

SCORE_SQL = """tp, fp, fn, tn,
  round(coalesce(tp::DOUBLE/nullif(tp+fn,0),0), 9) AS pod, round(coalesce(fp::DOUBLE/nullif(tp+fp,0),0), 9) AS far,
  round(coalesce(fp::DOUBLE/nullif(fp+tn,0),0), 9) AS pofd, round(coalesce(tp::DOUBLE/nullif(tp+fp,0),0), 9) AS "precision",
  round(coalesce(tp::DOUBLE/nullif(tp+fn,0),0)-coalesce(fp::DOUBLE/nullif(fp+tn,0),0), 9) AS tss,
  round(coalesce(2*(tp::DOUBLE*tn-fp::DOUBLE*fn)/nullif((tp+fn)::DOUBLE*(fn+tn)+(tp+fp)::DOUBLE*(fp+tn),0),0), 9) AS hss"""
COUNTS_SQL = """count(*) FILTER (o AND p) AS tp, count(*) FILTER (NOT o AND p) AS fp,
  count(*) FILTER (o AND NOT p) AS fn, count(*) FILTER (NOT o AND NOT p) AS tn"""

# 6-minute bins of the 10-minute grid would straddle; a bin here is one hour of six cells.
CTES["bins"] = ("grid10 flare det_other", """
    SELECT b.bin, b.bin//24 AS day_no, EXISTS (SELECT 1 FROM flare f WHERE f.peak_t//3600 = b.bin) AS obs,
      EXISTS (SELECT 1 FROM det_other d WHERE d.peak_t//3600 = b.bin) AS pred,
      b.bin - row_number() OVER (PARTITION BY b.bin//24 ORDER BY b.bin) AS seg
    FROM (SELECT k//6 AS bin FROM (SELECT DISTINCT k FROM grid10 WHERE gti) GROUP BY 1 HAVING count(*)*600/3600.0 > 0.5) b""")
CTES["bins_pers"] = ("bins", """
    SELECT *, coalesce(max(obs::INT) OVER (PARTITION BY day_no, seg ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)=1 AS p1,
      coalesce(max(obs::INT) OVER (PARTITION BY day_no, seg ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)=1 AS p5 FROM bins""")


def bins(t):
    good = t.grid(600).filter("gti").select((F.col("k") * 600).alias("t"))
    return K.score_bins(good, t.flare(), t.det_other(), "t", "peak_t", "peak_t", 3600, 600, None)


@query("h1_contingency", f"SELECT split, {COUNTS_SQL} FROM (SELECT split, y=1 AS o, p>=0.45 AS p FROM pred) GROUP BY 1", "pred")
def _(t):
    return K.contingency(t.pred(), ["split"], F.col("y") == 1, F.col("p") >= WATCH)


@query("h2_scores", f"""
SELECT day, {SCORE_SQL} FROM (SELECT day, {COUNTS_SQL} FROM (SELECT day, y=1 AS o, p>=0.45 AS p FROM pred) GROUP BY 1)""", "pred")
def _(t):
    return K.scores(K.contingency(t.pred(), ["day"], F.col("y") == 1, F.col("p") >= WATCH), 9)


def greedy_sql(det: str, cat: str) -> str:
    """Greedy matching per group g in SQL: ``det`` yields (g, t), ``cat`` (g, t, id, letter)."""
    return f"""
dd AS ({det}), cc AS ({cat}),
m AS (SELECT g, t, sum(nd) AS nd, sum(nc) AS nc FROM (SELECT g, t, 1 AS nd, 0 AS nc FROM dd UNION ALL SELECT g, t, 0, 1 FROM cc) GROUP BY g, t),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY g ORDER BY t) AS island FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY g ORDER BY t) <= 180 THEN 0 ELSE 1 END AS fresh FROM m)),
dl AS (SELECT g, island, list({{'t': t, 'n': nd, 'u': 0::BIGINT}} ORDER BY t) AS ds FROM isl WHERE nd > 0 GROUP BY 1, 2),
cl AS (SELECT g, island, t, unnest(range(nc::BIGINT)) AS j FROM isl WHERE nc > 0),
steps AS (SELECT cl.g, cl.island, list_concat([{{'ds': coalesce(any_value(dl.ds), []), 'c': NULL::BIGINT, 'hits': []::BIGINT[]}}],
    list({{'ds': []::STRUCT(t BIGINT, n HUGEINT, u BIGINT)[], 'c': cl.t, 'hits': []::BIGINT[]}} ORDER BY cl.t)) AS xs
  FROM cl LEFT JOIN dl USING (g, island) GROUP BY 1, 2),
folded AS (SELECT g, list_reduce(xs, lambda acc, x: {{
    'ds': list_transform(acc.ds, lambda q: {{'t': q.t, 'n': q.n, 'u': q.u + CASE WHEN q.t = list_min(list_transform(
        list_filter(acc.ds, lambda z: z.u < z.n AND abs(z.t - x.c) <= 180), lambda z: {{'a': abs(z.t - x.c), 't': z.t}})).t THEN 1 ELSE 0 END}}),
    'c': x.c, 'hits': list_concat(acc.hits, [CASE WHEN len(list_filter(acc.ds, lambda z: z.u < z.n AND abs(z.t - x.c) <= 180)) > 0
        THEN x.c ELSE -x.c END::BIGINT])}}) AS f FROM steps),
hits AS (SELECT g, abs(h) AS t, count(*) FILTER (h > 0) AS matched FROM (SELECT g, unnest(f.hits) AS h FROM folded) GROUP BY 1, 2),
events AS (SELECT c.*, coalesce(row_number() OVER (PARTITION BY c.g, c.t ORDER BY c.id) <= h.matched, FALSE) AS matched
  FROM cc c LEFT JOIN hits h ON h.g = c.g AND h.t = c.t)"""


ALL_CAT = "SELECT d.g, f.peak_t AS t, f.flare_id AS id, f.letter FROM flare f, (SELECT unnest(['click','error','purchase','signup','view']) AS g) d"
GTI_SQL = "SELECT detector, count(*)*600 AS gti_seconds FROM grid10 WHERE gti GROUP BY 1"


def per_detector(t):
    """Detections and the catalogue repeated for each of the five detectors."""
    cat = t.flare().withColumn("detector", F.explode(F.array(*[F.lit(d) for d in DETS])))
    return t.det(), cat


def gti_seconds(t):
    return t.grid(600).filter("gti").groupBy("detector").agg((F.count("*") * 600).alias("gti_seconds"))


@query("h3_event_contingency", f"""
WITH {greedy_sql("SELECT detector AS g, peak_t AS t FROM det", ALL_CAT)},
c AS (SELECT g, count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fn, count(*) AS n_cat FROM events GROUP BY 1),
f AS (SELECT c.*, (SELECT count(*) FROM dd WHERE dd.g=c.g)-tp AS fp, (SELECT gti_seconds FROM ({GTI_SQL}) q WHERE q.detector=c.g) AS gs FROM c)
SELECT g AS detector, {SCORE_SQL} FROM (SELECT *, greatest(0, greatest(0, gs//360-n_cat)-fp) AS tn FROM f)""", "det flare grid10")
def _(t):
    det, cat = per_detector(t)
    counts = M.match_counts(M.greedy_match(det, cat, ["detector"], "peak_t", "peak_t", MATCH_TOL, EVENT_CHUNK), ["detector"])
    rows = counts.join(gti_seconds(t), "detector")
    tn = K.true_negatives(F.col("gti_seconds"), F.col("tp") + F.col("fn"), F.col("fp"))
    return K.scores(rows.withColumn("tn", tn).drop("gti_seconds"), 9)


@query("h4_catalogue_aware_contingency", """
WITH m AS (SELECT anchor, unnest(member_peaks) AS p FROM master),
s AS (SELECT anchor, bool_or(EXISTS (SELECT 1 FROM flare f WHERE f.peak_t BETWEEN p-180 AND p+180)) AS a,
  bool_or(EXISTS (SELECT 1 FROM flare2 f WHERE f.peak_t BETWEEN p-180 AND p+180)) AS b FROM m GROUP BY 1)
SELECT count(*) FILTER (NOT a) AS fp_strict, count(*) FILTER (NOT a AND NOT b) AS fp_aware FROM s""", "master flare flare2")
def _(t):
    rows = t.master()
    rows = M.near_any_member(rows, t.flare(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "a")
    rows = M.near_any_member(rows, t.flare2(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "b")
    return rows.agg(F.count_if(~F.col("a")).alias("fp_strict"), F.count_if(~F.col("a") & ~F.col("b")).alias("fp_aware"))


#: All detections against the catalogue, as group "all"; and who explains each master event.
ALL_EVENTS = greedy_sql("SELECT 'all' AS g, peak_t AS t FROM det", "SELECT 'all' AS g, peak_t AS t, flare_id AS id, letter FROM flare")
EXPLAINED = """known AS (SELECT anchor, any_value(master_peak) AS master_peak,
  bool_or(EXISTS (SELECT 1 FROM flare f WHERE f.peak_t BETWEEN p-180 AND p+180)) AS a,
  bool_or(EXISTS (SELECT 1 FROM flare2 f WHERE f.peak_t BETWEEN p-180 AND p+180)) AS b
  FROM (SELECT anchor, master_peak, unnest(member_peaks) AS p FROM master) GROUP BY 1)"""


def explained(t):
    """Master events with the catalogues that explain them: a (main), b (broad)."""
    rows = M.near_any_member(t.master(), t.flare(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "a")
    return M.near_any_member(rows, t.flare2(), ["anchor"], "member_peaks", "peak_t", MATCH_TOL, EVENT_CHUNK, "b")


def observed_days(t):
    """(day, gti_seconds) that any detector observed."""
    good = t.grid(600).filter("gti").select("k").distinct()
    return good.groupBy(day_key(F.col("k") * 600).alias("day")).agg((F.count("*") * 600).alias("gti_seconds"))


@query("h4b_both_contingencies", f"""
WITH {ALL_EVENTS}, {EXPLAINED},
c AS (SELECT count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fn FROM events),
o AS (SELECT count(DISTINCT k)*600 AS gs FROM grid10 WHERE gti),
f AS (SELECT 'strict' AS kind, count(*) FILTER (NOT a) AS fp FROM known UNION ALL SELECT 'aware', count(*) FILTER (NOT a AND NOT b) FROM known)
SELECT kind, {SCORE_SQL} FROM (SELECT kind, tp, fp, fn, greatest(0, greatest(0, gs//360-(tp+fn))-fp) AS tn FROM c, o, f)""", "det flare flare2 master grid10")
def _(t):
    counts = M.match_counts(M.greedy_match(t.det(), t.flare(), [], "peak_t", "peak_t", MATCH_TOL, EVENT_CHUNK), []).select("tp", "fn")
    return K.both_contingencies(counts, explained(t), "a", "b", observed_days(t), 9)


@query("h5_score_bins", """
SELECT bin, obs::INT AS obs, pred::INT AS pred, min(bin) OVER (PARTITION BY day_no, seg) AS segment FROM bins""", "bins")
def _(t):
    return bins(t).select("bin", F.col("obs").cast("int").alias("obs"), F.col("pred").cast("int").alias("pred"), "segment")


@query("h6_climatology_contingency", """
WITH c AS (SELECT day_no, count(*) AS n, count(*) FILTER (obs) AS np FROM bins GROUP BY 1),
r AS (SELECT day_no, n, np, round_even(np::DOUBLE/n*np, 0)::BIGINT AS tp, round_even(np::DOUBLE/n*(n-np), 0)::BIGINT AS fp FROM c)
SELECT day_no, tp, fp, np-tp AS fn, n-np-fp AS tn FROM r""", "bins")
def _(t):
    return K.climatology_contingency(bins(t), ["day_no"], F.col("obs"))


@query("h7_baseline_comparison", f"""
WITH a AS (SELECT 'fused' AS method, {COUNTS_SQL} FROM (SELECT obs AS o, pred AS p FROM bins)
  UNION ALL SELECT 'persistence_1', {COUNTS_SQL} FROM (SELECT obs AS o, p1 AS p FROM bins_pers)
  UNION ALL SELECT 'persistence_5', {COUNTS_SQL} FROM (SELECT obs AS o, p5 AS p FROM bins_pers)
  UNION ALL SELECT 'climatology', tp, fp, np-tp, n-np-fp FROM (
    SELECT n, np, round_even(np::DOUBLE/n*np, 0)::BIGINT AS tp, round_even(np::DOUBLE/n*(n-np), 0)::BIGINT AS fp
    FROM (SELECT count(*) AS n, count(*) FILTER (obs) AS np FROM bins))),
s AS (SELECT method, {SCORE_SQL} FROM a)
SELECT *, (tss > max(CASE WHEN method<>'fused' THEN tss END) OVER ())::INT AS beats_all FROM s""", "bins bins_pers")
def _(t):
    rows = cut_lineage(bins(t))
    rows = persistence(rows, ["day_no"], "bin", "obs", "segment", "p1", 1, None)
    rows = persistence(rows, ["day_no"], "bin", "obs", "segment", "p5", 5, None)
    obs = F.col("obs")
    table = None
    for name, pred in (("fused", F.col("pred")), ("persistence_1", F.col("p1") == 1), ("persistence_5", F.col("p5") == 1)):
        one = K.contingency(rows, [], obs, pred).withColumn("method", F.lit(name))
        table = one if table is None else table.unionByName(one)
    table = table.unionByName(K.climatology_contingency(rows, [], obs).withColumn("method", F.lit("climatology")))
    best = F.max(F.when(F.col("method") != "fused", F.col("tss"))).over(Window.partitionBy(F.lit(0)))
    return K.scores(table, 9).withColumn("beats_all", (F.col("tss") > best).cast("int"))


CTES["val_grid"] = ("pred", """
    SELECT DISTINCT unnest(quantile_cont(p, [""" + ", ".join(str(q) for q in K.QUANTILE_GRID) + """])) AS thr FROM pred WHERE split='VAL'""")
CTES["val_table"] = ("val_grid pred", f"""
    SELECT thr, {SCORE_SQL} FROM (SELECT thr, {COUNTS_SQL} FROM (SELECT g.thr, y=1 AS o, p.p>=g.thr AS p FROM val_grid g, pred p WHERE split='VAL') GROUP BY 1)""")


@query("h8_best_threshold", """
SELECT round(thr, 9) AS threshold, tss FROM val_table ORDER BY tss DESC, thr LIMIT 1""", "val_table")
def _(t):
    out = K.best_threshold(t.pred().filter("split = 'VAL'"), [], "p", F.col("y") == 1)
    return out.select(F.round("threshold", 9).alias("threshold"), F.round("tss", 9).alias("tss"))


H9_THR = (9.0, 9.5, 10.0, 11.0, 12.0, 13.5, 15.0, 17.5, 20.0)


@query("h9_tss_curve", f"""
WITH thr AS (SELECT unnest({list(H9_THR)})::DOUBLE AS thr),
{greedy_sql("SELECT detector||'@'||thr AS g, peak_t AS t FROM det, thr WHERE max_significance>=thr",
            "SELECT d.g||'@'||thr AS g, f.peak_t AS t, f.flare_id AS id, f.letter FROM flare f, thr, (SELECT unnest(['click','error','purchase','signup','view']) AS g) d")},
c AS (SELECT g, count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fn, count(*) AS n_cat FROM events GROUP BY 1),
f AS (SELECT split_part(g, '@', 1) AS detector, split_part(g, '@', 2)::DOUBLE AS thr, c.*, (SELECT count(*) FROM dd WHERE dd.g=c.g)-tp AS fp,
  (SELECT gti_seconds FROM ({GTI_SQL}) q WHERE q.detector=split_part(c.g, '@', 1)) AS gs FROM c),
s AS (SELECT detector, thr, {SCORE_SQL} FROM (SELECT *, greatest(0, greatest(0, gs//360-n_cat)-fp) AS tn FROM f))
SELECT detector, thr, tss, (row_number() OVER (PARTITION BY detector ORDER BY tss DESC, thr)=1)::INT AS chosen FROM s""", "det flare grid10")
def _(t):
    det, cat = per_detector(t)
    steps = F.array(*[F.lit(x) for x in H9_THR])
    det = det.withColumn("thr", F.explode(F.filter(steps, lambda x: x <= F.col("max_significance"))))
    cat = cat.withColumn("thr", F.explode(steps))
    on = ["detector", "thr"]
    counts = M.match_counts(M.greedy_match(det, cat, on, "peak_t", "peak_t", MATCH_TOL, EVENT_CHUNK), on)
    tn = K.true_negatives(F.col("gti_seconds"), F.col("tp") + F.col("fn"), F.col("fp"))
    rows = K.scores(counts.join(gti_seconds(t), "detector").withColumn("tn", tn), 9)
    first = F.row_number().over(Window.partitionBy("detector").orderBy(F.col("tss").desc(), "thr")) == 1
    return rows.select("detector", "thr", "tss", first.cast("int").alias("chosen"))


@query("h10_class_recall", """
SELECT letter, count(*) FILTER (p>=0.45) AS hit, count(*) AS n, round(count(*) FILTER (p>=0.45)/count(*), 9) AS recall
FROM pred WHERE y=1 AND split='TEST' GROUP BY 1""", "pred")
def _(t):
    rows = t.pred().filter("y = 1 AND split = 'TEST'")
    return K.class_recall(rows, [], "letter", F.col("p") >= WATCH).withColumn("recall", F.round("recall", 9))


@query("h11_detector_class_recall", f"""
WITH {greedy_sql("SELECT detector AS g, peak_t AS t FROM det", ALL_CAT)},
r AS (SELECT g, letter, avg(matched::INT) AS r FROM events GROUP BY 1, 2)
SELECT g AS detector, round(max(r) FILTER (letter='B'), 9) AS recall_b, round(max(r) FILTER (letter='C'), 9) AS recall_c,
  round(max(r) FILTER (letter='M'), 9) AS recall_m, round(max(r) FILTER (letter='X'), 9) AS recall_x,
  round(max(r) FILTER (letter='X')/nullif(max(r) FILTER (letter='C'), 0), 9) AS x_over_c FROM r GROUP BY 1""", "det flare")
def _(t):
    det, cat = per_detector(t)
    rows = K.matched_events(det, cat, ["detector"], "peak_t", "peak_t", "flare_id", MATCH_TOL, EVENT_CHUNK)
    wide = rows.groupBy("detector").pivot("letter", ["B", "C", "M", "X"]).agg(F.avg(F.col("matched").cast("int")))
    return wide.select(
        "detector", *[F.round(c, 9).alias(f"recall_{c.lower()}") for c in "BCMX"],
        F.round(F.try_divide("X", F.nullif(F.col("C"), F.lit(0.0))), 9).alias("x_over_c"),
    )


@query("h12_union_vs_single", f"""
WITH {greedy_sql("SELECT detector AS g, peak_t AS t FROM det_other UNION ALL SELECT 'union', peak_t FROM det_other",
                 "SELECT d.g, f.peak_t AS t, f.flare_id AS id, f.letter FROM flare f, (SELECT unnest(['click','purchase','signup','view','union']) AS g) d")},
r AS (SELECT g, avg(matched::INT) AS recall FROM events GROUP BY 1)
SELECT round(max(recall) FILTER (g='union'), 9) AS union_recall, round(max(recall) FILTER (g<>'union'), 9) AS best_recall,
  arg_min(g, [-recall, ascii(g)]) FILTER (g<>'union') AS best_detector FROM r""", "det_other flare")
def _(t):
    det = t.det_other().select("detector", "peak_t")
    groups = ("click", "purchase", "signup", "view", "union")
    both = det.select(F.col("detector").alias("g"), "peak_t").unionByName(det.select(F.lit("union").alias("g"), "peak_t"))
    cat = t.flare().select("flare_id", "peak_t", F.explode(F.array(*[F.lit(g) for g in groups])).alias("g"))
    rows = K.matched_events(both, cat, ["g"], "peak_t", "peak_t", "flare_id", MATCH_TOL, EVENT_CHUNK)
    recall = rows.groupBy("g").agg(F.avg(F.col("matched").cast("int")).alias("recall"))
    single = F.col("g") != "union"
    return recall.agg(
        F.round(F.max(F.when(~single, F.col("recall"))), 9).alias("union_recall"),
        F.round(F.max(F.when(single, F.col("recall"))), 9).alias("best_recall"),
        F.min_by("g", F.when(single, F.struct(-F.col("recall"), F.ascii("g")))).alias("best_detector"),
    )


@query("h13_brier_score", "SELECT split, round(avg((p-y)*(p-y)), 9) AS brier FROM pred GROUP BY 1", "pred")
def _(t):
    return K.brier_and_ece(t.pred(), ["split"], "p", "y").select("split", F.round("brier", 9).alias("brier"))


@query("h14_reliability_curve", """
WITH r AS (SELECT least(floor(p*10), 9)::INT AS bin, avg(p) AS mp, avg(y) AS of, count(*) AS n FROM pred WHERE split='TEST' GROUP BY 1)
SELECT b.bin, round(mp, 9) AS mean_pred, round(of, 9) AS obs_freq, coalesce(n, 0) AS n
FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN r USING (bin)""", "pred")
def _(t):
    out = K.reliability(t.pred().filter("split = 'TEST'"), [], "p", "y")
    return out.select("bin", F.round("mean_pred", 9).alias("mean_pred"), F.round("obs_freq", 9).alias("obs_freq"), "n")


@query("h15_calibration_error", """
SELECT split, round(sum(abs(of-mp)*n)/sum(n), 9) AS ece FROM (
  SELECT split, least(floor(p*10), 9) AS bin, avg(p) AS mp, avg(y) AS of, count(*) AS n FROM pred GROUP BY 1, 2) GROUP BY 1""", "pred")
def _(t):
    return K.brier_and_ece(t.pred(), ["split"], "p", "y").select("split", F.round("ece", 9).alias("ece"))


N_BOOT = 2000


@query("h16_block_bootstrap", "WITH " + ALL_EVENTS + ", " + EXPLAINED + """,
obs AS (SELECT strftime(make_timestamp(k*600*1000000), '%Y%m%d') AS day, count(*)*600 AS gs FROM (SELECT DISTINCT k FROM grid10 WHERE gti) GROUP BY 1),
hit AS (SELECT strftime(make_timestamp(t*1000000), '%Y%m%d') AS day, count(*) FILTER (matched) AS tp, count(*) FILTER (NOT matched) AS fn FROM events GROUP BY 1),
false_alarm AS (SELECT strftime(make_timestamp(master_peak*1000000), '%Y%m%d') AS day, count(*) AS fp FROM known WHERE NOT a AND NOT b GROUP BY 1),
ec AS (SELECT obs.day, gs, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp FROM obs LEFT JOIN hit USING (day) LEFT JOIN false_alarm USING (day)),
edays AS (SELECT day, row_number() OVER (ORDER BY day)-1 AS i, count(*) OVER () AS n FROM ec),
epicks AS (SELECT b, ('0x' || substr(md5(b || '|' || i), 1, 12))::BIGINT % n AS i FROM edays, (SELECT unnest(range(2000)) AS b)),
et AS (SELECT tp, fn, fp, greatest(0, greatest(0, gs//360-(tp+fn))-fp) AS tn FROM (
  SELECT b, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(gs) AS gs FROM epicks JOIN edays USING (i) JOIN ec USING (day) GROUP BY b)),
comp AS (SELECT day, least(floor(p*10), 9) AS bin, count(*) FILTER (y=1 AND p>=0.45) AS tp, count(*) FILTER (y=0 AND p>=0.45) AS fp,
  count(*) FILTER (y=1 AND p<0.45) AS fn, count(*) FILTER (y=0 AND p<0.45) AS tn, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p-y)*(p-y)) AS se
  FROM pred WHERE split='TEST' GROUP BY 1, 2),
days AS (SELECT day, row_number() OVER (ORDER BY day)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM comp)),
picks AS (SELECT b, ('0x' || substr(md5(b || '|' || i), 1, 12))::BIGINT % n AS i FROM days, (SELECT unnest(range(2000)) AS b)),
pb AS (SELECT b, bin, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(c.n) AS n, sum(sp) AS sp, sum(sy) AS sy, sum(se) AS se
  FROM picks JOIN days USING (i) JOIN comp c USING (day) GROUP BY 1, 2),
pd AS (SELECT b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(n) AS n, sum(se) AS se, sum(abs(sy-sp)) AS gap FROM pb GROUP BY 1),
fm AS (SELECT unnest([{'metric': 'tss', 'v': coalesce(tp/nullif(tp+fn,0),0)-coalesce(fp/nullif(fp+tn,0),0)}, {'metric': 'far', 'v': coalesce(fp/nullif(tp+fp,0),0)},
  {'metric': 'brier', 'v': se/n}, {'metric': 'ece', 'v': gap/n}]) AS s FROM pd)
SELECT s.metric AS metric, round(quantile_cont(s.v, 0.025), 9) AS lo, round(quantile_cont(s.v, 0.975), 9) AS hi FROM fm GROUP BY 1
UNION ALL SELECT 'event_tss', round(quantile_cont(v, 0.025), 9), round(quantile_cont(v, 0.975), 9)
FROM (SELECT coalesce(tp/nullif(tp+fn,0),0)-coalesce(fp/nullif(fp+tn,0),0) AS v FROM et)""", "pred det flare flare2 master grid10")
def _(t):
    comp = cut_lineage(K.daily_components(t.pred().filter("split = 'TEST'"), "p", "y", WATCH))
    events = K.matched_events(t.det(), t.flare(), [], "peak_t", "peak_t", "flare_id", MATCH_TOL, EVENT_CHUNK)
    alarms = explained(t).filter("NOT a AND NOT b").select(day_key("master_peak").alias("day"))
    of_events = cut_lineage(K.daily_event_components(events.withColumn("day", day_key("peak_t")), alarms, observed_days(t)))
    out = K.block_bootstrap(comp, N_BOOT).unionByName(K.event_bootstrap(of_events, N_BOOT))
    return out.select("metric", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


LEADS = """
WITH mx AS (SELECT flare_id, letter, peak_t FROM flare WHERE letter IN ('M','X') AND peak_t >= 1705968000 AND peak_t < 1706745600),
l AS (SELECT mx.flare_id, mx.letter, bool_or(p.t >= peak_t-900) AS cov,
   round((any_value(peak_t)-min(p.t) FILTER (p.p>=0.45))/60.0, 1)::DOUBLE AS lead_watch, round((any_value(peak_t)-min(p.t) FILTER (p.p>=0.6))/60.0, 1)::DOUBLE AS lead_warning
  FROM mx LEFT JOIN pred p ON p.t BETWEEN peak_t-3600 AND peak_t GROUP BY 1, 2)
"""


def leads(t):
    mx = t.flare().filter("letter IN ('M', 'X') AND peak_t >= 1705968000 AND peak_t < 1706745600").select("flare_id", "letter", "peak_t")
    return K.lead_times(mx, t.pred().select("t", "p"), "peak_t", "t", "p", {"watch": WATCH, "warning": WARNING}, 3600, 900, EVENT_CHUNK)


@query("h17_lead_times", LEADS + "SELECT flare_id, letter, coalesce(cov, FALSE)::INT AS coverage, lead_watch, lead_warning FROM l", "flare pred")
def _(t):
    return leads(t).select("flare_id", "letter", F.col("coverage").cast("int").alias("coverage"), "lead_watch", "lead_warning")


@query("h17b_lead_summary", LEADS + """
SELECT letter, count(*) AS n, count(lead_warning) AS warned, count(*) FILTER (lead_warning IS NULL AND cov) AS no_warning,
  count(*) FILTER (lead_warning IS NULL AND NOT coalesce(cov, FALSE)) AS no_coverage, round(quantile_cont(lead_warning, 0.5), 6) AS median,
  round(quantile_cont(lead_warning, 0.25), 6) AS q1, round(quantile_cont(lead_warning, 0.75), 6) AS q3,
  min(lead_warning) AS shortest, max(lead_warning) AS longest FROM l GROUP BY 1""", "flare pred")
def _(t):
    out = K.lead_summary(leads(t), ["letter"], "lead_warning")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "q1", "q3")})


@query("h18_all_clear", """
SELECT x.flare_id, (SELECT count(*) FROM flare m WHERE m.letter IN ('M','X') AND m.peak_t >= x.start_t-43200 AND m.peak_t < x.start_t) AS n_prior,
  (EXISTS (SELECT 1 FROM pred p WHERE p.t BETWEEN x.peak_t-900 AND x.peak_t))::INT AS has_rows,
  (EXISTS (SELECT 1 FROM pred p WHERE p.t BETWEEN x.peak_t-900 AND x.peak_t AND p.p>=0.6))::INT AS flagged,
  (SELECT round((x.peak_t-min(p.t))/60.0, 1)::DOUBLE FROM pred p WHERE p.t BETWEEN x.peak_t-900 AND x.peak_t AND p.p>=0.6) AS lead_min
FROM flare x WHERE x.letter='X'""", "flare pred")
def _(t):
    flare = t.flare()
    x = flare.filter("letter = 'X'").select("flare_id", "start_t", "peak_t")
    mx = flare.filter("letter IN ('M', 'X')").select("peak_t")
    out = K.all_clear(x, mx, t.pred().select("t", "p"), "t", "p", WARNING, EVENT_CHUNK)
    return out.select("flare_id", "n_prior", F.col("coverage").cast("int").alias("has_rows"),
                      F.col("flagged").cast("int").alias("flagged"), F.col("lead_alarm").alias("lead_min"))


@query("h19_relative_value", f"""
WITH c AS (SELECT name, avg(o::INT) AS s, {COUNTS_SQL} FROM (
    SELECT q.name, y=1 AS o, p.p>=q.thr AS p FROM pred p, (SELECT unnest(['watch','warning']) AS name, unnest([0.45, 0.6]) AS thr) q WHERE split='TEST') GROUP BY 1),
v AS (SELECT name, s, tp/nullif(tp+fn,0)::DOUBLE AS h, fp/nullif(fp+tn,0)::DOUBLE AS f, 0.01*exp(i*ln(100.0)/299) AS r FROM c, (SELECT unnest(range(300)) AS i)),
w AS (SELECT name, r, greatest(-1, least(1, (least(r,s)-(f*r*(1-s)+h*r*s+(1-h)*s))/nullif(least(r,s)-s*r, 0))) AS val FROM v)
SELECT name, round(max(val), 8) AS vmax, round(min(r) FILTER (val>0), 8) AS cl_low, round(max(r) FILTER (val>0), 8) AS cl_high, count(*) AS n FROM w GROUP BY 1""", "pred")
def _(t):
    rows = t.pred().filter("split = 'TEST'").withColumn("pt", F.explode(F.array(
        F.struct(F.lit("watch").alias("name"), F.lit(WATCH).alias("thr")), F.struct(F.lit("warning").alias("name"), F.lit(WARNING).alias("thr")))))
    c = K.scores(K.contingency(rows.select("p", "y", "pt.*"), ["name"], F.col("y") == 1, F.col("p") >= F.col("thr")))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    v = K.relative_value(c.withColumn("s", (F.col("tp") + F.col("fn")) / total), "pod", "pofd", "s")
    positive = F.when(F.col("value") > 0, F.col("cl"))
    return v.groupBy("name").agg(
        F.round(F.max("value"), 8).alias("vmax"), F.round(F.min(positive), 8).alias("cl_low"),
        F.round(F.max(positive), 8).alias("cl_high"), F.count("*").alias("n"),
    )


UPPER = ", ".join(repr(0.5 + i * 0.499 / 199) for i in range(200))


@query("h20_operating_points", f"""
WITH w AS (SELECT thr AS watch FROM val_table ORDER BY tss DESC, thr LIMIT 1),
g AS (SELECT DISTINCT unnest(quantile_cont(p, [{UPPER}])) AS thr FROM pred WHERE split='VAL'),
tt AS (SELECT thr, {COUNTS_SQL} FROM (SELECT g.thr, y=1 AS o, p.p>=g.thr AS p FROM g, pred p WHERE split='VAL') GROUP BY 1)
SELECT round(watch, 9) AS watch, round(coalesce((SELECT min(thr) FROM tt WHERE thr>=watch AND tp>0 AND tp/(tp+fp)>=0.15), watch), 9) AS warning FROM w""", "val_table pred")
def _(t):
    out = K.operating_points(t.pred().filter("split = 'VAL'"), [], "p", F.col("y") == 1, 0.15)
    return out.select(F.round("watch", 9).alias("watch"), F.round("warning", 9).alias("warning"))


@query("h21_alert_timeline", """
SELECT day, count(*) FILTER (p IS NULL) AS nocov, count(*) FILTER (p<0.45) AS quiet, count(*) FILTER (p>=0.45 AND p<0.6) AS watch,
  count(*) FILTER (p>=0.6) AS warning, round(100.0*count(p)/count(*), 1) AS coverage_pct
FROM (SELECT day, CASE WHEN event_id%9<>0 THEN p END AS p FROM pred) GROUP BY 1""", "pred")
def _(t):
    rows = t.pred().withColumn("p", F.when(F.col("event_id") % 9 != 0, F.col("p")))
    rows = rows.withColumn("level", K.alert_level("p", WATCH, WARNING))
    return rows.groupBy("day").agg(
        *[F.count_if(F.col("level") == n).alias(n) for n in ("nocov", "quiet", "watch", "warning")],
        F.round(100.0 * F.count("p") / F.count("*"), 1).alias("coverage_pct"),
    )


@query("h22_drift_guard", """
WITH m AS (SELECT 'brier' AS metric, avg((p-y)*(p-y)) AS v FROM pred UNION ALL SELECT 'base_rate', avg(y) FROM pred UNION ALL SELECT 'mean_p', avg(p) FROM pred)
SELECT f.metric, round(m.v, 9) AS measured, coalesce(abs(m.v-f.frozen) <= f.tol, FALSE)::INT AS ok
FROM (SELECT unnest(['brier','base_rate','mean_p','absent']) AS metric, unnest([0.16, 0.5, 0.37, 1.0]) AS frozen, unnest([0.05, 0.01, 0.05, 0.1]) AS tol) f LEFT JOIN m USING (metric)""", "pred")
def _(t):
    p, y = F.col("p"), F.col("y")
    stats = t.pred().agg(F.avg((p - y) ** 2).alias("brier"), F.avg(y).alias("base_rate"), F.avg(p).alias("mean_p"))
    measured = stats.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("measured")) for n in ("brier", "base_rate", "mean_p")])))
    frozen = t.spark.createDataFrame(
        [("brier", 0.16, 0.05), ("base_rate", 0.5, 0.01), ("mean_p", 0.37, 0.05), ("absent", 1.0, 0.1)],
        "metric string, frozen double, tolerance double",
    )
    return K.drift_check(measured, frozen).select("metric", F.round("measured", 9).alias("measured"), F.col("ok").cast("int").alias("ok"))


@query("h23_top_by_significance", """
WITH q AS (SELECT *, CASE WHEN max_significance>=16 THEN 'classic' WHEN max_significance>=11 THEN 'intermediate' ELSE 'short' END AS tier FROM det),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY max_significance DESC, det_id) AS rn FROM q)
SELECT r.tier, r.rn::INT AS rn, r.det_id, r.max_significance, c.n_candidates, c.n_events FROM r
JOIN (SELECT tier, count(*) AS n_candidates, count(DISTINCT peak_t) AS n_events FROM q GROUP BY 1) c USING (tier) WHERE rn <= 5""", "det")
def _(t):
    s = F.col("max_significance")
    rows = t.det().withColumn("tier", F.when(s >= 16, "classic").when(s >= 11, "intermediate").otherwise("short"))
    counts = rows.groupBy("tier").agg(F.count("*").alias("n_candidates"), F.count_distinct("peak_t").alias("n_events"))
    w = Window.partitionBy("tier").orderBy(s.desc(), "det_id")
    top = rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    return top.join(counts, "tier").select("tier", "rn", "det_id", "max_significance", "n_candidates", "n_events")
