"""Queries: periodicity (section Q), on day-long windows of the ten-minute grid."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoflux.functions.scalars import _ACKLAM_A, _ACKLAM_B, _ACKLAM_C, _ACKLAM_D, floor_div
from chronoflux.operators import periodic as P
from chronoflux.plans.registry import query
from chronoflux.plans.tables import CTES
from chronoflux.session import cut_lineage

W = "wid"

CTES["win"] = ("grid10", """
  SELECT wid, row_number() OVER (PARTITION BY wid ORDER BY k)-1 AS j, n, y FROM (
    SELECT detector||'/'||(k//144) AS wid, k, rate AS y, count(*) OVER (PARTITION BY detector, k//144) AS n FROM grid10 WHERE gti) WHERE n >= 16""")
CTES["mm"] = ("win", """
  SELECT *, greatest(m, least(j, n-1-m)) AS c FROM (SELECT *, (least(CASE WHEN h%2=0 THEN h+1 ELSE h END, CASE WHEN n%2=1 THEN n ELSE n-1 END)-1)//2 AS m
    FROM (SELECT wid, j, n, y - avg(y) OVER (PARTITION BY wid) AS y, greatest(5, n//2) AS h FROM win))""")
CTES["resid"] = ("mm", """
  SELECT wid, j, n, y - (a0 + a1*k + a2*k*k) AS x FROM (
    SELECT *, s0/w - a2*k2/w AS a0, s1/k2 AS a1, (j-c)::DOUBLE AS k FROM (
      SELECT *, (s2-k2/w*s0)/(k4-k2*k2/w) AS a2 FROM (
        SELECT a.wid, a.j, a.n, any_value(a.y) AS y, any_value(a.c) AS c, sum(b.y) AS s0, sum(b.y*(b.j-a.c)) AS s1, sum(b.y*(b.j-a.c)*(b.j-a.c)) AS s2,
          count(*)::DOUBLE AS w, sum((b.j-a.c)*(b.j-a.c))::DOUBLE AS k2, sum((b.j-a.c)**4)::DOUBLE AS k4
        FROM mm a JOIN mm b ON a.wid=b.wid AND b.j BETWEEN a.c-a.m AND a.c+a.m GROUP BY a.wid, a.j, a.n)))""")
CTES["pgram"] = ("resid", """
  SELECT *, count(*) OVER (PARTITION BY wid) AS nf FROM (
    SELECT wid, n, i, i/n::DOUBLE AS f, (sum(x*cos(2*pi()*((i*j)%n)/n))**2 + sum(x*sin(2*pi()*((i*j)%n)/n))**2)/n AS power
    FROM (SELECT wid, n, j, x - avg(x) OVER (PARTITION BY wid) AS x, unnest(range(1, (n-1)//2+1)) AS i FROM resid) GROUP BY wid, n, i) WHERE power > 0""")
_fit = """SELECT wid, arg_min(beta, [nll, beta, lr]) AS beta, arg_min(lr, [nll, beta, lr]) AS lr, arg_min(a, [nll, beta, lr]) AS a FROM (
    SELECT wid, beta, lr, avg(power/g) AS a, round(ln(avg(power/g))+avg(ln(g)), 9) AS nll FROM (
      SELECT wid, power, beta, lr, pow(f, -beta)+CASE WHEN lr=-99 THEN 0 ELSE pow(10, lr) END AS g FROM ({src})) GROUP BY 1, 2, 3) GROUP BY 1"""
CTES["coarse"] = ("pgram", _fit.format(src="""SELECT wid, f, power, beta, lr FROM pgram,
    (SELECT unnest([""" + ", ".join(str(b) for b in P.COARSE_BETA) + """])::DOUBLE AS beta), (SELECT unnest([-99.0, """ + ", ".join(str(r) for r in P.COARSE_LOG_RATIO) + """])::DOUBLE AS lr) WHERE nf >= 6"""))
CTES["fine"] = ("coarse pgram", _fit.format(src="""SELECT * FROM (SELECT p.wid, f, power, round(c.beta+bk*0.1, 1) AS beta, CASE WHEN c.lr=-99 THEN -99 ELSE round(c.lr+rk*0.2, 1) END AS lr
    FROM pgram p JOIN coarse c USING (wid), (SELECT unnest(range(-5, 6)) AS bk), (SELECT unnest(range(-4, 5)) AS rk) WHERE c.lr<>-99 OR rk=0) WHERE beta BETWEEN 0 AND 5"""))
CTES["newton0"] = ("fine pgram", f"""
  SELECT p.wid, any_value(f.beta) AS beta, any_value(f.lr*ln(10)) AS u, any_value(f.lr <> -99) AS has_floor, avg(power/g) AS a, ln(avg(power/g))+avg(ln(g)) AS nll, {P.FIRST_DAMPING}::DOUBLE AS damping
  FROM (SELECT *, pow(f, -beta)+CASE WHEN lr=-99 THEN 0 ELSE pow(10, lr) END AS g FROM pgram JOIN fine USING (wid)) p JOIN fine f USING (wid) GROUP BY p.wid""")
for _k in range(P.NEWTON_STEPS):
    CTES[f"newton{_k + 1}"] = (f"newton{_k} pgram", f"""
  SELECT wid, CASE WHEN ok THEN b2 ELSE beta END AS beta, CASE WHEN ok THEN u2 ELSE u END AS u, has_floor, CASE WHEN ok THEN a2 ELSE a END AS a, CASE WHEN ok THEN n2 ELSE nll END AS nll,
    damping * CASE WHEN ok THEN 0.125 ELSE 8.0 END AS damping FROM (SELECT *, fit AND n2 < nll AS ok FROM (
    SELECT wid, any_value(beta) AS beta, any_value(u) AS u, any_value(has_floor) AS has_floor, any_value(a) AS a, any_value(nll) AS nll, any_value(damping) AS damping, any_value(fit) AS fit, any_value(b2) AS b2,
      any_value(u2) AS u2, avg(power/g) AS a2, ln(avg(power/g))+avg(ln(g)) AS n2 FROM (
      SELECT s.*, p.power, pow(p.f, -b2)+CASE WHEN has_floor THEN exp(u2) ELSE 0 END AS g FROM (
        SELECT *, least(5.0, greatest(0.0, beta+least(0.5, greatest(-0.5, CASE WHEN NOT fit THEN 0 WHEN has_floor THEN -(huu*db-hbu*du)/det ELSE -db/hbb END)))) AS b2,
          u+least(1.0, greatest(-1.0, CASE WHEN fit AND has_floor THEN -(hbb*du-hbu*db)/det ELSE 0 END)) AS u2 FROM (
          SELECT *, CASE WHEN has_floor THEN hbb*huu-hbu*hbu ELSE hbb END AS det, hbb > 0 AND CASE WHEN has_floor THEN hbb*huu-hbu*hbu ELSE hbb END > 0 AS fit FROM (
            SELECT *, ab+gb AS db, au+gu AS du, qbb/a-ab*ab+gbb+damping AS hbb, qbu/a-ab*au-gbu AS hbu, quu/a-au*au+guu+damping AS huu FROM (
              SELECT wid, any_value(beta) AS beta, any_value(u) AS u, any_value(has_floor) AS has_floor, any_value(a) AS a, any_value(nll) AS nll, any_value(damping) AS damping,
                -avg(q*b1)/any_value(a) AS ab, -avg(q*u1)/any_value(a) AS au, avg(b1) AS gb, avg(u1) AS gu, avg(q*(2*b1*b1-bb)) AS qbb, avg(2*q*b1*u1) AS qbu, avg(q*(2*u1*u1-u1)) AS quu,
                avg(bb-b1*b1) AS gbb, avg(b1*u1) AS gbu, avg(u1-u1*u1) AS guu FROM (
                SELECT *, power/g AS q, -ln(f)*pow(f, -beta)/g AS b1, CASE WHEN has_floor THEN exp(u) ELSE 0 END/g AS u1, ln(f)*ln(f)*pow(f, -beta)/g AS bb FROM (
                  SELECT n.*, p.f, p.power, pow(p.f, -beta)+CASE WHEN has_floor THEN exp(u) ELSE 0 END AS g FROM newton{_k} n JOIN pgram p USING (wid))) GROUP BY wid)))) s JOIN pgram p USING (wid)) GROUP BY wid))""")
# Both engines take the same steps; where the likelihood is flat their last digits differ, so what follows
# from a fit is compared at four or five digits.
CTES["fit"] = (f"newton{P.NEWTON_STEPS}", f"SELECT wid, beta, CASE WHEN has_floor THEN u/ln(10) ELSE -99 END AS lr, a FROM newton{P.NEWTON_STEPS}")
CTES["tested"] = ("fit pgram", """
  SELECT *, least(1, greatest(1e-300, 1-pow(1-exp(-gamma/2), nf))) AS p_global FROM (
    SELECT p.*, f.beta, f.lr, f.a, a*(pow(p.f, -beta)+CASE WHEN lr=-99 THEN 0 ELSE pow(10, lr) END) AS model,
      2*power/(a*(pow(p.f, -beta)+CASE WHEN lr=-99 THEN 0 ELSE pow(10, lr) END)) AS gamma, -2*ln(1-pow(0.95, 1.0/nf)) AS crit FROM pgram p JOIN fit f USING (wid) WHERE nf >= 6)""")
CTES["signals"] = ("tested", """
  SELECT wid, run, arg_max(n::DOUBLE/i, [gamma, -i]) AS period, any_value(n) AS n, max(gamma) AS gamma, arg_max(p_global, [gamma, -i]) AS p_global, arg_max(i, [gamma, -i])::DOUBLE AS n_cycles FROM (
    SELECT *, i-row_number() OVER (PARTITION BY wid ORDER BY i) AS run FROM tested WHERE gamma>crit AND n::DOUBLE/i>=4 AND n::DOUBLE/i<=least(n/3.0, 300)) GROUP BY 1, 2""")


def windows(t):
    """Every detector day of the ten-minute grid is one window."""
    grid = t.grid(600).withColumn("day_no", floor_div("k", 144))
    spans = grid.select("detector", "day_no").distinct().select(
        "detector", F.concat_ws("/", "detector", F.col("day_no").cast("string")).alias(W),
        (F.col("day_no") * 144).alias("start"), (F.col("day_no") * 144 + 143).alias("peak"),
    )
    return cut_lineage(P.impulsive_windows(spans, grid, ["detector"], W, "start", "peak", "k", "rate", "gti", 144))


@query("q1_impulsive_windows", "SELECT wid, j::INT AS j, n, round(y, 9) AS y FROM win", "win")
def _(t):
    return windows(t).withColumn("y", F.round("y", 9))


@query("q2_detrend", "SELECT wid, j::INT AS j, round(x, 6) AS x FROM resid", "resid")
def _(t):
    return P.detrend(windows(t), W).select(W, "j", F.round("x", 6).alias("x"))


@query("q3_periodogram", "SELECT wid, i::INT AS i, round(power, 5) AS power FROM pgram WHERE nf >= 6", "pgram")
def _(t):
    return P.periodogram(P.detrend(windows(t), W), W).select(W, "i", F.round("power", 5).alias("power"))


@query("q4_red_noise_fit", "SELECT wid, round(beta, 4) AS beta, round(lr, 3) AS lr, round(a, 2) AS a FROM fit", "fit")
def _(t):
    spectrum = cut_lineage(P.periodogram(P.detrend(windows(t), W), W))
    return P.red_noise_fit(spectrum, W).select(W, F.round("beta", 4).alias("beta"), F.round("lr", 3).alias("lr"), F.round("a", 2).alias("a"))


def tested(t):
    residual = P.detrend(windows(t), W)
    spectrum = cut_lineage(P.periodogram(residual, W))
    fit = cut_lineage(P.red_noise_fit(spectrum, W))
    return residual, spectrum, fit, P.significance(spectrum, fit, W)


@query("q5_significance", "SELECT wid, i::INT AS i, round(gamma, 4) AS gamma, round(crit, 8) AS crit, (gamma>crit)::INT AS significant FROM tested", "tested")
def _(t):
    return tested(t)[3].select(W, "i", F.round("gamma", 4).alias("gamma"), F.round("crit", 8).alias("crit"),
                               (F.col("gamma") > F.col("crit")).cast("int").alias("significant"))


@query("q6_global_p_value", "SELECT wid, i::INT AS i, round(p_global, 5) AS p_global FROM tested", "tested")
def _(t):
    return tested(t)[3].select(W, "i", F.round("p_global", 5).alias("p_global"))


@query("q7_periodic_signals", "SELECT wid, round(period, 8) AS period, round(gamma, 4) AS gamma, n_cycles FROM signals", "signals")
def _(t):
    return P.periodic_signals(tested(t)[3], W).select(W, F.round("period", 8).alias("period"), F.round("gamma", 4).alias("gamma"), "n_cycles")


_CHAIN = ("win", "mm", "resid", "pgram", "coarse", "fine", *(f"newton{k}" for k in range(P.NEWTON_STEPS + 1)), "fit", "tested", "signals")


def copy_chain(prefix):
    """The views from windows to signals once more, over the windows of the view ``<prefix>_win``."""
    for name in _CHAIN[1:]:
        needs, text = CTES[name]
        text = re.sub(r"(?<=FROM |JOIN )(" + "|".join(_CHAIN) + r")\b", rf"{prefix}_\1", text)
        CTES[f"{prefix}_{name}"] = (" ".join(f"{prefix}_{n}" if n in _CHAIN else n for n in needs.split()), text)


def upper_quantile_sql(p):
    """The normal quantile of ``scalars.normal_upper_quantile`` in SQL: the same published approximation."""
    poly = lambda cs, x: functools.reduce(lambda a, c: f"({a})*{x}+({c!r})", cs[1:], f"({cs[0]!r})")
    tail = f"-({poly(_ACKLAM_C, 'q')})/({poly(_ACKLAM_D, 'q')})"
    centre = f"-(({poly(_ACKLAM_A, 's')})*r/({poly(_ACKLAM_B, 's')}))"
    return f"(SELECT CASE WHEN pp < 0.02425 THEN {tail} ELSE {centre} END FROM (SELECT pp, sqrt(-2*ln(pp)) AS q, pp-0.5 AS r, (pp-0.5)*(pp-0.5) AS s FROM (SELECT {p} AS pp)))"


@query("q7b_signal_sigma", f"""
WITH b AS (SELECT wid, run, min(i) AS i_low, max(i) AS i_high FROM (
  SELECT wid, i, i-row_number() OVER (PARTITION BY wid ORDER BY i) AS run FROM tested WHERE gamma>crit AND n::DOUBLE/i>=4 AND n::DOUBLE/i<=least(n/3.0, 300)) GROUP BY 1, 2)
SELECT wid, round(period, 8) AS period, round(p_global, 5) AS p_global, round({upper_quantile_sql("p_global/2")}, 3) AS sigma,
  round(n::DOUBLE/i_high, 8) AS band_low, round(n::DOUBLE/i_low, 8) AS band_high FROM signals JOIN b USING (wid, run)""", "signals tested")
def _(t):
    rounded = {"period": 8, "p_global": 5, "sigma": 3, "band_low": 8, "band_high": 8}
    return P.periodic_signals(tested(t)[3], W).select(W, *[F.round(c, n).alias(c) for c, n in rounded.items()])


CTES["near_row"] = ("signals", """
  SELECT wid, period AS found, arg_min(r, [abs(per-period), r]) AS r, arg_min(per, [abs(per-period), r]) AS per FROM (
    SELECT s.*, r, 4.0*exp(r/47.0*ln(least(n/3.0, 300)/4.0)) AS per FROM signals s, (SELECT unnest(range(48)) AS r)) GROUP BY 1, 2""")


@query("q8_signal_times", """
SELECT wid, round(found, 8) AS period, arg_max(tau, [round(p, 8), -tau]) AS tau FROM (
  SELECT q.wid, q.found, b.j AS tau, (sum(a.x*exp(-pow((a.j-b.j)/per, 2)/1.5)*cos(2*pi()*(a.j-b.j)/per))**2 + sum(a.x*exp(-pow((a.j-b.j)/per, 2)/1.5)*sin(2*pi()*(a.j-b.j)/per))**2)/(pi()*1.5*any_value(per)) AS p
  FROM near_row q JOIN resid a USING (wid) JOIN resid b ON b.wid=a.wid WHERE abs(a.j-b.j) <= ceil(per*8) GROUP BY 1, 2, 3) GROUP BY 1, 2""", "near_row resid")
def _(t):
    residual, _, _, done = tested(t)
    out = P.signal_times(residual, P.periodic_signals(done, W), W)
    return out.select(W, F.round("period", 8).alias("period"), F.col("tau").cast("bigint").alias("tau"))


@query("q9_regime_tiers", """
SELECT regime, CASE WHEN regime='short' THEN 'pending_instrumental' ELSE 'confirmed_regime' END AS attribution, count(*) AS n FROM (
  SELECT CASE WHEN period>=16 THEN 'classic' WHEN period>=8 THEN 'intermediate' ELSE 'short' END AS regime FROM signals) GROUP BY 1""", "signals")
def _(t):
    rows = P.periodic_signals(tested(t)[3], W).withColumn("regime", P.regime("period"))
    return rows.groupBy("regime", P.attribution("regime").alias("attribution")).agg(F.count("*").alias("n"))


@query("q10_normalised_map", f"""
WITH per AS (SELECT w.wid, r, n, 4.0*exp(r/47.0*ln(least(n/3.0, 300)/4.0)) AS per, beta, CASE WHEN lr=-99 THEN 0 ELSE pow(10, lr) END AS ratio, a, (n-1)//2 AS last
  FROM (SELECT DISTINCT wid, n FROM signals) w JOIN fit USING (wid), (SELECT unnest(range(48)) AS r) WHERE least(n/3.0, 300) > 4),
ends AS (SELECT *, least(last, greatest(1, floor(n/per)))::DOUBLE AS lo, least(last, least(last, greatest(1, floor(n/per)))+1)::DOUBLE AS hi FROM per),
cont AS (SELECT *, exp(ln(a*(pow(lo/n, -beta)+ratio)) + (ln(a*(pow(hi/n, -beta)+ratio))-ln(a*(pow(lo/n, -beta)+ratio)))
  * CASE WHEN hi > lo THEN greatest(0, least(1, ln(n/per/lo)/ln(hi/lo))) ELSE 0 END) AS level FROM ends),
pw AS (SELECT c.wid, c.r, b.j AS tau, (sum(a.x*exp(-pow((a.j-b.j)/per, 2)/1.5)*cos(2*pi()*(a.j-b.j)/per))**2 + sum(a.x*exp(-pow((a.j-b.j)/per, 2)/1.5)*sin(2*pi()*(a.j-b.j)/per))**2)/(pi()*1.5*any_value(per)) AS p
  FROM cont c JOIN resid a USING (wid) JOIN resid b ON b.wid=a.wid WHERE abs(a.j-b.j) <= ceil(per*8) GROUP BY 1, 2, 3),
k AS (SELECT wid, quantile_cont(m/level, 0.5) AS k FROM (SELECT wid, r, avg(p) AS m FROM pw GROUP BY 1, 2) JOIN cont USING (wid, r) GROUP BY 1)
SELECT wid, round(per, 8) AS period, round(max(p/(k*level)), 4) AS z_max,
  count(*) FILTER (p/(k*level) > {P.LOCAL_LEVEL} AND per <= greatest(4.0, least(tau, n-1-tau)/sqrt(2))) AS n_inside, count(*) AS n
FROM pw JOIN cont USING (wid, r) JOIN k USING (wid) GROUP BY wid, r, per""", "signals fit resid")
def _(t):
    # Maps are drawn for windows that hold a signal.
    residual, spectrum, fit, done = tested(t)
    wanted = cut_lineage(P.periodic_signals(done, W).select(W).distinct())
    z = P.normalised_map(residual.join(wanted, W, "left_semi"), spectrum.join(wanted, W, "left_semi"), fit, W)
    return z.groupBy(W, F.round("period", 8).alias("period")).agg(
        F.round(F.max("z"), 4).alias("z_max"), F.count_if((F.col("z") > P.LOCAL_LEVEL) & (F.col("period") <= F.col("coi"))).alias("n_inside"),
        F.count("*").alias("n"),
    )


CTES["inj_win"] = ("win", """
  SELECT kind||'|'||wid AS wid, j, n, y + CASE WHEN kind='injected' THEN 60.0*sin(2*pi()*j/12.0) ELSE 0 END AS y FROM win, (SELECT unnest(['control', 'injected']) AS kind)""")
copy_chain("inj")


@query("q11_injection_gate", """
SELECT split_part(w.wid, '|', 1) AS kind, count(*) AS n_windows, round(avg((s.wid IS NOT NULL)::INT), 9) AS hit_share
FROM (SELECT DISTINCT wid FROM inj_win) w LEFT JOIN (SELECT DISTINCT wid FROM inj_signals WHERE abs(period-12.0) <= 2.0) s USING (wid) GROUP BY 1""", "inj_win inj_signals")
def _(t):
    """Share of windows in which an injected 12-cell wave is found, against the windows as they are."""
    rows = windows(t)
    both = rows.withColumn("kind", F.lit("control")).unionByName(P.inject(rows, 12.0, 60.0).withColumn("kind", F.lit("injected")))
    both = cut_lineage(both.withColumn(W, F.concat_ws("|", "kind", W)).drop("kind"))
    found = P.periodic_signals(P.search(both, W)[3], W)
    near = found.filter(F.abs(F.col("period") - 12.0) <= 2.0).select(W).distinct().withColumn("hit", F.lit(1))
    share = both.select(W, "n").distinct().join(near, W, "left").withColumn("kind", F.substring_index(W, "|", 1))
    return share.groupBy("kind").agg(F.count("*").alias("n_windows"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("hit_share"))


@query("q12_featured_picks", """
WITH x AS (SELECT DISTINCT peak_t//86400 AS day FROM flare WHERE letter='X'),
r AS (SELECT wid, period, gamma, CASE WHEN period>=16 THEN 'classic' WHEN period>=8 THEN 'intermediate' ELSE 'short' END AS regime,
  split_part(wid, '/', 2)::BIGINT IN (SELECT day FROM x) AS has_x FROM signals),
p AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY round(gamma, 6) DESC, wid, period) AS k1, row_number() OVER (ORDER BY round(gamma, 6) DESC, wid, period) AS k2 FROM r),
x1 AS (SELECT * FROM p WHERE has_x ORDER BY round(gamma, 6) DESC, wid, period LIMIT 1),
x2 AS (SELECT * FROM p WHERE has_x AND regime='classic' ORDER BY round(gamma, 6) DESC, wid, period LIMIT 1)
SELECT regime AS pick, wid, round(period, 8) AS period FROM p WHERE k1 <= 3 UNION ALL SELECT 'overall', wid, round(period, 8) FROM p WHERE k2 <= 3
UNION ALL SELECT 'featured_x', wid, round(period, 8) FROM x1 UNION ALL SELECT 'classic_x', wid, round(period, 8) FROM x2""", "signals flare")
def _(t):
    rows = P.periodic_signals(tested(t)[3], W).withColumn("regime", P.regime("period"))
    # a window's class is that of the strongest event of its day
    day = F.split(W, "/")[1].cast("bigint")
    days = t.flare().filter("letter = 'X'").select(floor_div("peak_t", 86400).alias("day")).distinct()
    rows = cut_lineage(rows.withColumn("day", day).join(days.withColumn("has_x", F.lit(True)), "day", "left").withColumn("has_x", F.coalesce("has_x", F.lit(False))))
    return P.featured(rows, W, 3).withColumn("period", F.round("period", 8))


# The same chain on the rises of events: [start, peak] of every catalogue event in each detector, in cells of
# ten seconds in which a sample holds for ten minutes. Short rises and rises without good time drop out.
RISE, HOLD = 10, 60
CTES["ev_win"] = ("flare sample", f"""
  SELECT wid, row_number() OVER (PARTITION BY wid ORDER BY k)-1 AS j, n, y FROM (
    SELECT detector||'/'||flare_id AS wid, k, rate AS y, count(*) OVER (PARTITION BY detector, flare_id) AS n
    FROM (SELECT flare_id, start_t//{RISE} AS lo, peak_t//{RISE} AS hi FROM flare WHERE peak_t//{RISE}-start_t//{RISE} >= {P.MIN_LENGTH})
    JOIN (SELECT detector, k, arg_max(rate, [t, event_id]) AS rate FROM (SELECT *, t//{RISE}+unnest(range({HOLD})) AS k FROM sample) GROUP BY 1, 2) ON k BETWEEN lo AND hi) WHERE n >= {P.MIN_SAMPLES}""")
copy_chain("ev")


def rises(t):
    """Windows of every event and detector, one row each."""
    cell = lambda c: floor_div(c, RISE)
    held = t.sample().select("detector", "t", "event_id", "rate", F.explode(F.sequence(cell("t"), cell("t") + HOLD - 1)).alias("k"))
    grid = held.groupBy("detector", "k").agg(F.max_by("rate", F.struct("t", "event_id")).alias("rate")).withColumn("gti", F.lit(True))
    detectors = t.sample().select("detector").distinct()
    events = t.flare().select("flare_id", cell("start_t").alias("start"), cell("peak_t").alias("peak"))
    spans = events.join(F.broadcast(detectors)).withColumn(W, F.concat_ws("/", "detector", F.col("flare_id").cast("string")))  # one row per detector
    return P.impulsive_series(spans, grid, ["detector"], W, "start", "peak", "k", "rate", "gti", 180)


@query("q1b_event_windows", "SELECT wid, j::INT AS j, n, round(y, 9) AS y FROM ev_win", "ev_win")
def _(t):
    return P.series_rows(rises(t), W, "y").withColumn("y", F.round("y", 9))


def event_tests(t):
    spectrum = P.spectrum_series(P.detrend_series(rises(t), W), W)
    return P.against_fit(P.spectrum_rows(P.fit_series(spectrum, W), W, "beta", "lr", "a"))


@query("q5b_event_significance", """
SELECT wid, count(*) AS nf, round(max(gamma), 3) AS gamma_max, round(min(p_global), 4) AS p_min, count(*) FILTER (gamma>crit) AS n_significant FROM ev_tested GROUP BY wid""", "ev_tested")
def _(t):
    return event_tests(t).groupBy(W).agg(
        F.count("*").alias("nf"), F.round(F.max("gamma"), 3).alias("gamma_max"), F.round(F.min("p_global"), 4).alias("p_min"),
        F.count_if(F.col("gamma") > F.col("crit")).alias("n_significant"),
    )
