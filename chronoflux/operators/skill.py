"""Skill scores, calibration measures and their uncertainty, all from additive counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.operators.matching import greedy_match
from chronoflux.operators.rolling import trailing_counts
from chronoflux.operators.timeline import asof, exact_quantiles, flag_runs
from chronoflux.session import stage_table

MATCH_BIN = 360


def ratio(num: Column, den: Column) -> Column:
    """num / den, zero where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def contingency(df: DataFrame, keys: Sequence[str], obs: Column, pred: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(obs & pred).alias("tp"), F.count_if(~obs & pred).alias("fp"),
        F.count_if(obs & ~pred).alias("fn"), F.count_if(~obs & ~pred).alias("tn"),
    )


def scores(df: DataFrame, digits: int | None = None) -> DataFrame:
    """POD, FAR, POFD, precision, TSS and HSS from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    pod, pofd = ratio(tp, tp + fn), ratio(fp, fp + tn)
    hss = ratio(2 * (tp * tn - fp * fn), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    made = {"pod": pod, "far": ratio(fp, tp + fp), "pofd": pofd, "precision": ratio(tp, tp + fp),
            "tss": pod - pofd, "hss": hss}
    return df.withColumns({n: F.round(c, digits) if digits is not None else c for n, c in made.items()})


def true_negatives(gti_seconds: Column, n_catalogue: Column, fp: Column, bin_s: int = MATCH_BIN) -> Column:
    """Quiet opportunities (good time in bins, less the catalogue) minus false alarms, not below 0."""
    bins = F.floor(gti_seconds / bin_s)
    free = F.greatest(F.lit(0).cast("bigint"), bins - n_catalogue)
    return F.greatest(F.lit(0).cast("bigint"), free - fp)


def score_bins(
    good: DataFrame, observed: DataFrame, predicted: DataFrame, t: str, obs_t: str, pred_t: str,
    bin_s: int, cell_s: int, size: int | None, share: float = 0.5,
) -> DataFrame:
    """Fixed bins where any series observes more than ``share`` of the time, with flags and segments.

    ``good`` has one row per grid second (or cell of ``cell_s``) and series inside good time.
    Segments are runs of valid bins that do not cross the day.
    """
    per_cell = good.select(t).distinct()
    bins = per_cell.groupBy(F.floor(F.col(t) / bin_s).alias("bin")).agg(
        (F.count("*") * cell_s / bin_s).alias("share")
    ).filter(F.col("share") > share)
    def marks(df: DataFrame, c: str, out: str) -> DataFrame:
        return df.select(F.floor(F.col(c) / bin_s).alias("bin")).distinct().withColumn(out, F.lit(True))
    rows = bins.join(marks(observed, obs_t, "obs"), "bin", "left").join(marks(predicted, pred_t, "pred"), "bin", "left")
    rows = rows.select(
        "bin", F.floor(F.col("bin") * bin_s / 86400).alias("day_no"),
        F.coalesce("obs", F.lit(False)).alias("obs"), F.coalesce("pred", F.lit(False)).alias("pred"),
    )
    return flag_runs(rows, ["day_no"], "bin", F.lit(True), size, "segment")


def climatology_contingency(df: DataFrame, keys: Sequence[str], obs: Column) -> DataFrame:
    """Expected counts of a random forecast at the base rate, rounded half to even."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(obs).alias("n_pos"))
    rate = F.col("n_pos") / F.col("n")
    n_neg = F.col("n") - F.col("n_pos")
    return c.select(
        *keys, F.rint(rate * F.col("n_pos")).cast("bigint").alias("tp"), F.rint(rate * n_neg).cast("bigint").alias("fp"),
        (F.col("n_pos") - F.rint(rate * F.col("n_pos")).cast("bigint")).alias("fn"),
        (n_neg - F.rint(rate * n_neg).cast("bigint")).alias("tn"),
    )


# --- thresholds ---------------------------------------------------------------
def threshold_table(df: DataFrame, keys: Sequence[str], score: str, obs: Column, qs: Sequence[float]) -> DataFrame:
    """Contingency of "score >= thr" at the distinct quantiles of the score.

    The at most ``len(qs)`` thresholds per group form one array; every row falls between
    two of them, so a single counting pass and a cumulation over them suffices.
    """
    keys = list(keys)
    by = keys or ["__g"]
    base = df.withColumn("__g", F.lit(0)) if not keys else df
    # Read five times below: a narrow stage spares recomputing what made the scores.
    base = stage_table(base.select(*by, score, obs.alias("__y")))
    grid = exact_quantiles(base, by, score, qs).groupBy(*by).agg(
        F.array_sort(F.collect_set("quantile")).alias("__t")
    )
    placed = base.join(grid if keys else F.broadcast(grid), by).withColumn(
        "__i", F.size(F.filter("__t", lambda x: x <= F.col(score)))
    )
    counts = placed.groupBy(*by, "__i").agg(F.count_if("__y").alias("__p"), F.count_if(~F.col("__y")).alias("__n"))
    steps = grid.select(*by, F.posexplode("__t").alias("__k", "thr")).select(
        *by, (F.col("__k") + 1).alias("__i"), "thr"
    )
    zero = grid.select(*by, F.lit(0).alias("__i"), F.lit(None).cast("double").alias("thr"))
    rows = steps.unionByName(zero).join(counts, [*by, "__i"], "left").fillna(0, ["__p", "__n"])
    w = Window.partitionBy(*by).orderBy("__i")
    above = w.rowsBetween(0, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        *by, "thr", F.sum("__p").over(above).alias("tp"), F.sum("__n").over(above).alias("fp"),
        F.sum("__p").over(whole).alias("__P"), F.sum("__n").over(whole).alias("__N"),
    ).filter(F.col("thr").isNotNull())
    return rows.select(
        *keys, "thr", "tp", "fp", (F.col("__P") - F.col("tp")).alias("fn"), (F.col("__N") - F.col("fp")).alias("tn")
    )


QUANTILE_GRID = tuple(round(i / 100, 2) for i in range(1, 100))


def best_threshold(df: DataFrame, keys: Sequence[str], score: str, obs: Column, qs: Sequence[float] = QUANTILE_GRID) -> DataFrame:
    """The lowest of the thresholds with the highest TSS."""
    table = scores(threshold_table(df, keys, score, obs, qs))
    best = F.max(F.struct(F.col("tss"), (-F.col("thr")).alias("n")))
    return table.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, (-F.col("__b.n")).alias("threshold"), F.col("__b.tss").alias("tss")
    )


def operating_points(df: DataFrame, keys: Sequence[str], score: str, obs: Column, precision: float = 0.40) -> DataFrame:
    """watch = best TSS; warning = lowest threshold from there on with the wanted precision."""
    watch = best_threshold(df, keys, score, obs).withColumnRenamed("threshold", "watch").drop("tss")
    upper = [0.5 + i * 0.499 / 199 for i in range(200)]
    table = scores(threshold_table(df, keys, score, obs, upper))
    on = list(keys)
    joined = table.join(watch, on) if on else table.join(F.broadcast(watch))
    good = joined.filter((F.col("thr") >= F.col("watch")) & (F.col("precision") >= precision) & (F.col("pod") > 0))
    warning = good.groupBy(*on, "watch").agg(F.min("thr").alias("warning"))
    return watch.join(warning, [*on, "watch"], "left").withColumn("warning", F.coalesce("warning", "watch"))


def class_recall(df: DataFrame, keys: Sequence[str], letter: str, hit: Column) -> DataFrame:
    return df.groupBy(*keys, letter).agg(F.count_if(hit).alias("hit"), F.count("*").alias("n")).withColumn(
        "recall", F.try_divide("hit", "n")
    )


def matched_events(
    detections: DataFrame, catalogue: DataFrame, keys: Sequence[str], det_pos: str, cat_pos: str, cat_id: str, tol: int, size: int
) -> DataFrame:
    """Catalogue rows with a ``matched`` flag; among equal times the first ids take the matches."""
    keys = list(keys)
    hits = greedy_match(detections, catalogue, keys, det_pos, cat_pos, tol, size).filter("side = 'cat'")
    hits = hits.select(*keys, F.col("t").alias(cat_pos), F.col("matched").alias("__m"))
    rank = F.row_number().over(Window.partitionBy(*keys, cat_pos).orderBy(cat_id))
    return catalogue.withColumn("__r", rank).join(hits, [*keys, cat_pos], "left").withColumn(
        "matched", F.coalesce(F.col("__r") <= F.col("__m"), F.lit(False))
    ).drop("__r", "__m")


# --- probabilities ---------------------------------------------------------------
def probability_bin(p: str, bins: int = 10) -> Column:
    """0 .. bins-1, with p = 1 in the last bin."""
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean forecast and observed frequency per bin; empty bins are kept with nulls."""
    keys = list(keys)
    found = df.groupBy(*keys, probability_bin(p, bins).alias("bin")).agg(
        F.avg(p).alias("mean_pred"), F.avg(y).alias("obs_freq"), F.count("*").alias("n")
    )
    spine = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(found, [*keys, "bin"], "left").fillna(0, ["n"])


def brier_and_ece(df: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = 10) -> DataFrame:
    keys = list(keys)
    per_bin = df.groupBy(*keys, probability_bin(p, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"),
        F.sum((F.col(p) - F.col(y)) ** 2).alias("se"),
    )
    return per_bin.groupBy(*keys).agg(
        (F.sum("se") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece")
    )


def bootstrap_draws(days: DataFrame, n_boot: int) -> DataFrame:
    """(b, day): ``n_boot`` resamples of the days with replacement, drawn by a hash of (b, i).

    The digest mixes its input, so draws of a resample and of different resamples are as
    good as independent, while a rerun, another engine or a lost executor gives the same.
    """
    numbered = days.select("day").distinct().withColumn(
        "i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")) - 1
    )
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    slots = numbered.withColumn("n", total).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "i").cast("binary")), 1, 12), 16, 10).cast("bigint")
    picks = slots.select("b", F.pmod(u, F.col("n")).alias("i"))
    return picks.join(numbered.select("i", "day"), "i").select("b", "day")


def daily_components(df: DataFrame, p: str, y: str, thr: float, bins: int = 10) -> DataFrame:
    """Additive per-day sums that determine TSS, FAR, Brier and ECE: one row per day and bin."""
    alarm, event = F.col(p) >= thr, F.col(y) == 1
    return df.groupBy("day", probability_bin(p, bins).alias("bin")).agg(
        F.count_if(event & alarm).alias("tp"), F.count_if(~event & alarm).alias("fp"),
        F.count_if(event & ~alarm).alias("fn"), F.count_if(~event & ~alarm).alias("tn"),
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"),
        F.sum((F.col(p) - F.col(y)) ** 2).alias("se"),
    )


def block_bootstrap(components: DataFrame, n_boot: int) -> DataFrame:
    """95 % intervals over day-block resamples: (metric, lo, hi)."""
    draws = bootstrap_draws(components, n_boot)
    per_bin = draws.join(components, "day").groupBy("b", "bin").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "n", "sp", "sy", "se")]
    )
    per_draw = per_bin.groupBy("b").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "n", "se")],
        F.sum(F.abs(F.col("sy") - F.col("sp"))).alias("gap"),
    )
    s = scores(per_draw).withColumn("brier", F.col("se") / F.col("n")).withColumn("ece", F.col("gap") / F.col("n"))
    long = s.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("tss", "far", "brier", "ece")])))
    return long.groupBy("metric").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))


def both_contingencies(counts: DataFrame, fused: DataFrame, main: str, broad: str, observed: DataFrame, digits: int | None = None) -> DataFrame:
    """Strict and catalogue-aware contingency with their scores: one row each.

    ``counts``: (tp, fn) of the match against the main catalogue, one row. Strictly every
    fused event without a main entry is a false alarm; aware ones without any entry are.
    """
    alarms = fused.agg(F.count_if(~F.col(main)).alias("strict"), F.count_if(~F.col(main) & ~F.col(broad)).alias("aware"))
    seconds = observed.agg(F.coalesce(F.sum("gti_seconds"), F.lit(0)).alias("gti_seconds"))
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("fp")) for k in ("strict", "aware")]))
    rows = alarms.select(kinds).join(F.broadcast(counts)).join(F.broadcast(seconds))
    tn = true_negatives(F.col("gti_seconds"), F.col("tp") + F.col("fn"), F.col("fp"))
    return scores(rows.withColumn("tn", tn), digits).select("kind", "tp", "fp", "fn", "tn", "pod", "far", "pofd", "precision", "tss", "hss")


def daily_event_components(catalogue: DataFrame, false_alarms: DataFrame, observed: DataFrame) -> DataFrame:
    """Additive per-day parts of the event contingency, for every observed day.

    ``catalogue``: (day, matched) per catalogue event; ``false_alarms``: (day) per detection
    that no catalogue explains; ``observed``: (day, gti_seconds).
    """
    hits = catalogue.groupBy("day").agg(F.count_if("matched").alias("tp"), F.count_if(~F.col("matched")).alias("fn"))
    alarms = false_alarms.groupBy("day").agg(F.count("*").alias("fp"))
    return observed.join(hits, "day", "left").join(alarms, "day", "left").fillna(0, ["tp", "fn", "fp"]).select("day", "tp", "fp", "fn", "gti_seconds")


def event_bootstrap(components: DataFrame, n_boot: int, bin_s: int = 360) -> DataFrame:
    """95 % interval of the event TSS over day-block resamples: one (metric, lo, hi) row."""
    draws = bootstrap_draws(components, n_boot)
    sums = draws.join(components, "day").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "gti_seconds")])
    tn = true_negatives(F.col("gti_seconds"), F.col("tp") + F.col("fn"), F.col("fp"), bin_s)
    return scores(sums.withColumn("tn", tn)).agg(
        F.lit("event_tss").alias("metric"), F.percentile("tss", 0.025).alias("lo"), F.percentile("tss", 0.975).alias("hi")
    )


# --- warnings and value ---------------------------------------------------------------
def lead_times(
    events: DataFrame, forecasts: DataFrame, peak: str, t: str, p: str, thresholds: Mapping[str, float],
    search: int, coverage: int, size: int,
) -> DataFrame:
    """First crossing of each threshold in [peak - search, peak]; coverage of the last ``coverage`` seconds.

    Every question is a probe row with its own kind; one forward as-of lookup keyed by
    kind answers them all.
    """
    columns = events.columns
    probe = lambda kind, back: F.struct(F.lit(kind).alias("__kind"), (F.col(peak) - back).alias("__from"))
    probes = events.select(
        F.struct(*columns).alias("__e"),
        F.inline(F.array(probe("coverage", coverage), *[probe(n, search) for n in thresholds])),
    )
    kinds = F.array(F.lit("coverage"), *[F.when(F.col(p) >= thr, F.lit(n)) for n, thr in thresholds.items()])
    alarms = forecasts.select(F.col(t).alias("__t"), F.explode(F.array_compact(kinds)).alias("__kind")).distinct()
    hits = asof(probes, alarms, ["__kind"], "__from", "__t", ["__t"], size, "forward", prefix="__a")
    found = F.when(F.col("__a__t") <= F.col(f"__e.{peak}"), F.col("__a__t"))
    out = hits.select("__e", "__kind", found.alias("__at")).groupBy("__e").agg(
        F.max(F.when(F.col("__kind") == "coverage", F.col("__at"))).isNotNull().alias("coverage"),
        *[F.max(F.when(F.col("__kind") == n, F.col("__at"))).alias(f"__at_{n}") for n in thresholds],
    )
    return out.select("__e.*", "coverage", *[
        F.round((F.col(f"__e.{peak}") - F.col(f"__at_{n}")) / 60.0, 1).alias(f"lead_{n}") for n in thresholds])


def lead_summary(leads: DataFrame, keys: Sequence[str], lead: str) -> DataFrame:
    v = F.col(lead)
    return leads.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(v).alias("warned"),
        F.count_if(v.isNull() & F.col("coverage")).alias("no_warning"),
        F.count_if(v.isNull() & ~F.col("coverage")).alias("no_coverage"),
        F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"),
        F.min(v).alias("shortest"), F.max(v).alias("longest"),
    )


def all_clear(
    targets: DataFrame, significant: DataFrame, forecasts: DataFrame, t: str, p: str, thr: float, size: int,
    quiet: int = 12 * 3600, window: int = 900,
) -> DataFrame:
    """Was the event preceded by quiet, and was it flagged in the last ``window`` seconds?"""
    rows = targets.withColumn("__s", F.col("start_t") - 1)
    rows = trailing_counts(rows, significant, [], "__s", "peak_t", {"n_prior": quiet}, size).drop("__s")
    rows = lead_times(rows, forecasts, "peak_t", t, p, {"alarm": thr}, window, window, size)
    return rows.withColumn("quiet", F.col("n_prior") == 0).withColumn("flagged", F.col("lead_alarm").isNotNull())


def relative_value(points: DataFrame, pod: str, pofd: str, base_rate: str, low: float = 0.01, high: float = 1.0, n: int = 300) -> DataFrame:
    """Richardson's cost-loss value of each operating point on geometric cost/loss ratios, clipped to [-1, 1]."""
    from chronoflux.functions.scalars import geometric_grid

    rows = points.withColumn("cl", F.explode(geometric_grid(low, high, n)))
    r, s, h, f = F.col("cl"), F.col(base_rate), F.col(pod), F.col(pofd)
    climate = F.least(r, s)
    forecast = f * r * (1 - s) + h * r * s + (1 - h) * s
    value = F.try_divide(climate - forecast, climate - s * r)
    return rows.withColumn("value", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def alert_level(p: str | Column, watch: float | Column, warning: float | Column, covered: Column | None = None) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    ok = p.isNotNull() if covered is None else covered & p.isNotNull()
    return F.when(~ok, "nocov").when(p >= warning, "warning").when(p >= watch, "watch").otherwise("quiet")


def drift_check(measured: DataFrame, frozen: DataFrame, on: str = "metric") -> DataFrame:
    """Measured against frozen values: within tolerance, or absent."""
    rows = frozen.join(measured, on, "left")
    ok = F.coalesce(F.abs(F.col("measured") - F.col("frozen")) <= F.col("tolerance"), F.lit(False))
    return rows.withColumn("ok", ok)


def assert_no_drift(checked: DataFrame) -> DataFrame:
    """Fails the job on the first row that drifted."""
    message = F.concat(F.lit("drifted: "), F.col("metric"))
    return checked.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
