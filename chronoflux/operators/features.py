"""Leakage-safe trailing feature matrix: every value is known at or before the row's time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.scalars import floor_div
from chronoflux.operators.grid import observed
from chronoflux.operators.joins import day_context
from chronoflux.operators.labels import max_class_ahead, peak_distances
from chronoflux.operators.rolling import (
    SHORT_FRAME,
    _trailing_native,
    hardness,
    poisson_sigma,
    rolling_mean,
    running_difference,
    threshold_crossings,
    trailing_change,
    trailing_counts,
    trailing_stats,
)
from chronoflux.operators.timeline import asof, at_positions, with_frames
from chronoflux.session import stage_table

STATS = ("mean", "std", "max")


def detector_features(
    grid: DataFrame, pos: str, detector: str, rate: str, gti: str, names: Sequence[str], windows: Mapping[str, int],
    short: int, long: str, step: int, size: int, soft: str, hard: str, ddt: Sequence[str],
) -> DataFrame:
    """Per-detector statistics, derivatives and hardness at every ``step``-th position, one row per position.

    The long (position, detector) form is kept through all frames; only the sampled rows
    are pivoted.
    """
    keys = [detector]
    rows = grid.select(detector, pos, observed(rate, gti).alias("x"))
    width = windows[long]
    half = {n: max(1, w // 2) for n, w in windows.items()}
    few = max(1, int(short * 0.3))
    if max(windows.values()) <= SHORT_FRAME:
        columns = {f"{s}_{n}": _trailing_native("x", s, w, half[n]) for n, w in windows.items() for s in STATS}
        columns["ma"] = _trailing_native("x", "mean", short, few)
        columns["bg"] = _trailing_native("x", "median", width, half[long])
        rows = with_frames(rows, keys, pos, columns, max(*windows.values(), short) - 1, 0, size)
        level = F.col("bg") + 3.0 * poisson_sigma("bg")
        above = F.when(F.col("x").isNotNull(), F.coalesce(F.col("x") > level, F.lit(False)).cast("double"))
        rows = rows.withColumn("__above", above)
        lags = {f"ma_lag_{n}": (lambda w_: lambda w: F.lag("ma", w_).over(w))(windows[n]) for n in ddt}
        second = {"xcross": _trailing_native("__above", "sum", width, half[long]), **lags}
        rows = with_frames(rows, keys, pos, second, width, 0, size).drop("__above")
    else:
        rows = trailing_stats(rows, keys, pos, "x", windows, size, STATS)
        rows = rolling_mean(rows, keys, pos, "x", "ma", short - 1, 0, few, size)
        rows = trailing_stats(rows, keys, pos, "x", {"bg": width}, size, ["median"]).withColumnRenamed("median_bg", "bg")
        rows = threshold_crossings(rows, keys, pos, "x", width, size, "xcross")
        lags = {f"ma_lag_{n}": (lambda w_: lambda w: F.lag("ma", w_).over(w))(windows[n]) for n in ddt}
        rows = with_frames(rows, keys, pos, lags, width, 0, size)
    rows = rows.filter(F.pmod(F.col(pos), F.lit(step)) == 0)
    kept = [f"{s}_{n}" for n in windows for s in STATS] + ["xcross"]
    helpers = ["ma", "bg", *[f"ma_lag_{n}" for n in ddt]]
    wide = rows.groupBy(pos).pivot(detector, list(names)).agg(*[F.first(c).alias(c) for c in (*kept, *helpers)])
    out = [F.col(pos)]
    out += [F.col(f"{d}_{c}") for d in names for c in kept]
    out.append(F.col(f"{hard}_ma").alias("hard_rate"))
    out.append((F.col(f"{hard}_ma") - F.col(f"{hard}_bg")).alias("hard_bgsub"))
    out += [((F.col(f"{soft}_ma") - F.col(f"{soft}_ma_lag_{n}")) / windows[n]).alias(f"soft_ddt_{n}") for n in ddt]
    now = hardness(f"{hard}_ma", f"{soft}_ma")
    mid = ddt[len(ddt) // 2]
    then = hardness(f"{hard}_ma_lag_{mid}", f"{soft}_ma_lag_{mid}")
    out += [now.alias("hardness_ratio"), ((now - then) / windows[mid]).alias("hardness_ddt")]
    seen = F.lit(False)
    first = next(iter(windows))
    for d in names:
        seen = seen | F.col(f"{d}_mean_{first}").isNotNull()
    out.append(seen.alias("in_gti_any"))
    return wide.select(*out)


def event_features(
    rows: DataFrame, master: DataFrame, periodic: DataFrame, t: str, size: int,
    rates: Mapping[str, int], recent: int = 3600, regimes: Sequence[str] = ("classic", "intermediate", "short"),
) -> DataFrame:
    """Detection history (age, strength, trailing counts) and periodicity history per regime.

    ``master`` has (t, rate, n_detectors, id); ``periodic`` has (t, regime), one row per event.
    """
    at = rows.select(t).distinct()
    age = asof(at, master, [], t, "t_event", ["t_event", "rate", "n_detectors"], size, order=["id"], prefix="__e_").select(
        t, (F.col(t) - F.col("__e_t_event")).alias("time_since_last_det_s"), F.col("__e_rate").alias("last_det_peak_rate"),
        F.col("__e_n_detectors").alias("last_det_n_detectors"))
    counts = trailing_counts(at, master, [], t, "t_event", {f"det_rate_{n}": w for n, w in rates.items()}, size)
    # All regimes in one pass: flags per event time, summed over the same frame.
    marks = periodic.groupBy(F.col("t_event").cast("bigint").alias("__pos")).agg(
        F.count("*").alias("__all"), *[F.count_if(F.col("regime") == r).alias(f"__{r}") for r in regimes]
    )
    def build(c: str):
        return lambda w: F.coalesce(running_difference(F.sum(c), w, recent - 1, 0), F.lit(0))
    frames = {"qpp_count": build("__all"), **{f"qpp_count_{r}": build(f"__{r}") for r in regimes}}
    recent_signals = at_positions(at, marks, [], t, frames, recent - 1, 0, size)
    recent_signals = recent_signals.withColumn("qpp_present", (F.col("qpp_count") > 0).cast("int"))
    return beside(rows, t, age, counts, recent_signals)


def beside(rows: DataFrame, t: str, *parts: DataFrame) -> DataFrame:
    """Join features worked out per time, side by side, so that no plan nests in another."""
    for part in parts:
        rows = rows.join(part, t, "left")
    return rows


def feature_matrix(
    grid: DataFrame, pos: str, cell: int, names: Sequence[str], windows: Mapping[str, int], short: int, long: str,
    step: int, size: int, soft: str, hard: str, ddt: Sequence[str], master: DataFrame, periodic: DataFrame,
    daily: DataFrame, context: Sequence[str], catalogue: DataFrame, event_size: int, rates: Mapping[str, int],
) -> DataFrame:
    """All feature groups and the aligned targets; lineage is cut after each big stage."""
    rows = detector_features(grid, pos, "detector", "rate", "gti", names, windows, short, long, step, size, soft, hard, ddt)
    rows = stage_table(rows.withColumn("t", F.col(pos) * cell))
    rows = event_features(rows, master, periodic, "t", event_size, rates)
    rows = stage_table(rows)
    lagged = daily.select("day_no", *[F.col(c).alias(f"{c}_lag1") for c in context])
    rows = day_context(rows, lagged, "t", [f"{c}_lag1" for c in context], 1)
    at = rows.select("t").distinct()
    ahead = peak_distances(at, catalogue, "t", event_size).drop("time_to_next_peak", "time_since_last_peak")
    ahead = ahead.withColumnsRenamed({f"flare_in_next_{h}min": f"y_{h}min" for h in (15, 30, 60)})
    best = max_class_ahead(at, catalogue, "t", 1800, event_size).withColumnRenamed("max_class", "y_class30")
    rows = beside(rows, "t", ahead, best)
    return rows.withColumn("day_no", floor_div("t", 86400))


# --- train-only statistics -------------------------------------------------------
def response_slope(rows: DataFrame, hard: str, ddt: str, train, minimum: int = 100) -> DataFrame:
    """One-row OLS slope of the hard rate on rising soft flux in the training rows, 0 if too few."""
    ok = train & F.col(hard).isNotNull() & (F.col(ddt) > 0)
    return rows.filter(ok).agg(
        F.count("*").alias("n"), F.when(F.count("*") >= minimum, F.regr_slope(hard, ddt)).otherwise(0.0).alias("slope")
    )


def response_residual(rows: DataFrame, slope: DataFrame, hard: str, ddt: str, out: str) -> DataFrame:
    return rows.join(F.broadcast(slope.select("slope"))).withColumn(out, F.col(hard) - F.col("slope") * F.col(ddt)).drop("slope")


def standardise(rows: DataFrame, columns: Sequence[str], train) -> DataFrame:
    """(x - mean) / spread with training statistics; no spread counts as 1, missing values become the mean."""
    stats = rows.filter(train).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns]
    )
    out = rows.join(F.broadcast(stats))
    scaled = {}
    for c in columns:
        spread = F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
        scaled[c] = F.coalesce((F.col(c) - F.col(f"__m_{c}")) / spread, F.lit(0.0))
    return out.withColumns(scaled).drop(*[f"__{p}_{c}" for c in columns for p in "ms"])


def subsample_negatives(rows: DataFrame, y: str, key: str, factor: int = 4, cells: int = 4096) -> DataFrame:
    """All positives and exactly ``factor`` times as many negatives, chosen by a hash of the key.

    Whole hash cells are taken up to the wanted number; only the one cell at the border
    is ranked, so no global sort is needed.
    """
    h = F.pmod(F.pmod(F.col(key), F.lit(2147483648)) * F.lit(2654435761), F.lit(4294967296))  # the product stays below 2^63
    marked = rows.withColumn("__h", h).withColumn("__cell", floor_div("__h", 4294967296 // cells))
    counts = marked.groupBy("__cell").agg(F.count_if(F.col(y) == 0).alias("__n"), F.count_if(F.col(y) == 1).alias("__p"))
    w = Window.partitionBy(F.lit(0))  # one row per cell
    counts = counts.select(
        "__cell", (F.sum("__p").over(w) * factor).alias("__want"),
        (F.sum("__n").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"), "__n",
    )
    placed = marked.join(F.broadcast(counts), "__cell")
    negative = F.col(y) == 0
    inside = F.col("__before") + F.col("__n") <= F.col("__want")
    border = ~inside & (F.col("__before") < F.col("__want"))
    sure = placed.filter(~negative | (negative & inside))
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__h", key))
    rest = placed.filter(negative & border).withColumn("__r", rank).filter(F.col("__before") + F.col("__r") <= F.col("__want")).drop("__r")
    return sure.unionByName(rest).drop("__h", "__cell", "__want", "__before", "__n")
