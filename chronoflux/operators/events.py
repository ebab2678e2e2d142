"""Event extraction from excess series, and fusion of detections across series.

Runs of high excess are gaps-and-islands; everything per event is one bounded range
join plus conditional aggregates. A run never crosses the reset period that is part
of ``keys`` (the day, for second data), which bounds the groups of the two steps that
look at a whole run (peak spacing and prominence).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoflux.operators.timeline import asof, carry_forward, gap_runs, range_join, with_frames
from chronoflux.session import stage_table

LOWEST = -1e308
BUCKET = 3600  # positions per bucket of the event x sample joins


def persistence_runs(
    df: DataFrame, keys: Sequence[str], pos: str, flag: Column, minimum: int, size: int | None = None
) -> DataFrame:
    """(keys, run_start, run_end) of unbroken flagged runs of at least ``minimum`` cells; end exclusive."""
    hits = gap_runs(df.filter(flag).select(*keys, pos), keys, pos, 1, size, out="run_start")
    return (
        hits.groupBy(*keys, "run_start")
        .agg((F.max(pos) + 1).alias("run_end"), F.count("*").alias("__n"))
        .filter(F.col("__n") >= minimum).drop("__n")
    )


def merge_runs(runs: DataFrame, keys: Sequence[str], link_gap: int, size: int | None = None) -> DataFrame:
    """Merge runs whose start is at most ``link_gap`` after the previous exclusive end."""
    linked = gap_runs(runs, keys, "run_start", link_gap, size, end="run_end", out="__m")
    return linked.groupBy(*keys, "__m").agg(F.max("run_end").alias("run_end")).withColumnRenamed("__m", "run_start")


def rows_in_runs(runs: DataFrame, df: DataFrame, keys: Sequence[str], pos: str, bucket: int = BUCKET) -> DataFrame:
    """The grid rows of every run; ``keys`` may hold fewer columns than the runs carry."""
    closed = runs.withColumn("__last", F.col("run_end") - 1)
    return range_join(closed, df, keys, "run_start", "__last", pos, bucket).drop("__last")


def first_argmax(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Position of the first largest value per group, and the value."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col(pos)).alias("n"))))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, (-F.col("__b.n")).alias("peak"), F.col("__b.v").alias("height"))


def local_maxima(df: DataFrame, run_keys: Sequence[str], pos: str, value: str, size: int | None = None) -> DataFrame:
    """Strict local maxima of every run; a plateau counts at its middle, run ends never do."""
    rows = df.withColumn("__v", F.coalesce(value, F.lit(LOWEST)))
    rows = with_frames(
        rows, run_keys, pos,
        {"__before": lambda w: F.lag("__v").over(w), "__after": lambda w: F.lead("__v").over(w)},
        1, 1, size,
    )
    begins = F.when(F.col("__before").isNull() | (F.col("__before") != F.col("__v")), F.col(pos))
    rows = carry_forward(rows, run_keys, pos, {"__flat": begins}, size)
    flats = rows.groupBy(*run_keys, "__flat").agg(
        F.max(pos).alias("__last"), F.first("__v").alias("height"),
        F.min_by("__before", pos).alias("__b"), F.max_by(F.struct("__after"), pos).alias("__a"),
    )
    return flats.filter((F.col("__b") < F.col("height")) & (F.col("__a.__after") < F.col("height"))).select(
        *run_keys, F.floor((F.col("__flat") + F.col("__last")) / 2).cast("bigint").alias("peak"), "height"
    )


def spaced_peaks(peaks: DataFrame, run_keys: Sequence[str], distance: int, size: int | None = None) -> DataFrame:
    """Highest first (later first among equals), drop peaks closer than ``distance`` to a kept one.

    Peaks at least ``distance`` apart never interact, so the fold runs inside chains of
    close peaks only.
    """
    if distance <= 1:
        return peaks
    chains = gap_runs(peaks, run_keys, "peak", distance - 1, size, out="__chain")
    entry = F.struct((-F.col("height")).alias("h"), (-F.col("peak")).alias("p"))
    ordered = F.array_sort(F.collect_list(entry))
    empty = F.array().cast("array<struct<h:double,p:bigint>>")
    kept = F.aggregate(
        ordered, empty,
        lambda acc, x: F.when(
            F.exists(acc, lambda k: F.abs(k["p"] - x["p"]) < distance), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return (
        chains.groupBy(*run_keys, "__chain").agg(kept.alias("__kept"))
        .select(*run_keys, F.explode("__kept").alias("__k"))
        .select(*run_keys, (-F.col("__k.p")).alias("peak"), (-F.col("__k.h")).alias("height"))
    )


def _prominences(values: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height above the higher of the two lowest points before higher ground."""
    def base(v: np.ndarray) -> np.ndarray:
        lows = np.empty(len(v))
        stack: list[tuple[float, float]] = []  # (value, lowest since the previous entry)
        for i, x in enumerate(v):
            low = x
            while stack and stack[-1][0] <= x:
                low = min(low, stack.pop()[1])
            lows[i] = low
            stack.append((x, low))
        return lows
    left = base(values)
    right = base(values[::-1])[::-1]
    return values[peaks] - np.maximum(left[peaks], right[peaks])


def prominent_peaks(
    peaks: DataFrame, df: DataFrame, run_keys: Sequence[str], pos: str, value: str, minimum: float
) -> DataFrame:
    """Keep peaks standing at least ``minimum`` above the surrounding low points of their run."""
    rows = df.select(*run_keys, pos, F.coalesce(value, F.lit(LOWEST)).alias("__v"))
    marked = rows.join(
        peaks.select(*run_keys, F.col("peak").alias(pos), "height"), [*run_keys, pos], "left"
    )
    schema = T.StructType([
        *[f for f in df.schema.fields if f.name in run_keys],
        T.StructField("peak", T.LongType()), T.StructField("height", T.DoubleType()),
        T.StructField("prominence", T.DoubleType()),
    ])

    def per_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        at = np.flatnonzero(pdf["height"].notna().to_numpy())
        out = pdf.iloc[at]
        out = out.assign(peak=out[pos], prominence=_prominences(pdf["__v"].to_numpy(), at))
        return out[[f.name for f in schema.fields]]

    # Runs without a candidate need no visit.
    with_peak = peaks.select(*run_keys).distinct()
    found = marked.join(with_peak, list(run_keys), "left_semi").groupBy(*run_keys).applyInPandas(per_run, schema)
    return found.filter(F.col("prominence") >= minimum)


def _run_peaks(values: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Peak offsets of one run: local maxima, spaced, prominent; else the first largest value."""
    edges = np.flatnonzero(np.diff(values) != 0)
    first = np.concatenate(([0], edges + 1))
    last = np.concatenate((edges, [len(values) - 1]))
    level = values[first]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (first[inner] + last[inner]) // 2
    kept: list[int] = []
    for p in sorted(peaks, key=lambda i: (-values[i], -i)):
        if all(abs(p - other) >= distance for other in kept):
            kept.append(p)
    found = np.array(sorted(kept), dtype=np.int64)
    if len(found):
        found = found[_prominences(values, found) >= prominence]
    return found if len(found) else np.array([int(np.argmax(values))])


def peaks_in_runs(
    rows: DataFrame, run_keys: Sequence[str], pos: str, value: str, distance: int, prominence: float,
) -> DataFrame:
    """Peaks of every run in one shuffle of the run rows, with the bounds towards their neighbours.

    Same result as local_maxima, spaced_peaks and prominent_peaks in turn, with a first
    largest value for runs that have no peak. The last run key must be the exclusive end.
    """
    start, end = run_keys[-2:]
    fields = [f for f in rows.schema.fields if f.name in run_keys]
    schema = T.StructType([
        *fields, *[T.StructField(n, T.LongType()) for n in ("peak", "left_bound", "right_bound")]
    ])

    def per_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        at = _run_peaks(pdf[value].fillna(LOWEST).to_numpy(), distance, prominence)
        out = pdf.iloc[at][[f.name for f in fields]].copy()
        peak = pdf[pos].to_numpy()[at]
        out["peak"] = peak
        out["left_bound"] = np.concatenate(([out[start].iloc[0]], peak[:-1]))
        out["right_bound"] = np.concatenate((peak[1:], [out[end].iloc[0] - 1]))
        return out

    return rows.select(*run_keys, pos, value).groupBy(*run_keys).applyInPandas(per_run, schema)


def valley_bounds(
    peaks: DataFrame, df: DataFrame, keys: Sequence[str], pos: str, smoothed: str, edge: int, bucket: int = BUCKET
) -> DataFrame:
    """First lowest smoothed value on each side of the peak, at most ``edge`` cells away."""
    reach = peaks.withColumn("__lo", F.greatest(F.col("left_bound"), F.col("peak") - edge)).withColumn(
        "__hi", F.least(F.col("right_bound"), F.col("peak") + edge)
    )
    rows = df.select(*keys, pos, F.col(smoothed).alias("__sm"))
    near = range_join(reach, rows, keys, "__lo", "__hi", pos, bucket)
    low = F.struct(F.col("__sm").alias("v"), F.col(pos).alias("p"))
    seen = F.col("__sm").isNotNull()
    columns = [c for c in peaks.columns]
    out = near.groupBy(*columns).agg(
        F.min(F.when(seen & (F.col(pos) <= F.col("peak")), low)).alias("__l"),
        F.min(F.when(seen & (F.col(pos) >= F.col("peak")), low)).alias("__r"),
    )
    return out.select(
        *columns, F.coalesce("__l.p", "peak").alias("start"), F.coalesce("__r.p", "peak").alias("end")
    )


def event_attributes(
    bounded: DataFrame, df: DataFrame, keys: Sequence[str], pos: str, rate: str, gti: str,
    sep: int, pre: int, min_duration: int, bucket: int = BUCKET,
) -> DataFrame:
    """Refine each peak on the raw rate and measure the event, in one range join.

    The raw-rate peak is the first largest value within ``sep`` of the excess peak and
    inside the event; the pre-event level is the median of in-GTI rates of the ``pre``
    cells before the start.
    """
    long_enough = bounded.filter(F.col("end") - F.col("start") >= min_duration)
    reach = long_enough.withColumn("__lo", F.col("start") - pre)
    rows = df.select(
        *keys, pos, F.col(rate).alias("__rate"), F.col(gti).alias("__gti"), F.col("smoothed").alias("__sm"),
        F.col("excess").alias("__ex"), F.col("background").alias("__bg"),
    )
    columns = bounded.columns
    near = range_join(reach, rows, keys, "__lo", "end", pos, bucket)
    p = F.col(pos)
    in_event = p >= F.col("start")
    by_peak = in_event & (F.abs(p - F.col("peak")) <= sep) & F.col("__rate").isNotNull()
    best = F.max(F.when(by_peak, F.struct(F.col("__rate").alias("v"), (-p).alias("n"))))
    steps = F.array_sort(F.collect_list(F.when(in_event, F.struct(p.alias("p"), F.col("__sm").alias("s")))))
    out = near.groupBy(*columns).agg(
        best.alias("__best"),
        F.percentile(F.when(~in_event & F.col("__gti"), F.col("__rate")), 0.5).alias("__pre"),
        F.count_if(~in_event & F.col("__gti")).alias("__npre"),
        F.max(F.when(p == F.col("start"), F.col("__bg"))).alias("__bg0"),
        F.max(F.when(in_event, F.col("__ex"))).alias("max_significance"),
        F.max(F.when(p == F.col("peak"), F.struct(F.col("__rate").alias("v")))).alias("__at_peak"),
        steps.alias("__steps"),
    )
    refined = F.coalesce(-F.col("__best.n"), F.col("peak"))
    out = out.withColumn("__new", refined).withColumn("peak_rate", F.coalesce("__best.v", "__at_peak.v"))
    level = F.when(F.col("__npre") > 0, F.col("__pre")).otherwise(F.col("__bg0"))
    out = out.withColumn("preflare_bg", F.coalesce(level, F.lit(0.0)))
    # Rise slopes need neighbours: compare the sorted rise with itself shifted by one.
    rise = F.filter("__steps", lambda s: s["p"] <= F.col("__new"))
    slopes = F.zip_with(
        F.slice(rise, 2, F.greatest(F.size(rise), F.lit(1))), rise,
        lambda b, a: b["s"] - a["s"],
    )
    out = out.withColumn("__rise", slopes)
    keep = [c for c in columns if c not in ("peak", "height", "left_bound", "right_bound")]
    return out.select(
        *keep, F.col("__new").alias("peak"), (F.col("end") - F.col("start")).alias("duration"),
        "peak_rate", "preflare_bg", (F.col("peak_rate") - F.col("preflare_bg")).alias("peak_bgsub"),
        "max_significance", F.greatest(F.lit(0), F.col("__new") - F.col("start")).alias("rise_time"),
        F.when(F.col("__new") > F.col("start"), F.array_max("__rise")).otherwise(F.lit(0.0)).alias("max_derivative"),
    )


def detect_from_excess(
    ex: DataFrame, keys: Sequence[str], pos: str, rate: str, gti: str, thresholds: Sequence[float],
    min_run: int, link_gap: int, edge: int, sep: int, prominence: float, pre: int, min_duration: int,
    size: int | None = None, bucket: int = BUCKET,
) -> DataFrame:
    """Events at every threshold from one excess table (columns of compute_excess).

    Rows are copied only to the thresholds they reach, so a sweep costs what its
    detections cost and not a full copy of the grid per threshold.
    """
    keys = list(keys)
    steps = F.array(*[F.lit(float(x)) for x in thresholds])
    reached = F.filter(steps, lambda x: x <= F.col("excess"))
    hits = ex.filter(F.col(gti) & (F.col("excess") >= min(thresholds))).select(*keys, pos, F.explode(reached).alias("thr"))
    swept = [*keys, "thr"]
    runs = persistence_runs(hits, swept, pos, F.lit(True), min_run, size)
    runs = merge_runs(runs, swept, link_gap, size)
    rows = rows_in_runs(runs, ex.select(*keys, pos, "excess"), keys, pos, bucket)
    run_keys = [*swept, "run_start", "run_end"]
    peaks = peaks_in_runs(rows, run_keys, pos, "excess", sep, prominence)
    bounded = valley_bounds(peaks, ex, keys, pos, "smoothed", edge, bucket)
    return event_attributes(bounded, ex, keys, pos, rate, gti, sep, pre, min_duration, bucket)


# --- fusion across series ---------------------------------------------------
def link_clusters(
    df: DataFrame, keys: Sequence[str], pos: str, order: str, window: int, span: int, size: int | None, out: str = "anchor"
) -> DataFrame:
    """Bounded single linkage: join while the gap is at most ``window`` and the distance
    to the first member at most ``span``.

    A gap above ``window`` always starts a cluster. An island of linked positions that is
    no longer than ``span`` is one cluster; the anchors of longer ones follow from the
    start by pointers to the first position beyond ``span``, which are doubled. The anchor
    depends on the position only: it is found per distinct position and joined back, so
    rows that share a position never gather in one task.
    """
    keys = list(keys)
    points = df.select(*keys, F.col(pos).cast("bigint").alias(pos)).distinct()
    part = [*keys, "__isl"]
    islands = stage_table(gap_runs(points, keys, pos, window, size, out="__isl"))
    long = islands.groupBy(*part).agg(F.max(pos).alias("__last")).filter(F.col("__last") - F.col("__isl") > span).select(*part)
    hot = stage_table(islands.join(long, part, "left_semi"))
    starts = _double_pointers(hot, keys, pos, span, size)
    marked = asof(hot, starts, part, pos, "__a", ["__a"], size, prefix="__at").select(*keys, pos, "__at__a")
    anchors = islands.join(marked, [*keys, pos], "left").select(*keys, pos, F.coalesce("__at__a", "__isl").alias(out))
    return df.join(anchors, [*keys, pos]).select(*df.columns, out)


def _double_pointers(points: DataFrame, keys: list[str], pos: str, span: int, size: int) -> DataFrame:
    """Cluster anchors (keys..., __isl, __a) of large islands, in logarithmically many rounds.

    If p is an anchor, the next one is the first position beyond p + span. Doubling that
    pointer reaches all anchors of an island from its start.
    """
    part = [*keys, "__isl"]
    starts = points.select(*part, (F.col(pos) + span).alias("__from"), F.col(pos).alias("__p"))
    jumps = asof(starts, points.withColumnRenamed(pos, "__q"), part, "__from", "__q", ["__q"], size, "forward", strict=True, prefix="__n")
    jumps = stage_table(jumps.filter(F.col("__n__q").isNotNull()).select(*part, "__p", F.col("__n__q").alias("__to")))
    reached = stage_table(points.groupBy(*part).agg(F.min(pos).alias("__p")))
    while not jumps.isEmpty():
        further = reached.join(jumps, [*part, "__p"]).select(*part, F.col("__to").alias("__p"))
        reached = stage_table(reached.unionByName(further).distinct())
        second = jumps.select(*part, F.col("__p").alias("__to"), F.col("__to").alias("__far"))
        jumps = stage_table(jumps.join(second, [*part, "__to"]).select(*part, "__p", F.col("__far").alias("__to")))
    return reached.withColumnRenamed("__p", "__a")


def fuse_clusters(df: DataFrame, keys: Sequence[str], anchor: str, n_series: int = 5) -> DataFrame:
    """One row per cluster: median peak, outer bounds, members, detectors, confidence.

    ``member_peaks`` are the distinct peak positions in order and ``member_counts`` their
    numbers of members. A cluster's span bounds both, however many detections share a
    position; the median is read from the running counts.
    """
    part = [*keys, anchor]
    per_series = df.groupBy(*part, "detector").agg(
        F.max("max_significance").alias("sig"), F.min("start_t").alias("s"), F.max("end_t").alias("e"),
        F.max("peak_rate").alias("rate"), F.count("*").alias("n"),
    )
    fused = per_series.groupBy(*part).agg(
        F.min("s").alias("master_start"), F.max("e").alias("master_end"),
        F.count("*").alias("n_detectors"), F.sum("n").alias("n_members"),
        F.array_join(F.array_sort(F.collect_list("detector")), ",").alias("detectors"),
        F.max("sig").alias("max_significance"), F.max("rate").alias("peak_rate_max"),
        F.exp(F.avg(F.log(F.greatest("sig", F.lit(1e-6))))).alias("__g"),
    )
    places = df.groupBy(*part, "peak_t").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*part)
    places = places.select(*part, "peak_t", "n", F.sum("n").over(w.orderBy("peak_t")).alias("upto"), F.sum("n").over(w).alias("all"))
    at_rank = lambda k: F.min(F.when(F.col("upto") > F.floor(k), F.col("peak_t")))
    members = places.groupBy(*part).agg(
        F.array_sort(F.collect_list(F.struct("peak_t", "n"))).alias("m"),
        at_rank((F.col("all") - 1) / 2).alias("low"), at_rank(F.col("all") / 2).alias("high"),
    )
    return fused.join(members, part).select(
        *part, F.floor((F.col("low") + F.col("high")) / 2).cast("bigint").alias("master_peak"), "master_start", "master_end",
        "n_detectors", "n_members", "detectors", F.col("m.peak_t").alias("member_peaks"), F.col("m.n").alias("member_counts"),
        "max_significance", "peak_rate_max", (F.col("n_detectors") / float(n_series) * F.col("__g")).alias("confidence"),
    )
