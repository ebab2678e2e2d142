"""Supervision labels: which event owns a second, its phase, and what comes next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoflux.functions.scalars import floor_div, rank_letter
from chronoflux.operators.timeline import CHUNK, asof_both, at_positions, best_segments

HORIZON_CAP = 6 * 3600
# Phase precedence, highest wins.
PHASES = {"quiet": 0, "pre": 1, "flank": 2, "peak": 3}


def paint(
    grid: DataFrame, pieces: DataFrame, pos: str, cell: int, low: str, high: str, best: Column, out: str, size: int = 64
) -> DataFrame:
    """The largest ``best`` of the closed intervals [low, high] seconds at each grid cell, null without any.

    Overlapping intervals become disjoint segments of cells first (a sweep over their
    ends), so rows follow the intervals and not the cells they hold; each grid row then
    meets the segments of its own ``size`` cells.
    """
    segments = best_segments(pieces, [], F.ceil(F.col(low) / cell), F.floor(F.col(high) / cell), best, size)
    segments = segments.select(F.col(CHUNK).alias("__at"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("best").alias(out))
    here = (floor_div(pos, size) == F.col("__at")) & F.col(pos).between(F.col("__low"), F.col("__high"))
    return grid.join(segments, here, "left").drop("__at", "__low", "__high")


def active_events(grid: DataFrame, events: DataFrame, pos: str, cell: int = 1) -> DataFrame:
    """is_event, and the owner under overlap: highest class, then largest magnitude.

    An event without a class owns the row by id only, when no classed event is there.
    """
    by = F.struct("rnk", F.coalesce("mag", F.lit(-1.0)), "flare_id")
    owner = F.struct(by.alias("by"), "flare_id", "rnk", "letter", "mag")
    out = paint(grid, events, pos, cell, "start_t", "end_t", owner, "__own")
    classed = F.col("__own.rnk") > 0
    return out.select(
        *grid.columns, F.when(F.col("__own").isNotNull(), 1).otherwise(0).alias("is_flare"),
        F.col("__own.flare_id").alias("owner_id"), F.when(classed, F.col("__own.letter")).alias("owner_letter"),
        F.when(classed, F.col("__own.mag")).alias("owner_mag"),
    )


def phases(grid: DataFrame, events: DataFrame, pos: str, cell: int = 1, pre: int = 1800, peak_pad: int = 30) -> DataFrame:
    """quiet / pre / rise / peak / decay per row.

    peak beats rise and decay, those beat pre. Between rise and decay of overlapping
    events the higher class decides; within one event the later-painted decay cannot
    meet the rise.
    """
    s, p, e = F.col("start_t"), F.col("peak_t"), F.col("end_t")
    rank = F.struct("rnk", F.coalesce("mag", F.lit(-1.0)), "flare_id")
    def piece(level: int, name: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(name).alias("phase"),
                        low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"))
    pieces = events.withColumn("by", rank).select("by", F.inline(F.array(
        piece(1, "pre", s - pre, s - 1), piece(2, "rise", s, p - 1),
        piece(2, "decay", p + 1, e), piece(3, "peak", p - peak_pad, p + peak_pad),
    )))
    out = paint(grid, pieces, pos, cell, "lo", "hi", F.struct("level", "by", "phase"), "__b")
    return out.select(*grid.columns, F.coalesce("__b.phase", F.lit("quiet")).alias("phase"))


def peak_distances(
    grid: DataFrame, events: DataFrame, t: str, size: int, horizons_min: Sequence[int] = (15, 30, 60), cap: int = HORIZON_CAP
) -> DataFrame:
    """Seconds to the next and since the last peak (null beyond ``cap``) and "peak in (t, t + H]" flags."""
    peaks = events.select("peak_t").distinct()
    rows = asof_both(grid, peaks, [], t, "peak_t", ["peak_t"], size, strict_ahead=True, back="__l_", ahead="__n_")
    ahead = F.col("__n_peak_t") - F.col(t)
    behind = F.col(t) - F.col("__l_peak_t")
    flags = [
        F.when(ahead <= h * 60, 1).otherwise(0).alias(f"flare_in_next_{h}min") for h in horizons_min
    ]
    return rows.select(
        *grid.columns, F.when(ahead <= cap, ahead).alias("time_to_next_peak"),
        F.when(behind <= cap, behind).alias("time_since_last_peak"), *flags,
    )


def max_class_ahead(grid: DataFrame, events: DataFrame, t: str, window: int, size: int) -> DataFrame:
    """Highest class letter peaking in (t, t + window], null if none has a class."""
    marks = events.groupBy(F.col("peak_t").cast("bigint").alias("__pos")).agg(F.max("rnk").alias("__r"))
    frames = {"__m": lambda w: F.max("__r").over(w.rangeBetween(1, window))}
    out = at_positions(grid, marks, [], t, frames, 0, window, size)
    return out.select(*grid.columns, rank_letter("__m").alias("max_class"))


def buffered_slice(days: DataFrame, events: DataFrame, before: int = 6 * 3600, after: int = 6 * 3600) -> DataFrame:
    """Events each day needs: peaks from ``before`` the day's start to ``after`` its end."""
    reach = events.withColumn(
        "day_no", F.explode(F.sequence(floor_div(F.col("peak_t") - after, 86400), floor_div(F.col("peak_t") + before, 86400)))
    )
    # A peak exactly at the closing edge (day end + after) still belongs to the day.
    edge = events.filter((F.col("peak_t") - after) % 86400 == 0).withColumn(
        "day_no", floor_div(F.col("peak_t") - after, 86400) - 1
    )
    return reach.unionByName(edge).join(days.select("day_no"), "day_no", "left_semi")


def distribution(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Rows and share per category; the share is taken within ``keys``."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", 100.0 * F.col("n") / total)
