"""Gap-aware rolling statistics: smoothing, background, excess, trailing features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoflux.functions.frames import centred, min_periods
from chronoflux.operators.timeline import (
    RankTree,
    at_positions,
    exact_quantiles,
    flag_runs,
    floats,
    framed_chunks,
    home_rows,
    rolling_quantile,
    running_difference,
    sliding_sums,
    with_double,
    with_frames,
)
from chronoflux.session import stage_table

SHORT_FRAME = 64
SIGMA_FLOOR = 1.0


def rolling_mean(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, before: int, after: int,
    minimum: int, size: int | None, segment: Sequence[str] = (),
) -> DataFrame:
    """Null-skipping mean; constant work per row once the frame is long."""
    if before + after + 1 <= SHORT_FRAME:
        def build(w: WindowSpec) -> Column:
            frame = w.rangeBetween(-before, after)
            return min_periods(F.avg(value).over(frame), F.count(value).over(frame), minimum)
        return with_frames(df, keys, pos, {out: build}, before, after, size, segment)
    sums = sliding_sums(
        df, keys, pos, {"__sum": F.col(value), "__cnt": F.col(value).isNotNull().cast("bigint")},
        before, after, size, segment,
    )
    return sums.withColumn(
        out, min_periods(F.try_divide("__sum", "__cnt"), F.col("__cnt"), max(1, minimum))
    ).drop("__sum", "__cnt")


def boxcar(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, width: int, size: int | None) -> DataFrame:
    """Centred mean over ``width`` cells that needs a quarter of them."""
    before, after = centred(width)
    return rolling_mean(df, keys, pos, value, out, before, after, max(1, width // 4), size)


def dilate(df: DataFrame, keys: Sequence[str], pos: str, flag: str, out: str, pad: int, size: int | None) -> DataFrame:
    """Grow a flag by ``pad`` cells on both sides."""
    if 2 * pad + 1 <= SHORT_FRAME:
        def build(w: WindowSpec) -> Column:
            return F.coalesce(F.max(F.col(flag).cast("int")).over(w.rangeBetween(-pad, pad)), F.lit(0)) > 0
        return with_frames(df, keys, pos, {out: build}, pad, pad, size)
    hits = sliding_sums(df, keys, pos, {"__hits": F.coalesce(F.col(flag).cast("bigint"), F.lit(0))}, pad, pad, size)
    return hits.withColumn(out, F.col("__hits") > 0).drop("__hits")


def background(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    gti: str,
    out: str,
    window: int,
    min_quiet: int,
    size: int | None,
    event_flag: str | None = None,
    pad: int = 0,
    widen: int = 4,
    low_quantile: float = 0.1,
) -> DataFrame:
    """Quiescent level per row, never bridging a gap in good time.

    With ``event_flag`` (label-aware) it is the rolling median of samples outside the
    padded events; without, the rolling low quantile. Rows whose window holds too few
    quiet samples fall back to a ``widen`` times longer window, then to the whole
    segment; a segment without any quiet sample takes the median of all its samples.

    A task gets one chunk with its edges and builds one rank tree, which serves both
    windows; segment borders only clip the frames. A frame that holds its whole segment
    has the segment's level, which is taken once per segment. Segments longer than a
    chunk's view that need their own level are summarised by exact quantiles on Spark.
    Without ``size`` the keys must hold the reset period (the day), which bounds a chunk.
    """
    q = 0.5 if event_flag else low_quantile
    keys = list(keys)
    rows = df
    quiet = F.col(gti)
    if event_flag:
        rows = dilate(rows, keys, pos, event_flag, "__near", pad, size)
        quiet = quiet & ~F.col("__near")
    rows = flag_runs(rows, keys, pos, F.col(gti), size, out="__seg")
    rows = rows.withColumn("__quiet", F.when(quiet, F.col(value))).drop("__near")
    narrow, wide = centred(window), centred(window * widen)
    find = _levels(pos, value, out, q, narrow, wide, min_quiet, max(1, min_quiet // 2), size is None)
    chunks = framed_chunks(rows, keys, pos, *wide, size and max(size, window * widen))
    found = chunks.applyInArrow(find, with_double(rows, out))
    if size is not None:
        found = _segment_levels(stage_table(found), [*keys, "__seg"], value, out, q)
    return found.drop("__seg", "__quiet")


def _levels(
    pos: str, value: str, out: str, q: float, narrow: tuple[int, int], wide: tuple[int, int], least: int, least_wide: int, whole: bool
):
    """Background of one chunk; null where its segment reaches beyond what the chunk sees.

    Frames are index ranges: positions of a segment follow one another without a hole.
    """

    def level(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        at, seg = table.column(pos).to_numpy(), floats(table.column("__seg"))
        x, quiet = floats(table.column(value)), floats(table.column("__quiet"))
        n, good = len(at), ~np.isnan(seg)
        cut = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) & (good[1:] | good[:-1])))) if n else np.empty(0, int)
        length = np.diff(np.append(cut, n))
        first, last = np.repeat(cut, length), np.repeat(cut + length, length)
        upto = np.concatenate(([0], np.cumsum(~np.isnan(quiet))))
        tree = RankTree(quiet[~np.isnan(quiet)])
        row, result = np.arange(n), np.full(n, np.nan)

        def fill(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            """Equal ranges follow one another where a frame holds its segment: each is asked for once."""
            low, high = upto[low], upto[high]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(rows)]
            if len(rows):
                result[rows] = tree.quantile(low[new], high[new], q)[np.cumsum(new) - 1]

        left = good
        for (before, after), minimum in ((narrow, least), (wide, least_wide)):
            low, high = np.maximum(first, row - before), np.minimum(last, row + after + 1)
            enough = left & (upto[high] - upto[low] >= max(1, minimum))
            fill(row[enough], low[enough], high[enough])
            left = left & ~enough
        if not whole:
            # the wide frame saw the segment begin, and end before its own end
            left = left & (at[np.minimum(low, n - 1)] == np.where(good, seg, 0)) & (at[high - 1] < at + after)
        some = left & (upto[last] > upto[first])
        fill(row[some], first[some], last[some])
        rest = left & ~some
        known = rest & ~np.isnan(x)
        if known.any():
            raw = RankTree(x[known])
            count = np.concatenate(([0], np.cumsum(known)))
            a, b = count[first[rest]], count[last[rest]]
            result[row[rest][b > a]] = raw.quantile(a[b > a], b[b > a], 0.5)
        return home_rows(table, out, result)

    return level


def _segment_levels(rows: DataFrame, segment: list[str], value: str, out: str, q: float) -> DataFrame:
    """``rows`` with the level of the whole segment where none was found yet."""
    open_segments = rows.filter(F.col("__seg").isNotNull() & F.col(out).isNull()).select(*segment).distinct()
    samples = stage_table(rows.join(open_segments, segment, "left_semi").select(*segment, "__quiet", value))
    if samples.isEmpty():
        return rows
    quiet = exact_quantiles(samples, segment, "__quiet", [q]).select(*segment, F.col("quantile").alias("__level"))
    raw = exact_quantiles(samples, segment, value, [0.5]).select(*segment, F.col("quantile").alias("__raw"))
    levels = raw.join(quiet, segment, "left").select(*segment, F.coalesce("__level", "__raw").alias("__level"))
    kept = [c for c in rows.columns if c != out]
    return rows.join(levels, segment, "left").select(*kept, F.coalesce(out, "__level").alias(out))


def poisson_sigma(level: str | Column) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.sqrt(F.when(c.isNotNull(), F.greatest(c, F.lit(SIGMA_FLOOR))))


def excess(value: str, level: str) -> Column:
    return (F.col(value) - F.col(level)) / poisson_sigma(level)


def compute_excess(
    df: DataFrame, keys: Sequence[str], pos: str, rate: str, gti: str, size: int | None,
    smooth: int = 70, window: int = 1800, min_quiet: int = 120, pad: int = 1800,
    event_flag: str | None = None,
) -> DataFrame:
    """Smoothed rate, background, sigma and excess; independent of any threshold."""
    rows = boxcar(df, keys, pos, rate, "smoothed", smooth, size)
    rows = background(
        rows, keys, pos, "smoothed", gti, "background", window, min_quiet, size, event_flag, pad
    )
    return rows.withColumn("sigma", poisson_sigma("background")).withColumn(
        "excess", excess("smoothed", "background")
    )


TRAILING_STATS = ("mean", "std", "max", "median")


def trailing_stats(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    windows: Mapping[str, int],
    size: int | None,
    stats: Sequence[str] = ("mean", "std", "max"),
    prefix: str = "",
    fraction: float = 0.5,
) -> DataFrame:
    """Trailing statistics over the current row and the ``w - 1`` cells before it.

    All windows share one chunk layout and hence one shuffle. Mean and spread of long
    windows come from running sums centred on a chunk-independent level, the maximum
    from block prefix and suffix maxima: constant work per row.
    """
    longest = max(windows.values())
    if longest <= SHORT_FRAME:
        columns = {}
        for name, width in windows.items():
            minimum = max(1, int(width * fraction))
            for stat in stats:
                columns[f"{prefix}{stat}_{name}"] = _trailing_native(value, stat, width, minimum)
        return with_frames(df, keys, pos, columns, longest - 1, 0, size)
    rows = df
    for name, width in windows.items():
        minimum = max(1, int(width * fraction))
        rows = _trailing_long(rows, keys, pos, value, width, minimum, size, stats, prefix, name)
    return rows


def _trailing_native(value: str, stat: str, width: int, minimum: int):
    def build(w: WindowSpec) -> Column:
        frame = w.rangeBetween(-(width - 1), 0)
        agg = {
            "mean": F.avg(value), "std": F.stddev_samp(value), "max": F.max(value),
            "median": F.percentile(value, 0.5), "sum": F.sum(value),
        }[stat]
        return min_periods(agg.over(frame), F.count(value).over(frame), minimum)
    return build


def _trailing_long(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int, minimum: int, size: int | None,
    stats: Sequence[str], prefix: str, name: str,
) -> DataFrame:
    from chronoflux.operators.timeline import CHUNK, HOME, spread

    keys = list(keys)
    rows = df
    before = width - 1
    size = size or 1 << 40  # without a size a key is one chunk
    if {"mean", "std"} & set(stats):
        # Centre on the first value of the chunk: spreads survive the subtraction of sums.
        rows = spread(rows, pos, max(size, width), before, 0)
        w = Window.partitionBy(*keys, CHUNK).orderBy(pos)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("__ref", F.first(value, ignorenulls=True).over(whole))
        x = F.col(value) - F.col("__ref")
        totals = {"__ds": F.sum(F.coalesce(x, F.lit(0.0))), "__dss": F.sum(F.coalesce(x * x, F.lit(0.0))), "__dn": F.count(value)}
        rows = rows.select("*", *[running_difference(c, w, before, 0).alias(n) for n, c in totals.items()])
        mean = F.col("__ref") + F.try_divide("__ds", "__dn")
        var = F.try_divide(F.col("__dss") - F.try_divide(F.col("__ds") * F.col("__ds"), F.col("__dn")), F.col("__dn") - 1)
        if "mean" in stats:
            rows = rows.withColumn(f"{prefix}mean_{name}", min_periods(mean, F.col("__dn"), minimum))
        if "std" in stats:
            rows = rows.withColumn(
                f"{prefix}std_{name}", min_periods(F.sqrt(F.greatest(var, F.when(var.isNotNull(), F.lit(0.0)))), F.col("__dn"), minimum)
            )
        rows = rows.filter(HOME).drop(CHUNK, HOME, "__ref", "__ds", "__dss", "__dn")
    if "max" in stats:
        rows = spread(rows, pos, max(size, width), before, 0)
        rows = rows.withColumn("__block", F.floor(F.col(pos) / width))
        block = Window.partitionBy(*keys, CHUNK, "__block")
        up = block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        down = block.orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__down", F.max(value).over(down)).withColumn("__up", F.max(value).over(up))
        w = Window.partitionBy(*keys, CHUNK).orderBy(pos)
        # What the frame holds of the block before starts at the row after the last one ahead of the frame.
        tail = F.struct("__block", "__down")
        rows = rows.select("*", F.lead(tail).over(w).alias("__next"), F.first(tail).over(w).alias("__head"), running_difference(F.count(value), w, before, 0).alias("__cnt"))
        ahead = F.last("__next").over(w.rangeBetween(Window.unboundedPreceding, -before - 1))
        rows = rows.withColumn("__left", F.coalesce(ahead, "__head"))
        left = F.when(F.col("__left.__block") < F.col("__block"), F.col("__left.__down"))
        best = F.greatest(left, "__up")
        rows = rows.withColumn(f"{prefix}max_{name}", min_periods(best, F.col("__cnt"), minimum))
        rows = rows.filter(HOME).drop(CHUNK, HOME, "__block", "__down", "__up", "__next", "__head", "__left", "__cnt")
    if "median" in stats:
        rows = rolling_quantile(rows, keys, pos, value, f"{prefix}median_{name}", 0.5, before, 0, minimum, max(size, width))
    if "sum" in stats:
        rows = sliding_sums(
            rows, keys, pos, {"__sum": F.col(value), "__cnt": F.col(value).isNotNull().cast("bigint")},
            before, 0, max(size, width),
        )
        rows = rows.withColumn(f"{prefix}sum_{name}", min_periods(F.col("__sum"), F.col("__cnt"), minimum)).drop("__sum", "__cnt")
    return rows


def threshold_crossings(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int, size: int | None, out: str,
    nsigma: float = 3.0,
) -> DataFrame:
    """Cells above background + n sigma in the trailing window; background is its median."""
    rows = trailing_stats(df, keys, pos, value, {"w": width}, size, ["median"], "__bg_")
    level = F.col("__bg_median_w") + nsigma * poisson_sigma("__bg_median_w")
    # A null level compares as "not above"; a null sample stays unknown.
    above = F.when(F.col(value).isNotNull(), F.coalesce((F.col(value) > level), F.lit(False)).cast("double"))
    rows = rows.withColumn("__above", above)
    rows = trailing_stats(rows, keys, pos, "__above", {"w": width}, size, ["sum"], "__x_")
    return rows.withColumnRenamed("__x_sum_w", out).drop("__above", "__bg_median_w")


def trailing_change(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, widths: Mapping[str, int], size: int
) -> DataFrame:
    """(x(t) - x(t - w)) / w on a dense grid."""
    def build(width: int):
        return lambda w: (F.col(value) - F.lag(value, width).over(w)) / width
    return with_frames(df, keys, pos, {n: build(x) for n, x in widths.items()}, max(widths.values()), 0, size)


def hardness(hard: str, soft: str) -> Column:
    return F.try_divide(F.col(hard), F.nullif(F.col(soft), F.lit(0.0)))


def central_difference(df: DataFrame, keys: Sequence[str], pos: str, value: str, out: str, size: int | None) -> DataFrame:
    """(next - previous) / 2, one-sided at the ends of the series."""
    def build(w: WindowSpec) -> Column:
        ahead, behind = F.lead(value).over(w), F.lag(value).over(w)
        has_next, has_prev = F.lead(pos).over(w).isNotNull(), F.lag(pos).over(w).isNotNull()
        return (
            F.when(has_next & has_prev, (ahead - behind) / 2)
            .when(has_next, ahead - F.col(value))
            .when(has_prev, F.col(value) - behind)
        )
    return with_frames(df, keys, pos, {out: build}, 1, 1, size)


def trailing_counts(
    grid: DataFrame, events: DataFrame, keys: Sequence[str], grid_pos: str, event_pos: str,
    widths: Mapping[str, int], size: int | None,
) -> DataFrame:
    """Events in (t - w, t] for every row, from one union of positions and shared running counts."""
    keys = list(keys)
    marks = events.groupBy(*keys, F.col(event_pos).cast("bigint").alias("__pos")).agg(F.count("*").alias("__e"))
    def build(width: int):
        return lambda w: F.coalesce(running_difference(F.sum("__e"), w, width - 1, 0), F.lit(0))
    frames = {n: build(x) for n, x in widths.items()}
    return at_positions(grid, marks, keys, grid_pos, frames, max(widths.values()) - 1, 0, size)


def persistence(df: DataFrame, keys: Sequence[str], pos: str, flag: str, segment: str, out: str, k: int, size: int | None) -> DataFrame:
    """Any positive among the ``k`` previous rows of the same segment."""
    def build(w: WindowSpec) -> Column:
        return F.coalesce(F.max(F.col(flag).cast("int")).over(w.rowsBetween(-k, -1)), F.lit(0))
    return with_frames(df, keys, pos, {out: build}, k, 0, size, [segment])


def trailing_arrays(
    df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], length: int, size: int | None, out: str
) -> DataFrame:
    """The last ``length`` rows as an array of structs; shorter histories give no row."""
    def build(w: WindowSpec) -> Column:
        return F.collect_list(F.struct(*values)).over(w.rowsBetween(-(length - 1), 0))
    rows = with_frames(df, keys, pos, {out: build}, length - 1, 0, size)
    return rows.filter(F.size(out) == length)
