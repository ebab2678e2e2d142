"""From raw samples and good-time intervals to dense, masked, reshaped grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.scalars import SECONDS_PER_DAY, finite, floor_div, second_of_day
from chronoflux.operators.timeline import CHUNK, carry_back, carry_forward, covered, explode_interval, with_chunk


def bin_samples(df: DataFrame, keys: Sequence[str], t: str, value: str, order: str) -> DataFrame:
    """Samples to one value per whole second: half-even rounding, the last write wins."""
    second = F.rint(t).cast("bigint").alias("t")
    return df.groupBy(*keys, second).agg(F.max_by(value, order).alias(value))


def cell_means(df: DataFrame, keys: Sequence[str], t: str, value: str, cell: int, pos: str = "k") -> DataFrame:
    """Null-skipping mean per cell of ``cell`` seconds."""
    return df.groupBy(*keys, floor_div(t, cell).alias(pos)).agg(
        F.avg(finite(value)).alias(value), F.count(finite(value)).alias("n")
    )


def extents(df: DataFrame, keys: Sequence[str], t: str, cell: int = 1) -> DataFrame:
    """First and last cell of every series: (keys..., lo, hi). Take it from the narrowest input at hand."""
    return df.groupBy(*keys).agg(floor_div(F.min(t), cell).alias("lo"), floor_div(F.max(t), cell).alias("hi"))


def densify(
    cells: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], size: int,
    extent: DataFrame | None = None, chunk_as: str | None = None,
) -> DataFrame:
    """Add the missing positions of every series, with null values.

    All series cover the same whole chunks of ``size`` positions. The rows are
    widened in place, from each row up to the next one of its chunk, so the dense
    grid itself is never shuffled and no join against a spine is needed. ``extent``
    (see extents) spares a second pass over expensive cells. With ``chunk_as`` the chunk
    number stays as a column, and later windows over (keys, chunk) need no new shuffle.
    """
    keys = list(keys)
    rows = with_chunk(cells.select(*keys, pos, *values), pos, size)
    series = extent if extent is not None else extents(cells, keys, pos)
    span = series.agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))  # one row
    anchors = series.select(*keys).join(F.broadcast(span)).select(
        *keys, F.explode(F.sequence(floor_div("__lo", size), floor_div("__hi", size))).alias(CHUNK)
    ).withColumn(pos, F.col(CHUNK) * size).withColumn("__real", F.lit(0))
    both = rows.withColumn("__real", F.lit(1)).unionByName(anchors, allowMissingColumns=True)
    w = Window.partitionBy(*keys, CHUNK).orderBy(pos, "__real")
    until = F.coalesce(F.lead(pos).over(w), (F.col(CHUNK) + 1) * size)
    wide = both.withColumn("__next", until).filter(F.col("__next") > F.col(pos))
    wide = wide.withColumnRenamed(pos, "__p").withColumn(
        pos, F.explode(F.sequence(F.col("__p"), F.col("__next") - 1))
    )
    kept = [F.col(CHUNK).alias(chunk_as)] if chunk_as else []
    return wide.select(
        *keys, pos, *kept, *[F.when(F.col("__p") == F.col(pos), F.col(v)).alias(v) for v in values]
    )


def gti_seconds(intervals: DataFrame, keys: Sequence[str], start: str, stop: str, size: int = 86_400) -> DataFrame:
    """Seconds covered by the union of intervals: ceil(start) .. floor(stop), inclusive.

    The union is taken on the intervals; its seconds are spelled out once, at the end.
    """
    union = covered(intervals, keys, F.ceil(start), F.floor(stop), size)
    return explode_interval(union, F.col("low"), F.col("high"), "t").select(*keys, "t")


def stitch(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Overlapping observations: the first non-null value in observation order wins."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, F.struct(*order)).alias(value)
    )


def slug(detector: str | Column) -> Column:
    c = F.col(detector) if isinstance(detector, str) else detector
    return F.regexp_replace(F.lower(c), "-", "_")


def to_wide(df: DataFrame, index: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Tidy to wide; naming the columns up front spares a pass over the data."""
    return df.groupBy(*index).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def to_tidy(
    df: DataFrame, index: Sequence[str], columns: Mapping[str, str], gti: Mapping[str, str] | None = None,
    name: str = "detector", value: str = "count_rate", apply_gti: bool = True, drop_null: bool = True,
) -> DataFrame:
    """Wide to tidy: ``columns`` maps series name to rate column, ``gti`` to its mask column."""
    gti = gti or {}
    pieces = F.array(*[
        F.struct(F.lit(n).alias(name), F.col(c).cast("double").alias(value),
                 (F.col(gti[n]) if n in gti else F.lit(True)).alias("in_gti"))
        for n, c in columns.items()
    ])
    tidy = df.select(*index, F.inline(pieces))
    if apply_gti:
        tidy = tidy.filter("in_gti")
    return tidy.filter(F.col(value).isNotNull()) if drop_null else tidy


def available(df: DataFrame, keys: Sequence[str], value: str, gti: str) -> DataFrame:
    """Series with at least one observed value inside good time."""
    return df.groupBy(*keys).agg(F.bool_or(F.col(gti) & F.col(value).isNotNull()).alias("present"))


def observed(value: str, gti: str) -> Column:
    return F.when(F.col(gti), F.col(value))


def log_safe(value: str, gti: str) -> Column:
    """Null outside good time and where a logarithm is undefined."""
    return F.when(F.col(gti) & (F.col(value) > 0), F.col(value))


def time_split(day: str | Column, train_end: str, val_end: str, test_end: str, train_start: str = "00000000") -> Column:
    """Closed day-key ranges; days outside all ranges belong to no split."""
    day = F.col(day) if isinstance(day, str) else day
    return (
        F.when((day >= train_start) & (day <= train_end), "TRAIN")
        .when((day > train_end) & (day <= val_end), "VAL")
        .when((day > val_end) & (day <= test_end), "TEST")
    )


def decimate(df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], width: int) -> DataFrame:
    """Means over ``width`` grid rows, skipping nulls and dropping an incomplete tail bin."""
    bins = df.groupBy(*keys, (floor_div(t, width) * width).alias("bin_t")).agg(
        F.count("*").alias("__rows"), *[F.avg(v).alias(v) for v in values]
    )
    return bins.filter(F.col("__rows") == width).drop("__rows")


def minute_marks(df: DataFrame, t: str) -> DataFrame:
    return df.filter(second_of_day(t) % 60 == 0)


def regrid(
    df: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], order: Sequence[str], step: int = 60
) -> DataFrame:
    """Regular grid from floor(min) to ceil(max): first row per timestamp, gaps stay null.

    Rows off the grid do not land on it.
    """
    first = df.groupBy(*keys, t).agg(
        F.min_by(F.struct(*values), F.struct(*order)).alias("__v")
    ).select(*keys, t, "__v.*")
    on_grid = first.filter(F.pmod(F.col(t), F.lit(step)) == 0).withColumn("k", floor_div(t, step))
    span = df.groupBy(*keys).agg(
        F.floor(F.min(t) / step).cast("bigint").alias("__lo"), F.ceil(F.max(t) / step).cast("bigint").alias("__hi")
    )
    spine = explode_interval(span, F.col("__lo"), F.col("__hi"), "k", SECONDS_PER_DAY)
    return spine.select(*keys, "k").join(on_grid.drop(t), [*keys, "k"], "left").select(
        *keys, (F.col("k") * step).alias(t), *values
    )


def fill_category(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, size: int, out: str | None = None
) -> DataFrame:
    """Forward fill, then backward fill of what is still missing at the front."""
    out = out or value
    there = carry_forward(df, keys, pos, {"__ff": F.col(value)}, size)
    back = carry_back(there, keys, pos, {"__bf": F.col(value)}, size)
    return back.withColumn(out, F.coalesce("__ff", "__bf")).drop("__ff", "__bf")
