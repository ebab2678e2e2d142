"""Calendar and context joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoflux.functions.scalars import SECONDS_PER_DAY, correlation, floor_div
from chronoflux.operators.timeline import asof_both


def overlap_days(obs: DataFrame, start: str, end: str, day: str = "day_no") -> DataFrame:
    """One row per observation and day it overlaps (start < day end and end > day start)."""
    last = F.greatest(floor_div(start, SECONDS_PER_DAY), floor_div(F.col(end) - 1, SECONDS_PER_DAY))
    return obs.filter(F.col(end) > F.col(start)).withColumn(
        day, F.explode(F.sequence(floor_div(start, SECONDS_PER_DAY), last))
    )


def minute_context(df: DataFrame, context: DataFrame, t: str, values: Sequence[str], order: str) -> DataFrame:
    """Attach the last context row of the same minute."""
    by_minute = context.groupBy(floor_div(t, 60).alias("__m")).agg(
        F.max_by(F.struct(*values), F.struct(t, order)).alias("__v")
    )
    return df.withColumn("__m", floor_div(t, 60)).join(by_minute, "__m", "left").select(
        *df.columns, *[F.col(f"__v.{v}").alias(v) for v in values]
    )


def day_context(df: DataFrame, daily: DataFrame, t: str, values: Sequence[str], lag_days: int = 0) -> DataFrame:
    """Attach day scalars; ``lag_days`` 1 gives every row the day before, known by then.

    The size of the daily table is left to the optimizer's statistics: it is broadcast
    only while it is measured to be small.
    """
    shifted = daily.select((F.col("day_no") + lag_days).alias("__d"), *values)
    return df.withColumn("__d", floor_div(t, SECONDS_PER_DAY)).join(shifted, "__d", "left").drop("__d")


def merge_daily(left: DataFrame, right: DataFrame, key: str, right_values: Sequence[str]) -> DataFrame:
    """Full outer join of two daily series; the right one is averaged per day first."""
    means = right.groupBy(key).agg(*[F.avg(v).alias(v) for v in right_values])
    return left.join(means, key, "full")


def nearest_row(df: DataFrame, at: DataFrame, t: str, at_t: str, values: Sequence[str], size: int, order: Sequence[str]) -> DataFrame:
    """The row nearest to each requested time, without a limit; earlier on a tie."""
    wanted = [t, *values]
    unique = df.groupBy(t).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("__v")).select(
        t, *[F.col(f"__v.{v}").alias(v) for v in values]
    )
    rows = asof_both(at, unique, [], at_t, t, wanted, size, back="__b_", ahead="__f_")
    back = F.col(at_t) - F.col(f"__b_{t}")
    ahead = F.col(f"__f_{t}") - F.col(at_t)
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    return rows.select(
        *at.columns, *[F.when(use_back, F.col(f"__b_{v}")).otherwise(F.col(f"__f_{v}")).alias(f"near_{v}") for v in wanted]
    )


def correlate_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], x: str, y: str, minimum: int = 100) -> DataFrame:
    """Correlation on common positions; null below ``minimum`` pairs or without spread."""
    pairs = left.join(right, list(on)).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    stats = pairs.agg(
        F.count("*").alias("n_common"), correlation(x, y).alias("__r"),
        F.stddev_samp(x).alias("__sx"), F.stddev_samp(y).alias("__sy"),
    )
    ok = (F.col("n_common") >= minimum) & (F.col("__sx") > 0) & (F.col("__sy") > 0)
    return stats.select("n_common", F.when(ok, F.col("__r")).alias("correlation"))
