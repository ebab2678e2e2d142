"""Coverage, consistency and leakage audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoflux.functions.scalars import SECONDS_PER_DAY, correlation, floor_div, utc_of
from chronoflux.operators.joins import overlap_days
from chronoflux.operators.timeline import asof, exact_quantiles, explode_interval, gap_runs, range_join, running_sum, with_frames

# The status words FULL, PARTIAL, MISSING, NO_SOLEXS, NEITHER and the note words
# below are stored in existing coverage tables and stay as they are.
FULL_SHARE = 0.9
SPAN_GAP = 60
MISSING_GAP = 300


def day_pieces(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Observations cut at midnight: (…, day_no, s, e)."""
    rows = overlap_days(obs, start, end)
    d0 = F.col("day_no") * SECONDS_PER_DAY
    return rows.withColumn("s", F.greatest(F.col(start), d0)).withColumn("e", F.least(F.col(end), d0 + SECONDS_PER_DAY))


def day_coverage(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("day_no").agg(F.count("*").alias("n_obs"), F.sum(F.col("e") - F.col("s")).alias("seconds")).withColumn(
        "fraction", F.least(F.lit(1.0), F.col("seconds") / SECONDS_PER_DAY)
    )


def merged_spans(pieces: DataFrame, gap: int = SPAN_GAP, size: int = 3600) -> DataFrame:
    """Spans of a day merged over gaps up to ``gap`` seconds, carrying the largest end."""
    unique = pieces.groupBy("day_no", "s").agg(F.max("e").alias("e"))
    linked = gap_runs(unique, ["day_no"], "s", gap, size, end="e", out="span_start")
    return linked.groupBy("day_no", "span_start").agg(F.max("e").alias("span_end"))


def clock(t: str) -> Column:
    return F.date_format(utc_of(t), "HH:mm")


def span_list(spans: DataFrame) -> DataFrame:
    """``HH:MM-HH:MM; …`` per day; merged spans are over a minute apart, so a list stays short."""
    item = F.struct("span_start", F.concat(clock("span_start"), F.lit("-"), clock("span_end")).alias("x"))
    return spans.groupBy("day_no").agg(F.array_join(F.array_sort(F.collect_list(item)).getField("x"), "; ").alias("time_spans"))


def missing_parts(spans: DataFrame, gap: int = MISSING_GAP) -> DataFrame:
    """Uncovered parts of each observed day that last longer than ``gap`` seconds."""
    d0 = F.col("day_no") * SECONDS_PER_DAY
    w = Window.partitionBy("day_no").orderBy("span_start")
    before = spans.select("day_no", F.coalesce(F.lag("span_end").over(w), d0).alias("gap_start"), F.col("span_start").alias("gap_end"))
    tail = spans.groupBy("day_no").agg(F.max("span_end").alias("gap_start")).withColumn("gap_end", d0 + SECONDS_PER_DAY)
    return before.unionByName(tail).filter(F.col("gap_end") - F.col("gap_start") > gap)


def calendar(first_last: DataFrame, low: str, high: str) -> DataFrame:
    """One row per day from one (low, high) row."""
    return explode_interval(first_last, F.col(low), F.col(high), "day_no", 3650).select("day_no")


def day_status(coverage: DataFrame, other_days: DataFrame, full: float = FULL_SHARE) -> DataFrame:
    """FULL / PARTIAL / MISSING / NO_SOLEXS / NEITHER on the calendar both sources span."""
    both = coverage.select("day_no").unionByName(other_days.select("day_no"))
    days = calendar(both.agg(F.min("day_no").alias("lo"), F.max("day_no").alias("hi")), "lo", "hi")
    other = other_days.select("day_no").distinct().withColumn("has_other", F.lit(True))
    rows = days.join(coverage, "day_no", "left").join(other, "day_no", "left")
    has, has_other = F.col("n_obs").isNotNull(), F.coalesce("has_other", F.lit(False))
    share = F.coalesce("fraction", F.lit(0.0))
    status = (
        F.when(has & (share >= full), "FULL").when(has & (share > 0), "PARTIAL")
        .when(has_other & ~has, "MISSING").when(has & ~has_other, "NO_SOLEXS").otherwise("NEITHER")
    )
    return rows.select("day_no", has_other.alias("has_soft"), has.alias("has_hard"), share.alias("fraction"), status.alias("status"))


def missing_days(days: DataFrame) -> DataFrame:
    """Calendar days absent between the first and the last one."""
    span = days.agg(F.min("day_no").alias("lo"), F.max("day_no").alias("hi"))
    return calendar(span, "lo", "hi").join(days.select("day_no").distinct(), "day_no", "left_anti")


def day_runs(days: DataFrame, size: int = 3650) -> DataFrame:
    """Runs of consecutive days: (run_start, run_end, length)."""
    runs = gap_runs(days.select("day_no").distinct(), [], "day_no", 1, size, out="run_start")
    return runs.groupBy("run_start").agg(F.max("day_no").alias("run_end"), F.count("*").alias("length"))


def coverage_note(has_a: Column, has_b: Column, built: Column, n_detectors: Column, wanted: int = 5) -> Column:
    partial = F.concat(F.lit("partial_coverage_"), n_detectors.cast("string"), F.lit(f"of{wanted}_detectors"))
    return (
        F.when(built & (n_detectors < wanted), partial).when(built, "")
        .when(has_a & has_b, "build_missing").when(has_a, "solexs_only").when(has_b, "hel1os_only").otherwise("no_raw_data")
    )


def gti_statistics(intervals: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    length = F.col(stop) - F.col(start)
    elapsed = F.max(stop) - F.min(start)
    return intervals.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(length).alias("good_time"), elapsed.alias("elapsed"),
        F.max(length).alias("longest"), F.min(length).alias("shortest"),
    ).withColumn("duty_cycle", F.try_divide("good_time", "elapsed"))


def equal_width_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Equal-width counts between each group's own extremes; the maximum falls into the last bin."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1))
    placed = df.join(span, keys).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int"))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    spine = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])


def anomalies(df: DataFrame, checks: Mapping[str, Column], row_id: str) -> DataFrame:
    """(row_id, reason) for every check a row fails, in one pass."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return df.select(row_id, F.explode(reasons).alias("reason"))


def file_type_presence(files: DataFrame, obs: str, kind: str, size: str, kinds: Sequence[str]) -> DataFrame:
    return files.groupBy(obs).agg(
        *[F.bool_or(F.col(kind) == k).alias(f"has_{k}") for k in kinds],
        F.array_join(F.array_sort(F.collect_set(kind)), "+").alias("types"), F.sum(size).alias("total_size"),
    )


def series_summary(df: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(value).alias("n_seen"), F.count_if(F.col(value) != 0).alias("n_nonzero"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"),
        F.min(t).alias("first_t"), F.max(t).alias("last_t"),
    )
    medians = exact_quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile").alias("median"))
    return base.join(medians, list(keys), "left")


def table_summary(df: DataFrame, t: str, columns: Sequence[str]) -> DataFrame:
    """Rows, time range, and nulls and distinct values per column, one row per column."""
    exprs = [F.count("*").alias("n_rows"), F.min(t).alias("first_t"), F.max(t).alias("last_t")]
    exprs += [F.count_if(F.col(c).isNull()).alias(f"__n_{c}") for c in columns]
    stats = df.agg(*exprs)
    nulls = stats.select("n_rows", "first_t", "last_t", F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"__n_{c}").alias("n_null")) for c in columns])))
    # Distinct values are counted by grouping, not by one growing set per column.
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])))
    distinct = long.filter("v IS NOT NULL").groupBy("name", "v").agg(F.lit(1)).groupBy("name").agg(F.count("*").alias("n_distinct"))
    return nulls.join(distinct, "name", "left").fillna(0, ["n_distinct"])


def well_covered_days(grid: DataFrame, keys: Sequence[str], day: str, gti: str, share: float = 0.9) -> DataFrame:
    per_day = grid.groupBy(*keys, day).agg(F.avg(F.col(gti).cast("double")).alias("share"))
    return per_day.groupBy(*keys).agg(F.count_if(F.col("share") >= share).alias("n_days"), F.count("*").alias("n_total"))


def peak_lags(events: DataFrame, rows: DataFrame, event_id: str, low: str, high: str, pos: str, series: str, value: str, bucket: int) -> DataFrame:
    """Position of each series' first maximum inside every event window."""
    near = range_join(events, rows.filter(F.col(value).isNotNull()), [], low, high, pos, bucket)
    return near.groupBy(event_id, series).agg((-F.max_by(-F.col(pos), F.struct(value, -F.col(pos)))).alias("peak_pos"))


# --- leakage ---------------------------------------------------------------------
def trailing_recheck(
    feature_rows: DataFrame, raw: DataFrame, keys: Sequence[str], pos: str, value: str, feature: str,
    width: int, minimum: int, bucket: int, tolerance: float = 1e-6,
) -> DataFrame:
    """Recompute a trailing mean from raw rows at or before each position and compare.

    The mean is a difference of running sums at the position and just before the window,
    each found by one as-of lookup, so the cost does not depend on ``width``.
    """
    keys = list(keys)
    known = raw.filter(F.col(value).isNotNull()).groupBy(*keys, pos).agg(F.sum(value).alias("__x"), F.count("*").alias("__c"))
    sums = running_sum(known, keys, pos, {"__s": F.col("__x"), "__n": F.col("__c")}, bucket).select(*keys, F.col(pos).alias("__at"), "__s", "__n")
    rows = feature_rows.select(*keys, pos, (F.col(pos) - width).alias("__before"), feature)
    seen = asof(rows, sums, keys, pos, "__at", ["__s", "__n"], bucket, prefix="__u")
    seen = asof(seen, sums, keys, "__before", "__at", ["__s", "__n"], bucket, prefix="__l")
    n = F.coalesce("__u__n", F.lit(0)) - F.coalesce("__l__n", F.lit(0))
    again = F.when((n >= minimum) & (n > 0), (F.col("__u__s") - F.coalesce("__l__s", F.lit(0.0))) / n)
    same = again.eqNullSafe(F.col(feature)) | (F.abs(again - F.col(feature)) <= tolerance)
    return seen.select(*keys, pos, F.coalesce(same, F.lit(False)).alias("same"))


def unpivot(df: DataFrame, index: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.unpivot(list(index), list(features), "feature", "x")


def change_share(df: DataFrame, keys: Sequence[str], pos: str, features: Sequence[str], size: int | None) -> DataFrame:
    """Share of consecutive rows on which each feature changes; null to null is no change."""
    frames = {f"__d_{f}": (lambda f: lambda w: (~F.col(f).eqNullSafe(F.lag(f).over(w))).cast("int"))(f) for f in features}
    frames["__has"] = lambda w: F.lag(pos).over(w).isNotNull()
    rows = with_frames(df, keys, pos, frames, 1, 0, size).filter("__has")
    stats = rows.agg(*[F.avg(f"__d_{f}").alias(f) for f in features])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("share")) for f in features])))


def target_correlations(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.9) -> DataFrame:
    """|corr(feature, target)| of all features in one aggregation, suspicious ones flagged.

    A feature or target without spread has no correlation (NaN), which no limit clears: it is flagged.
    """
    stats = df.agg(*[F.abs(correlation(f, target)).alias(f) for f in features])
    long = stats.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])))
    return long.withColumn("suspicious", F.coalesce(F.col("r") > limit, F.lit(False)))


def gap_rule(df: DataFrame, mean: str, std: str) -> DataFrame:
    """Rows with a spread but no mean must not exist; overall share of missing means."""
    return df.agg(
        F.count_if(F.col(mean).isNull() & F.col(std).isNotNull()).alias("n_broken"),
        F.avg(F.col(mean).isNull().cast("double")).alias("null_share"), F.count("*").alias("n"),
    )


def background_sanity(ex: DataFrame, keys: Sequence[str], pos: str, event: Column, edge: int) -> DataFrame:
    """Quiet floor, background under events relative to it, and the largest excess near events."""
    keys = list(keys)
    quiet = exact_quantiles(ex.filter(~event), keys, "background", [0.5]).select(*keys, F.col("quantile").alias("quiet_level"))
    out = ex.groupBy(*keys).agg(
        F.min("background").alias("floor"), F.max(F.when(event, F.col("background"))).alias("event_level"),
        F.max(F.when(event, F.col("excess"))).alias("event_excess"),
    )
    out = (out.join(quiet, keys, "left") if keys else out.join(F.broadcast(quiet), how="left")).select(*keys, "floor", "quiet_level", "event_level", "event_excess")
    return out.withColumn("ratio", F.try_divide("event_level", "quiet_level")).withColumn("passes", F.coalesce(F.col("ratio") < 2.5, F.lit(True)))
