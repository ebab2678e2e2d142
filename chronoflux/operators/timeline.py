"""Time-line primitives that stay parallel inside a single long or hot series.

A window partitioned by series alone puts each series into one task. Here every
frame and scan is cut into time chunks instead:

* bounded frames (rolling statistics, lags, dilation) copy the rows near a chunk
  edge into the neighbour chunk, compute there and keep each row once
  (:func:`with_frames`);
* unbounded frames (last value so far, running sums, run ids, as-of joins) scan
  inside the chunk and add what the earlier chunks carry in. The carry is a scan
  over one summary row per chunk, so its size is set by the time range and not by
  the number of rows (:func:`carry_forward`, :func:`running_sum`).

With ``size=None`` the groups of ``keys`` are taken as bounded, because the keys hold
a reset period such as the day (at most 86,400 rows of second data): one plain window
per group then does the work with a single shuffle.

No primitive emits pairs of rows: tolerance matches are as-of lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoflux.functions.scalars import floor_div

CHUNK = "__chunk"
HOME = "__home"
NATIVE_FRAME = 256


class RankTree:
    """Order statistics of any ranges of a sequence, for all ranges together.

    The ranks of the values stand bit by bit, from the highest on, each level parted into
    zeros and ones (a wavelet matrix). A range keeps its bounds from level to level by two
    look-ups, so a quantile costs one step per bit whatever the range's length.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, rank = np.unique(values, return_inverse=True)
        rank = rank.astype(np.int32)
        self.bits = range(max(len(self.values) - 1, 0).bit_length() - 1, -1, -1)
        self.levels = []
        for bit in self.bits:
            one = (rank >> bit) & 1 == 1
            ones = np.concatenate(([0], np.cumsum(one, dtype=np.int32))).astype(np.int32)
            self.levels.append((np.int32(len(rank) - ones[-1]), ones))
            rank = np.concatenate((rank[~one], rank[one]))

    def at_rank(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of values ``low`` to ``high - 1``."""
        low, high, k = (x.astype(np.int32) for x in (low, high, k))
        found = np.zeros(len(low), np.int32)
        for bit, (zeros, ones) in zip(self.bits, self.levels, strict=True):
            first, last = ones[low], ones[high]
            below = high - low - (last - first)
            right = k >= below
            k = np.where(right, k - below, k)
            found |= right.astype(np.int32) << np.int32(bit)
            low, high = np.where(right, zeros + first, low - first), np.where(right, zeros + last, high - last)
        return self.values[found]

    def quantile(self, low: np.ndarray, high: np.ndarray, q: float) -> np.ndarray:
        """Linearly interpolated quantile of values ``low`` to ``high - 1``; no range may be empty."""
        at = q * (high - low - 1)
        below = np.floor(at).astype(np.int64)
        first = self.at_rank(low, high, below)
        step = self.at_rank(low, high, np.minimum(below + 1, high - low - 1)) - first
        return first + step * (at - below)


def floats(column: pa.ChunkedArray) -> np.ndarray:
    """A numeric column as floats, null as NaN."""
    return column.cast(pa.float64()).to_numpy()


def with_chunk(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn(CHUNK, floor_div(pos, size))


def spread(df: DataFrame, pos: str, size: int, before: int, after: int) -> DataFrame:
    """Copy each row to all chunks whose frames reach it; ``__home`` marks its own chunk."""
    chunks = F.sequence(floor_div(F.col(pos) - after, size), floor_div(F.col(pos) + before, size))
    return df.withColumn(CHUNK, F.explode(chunks)).withColumn(
        HOME, F.col(CHUNK) == floor_div(pos, size)
    )


def with_frames(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    before: int,
    after: int,
    size: int | None,
    segment: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Add bounded-frame columns.

    Each entry of ``columns`` gets the ordered window of its chunk and returns a
    column whose frame stays within ``before``/``after``. ``segment`` columns cut
    frames further (a run id, say), without widening the partitioning.
    """
    if size is None:
        w = Window.partitionBy(*keys, *segment).orderBy(pos, *order)
        return df.select("*", *[build(w).alias(name) for name, build in columns.items()])
    part = [*keys, CHUNK, *segment]
    w = Window.partitionBy(*part).orderBy(pos, *order)
    out = spread(df, pos, size, before, after)
    out = out.select("*", *[build(w).alias(name) for name, build in columns.items()])
    return out.filter(HOME).drop(CHUNK, HOME)


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, Column],
    before: int,
    after: int,
    size: int | None,
    segment: Sequence[str] = (),
) -> DataFrame:
    """Frame sums by position in constant time per row; a hole in the positions counts as zero.

    Both ends are running sums over ranges that start at the first row, which grow row
    by row, so the cost does not grow with the frame as it does for a sliding frame.
    Null counts as zero; pass 0/1 indicators to count.
    """
    if size is None:
        out = df.withColumn(CHUNK, F.lit(0)).withColumn(HOME, F.lit(True))
    else:
        out = spread(df, pos, size, before, after)
    w = Window.partitionBy(*keys, CHUNK, *segment).orderBy(pos)
    zero = {n: F.coalesce(c, F.lit(0)) for n, c in columns.items()}
    out = out.select("*", *[running_difference(F.sum(c), w, before, after).alias(n) for n, c in zero.items()])
    return out.filter(HOME).drop(CHUNK, HOME)


def running_difference(total: Column, w: WindowSpec, before: int, after: int) -> Column:
    """A sum or count over ``before`` to ``after`` positions, as a difference of running ones."""
    first = Window.unboundedPreceding
    upto, earlier = total.over(w.rangeBetween(first, after)), total.over(w.rangeBetween(first, -before - 1))
    return upto - F.coalesce(earlier, F.lit(0))


def rolling_quantile(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    out: str,
    q: float,
    before: int,
    after: int,
    minimum: int,
    size: int | None,
    segment: Sequence[str] = (),
) -> DataFrame:
    """Exact rolling quantile (linear interpolation) of the rows ``before`` to ``after`` positions away.

    Short frames use Spark's ``percentile`` frame. That re-sorts the frame for
    every row, so longer frames query a rank tree per chunk: a group is one chunk
    plus its edges, at most ``size + before + after`` rows.
    """
    if before + after + 1 <= NATIVE_FRAME:
        def build(w: WindowSpec) -> Column:
            frame = w.rangeBetween(-before, after)
            return F.when(F.count(value).over(frame) >= minimum,
                          F.percentile(value, q).over(frame))
        return with_frames(df, keys, pos, {out: build}, before, after, size, segment)

    def per_chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        at, x = table.column(pos).to_numpy(), floats(table.column(value))
        seen = ~np.isnan(x)
        upto = np.concatenate(([0], np.cumsum(seen)))
        low, high = upto[np.searchsorted(at, at - before)], upto[np.searchsorted(at, at + after, "right")]
        enough = high - low >= max(1, minimum)
        level = np.full(len(x), np.nan)
        if enough.any():
            level[enough] = RankTree(x[seen]).quantile(low[enough], high[enough], q)
        return home_rows(table, out, level)

    return framed_chunks(df, keys, pos, before, after, size, segment).applyInArrow(per_chunk, with_double(df, out))


def with_double(df: DataFrame, out: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])


def framed_chunks(
    df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, size: int | None, segment: Sequence[str] = ()
) -> GroupedData:
    """Chunks with the rows their frames reach, for work inside the task; see :func:`home_rows`."""
    rows = df.withColumn(CHUNK, F.lit(0)).withColumn(HOME, F.lit(True)) if size is None else spread(df, pos, size, before, after)
    return rows.groupBy(*keys, CHUNK, *segment)


def home_rows(table: pa.Table, out: str, values: np.ndarray) -> pa.Table:
    """The chunk's own rows with one more column; NaN becomes null."""
    table = table.append_column(out, pa.array(values, from_pandas=True))
    return table.filter(table.column(HOME)).drop_columns([CHUNK, HOME])


def _carry(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    size: int | None,
    order: Sequence[str],
    inclusive: bool,
    forward: bool,
) -> DataFrame:
    """Shared body of carry_forward/carry_back."""
    keys = list(keys)
    columns = df.columns
    if size is None:
        directed = [F.col(c) if forward else F.col(c).desc() for c in (pos, *order)]
        w = Window.partitionBy(*keys).orderBy(*directed)
        w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select("*", *[F.last(v, ignorenulls=True).over(w).alias(n) for n, v in values.items()])
    chunked = with_chunk(df, pos, size)
    chunked = chunked.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    where = F.struct(pos, *order)
    pick = F.max_by if forward else F.min_by
    summary = chunked.groupBy(*keys, CHUNK).agg(
        *[pick(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), where)).alias(f"__s_{n}") for n in values]
    )
    by_chunk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    by_chunk = by_chunk.orderBy(CHUNK if forward else F.col(CHUNK).desc())
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys, CHUNK,
        *[F.last(f"__s_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in values],
    )
    directed = [F.col(c) if forward else F.col(c).desc() for c in (pos, *order)]
    w = Window.partitionBy(*keys, CHUNK).orderBy(*directed)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = chunked.select(
        *columns, CHUNK,
        *[F.last(f"__v_{n}", ignorenulls=True).over(frame).alias(f"__l_{n}") for n in values],
    )
    joined = local.join(summary, [*keys, CHUNK], "left")
    return joined.select(
        *columns, *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in values]
    )


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    size: int | None,
    order: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null value at or before each row (strictly before if not inclusive)."""
    return _carry(df, keys, pos, values, size, order, inclusive, True)


def carry_back(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    size: int | None,
    order: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """First non-null value at or after each row (strictly after if not inclusive)."""
    return _carry(df, keys, pos, values, size, order, inclusive, False)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    size: int | None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums without putting a series into one task."""
    keys = list(keys)
    columns = df.columns
    chunked = with_chunk(df, pos, size).select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    summary = chunked.groupBy(*keys, CHUNK).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    by_chunk = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(CHUNK)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, CHUNK, *[F.sum(f"__s_{n}").over(earlier).alias(f"__c_{n}") for n in values])
    w = Window.partitionBy(*keys, CHUNK).orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.select(*columns, CHUNK, *[F.sum(f"__v_{n}").over(w).alias(f"__l_{n}") for n in values])
    joined = local.join(summary, [*keys, CHUNK], "left")
    return joined.select(
        *columns,
        *[(F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0))).alias(n) for n in values],
    )


def flag_runs(
    df: DataFrame, keys: Sequence[str], pos: str, flag: Column, size: int | None, out: str = "run"
) -> DataFrame:
    """Gaps and islands on a flag: ``out`` is the position where the row's run began.

    Rows with a false or null flag get null. A missing position also ends a run.
    """
    flagged = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    marked = with_frames(
        flagged, keys, pos,
        {"__pf": lambda w: F.lag("__f").over(w), "__pp": lambda w: F.lag(pos).over(w)},
        before=1, after=0, size=size,
    )
    continues = F.coalesce(F.col("__pf") & (F.col("__pp") == F.col(pos) - 1), F.lit(False))
    begin = F.when(F.col("__f") & ~continues, F.col(pos))
    runs = carry_forward(marked, keys, pos, {out: begin}, size)
    return runs.withColumn(out, F.when(F.col("__f"), F.col(out))).drop("__f", "__pf", "__pp")


def gap_runs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    gap: int,
    size: int | None,
    order: Sequence[str] = (),
    end: str | None = None,
    out: str = "run",
) -> DataFrame:
    """Group rows whose distance to what came before is at most ``gap``.

    Without ``end`` the distance is to the previous position; with it, to the
    largest ``end`` so far (interval merging). ``out`` numbers the runs by their
    first position. A predecessor further away than ``gap`` starts a run just like a
    missing one, so looking back needs no more than an edge of ``gap`` positions.
    """
    if end is None:
        seen = with_frames(
            df, keys, pos, {"__prev": lambda w: F.lag(pos).over(w)}, gap, 0, size and max(size, gap), order=order
        )
    else:
        seen = _running_max_before(df, keys, pos, end, size, order)
    fresh = F.col("__prev").isNull() | (F.col(pos) - F.col("__prev") > gap)
    begin = F.when(fresh, F.struct(F.col(pos).alias("p"), *order))
    runs = carry_forward(seen, keys, pos, {"__run": begin}, size, order)
    return runs.withColumn(out, F.col("__run.p")).drop("__prev", "__run")


def _running_max_before(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, size: int | None, order: Sequence[str]
) -> DataFrame:
    keys = list(keys)
    columns = df.columns
    if size is None:
        w = Window.partitionBy(*keys).orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("__prev", F.max(value).over(w))
    chunked = with_chunk(df, pos, size)
    by_chunk = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(CHUNK)
    summary = chunked.groupBy(*keys, CHUNK).agg(F.max(value).alias("__s"))
    summary = summary.select(
        *keys, CHUNK, F.max("__s").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("__c")
    )
    w = Window.partitionBy(*keys, CHUNK).orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.select(*columns, CHUNK, F.max(value).over(w).alias("__l"))
    return local.join(summary, [*keys, CHUNK], "left").select(
        *columns, F.greatest("__l", "__c").alias("__prev")
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    values: Sequence[str],
    size: int | None,
    direction: str = "backward",
    strict: bool = False,
    order: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """As-of join: the last right row at or before (first at or after) each left row.

    ``strict`` excludes equal positions. ``order`` breaks ties among right rows with
    equal positions: backward takes the largest, forward the smallest. Adds
    ``prefix + value`` columns.

    Both sides are reduced to one row per position first, so a chunk holds at most two
    rows per position however many rows share it; the result is joined back by position.
    No candidate pairs exist.
    """
    keys = list(keys)
    forward = direction == "forward"
    side = 0 if (strict == forward) else 1
    lookup = _lookup_rows(right, keys, right_pos, values, order, not forward).withColumn("__side", F.lit(side))
    probes = _probe_rows(left, keys, left_pos).withColumn("__side", F.lit(1 - side))
    both = probes.unionByName(lookup, allowMissingColumns=True)
    carried = _carry(both, keys, "__pos", {"__match": F.col("__hit")}, size, ["__side"], True, not forward)
    found = carried.filter(F.col("__side") == 1 - side).select(*keys, "__pos", "__match")
    return _join_back(left, found, keys, left_pos, {prefix + v: F.col(f"__match.{v}") for v in values})


def _lookup_rows(
    right: DataFrame, keys: list[str], pos: str, values: Sequence[str], order: Sequence[str], last: bool
) -> DataFrame:
    """One payload per position: the last or first row in ``order``."""
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    if order:
        pick = F.max_by if last else F.min_by
        payload = pick(payload, F.struct(*[F.col(c) for c in order]))
    else:
        payload = F.first(payload)
    return right.groupBy(*keys, F.col(pos).cast("bigint").alias("__pos")).agg(payload.alias("__hit"))


def _probe_rows(left: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return left.select(*keys, F.col(pos).cast("bigint").alias("__pos")).filter(F.col("__pos").isNotNull()).distinct()


def _join_back(left: DataFrame, found: DataFrame, keys: list[str], pos: str, columns: Mapping[str, Column]) -> DataFrame:
    rows = left.withColumn("__pos", F.col(pos).cast("bigint"))
    return rows.join(found, [*keys, "__pos"], "left").select(*left.columns, *[c.alias(n) for n, c in columns.items()])


def asof_both(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    values: Sequence[str],
    size: int,
    strict_ahead: bool = False,
    order: Sequence[str] = (),
    back: str = "back_",
    ahead: str = "ahead_",
) -> DataFrame:
    """Backward (at or before) and forward as-of join in one union, one shuffle and one carry.

    ``strict_ahead`` looks strictly after the row. Ties follow ``asof``, and so does the
    reduction to one row per position.
    """
    keys = list(keys)
    last = _lookup_rows(right, keys, right_pos, values, order, True)
    lookup = last
    if order:
        first = _lookup_rows(right, keys, right_pos, values, order, False).withColumnRenamed("__hit", "__hit1")
        lookup = last.join(first, [*keys, "__pos"])
    else:
        lookup = last.withColumn("__hit1", F.col("__hit"))
    lookup = lookup.withColumn("__side", F.lit(0))
    probes = _probe_rows(left, keys, left_pos).withColumn("__side", F.lit(1))
    both = with_chunk(probes.unionByName(lookup, allowMissingColumns=True), "__pos", size)
    where = F.when(F.col("__side") == 0, F.col("__pos"))
    summary = both.groupBy(*keys, CHUNK).agg(
        F.max_by("__hit", where).alias("__last"), F.min_by("__hit1", where).alias("__first")
    )
    by_chunk = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(CHUNK)
    summary = summary.select(
        *keys, CHUNK,
        F.last("__last", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("__cb"),
        F.first("__first", ignorenulls=True).over(by_chunk.rowsBetween(1, Window.unboundedFollowing)).alias("__cf"),
    )
    part = Window.partitionBy(*keys, CHUNK)
    so_far = (Window.unboundedPreceding, 0)
    wb = part.orderBy("__pos", "__side").rowsBetween(*so_far)
    side = F.col("__side").desc() if strict_ahead else F.col("__side")
    wf = part.orderBy(F.col("__pos").desc(), side).rowsBetween(*so_far)
    local = both.select(
        *keys, CHUNK, "__pos", "__side", F.last("__hit", ignorenulls=True).over(wb).alias("__lb"),
        F.last("__hit1", ignorenulls=True).over(wf).alias("__lf"),
    ).filter(F.col("__side") == 1)
    found = local.join(summary, [*keys, CHUNK], "left").select(
        *keys, "__pos", F.coalesce("__lb", "__cb").alias("__b"), F.coalesce("__lf", "__cf").alias("__f")
    )
    return _join_back(left, found, keys, left_pos, {
        **{back + v: F.col(f"__b.{v}") for v in values}, **{ahead + v: F.col(f"__f.{v}") for v in values}})


def at_positions(
    left: DataFrame, marks: DataFrame, keys: Sequence[str], left_pos: str,
    frames: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int, size: int,
) -> DataFrame:
    """Bounded frames over ``marks`` (keys..., __pos, values; one row per position) seen from every left row."""
    keys = list(keys)
    probes = _probe_rows(left, keys, left_pos).withColumn("__probe", F.lit(True))
    both = probes.unionByName(marks, allowMissingColumns=True)
    seen = with_frames(both, keys, "__pos", frames, before, after, size).filter("__probe").select(*keys, "__pos", *frames)
    return _join_back(left, seen, keys, left_pos, {n: F.col(n) for n in frames})


def explode_interval(
    df: DataFrame, low: Column, high: Column, out: str, size: int = 86_400
) -> DataFrame:
    """One row per integer of the closed interval [low, high]; empty intervals vanish.

    Long intervals are first split at chunk borders and redistributed, so one row
    never turns into an unbounded array inside one task.
    """
    bounded = df.withColumn("__lo", low.cast("bigint")).withColumn("__hi", high.cast("bigint"))
    bounded = bounded.filter(F.col("__lo") <= F.col("__hi"))
    pieces = bounded.withColumn(
        "__piece", F.explode(F.sequence(floor_div("__lo", size), floor_div("__hi", size)))
    )
    return pieces.withColumn(
        out,
        F.explode(F.sequence(
            F.greatest(F.col("__lo"), F.col("__piece") * size),
            F.least(F.col("__hi"), F.col("__piece") * size + (size - 1)),
        )),
    ).drop("__lo", "__hi", "__piece")


def covered(intervals: DataFrame, keys: Sequence[str], low: Column, high: Column, size: int) -> DataFrame:
    """Union of the closed integer intervals [low, high] as disjoint ones: (keys..., low, high).

    Runs of overlapping or touching intervals, found from the largest end so far; rows
    follow the intervals, however long they are.
    """
    keys = list(keys)
    spans = intervals.select(*keys, low.cast("bigint").alias("low"), high.cast("bigint").alias("high")).filter("low <= high")
    spans = spans.groupBy(*keys, "low").agg(F.max("high").alias("high"))
    runs = gap_runs(spans, keys, "low", 1, size, end="high", out="__first")
    return runs.groupBy(*keys, F.col("__first").alias("low")).agg(F.max("high").alias("high"))


def best_segments(intervals: DataFrame, keys: Sequence[str], low: Column, high: Column, best: Column, size: int) -> DataFrame:
    """What is largest at every position of overlapping closed intervals: disjoint (keys..., chunk, low, high, best).

    Intervals are cut at the borders of chunks of ``size`` positions. Cuts of equal ends
    keep their largest value before they are shuffled, so a chunk holds at most
    size * (size + 1) / 2 of them; between two neighbouring ends the owner does not change.
    """
    keys = list(keys)
    spans = intervals.select(*keys, low.cast("bigint").alias("__lo"), high.cast("bigint").alias("__hi"), best.alias("__best")).filter("__lo <= __hi")
    cuts = spans.withColumn(CHUNK, F.explode(F.sequence(floor_div("__lo", size), floor_div("__hi", size))))
    cuts = cuts.groupBy(
        *keys, CHUNK, F.greatest(F.col("__lo"), F.col(CHUNK) * size).alias("lo"), F.least(F.col("__hi"), (F.col(CHUNK) + 1) * size - 1).alias("hi")
    ).agg(F.max("__best").alias("best"))
    chunks = cuts.groupBy(*keys, CHUNK).agg(F.collect_list(F.struct("lo", "hi", "best")).alias("cuts"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("cuts", lambda c: F.array(c["lo"], c["hi"] + 1)))))
    chunks = chunks.withColumn("ends", ends)

    def segment(first: Column, i: Column) -> Column:
        here = F.filter("cuts", lambda c: (c["lo"] <= first) & (c["hi"] >= first))
        return F.struct(first.alias("low"), (F.get("ends", i + 1) - 1).alias("high"), F.array_max(F.transform(here, lambda c: c["best"])).alias("best"))

    inner = F.expr("slice(ends, 1, size(ends) - 1)")
    return chunks.select(*keys, CHUNK, F.inline(F.transform(inner, segment))).filter("best IS NOT NULL")


def range_join(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    low: str,
    high: str,
    pos: str,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Points inside closed intervals through an equi join on time buckets.

    Only the interval side is copied, once per bucket it touches, so each pair meets
    exactly once. For use where intervals are short and points are gridded, which
    bounds the matches per interval.
    """
    left = intervals.withColumn(
        CHUNK, F.explode(F.sequence(floor_div(low, width), F.greatest(floor_div(low, width), floor_div(high, width))))
    )
    right = with_chunk(points, pos, width)
    hit = F.col(pos).between(F.col(low), F.col(high))
    if how == "inner":
        return left.join(right, [*keys, CHUNK]).filter(hit).drop(CHUNK)
    raise ValueError(f"unsupported join: {how}")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], buckets: int = 1024
) -> DataFrame:
    """Exact interpolated quantiles of groups of any size: (keys..., q, quantile).

    Equal values are counted first. A mergeable sketch gives value borders per
    group; counts per border cell then locate the cells that hold the wanted ranks,
    and only those are ordered. No task sees more than a cell of distinct values.
    """
    keys = list(keys)
    spark_keys = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    base = base.filter(F.col(value).isNotNull())
    counts = base.groupBy(*spark_keys, value).agg(F.count("*").alias("__n"))
    marks = [i / buckets for i in range(1, buckets)]
    # Without keys there is one row of borders: broadcast it, or all counts would meet in one task.
    aside = (lambda df: df) if keys else F.broadcast
    borders = base.groupBy(*spark_keys).agg(
        F.percentile_approx(value, F.array(*[F.lit(m) for m in marks]), F.lit(10_000)).alias("__b"),
        F.count("*").alias("__total"),
    )
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length() - 1))])
    cell = F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when(F.get(F.col("__b"), at + step - 1) < F.col(value), step).otherwise(0),
    )
    placed = counts.join(aside(borders), spark_keys).withColumn("__cell", cell).drop("__b")
    totals = placed.groupBy(*spark_keys, "__cell").agg(F.sum("__n").alias("__m"), F.first("__total").alias("__total"))
    before = Window.partitionBy(*spark_keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[F.lit(float(q)) for q in qs])
    ranks = totals.withColumn("__upto", F.sum("__m").over(before)).select(
        *spark_keys, "__cell", (F.col("__upto") - F.col("__m")).alias("__base"), "__upto", "__total",
        F.explode(wanted).alias("q"),
    )
    at = F.col("q") * (F.col("__total") - 1)
    ranks = ranks.withColumn("__at", at).filter(
        (F.floor("__at") < F.col("__upto")) & (F.ceil("__at") >= F.col("__base"))
    )
    cells = ranks.groupBy(*spark_keys, "__cell", "__base").agg(F.collect_set(F.struct("q", "__at")).alias("__want"))
    inside = Window.partitionBy(*spark_keys, "__cell").orderBy(value)
    ordered = placed.drop("__total").join(cells, [*spark_keys, "__cell"]).withColumn(
        "__hi", F.col("__base") + F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    picked = ordered.select(
        *spark_keys, F.col(value).alias("__v"), "__hi", (F.col("__hi") - F.col("__n")).alias("__lo"),
        F.explode("__want").alias("__w"),
    ).select("*", "__w.q", "__w.__at")
    low_hit = F.floor("__at").between(F.col("__lo"), F.col("__hi") - 1)
    high_hit = F.ceil("__at").between(F.col("__lo"), F.col("__hi") - 1)
    picked = picked.groupBy(*spark_keys, "q").agg(
        F.max(F.when(low_hit, F.col("__v"))).alias("__a"),
        F.max(F.when(high_hit, F.col("__v"))).alias("__z"),
        F.first("__at").alias("__at"),
    )
    share = F.col("__at") - F.floor("__at")
    result = (F.col("__a") + (F.col("__z") - F.col("__a")) * share).alias("quantile")
    return picked.select(*keys, "q", result)
