"""Tolerance matching of event lists: existence, nearest, first, greedy one-to-one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoflux.operators.timeline import CHUNK, HOME, asof, asof_both, carry_forward, spread
from chronoflux.session import stage_table


def near_any(
    df: DataFrame, catalogue: DataFrame, keys: Sequence[str], pos: str, cat_pos: str, tol: int, size: int, out: str
) -> DataFrame:
    """Is any catalogue time within ``tol``? One forward lookup from ``pos - tol`` decides."""
    cat = catalogue.select(*keys, F.col(cat_pos).alias("__c")).distinct()
    rows = df.withColumn("__from", F.col(pos) - tol)
    hit = asof(rows, cat, keys, "__from", "__c", ["__c"], size, "forward", prefix="__m")
    return hit.withColumn(out, F.coalesce(F.col("__m__c") <= F.col(pos) + tol, F.lit(False))).drop("__from", "__m__c")


def first_within(
    df: DataFrame, catalogue: DataFrame, keys: Sequence[str], pos: str, cat_pos: str, values: Sequence[str],
    tol: int, size: int, order: Sequence[str], prefix: str = "m_",
) -> DataFrame:
    """Earliest catalogue row inside [pos - tol, pos + tol], null without one."""
    rows = df.withColumn("__from", F.col(pos) - tol)
    wanted = [cat_pos, *[v for v in values if v != cat_pos]]
    hit = asof(rows, catalogue, keys, "__from", cat_pos, wanted, size, "forward", order=order, prefix="__m_")
    ok = F.col(f"__m_{cat_pos}") <= F.col(pos) + tol
    return hit.select(*df.columns, *[F.when(ok, F.col(f"__m_{v}")).alias(prefix + v) for v in wanted])


def nearest_within(
    df: DataFrame, catalogue: DataFrame, keys: Sequence[str], pos: str, cat_pos: str, values: Sequence[str],
    tol: int, size: int, order: Sequence[str], prefix: str = "m_",
) -> DataFrame:
    """Nearest catalogue row within ``tol``; the earlier one among equally near."""
    wanted = [cat_pos, *[v for v in values if v != cat_pos]]
    # Both lookups name the same row among equal times: the first in ``order``.
    unique = catalogue.groupBy(*keys, cat_pos).agg(
        F.min_by(F.struct(*wanted), F.struct(*order)).alias("__row")
    ).select(*keys, cat_pos, *[F.col(f"__row.{v}").alias(v) for v in wanted if v != cat_pos])
    both = asof_both(df, unique, keys, pos, cat_pos, wanted, size, back="__b_", ahead="__f_")
    db = F.col(pos) - F.col(f"__b_{cat_pos}")
    df_ = F.col(f"__f_{cat_pos}") - F.col(pos)
    use_back = (db <= tol) & (df_.isNull() | (db <= df_))
    use_next = df_ <= tol
    return both.select(
        *df.columns,
        *[F.when(use_back, F.col(f"__b_{v}")).when(use_next, F.col(f"__f_{v}")).alias(prefix + v) for v in wanted],
    )


def near_any_member(
    df: DataFrame, catalogue: DataFrame, row_id: Sequence[str], members: str, cat_pos: str, tol: int, size: int, out: str
) -> DataFrame:
    """Does any member time of the array lie within ``tol`` of any catalogue time?"""
    times = df.select(*row_id, F.explode(members).alias("__p"))
    near = near_any(times, catalogue, [], "__p", cat_pos, tol, size, "__hit").filter("__hit").select(*row_id).distinct()
    return df.join(near.withColumn(out, F.lit(True)), list(row_id), "left").withColumn(out, F.coalesce(out, F.lit(False))).select(*df.columns, out)


def greedy_match(
    detections: DataFrame, catalogue: DataFrame, keys: Sequence[str], det_pos: str, cat_pos: str,
    tol: int, size: int,
) -> DataFrame:
    """Greedy one-to-one matching: (keys..., side, t, n, matched).

    Catalogue rows in time order each take the nearest free detection within ``tol``,
    the earliest among equally near. ``side`` is 'det' or 'cat'. Rows of equal time and
    side are interchangeable, so only counts per position travel and a catalogue position
    takes ``min(free, wanted)`` of each neighbour in one step.

    The line is cut into pieces of ``size`` positions. A piece depends on the ones before
    only through the detections near its begin that are taken already. More free
    detections at the begin leave more (never fewer) of each free at the end, so two runs
    of a piece, with all and with none of them free, bracket every case: where both leave
    the same at its end, as nearly all pieces do, that end is settled. Pieces whose begin
    is not settled follow the ones before in one chain, which is read as a stream of
    positions with a state of ``2 tol``. Two passes suffice, whatever the data.
    """
    keys, size = list(keys), max(size, 2 * tol + 1)
    both = detections.select(*keys, F.col(det_pos).cast("bigint").alias("t"), F.lit(1).alias("d")).unionByName(
        catalogue.select(*keys, F.col(cat_pos).cast("bigint").alias("t"), F.lit(0).alias("d"))
    )
    merged = both.groupBy(*keys, "t").agg(F.sum("d").cast("bigint").alias("nd"), F.count_if(F.col("d") == 0).alias("nc"))
    rows = spread(merged, "t", size, tol, tol).withColumn("nc", F.when(F.col(HOME), F.col("nc")).otherwise(0)).drop(HOME)
    rows = stage_table(rows.filter("nd > 0 OR nc > 0"))
    begin, end = F.col(CHUNK) * size, (F.col(CHUNK) + 1) * size

    taken = F.when(F.col("t") < begin + tol, F.col("nd")).otherwise(0)
    cases = rows.withColumn("__case", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("used", F.when(F.col("__case") == 1, taken).otherwise(0))
    ends = _fold(cases, [*keys, CHUNK, "__case"], tol).filter((F.col("nd") > 0) & (F.col("t") >= end - tol))
    at = (F.col(CHUNK) + 1).alias(CHUNK)
    borders = stage_table(ends.groupBy(*keys, at, "t").agg(F.min("used").alias("used"), (F.min("used") < F.max("used")).alias("__open")))

    waiting = stage_table(borders.filter("__open").select(*keys, CHUNK).distinct())
    if waiting.isEmpty():
        chained = rows.withColumn("__chain", F.col(CHUNK))
    else:
        pieces = rows.select(*keys, CHUNK).distinct().join(waiting.withColumn("__waits", F.lit(True)), [*keys, CHUNK], "left")
        first = F.when(F.col("__waits").isNull(), F.col("__piece"))
        pieces = carry_forward(pieces.withColumnRenamed(CHUNK, "__piece"), keys, "__piece", {"__chain": first}, 10_000)
        chained = rows.join(pieces.select(*keys, F.col("__piece").alias(CHUNK), "__chain"), [*keys, CHUNK])
    part = [*keys, "__chain", "t"]
    lines = chained.groupBy(*part).agg(F.max("nd").alias("nd"), F.sum("nc").alias("nc"))
    settled = borders.filter("used > 0").join(waiting, [*keys, CHUNK], "left_anti")
    entry = settled.select(*keys, F.col(CHUNK).alias("__chain"), "t", "used")
    lines = lines.join(entry, part, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    done = stage_table(_fold(lines, [*keys, "__chain"], tol))
    cats = done.filter("nc > 0").select(*keys, F.lit("cat").alias("side"), "t", F.col("nc").alias("n"), F.col("hits").alias("matched"))
    # a detection near a border is seen by both chains; the later one knows more
    dets = done.filter("nd > 0").groupBy(*keys, "t").agg(F.max("nd").alias("n"), F.max("used").alias("matched"))
    return cats.unionByName(dets.select(*keys, F.lit("det").alias("side"), "t", "n", "matched"))


def _fold(rows: DataFrame, part: list[str], tol: int) -> DataFrame:
    """Match each group of ``part`` in time order: ``rows`` (part..., t, nd, nc, used) with ``used`` brought up to date and ``hits``.

    Tasks read their sorted rows as a stream. Groups are laid end to end on one line, too
    far apart to meet, so small groups share a batch and long ones pass through in turn.
    """
    columns = [*part, "t", "nd", "nc", "used"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, line, tail = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("t").to_numpy()
            new = np.zeros(len(t), bool)
            for name in part:
                ids = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= ids[1:] != ids[:-1]
            here = [tuple(batch.column(name)[i].as_py() for name in part) for i in (0, -1)]
            new[0] = last is None or here[0] != last[0]
            step = np.diff(t, prepend=t[0] if last is None else last[1])
            step[new] = 2 * tol + 1
            place = line + np.cumsum(step)
            last, line = (here[1], t[-1]), int(place[-1])
            free = batch.column("nd").to_numpy() - batch.column("used").to_numpy()
            more = (pa.Table.from_batches([batch]), place, free, batch.column("nc").to_numpy().copy(), np.zeros(len(t), np.int64))
            tail = more if tail is None else (pa.concat_tables([tail[0], more[0]]), *(np.concatenate(x) for x in zip(tail[1:], more[1:], strict=True)))
            ready = int(np.searchsorted(tail[1], line - tol))  # all that these can take is here
            match_counted(*tail[1:], tol, ready)
            over = int(np.searchsorted(tail[1], line - 2 * tol))  # nothing that follows takes these
            if over:
                yield from _folded(tail, over, columns)
                tail = (tail[0].slice(over), *(x[over:] for x in tail[1:]))
        if tail is not None:
            match_counted(*tail[1:], tol, len(tail[1]))
            yield from _folded(tail, len(tail[1]), columns)

    types = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(types[n] for n in part), *(T.StructField(n, T.LongType()) for n in ("t", "nd", "nc", "used", "hits"))])
    ordered = rows.select(*columns).repartition(*part).sortWithinPartitions(*part, "t")
    return ordered.mapInArrow(run, schema)


def _folded(tail: tuple, n: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    table, _, free, _, hits = tail
    table = table.slice(0, n).select(columns)
    used = table.column("nd").to_numpy() - free[:n]
    table = table.set_column(len(columns) - 1, "used", pa.array(used)).append_column("hits", pa.array(hits[:n]))
    yield from table.combine_chunks().to_batches()


def match_counted(place: np.ndarray, free: np.ndarray, wanted: np.ndarray, hits: np.ndarray, tol: int, upto: int) -> None:
    """Give the first ``upto`` positions what they want of the free ones near them; changes the arrays.

    Links past used-up positions are shortened as they are followed, so a crowded stretch
    costs no more than an empty one.
    """
    at, left = place.tolist(), free.tolist()
    n = len(at)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def nearest(i: int, link: list[int]) -> int:
        passed = []
        while 0 <= i < n and not left[i]:
            passed.append(i)
            i = link[i]
        for p in passed:
            link[p] = i
        return i

    for c in np.flatnonzero(wanted[:upto]).tolist():
        want, low, high = int(wanted[c]), nearest(c, before), nearest(c, after)
        while want:
            back = at[c] - at[low] if low >= 0 else tol + 1
            ahead = at[high] - at[c] if high < n else tol + 1
            if min(back, ahead) > tol:
                break
            k = low if back <= ahead else high
            take = min(left[k], want)
            left[k] -= take
            want -= take
            if not left[k]:
                low, high = nearest(low, before), nearest(high, after)
        hits[c] += int(wanted[c]) - want
        wanted[c] = 0
    free[:] = left


def match_counts(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TP, FP and FN from greedy_match rows."""
    n, m, side = F.col("n"), F.col("matched"), F.col("side")
    zero = F.lit(0).cast("bigint")
    return matched.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(side == "cat", m)), zero).alias("tp"),
        F.coalesce(F.sum(F.when(side == "det", n - m)), zero).alias("fp"),
        F.coalesce(F.sum(F.when(side == "cat", n - m)), zero).alias("fn"),
    )
