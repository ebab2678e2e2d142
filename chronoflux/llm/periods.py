"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are
equal) that is long enough. The texts of a batch are laid end to end, every text with
words of its own, so that nothing is equal across texts.

1. Prefix doubling ranks all factors of 1, 2, 4, ... words (a factor's rank is the first
   row of its class in the suffix array). Two ranks compare any two dyadic factors, and
   so give longest common extensions in both directions. Only positions whose factor
   occurs again are sorted on.
2. The text is cut into dyadic blocks: of 8 words for periods 1 to 15, of b = 16, 32, ...
   for periods b to 2b - 1. A run of three periods contains a whole block and its copy one
   period later. Each block that occurs again queries its occurrences in the neighbouring
   window: range successors (next greater position in its class's rows of the suffix
   array) over a wavelet tree.
3. Up to two occurrences give their distances as candidate periods. Three or more form an
   arithmetic progression, whose difference is the block's own period: block and
   progression lie in two runs of that small period, and a larger period can only carry
   the end (or start) of the one onto that of the other, which gives two candidates.
4. Extensions in both directions verify each candidate; the least period of a stretch
   stays.

Work is near linear in the words; a worker holds one batch of texts or one longer text.

Defined cases: null, empty and blank texts have no words and no runs and collapse to an
empty text; rows that repeat an id are judged one by one; the order of runs is by start,
then period; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.llm.common import id_remainder, table, texts_of

#: Least length of a run in words and in periods. Three periods are what step 2 needs.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a batch of texts, log2 of the smallest block.
BATCH_WORDS, SMALLEST = 1 << 17, 3
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def factor_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the factors of 1, 2, 4, ... symbols from each position, until none occurs twice.

    The last symbol must be unique, so that every factor that occurs twice lies within.
    """
    order = np.argsort(symbols, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], symbols[order[1:]] != symbols[order[:-1]])))
    size = np.diff(np.concatenate((new, [len(symbols)])))
    rank = np.empty(len(symbols), np.int64)
    rank[order] = np.repeat(new, size)
    active, width, levels = order[np.repeat(size, size) > 1], 1, [rank]
    while len(active):
        key = rank[active] << 32 | rank[active + width]
        by = np.argsort(key)
        active, key = active[by], key[by]
        row = np.arange(len(key))
        old = np.concatenate(([True], (key[1:] >> 32) != (key[:-1] >> 32)))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        moved = np.maximum.accumulate(np.where(new, row, 0)) - np.maximum.accumulate(np.where(old, row, 0))
        rank = rank.copy()
        rank[active] += moved
        levels.append(rank)
        active = active[~(new & np.concatenate((new[1:], [True])))]
        width *= 2
    return levels


class Wavelet:
    """Wavelet tree (in matrix form) over a sequence of whole numbers; queries take arrays."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits, self.zeros, self.ones = range(int(top).bit_length() - 1, -1, -1), [], []
        for bit in self.bits:
            one = (values >> bit) & 1 == 1
            self.ones.append(np.concatenate(([0], np.cumsum(one))))
            self.zeros.append(len(values) - self.ones[-1][-1])
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of rows lo to hi - 1 are less than x."""
        n = np.zeros_like(lo)
        for bit, zeros, ones in zip(self.bits, self.zeros, self.ones, strict=True):
            a, b, right = ones[lo], ones[hi], (x >> bit) & 1 == 1
            n += np.where(right, hi - lo - (b - a), 0)
            lo, hi = np.where(right, zeros + a, lo - a), np.where(right, zeros + b, hi - b)
        return n

    def at_rank(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of rows lo to hi - 1."""
        value = np.zeros_like(lo)
        for bit, zeros, ones in zip(self.bits, self.zeros, self.ones, strict=True):
            a, b = ones[lo], ones[hi]
            left = hi - lo - (b - a)
            right = k >= left
            k = np.where(right, k - left, k)
            value |= right.astype(np.int64) << bit
            lo, hi = np.where(right, zeros + a, lo - a), np.where(right, zeros + b, hi - b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The smallest value of rows lo to hi - 1 that is at least x, or ``none``."""
        k = self.below(lo, hi, x)
        return np.where(k < hi - lo, self.at_rank(lo, hi, np.minimum(k, hi - lo - 1)), none)


class Factors:
    """Extensions and occurrences of the factors of one sequence."""

    def __init__(self, symbols: np.ndarray):
        self.levels, self.n = factor_ranks(symbols), len(symbols)
        self.repeats = len(self.levels) > SMALLEST + 1
        if not self.repeats:
            return
        rows = np.empty(self.n, np.int64)
        rows[self.levels[-1]] = np.arange(self.n)  # the suffix array
        first = self.levels[SMALLEST]
        kept = np.bincount(first, minlength=self.n)[first[rows]] > 1
        self.before = np.concatenate(([0], np.cumsum(kept)))
        self.wavelet = Wavelet(rows[kept], self.n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor from i and from j > i on."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][i] == self.levels[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends before i and before j > i."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            same = i >= 1 << k
            same[same] = self.levels[k][i[same] - (1 << k)] == self.levels[k][j[same] - (1 << k)]
            i[same] -= 1 << k
            j[same] -= 1 << k
        return start - i

    def candidates(self):
        """(start, period): places where a block occurs again one candidate period later."""
        for k in range(SMALLEST, len(self.levels) - 1):
            b, rank = 1 << k, self.levels[k]
            size = np.bincount(rank, minlength=self.n)
            at = np.arange(0, self.n, b)
            at = at[size[rank[at]] > 1]
            if not len(at):
                continue
            lo, hi = self.before[rank[at]], self.before[rank[at] + size[rank[at]]]
            begin, end = at + (1 if k == SMALLEST else b), np.minimum(at + 2 * b - 1, self.n - 1)
            if k == SMALLEST:
                while len(at):  # at most 15 places
                    p = self.wavelet.successor(lo, hi, begin, self.n)
                    found = p <= end
                    at, lo, hi, end, p = at[found], lo[found], hi[found], end[found], p[found]
                    yield at, p - at
                    begin = np.minimum(p + 1, self.n)
                continue
            first = self.wavelet.successor(lo, hi, begin, self.n)
            some = first <= end
            at, lo, hi, end, first = at[some], lo[some], hi[some], end[some], first[some]
            second = self.wavelet.successor(lo, hi, np.minimum(first + 1, self.n), self.n)
            third = self.wavelet.successor(lo, hi, np.minimum(second + 1, self.n), self.n)
            many = third <= end
            two = (second <= end) & ~many
            yield at[~many], (first - at)[~many]
            yield at[two], (second - at)[two]
            i, p, step = at[many], first[many], (second - first)[many]
            yield i, self.ahead(p, p + step) + p - self.ahead(i, i + step) - i
            yield i, self.behind(i, i + step) - i - self.behind(p, p + step) + p

    def runs(self, least_words: int, least_periods: int) -> np.ndarray:
        """(start, end, period) of all runs, ordered by start and period."""
        found = [np.empty((0, 3), np.int64)]
        for i, q in self.candidates() if self.repeats else ():
            fit = (q > 0) & (i + q < self.n)
            i, q = i[fit], q[fit]
            start, end = i - self.behind(i, i + q), i + q + self.ahead(i, i + q)
            long = end - start >= np.maximum(least_words, least_periods * q)
            found.append(np.stack((start[long], end[long], q[long]), 1))
        found = np.unique(np.concatenate(found), axis=0)
        # of the periods of one stretch the least stays
        new = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))[: len(found)]
        found = found[new]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def _batches(batches):
    """(id, words) of the rows, gathered to batches of ``BATCH_WORDS`` words."""
    held, size = [], 0
    for b in batches:
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), texts_of(b.column("body")), strict=True):
            held.append((doc_id, raw.split()))
            size += len(held[-1][1])
            if size >= BATCH_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _find(least_words: int, least_periods: int):
    def find(batches):
        for held in _batches(batches):
            number, symbols, border = count(), [], [0]
            for _, words in held:
                symbols += map(defaultdict(number.__next__).__getitem__, words)
                border.append(len(symbols))
            runs = Factors(np.array([*symbols, next(number)], np.int64)).runs(least_words, least_periods)
            cut = np.searchsorted(runs[:, 0], border)
            lists, texts = [], []
            for k, (_, words) in enumerate(held):
                own = runs[cut[k] : cut[k + 1]] - np.array([border[k], border[k], 0])
                lists.append([{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()])
                if len(own):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, own[:, 0] + own[:, 2], 1)
                    np.add.at(gone, own[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                texts.append(b" ".join(words))
            n = [len(words) for _, words in held]
            columns = [pa.array([i for i, _ in held], pa.int64()), pa.array(n, pa.int64()), pa.array(lists, RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its periodic runs, and its words with one period of each run."""
    if least_words < 24 or least_periods < 3:
        raise ValueError("blocks of 8 words find runs of 24 words and three periods or more")
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return body.mapInArrow(_find(least_words, least_periods), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeated_tail(doc_id: Column, words: Column) -> Column:
    """The text in which the words from a place on repeat; place and period follow from the id."""
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
    n = F.size(words).cast("long")
    at = g % n
    period = (F.lit(1) + F.floor((n - at) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - at) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (at + 1).cast("int"), period), times)), F.lit(1), (n - at).cast("int"))
    return F.array_join(F.concat(F.slice(words, F.lit(1), at.cast("int")), tail), " ")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.withColumn("words", F.when(id_remainder(F.col("doc_id"), 10) == 0, words))
    text = F.when(F.size("words") > 0, repeated_tail(F.col("doc_id"), F.col("words"))).otherwise(F.col("text"))
    found = periodic_runs(cut.select("doc_id", text.alias("text")))
    # runs are ordered by start and period, so the first of the best ones stays
    better = F.aggregate("runs", F.expr("runs[0]"), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, better).alias("best"),
                       F.sha2(F.concat(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
