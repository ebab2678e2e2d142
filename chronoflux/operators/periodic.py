"""Periodicity of event windows as set-based jobs over all windows at once.

A window is one row set (wid, j = 0..n-1, x); windows are short (an event's rise, at
most 30 minutes), so every group below is bounded. After the first shuffle by window
all later steps group by keys that start with the window and reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoflux.functions.scalars import floor_div, geometric_grid, normal_upper_quantile
from chronoflux.operators.timeline import CHUNK, gap_runs, with_chunk

MIN_SAMPLES, MIN_LENGTH = 16, 30
MIN_PERIOD, MAX_PERIOD, PERIOD_SHARE = 4.0, 300.0, 1 / 3
N_PERIODS = 48
CONFIDENCE = 0.95
LOCAL_LEVEL = 2.9957  # half the 95 % point of chi-square with 2 degrees of freedom
BANDWIDTH = 1.5
REACH = 8.0  # wavelet support in scales


def impulsive_windows(
    events: DataFrame, samples: DataFrame, keys: Sequence[str], wid: str, start: str, peak: str, pos: str,
    rate: str, gti: str, bucket: int, min_length: int = MIN_LENGTH, min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """In-GTI samples of [start, peak] of every event, renumbered without gaps."""
    return series_rows(impulsive_series(events, samples, keys, wid, start, peak, pos, rate, gti, bucket, min_length, min_samples), wid, "y")


def impulsive_series(
    events: DataFrame, samples: DataFrame, keys: Sequence[str], wid: str, start: str, peak: str, pos: str,
    rate: str, gti: str, bucket: int, min_length: int = MIN_LENGTH, min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """The windows of :func:`impulsive_windows` as one row each: (wid, n, y by position).

    The cells of a time bucket are one list. An event cuts its part out of the list of each
    bucket it touches, and the parts of a window meet by their bucket: samples travel
    packed, without a row and a window's name each.
    """
    keys = list(keys)
    long_enough = events.filter(F.col(peak) - F.col(start) >= min_length)
    good = samples.filter(F.col(gti) & F.col(rate).isNotNull()).select(*keys, pos, F.col(rate).cast("double").alias("y"))
    home = F.col(CHUNK) * bucket
    cells = with_chunk(good, pos, bucket).groupBy(*keys, CHUNK).agg(
        F.array_sort(F.collect_list(F.struct((F.col(pos) - home).cast("int").alias("at"), "y"))).alias("__cells"))
    first = floor_div(start, bucket)
    spans = long_enough.select(*keys, wid, start, peak).withColumn(CHUNK, F.explode(F.sequence(first, F.greatest(first, floor_div(peak, bucket)))))
    inside = F.filter("__cells", lambda c: c["at"].between(F.col(start) - home, F.col(peak) - home))
    parts = spans.join(cells, [*keys, CHUNK]).select(wid, F.col(CHUNK).alias("chunk"), inside.alias("__in"))
    parts = parts.filter(F.size("__in") > 0).select(wid, F.struct("chunk", F.col("__in.at").alias("at"), F.col("__in.y").alias("y")).alias("__part"))
    rows = parts.groupBy(wid).agg(F.array_sort(F.collect_list("__part")).alias("__p"))
    one_each = F.size(F.array_distinct("__p.chunk")) == F.size("__p")
    # Spans of one name that share a bucket are merged cell by cell.
    mixed = F.array_sort(F.flatten(F.transform("__p", lambda p: F.transform(
        F.arrays_zip(p["at"].alias("at"), p["y"].alias("y")), lambda c: F.struct(p["chunk"].alias("chunk"), c["at"].alias("at"), c["y"].alias("y"))))))
    y = F.when(one_each, F.flatten("__p.y")).otherwise(F.transform(mixed, lambda c: c["y"]))
    rows = rows.select(wid, y.alias("y"))
    return rows.select(wid, F.size("y").cast("bigint").alias("n"), "y").filter(F.col("n") >= min_samples)


def series_rows(series: DataFrame, wid: str, value: str) -> DataFrame:
    """A window's list as rows (wid, j, n, value)."""
    return series.select(wid, "n", F.posexplode(value).alias("j", value)).select(wid, "j", "n", value)


def gather(rows: DataFrame, wid: str, value: str) -> DataFrame:
    """Rows (wid, j, n, value) as one list per window."""
    lists = rows.groupBy(wid).agg(F.first("n").cast("bigint").alias("n"), F.array_sort(F.collect_list(F.struct("j", value))).alias("__s"))
    return lists.select(wid, "n", F.col(f"__s.{value}").cast("array<double>").alias(value))


def map_series(series: DataFrame, wid: str, value: str, out: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``work`` on the lists of all windows: those of a batch that are equally long are one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in matrices(batch.column(value)):
                done = work(matrix)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(wid).take(at), batch.column("n").take(at), lists_of(done)], [wid, "n", out])

    return series.select(wid, "n", value).mapInArrow(run, f"{wid} {series.schema[wid].dataType.simpleString()}, n bigint, {out} array<double>")


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values of the lists of each length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield rows, flat[start[rows][:, None] + np.arange(n)]


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    rows, n = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def detrend(rows: DataFrame, wid: str) -> DataFrame:
    """Residual after a sliding quadratic fit over about half the window."""
    return series_rows(detrend_series(gather(rows, wid, "y"), wid), wid, "x")


def detrend_series(series: DataFrame, wid: str) -> DataFrame:
    """Residuals (wid, n, x) of the windows (wid, n, y)."""
    return map_series(series, wid, "y", "x", residuals)


def residuals(y: np.ndarray) -> np.ndarray:
    """Each row less its sliding quadratic fits.

    Prefix sums of y, i*y and i^2*y give the fit around any centre in closed form; values
    near the ends are evaluated on the first and last full fit.
    """
    n = y.shape[1]
    half = max(5, n // 2)
    width = min(half + 1 if half % 2 == 0 else half, n if n % 2 == 1 else n - 1)
    m = (width - 1) // 2
    y = centred(y)
    j = np.arange(n)
    c = np.maximum(m, np.minimum(j, n - 1 - m))
    upto = [np.cumsum(np.concatenate([np.zeros((len(y), 1)), v], 1), 1) for v in (y, y * j, y * j * j)]
    s0, t1, t2 = (p[:, c + m + 1] - p[:, c - m] for p in upto)
    s1 = t1 - c * s0
    s2 = t2 - 2 * c * t1 + c * c * s0
    k2 = m * (m + 1) * (2 * m + 1) / 3
    k4 = k2 * (3 * m * m + 3 * m - 1) / 5
    size = 2.0 * m + 1
    a2 = (s2 - k2 / size * s0) / (k4 - k2 * k2 / size)
    a0 = s0 / size - a2 * k2 / size
    k = j - c
    return y - (a0 + s1 / k2 * k + a2 * k * k)


def centred(y: np.ndarray) -> np.ndarray:
    """Each row less its mean, summed in order."""
    return y - np.cumsum(y, 1)[:, -1:] / y.shape[1]


def periodogram(rows: DataFrame, wid: str) -> DataFrame:
    """|DFT|^2 / n of the centred residual without the DC and Nyquist terms: (wid, n, i, f, power)."""
    return spectrum_rows(spectrum_series(gather(rows, wid, "x"), wid), wid)


def spectrum_series(series: DataFrame, wid: str) -> DataFrame:
    """Power by frequency (wid, n, power) of the residuals (wid, n, x)."""
    return map_series(series, wid, "x", "power", powers)


def powers(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return np.abs(np.fft.rfft(centred(x), axis=1)[:, 1 : (n - 1) // 2 + 1]) ** 2 / n


def spectrum_rows(series: DataFrame, wid: str, *more: str) -> DataFrame:
    """Positive powers as rows, of windows that have six or more."""
    nf = F.size(F.filter("power", lambda p: p > 0)).cast("bigint")
    rows = series.withColumn("nf", nf).filter("nf >= 6").select(wid, "n", "nf", *more, F.posexplode("power").alias("__i", "power"))
    i = F.col("__i") + 1
    return rows.filter("power > 0").select(wid, "n", i.alias("i"), "power", (i / F.col("n")).alias("f"), "nf", *more)


COARSE_BETA = tuple(round(0.5 * k, 1) for k in range(11))
COARSE_LOG_RATIO = tuple(round(-8 + 0.8 * k, 1) for k in range(16))
NO_FLOOR = -99.0  # log10 ratio standing for "no white-noise floor"
NEWTON_STEPS, FIRST_DAMPING = 24, 0.01


def red_noise_fit(spectrum: DataFrame, wid: str) -> DataFrame:
    """Whittle fit of A * (f^-beta + ratio) to each window: (wid, beta, lr, a), ``lr`` the decimal log of the ratio.

    A window is one row with its ordinates, which its length bounds; a task fits many.
    """
    lists = spectrum.groupBy(wid).agg(F.array_sort(F.collect_list(F.struct("f", "power"))).alias("s")).select(wid, F.col("s.f").alias("f"), F.col("s.power").alias("power"))
    return fit_lists(lists, wid).drop("f", "power")


def fit_series(series: DataFrame, wid: str) -> DataFrame:
    """The windows (wid, n, power) of six or more positive powers, with their fit (beta, lr, a)."""
    seen = F.filter(F.transform("power", lambda p, i: F.struct(((i + 1) / F.col("n")).alias("f"), p.alias("power"))), lambda c: c["power"] > 0)
    lists = series.select(wid, "n", F.col("power").alias("all"), seen.alias("__s")).filter(F.size("__s") >= 6)
    fitted = fit_lists(lists.select(wid, "n", "all", F.col("__s.f").alias("f"), F.col("__s.power").alias("power")), wid)
    return fitted.select(wid, "n", F.col("all").alias("power"), "beta", "lr", "a")


def fit_lists(lists: DataFrame, wid: str) -> DataFrame:
    """``lists`` (with f and power) and the fit of each row."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, 3))
            for (rows, f), (_, power) in zip(matrices(batch.column("f")), matrices(batch.column("power")), strict=True):
                kinds, kind = np.unique(f, axis=0, return_inverse=True)
                for k in range(len(kinds)):
                    of = np.flatnonzero(kind.ravel() == k)
                    found[rows[of]] = whittle_fits(kinds[k], power[of])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[:, k]) for k in range(3)]], [*batch.schema.names, "beta", "lr", "a"])

    return lists.mapInArrow(fit, T.StructType([*lists.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("beta", "lr", "a")]]))


def whittle_fit(f: np.ndarray, power: np.ndarray) -> tuple[float, float, float]:
    """(beta, lr, a) of one window; see :func:`whittle_fits`."""
    return tuple(float(v) for v in whittle_fits(f, power[None, :])[0])


def whittle_fits(f: np.ndarray, power: np.ndarray) -> np.ndarray:
    """(beta, lr, a) of least negative log-likelihood per row of ``power``, the scale profiled out.

    A coarse grid, a fine one around its best point (of equal points the least), then
    Newton steps on beta and the log of the ratio. A step is taken only downhill; one that
    is not is tried again with more damping, which shortens it and turns it to the gradient.
    All rows share the frequencies and go through the grids and the steps together.
    """
    log_f = np.log(f)

    def best(power: np.ndarray, betas: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beta, lr = (x.ravel() for x in np.meshgrid(betas, ratios, indexing="ij"))  # rising: of equal points the first is least
        g = f[None, :] ** -beta[:, None] + np.where(lr == NO_FLOOR, 0.0, 10.0**lr)[:, None]
        nll = np.round(np.log(power @ (1 / g).T / len(f)) + np.log(g).mean(1), 9)
        i = nll.argmin(1)
        return beta[i], lr[i]

    beta, lr = best(power, np.array(COARSE_BETA), np.array((NO_FLOOR, *COARSE_LOG_RATIO)))
    starts, start = np.unique(np.stack([beta, lr], 1), axis=0, return_inverse=True)
    for k, (b, r) in enumerate(starts):
        of = start.ravel() == k
        betas = np.round(b + 0.1 * np.arange(-5, 6), 1)
        ratios = np.array([NO_FLOOR]) if r == NO_FLOOR else np.round(r + 0.2 * np.arange(-4, 5), 1)
        beta[of], lr[of] = best(power[of], betas[(betas >= 0) & (betas <= 5)], ratios)
    floor, u = lr != NO_FLOOR, lr * np.log(10.0)

    def parts(beta: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, r = np.exp(-beta[:, None] * log_f), np.where(floor, np.exp(u), 0.0)[:, None]
        return p, r, p + r

    def level(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = (power / g).mean(1)
        return a, np.log(a) + np.log(g).mean(1)

    a, nll = level(parts(beta, u)[2])
    damping = np.full(len(power), FIRST_DAMPING)
    for _ in range(NEWTON_STEPS):
        p, r, g = parts(beta, u)
        q, b1, u1 = power / g, -log_f * p / g, r / g  # first derivatives of log g
        b2 = log_f**2 * p / g
        ab, au = -(q * b1).mean(1) / a, -(q * u1).mean(1) / a
        db, du = ab + b1.mean(1), au + u1.mean(1)
        hbb = (q * (2 * b1 * b1 - b2)).mean(1) / a - ab * ab + (b2 - b1 * b1).mean(1) + damping
        hbu = (2 * q * b1 * u1).mean(1) / a - ab * au - (b1 * u1).mean(1)
        huu = (q * (2 * u1 * u1 - u1)).mean(1) / a - au * au + (u1 - u1 * u1).mean(1) + damping
        det = np.where(floor, hbb * huu - hbu * hbu, hbb)
        better = (hbb > 0) & (det > 0)
        safe = np.where(better, det, 1.0)
        sb = np.where(floor, -(huu * db - hbu * du) / safe, -db / safe)
        su = np.where(floor, -(hbb * du - hbu * db) / safe, 0.0)
        new_b = np.where(better, np.clip(beta + np.clip(sb, -0.5, 0.5), 0.0, 5.0), beta)
        new_u = np.where(better, u + np.clip(su, -1.0, 1.0), u)
        new_a, new_nll = level(parts(new_b, new_u)[2])
        better &= new_nll < nll
        beta, u, a, nll = (np.where(better, new, old) for new, old in ((new_b, beta), (new_u, u), (new_a, a), (new_nll, nll)))
        damping = damping * np.where(better, 0.125, 8.0)
    return np.stack([beta, np.where(floor, u / np.log(10.0), NO_FLOOR), a], 1)


def significance(spectrum: DataFrame, fit: DataFrame, wid: str) -> DataFrame:
    """gamma = 2 I / S, the global threshold, and the global p-value of every frequency."""
    return against_fit(spectrum.join(fit, wid))


def against_fit(rows: DataFrame) -> DataFrame:
    """:func:`significance` of rows that carry their window's fit."""
    ratio = F.when(F.col("lr") == NO_FLOOR, 0.0).otherwise(F.pow(F.lit(10.0), F.col("lr")))
    model = F.col("a") * (F.pow(F.col("f"), -F.col("beta")) + ratio)
    gamma = 2.0 * F.col("power") / model
    crit = -2.0 * F.log(1.0 - F.pow(F.lit(CONFIDENCE), 1.0 / F.col("nf")))
    rows = rows.withColumn("model", model).withColumn("gamma", gamma).withColumn("crit", crit)
    p = 1.0 - F.pow(1.0 - F.exp(-F.col("gamma") / 2), F.col("nf"))
    return rows.withColumn("p_global", F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p)))


def equivalent_sigma(p: str) -> Column:
    """Two-sided Gaussian equivalent of a global p-value."""
    return normal_upper_quantile(F.col(p) / 2)


def periodic_signals(tested: DataFrame, wid: str) -> DataFrame:
    """The strongest frequency of every run of adjacent significant in-band bins."""
    period = F.col("n") / F.col("i")
    top = F.least(F.col("n") * PERIOD_SHARE, F.lit(MAX_PERIOD))
    hits = tested.filter((F.col("gamma") > F.col("crit")) & (period >= MIN_PERIOD) & (period <= top))
    runs = gap_runs(hits.select(wid, "i", "n", "gamma", "p_global"), [wid], "i", 1, None, out="run")
    best = F.max_by(F.struct("i", "n", "gamma", "p_global"), F.struct("gamma", -F.col("i")))
    out = runs.groupBy(wid, "run").agg(best.alias("b"), F.min("i").alias("i_low"), F.max("i").alias("i_high"))
    return out.select(
        wid, (F.col("b.n") / F.col("b.i")).alias("period"), "b.n", "b.gamma", "b.p_global", F.col("b.i").cast("double").alias("n_cycles"),
        (F.col("b.n") / F.col("i_high")).alias("band_low"), (F.col("b.n") / F.col("i_low")).alias("band_high"),
    ).withColumn("sigma", equivalent_sigma("p_global"))


def regime(period: str) -> Column:
    return F.when(F.col(period) >= 16, "classic").when(F.col(period) >= 8, "intermediate").otherwise("short")


def attribution(tier: str) -> Column:
    return F.when(F.col(tier).isin("classic", "intermediate"), "confirmed_regime").otherwise("pending_instrumental")


def featured(signals: DataFrame, wid: str, top: int) -> DataFrame:
    """(pick, wid, period): the strongest signals per regime and overall, and of X-class windows (``has_x``) the
    strongest and the strongest classic one."""
    strength = [F.round("gamma", 6).desc(), F.col(wid), F.col("period")]
    per_regime = Window.partitionBy("regime").orderBy(*strength)
    picks = signals.withColumn("k", F.row_number().over(per_regime)).filter(F.col("k") <= top).select(F.col("regime").alias("pick"), wid, "period")
    x_class = signals.filter("has_x")
    for name, rows, n in (("overall", signals, top), ("featured_x", x_class, 1), ("classic_x", x_class.filter("regime = 'classic'"), 1)):
        picks = picks.unionByName(rows.orderBy(*strength).limit(n).select(F.lit(name).alias("pick"), wid, "period"))
    return picks


def period_rows(windows: DataFrame, n: str = "n") -> DataFrame:
    """The geometric period grid of every window: (…, r, period)."""
    top = F.least(F.col(n) * PERIOD_SHARE, F.lit(MAX_PERIOD))
    return windows.filter(top > MIN_PERIOD).select("*", F.posexplode(geometric_grid(F.lit(MIN_PERIOD), top, N_PERIODS)).alias("r", "period"))


def wavelet_power(rows: DataFrame, wanted: DataFrame, wid: str) -> DataFrame:
    """Complex-Morlet power of every window at the wanted (wid, r, period): (wid, r, period, power by time).

    A window travels as one row with its samples and its periods, both bounded by the
    window, and a task works through many windows: one transform of the samples and one
    of each wavelet give the sums of all times together, without a row per pair.
    """
    series = rows.groupBy(wid).agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("s")).select(wid, F.col("s.x").alias("x"))
    asked = wanted.groupBy(wid).agg(F.array_sort(F.collect_list(F.struct("r", "period"))).alias("p"))
    both = series.join(asked, wid).select(wid, "x", F.col("p.r").alias("r"), F.col("p.period").alias("period"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, r, period = (batch.column(c)[i].values for c in ("x", "r", "period"))
                power = morlet_powers(x.to_numpy(), period.to_numpy())
                name = pa.array([batch.column(wid)[i].as_py()] * len(r), batch.column(wid).type)
                yield pa.RecordBatch.from_arrays([name, r, period, pa.array(list(power), pa.list_(pa.float64()))], [wid, "r", "period", "power"])

    key = both.schema[wid].dataType.simpleString()
    return both.mapInArrow(transform, f"{wid} {key}, r int, period double, power array<double>")


def morlet_powers(x: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Power at each period (rows) and sample of one window; the wavelet ends at ``REACH`` scales."""
    n = len(x)
    size = 1 << int(2 * n - 1).bit_length()  # no lag wraps around
    lag = np.arange(-(n - 1), n)
    u = lag[None, :] / periods[:, None]
    wave = np.where(np.abs(lag)[None, :] <= np.ceil(periods * REACH)[:, None], np.exp(-u * u / BANDWIDTH + 2j * np.pi * u), 0)
    placed = np.zeros((len(periods), size), complex)
    placed[:, lag % size] = wave
    sums = np.fft.ifft(np.fft.fft(x, size)[None, :] * np.fft.fft(placed, axis=1), axis=1)[:, :n]
    return np.abs(sums) ** 2 / (np.pi * BANDWIDTH * periods)[:, None]


def signal_times(rows: DataFrame, signals: DataFrame, wid: str) -> DataFrame:
    """Time of the largest wavelet power at the grid period nearest to each signal."""
    grid = period_rows(signals.select(wid, F.col("period").alias("found"), "n"))
    gap = F.abs(F.col("period") - F.col("found"))
    nearest = grid.groupBy(wid, "found").agg(F.min(F.struct(gap.alias("g"), "r", "period")).alias("b")).select(
        wid, "found", F.col("b.r").alias("r"), F.col("b.period").alias("period"))
    power = wavelet_power(rows, nearest.select(wid, "r", "period").distinct(), wid)
    rounded = F.transform("power", lambda p: F.round(p, 8))
    times = power.select(wid, "r", (F.array_position(rounded, F.array_max(rounded)) - 1).alias("tau"))
    return nearest.join(times, [wid, "r"]).select(wid, F.col("found").alias("period"), "tau")


def normalised_map(rows: DataFrame, spectrum: DataFrame, fit: DataFrame, wid: str) -> DataFrame:
    """Wavelet power in units of the fitted red noise, with the cone of influence.

    The continuum is interpolated log-log between the two Fourier frequencies around
    each period, clamped to the outermost ones; one constant per window (the median over
    periods) aligns both power scales.
    """
    windows = spectrum.groupBy(wid, "n").agg(F.count("*").alias("nf")).join(fit, wid)
    wanted = period_rows(windows)
    ratio = F.when(F.col("lr") == NO_FLOOR, 0.0).otherwise(F.pow(F.lit(10.0), F.col("lr")))
    at = F.col("n") / F.col("period")
    last = F.floor((F.col("n") - 1) / 2)
    lo = F.least(last, F.greatest(F.lit(1), F.floor(at))).cast("double")
    hi = F.least(last.cast("double"), lo + 1)
    def level(i: Column) -> Column:
        return F.log(F.col("a") * (F.pow(i / F.col("n"), -F.col("beta")) + ratio))
    share = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(at / lo) / F.log(hi / lo)))).otherwise(0.0)
    wanted = wanted.withColumn("continuum", F.exp(level(lo) + (level(hi) - level(lo)) * share))
    power = wavelet_power(rows, wanted, wid)
    joined = power.join(wanted.select(wid, "r", "n", "continuum"), [wid, "r"])
    mean_power = F.aggregate("power", F.lit(0.0), lambda a, p: a + p) / F.size("power")
    constant = F.percentile(mean_power / F.col("continuum"), 0.5).over(Window.partitionBy(wid)).alias("k")
    out = joined.select("*", constant).select(wid, "r", "period", "n", "continuum", "k", F.posexplode("power").alias("tau", "power"))
    cone = F.greatest(F.lit(MIN_PERIOD), F.least(F.col("tau"), F.col("n") - 1 - F.col("tau")) / F.sqrt(F.lit(2.0)))
    return out.select(
        wid, "r", "period", "tau", (F.col("power") / (F.col("k") * F.col("continuum"))).alias("z"), cone.alias("coi"),
    )


def inject(rows: DataFrame, period: float, amplitude: float) -> DataFrame:
    """Add a sinusoid to every window (for recovery tests)."""
    wave = amplitude * F.sin(2 * 3.141592653589793 * F.col("j") / period)
    return rows.withColumn("y", F.col("y") + wave)


def search(rows: DataFrame, wid: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(residual, spectrum, fit, tested) of all windows."""
    residual = detrend(rows, wid)
    spectrum = periodogram(residual, wid)
    fit = red_noise_fit(spectrum, wid)
    return residual, spectrum, fit, significance(spectrum, fit, wid)
