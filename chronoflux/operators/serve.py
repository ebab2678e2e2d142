"""Serving queries over catalogues, forecasts and detections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoflux.functions.scalars import floor_div, json_round
from chronoflux.operators.skill import alert_level, brier_and_ece, class_recall, contingency, reliability, scores
from chronoflux.session import stage_table


def catalogue_page(
    rows: DataFrame, newest: str, tie: str, page: int, page_size: int, status: str | None = None, class_prefix: str | None = None
) -> DataFrame:
    """One page of the catalogue, newest first, with totals over the filtered rows.

    ``orderBy.offset.limit`` keeps only the leading rows of each partition, so no full
    sort is collected anywhere; the totals are one small aggregate beside it.
    """
    if status:
        rows = rows.filter(F.col("status") == status)
    if class_prefix:
        rows = rows.filter(F.coalesce("goes_class", F.lit("")).startswith(class_prefix.upper()))
    totals = rows.agg(F.count("*").alias("total")).withColumn(
        "n_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size))
    )
    chosen = rows.orderBy(F.col(newest).desc(), tie).offset((page - 1) * page_size).limit(page_size)
    return chosen.join(F.broadcast(totals))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def has_member(detectors: str, wanted: str) -> Column:
    return F.array_contains(F.split(detectors, ","), wanted)


def by_tier_and_class(rows: DataFrame, tier: str | None = None, letter: str | None = None) -> DataFrame:
    """Filter by regime tier and class; letter "none" asks for rows without a class."""
    if tier:
        rows = rows.filter(F.col("regime") == tier)
    if letter == "none":
        return rows.filter(F.col("letter").isNull())
    return rows.filter(F.col("letter") == letter) if letter else rows


def latest(rows: DataFrame, t: str, n: int = 1, tie: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(F.col(t).desc(), *tie).limit(n)


def valid_forecasts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with defaults filled, rejected with a reason)."""
    ps = ("probability_15m", "probability_30m", "probability_60m")
    checks = [F.when(~F.coalesce(F.col(p).between(0.0, 1.0), F.lit(False)), F.lit(p)) for p in ps]
    marked = records.withColumn("reason", F.array_join(F.array_compact(F.array(*checks)), ","))
    good = marked.filter("reason = ''").drop("reason").withColumns({
        "alert_level": F.coalesce("alert_level", F.lit("ALL_CLEAR")),
        "source": F.coalesce("source", F.lit("calibrated_trees")),
    })
    return good, marked.filter("reason <> ''")


def day_manifest(flares: DataFrame, forecasts: DataFrame, day: str, p: str, watch: float, warning: float) -> DataFrame:
    """Event counts, alert minutes and X flags per day."""
    events = flares.groupBy(day).agg(F.count("*").alias("n_flares"), F.bool_or(F.col("letter") == "X").alias("has_x"))
    levels = forecasts.withColumn("level", alert_level(p, watch, warning)).groupBy(day).agg(
        F.count_if(F.col("level") == "warning").alias("warning_minutes"), F.count_if(F.col("level") == "watch").alias("watch_minutes")
    )
    return levels.join(events, day, "full").fillna(0).fillna(False, ["has_x"])


def replay_days(parts: Mapping[str, DataFrame], day: str, t: str, width: int, needed: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Replay documents in chunks of ``width`` seconds, and a manifest of the days.

    Every part (series points, events, detections, lead times) has ``day`` and ``t``.
    Chunks: (day, chunk, one list per part in time order); none holds more than what falls
    into ``width`` seconds. Manifest: (day, n_chunks, n_<part>) of the days that all
    ``needed`` parts touch.
    """
    out = None
    for name, df in parts.items():
        rest = [c for c in df.columns if c not in (day, t)]
        rows = df.groupBy(day, floor_div(t, width).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(t, *rest))).alias(name))
        out = rows if out is None else out.join(rows, [day, "chunk"], "full")
    chunks = stage_table(out.select(day, "chunk", *[F.coalesce(n, F.array()).alias(n) for n in parts]))
    sizes = {f"n_{n}": F.sum(F.size(n)) for n in parts}
    manifest = chunks.groupBy(day).agg(F.count("*").alias("n_chunks"), *[c.alias(n) for n, c in sizes.items()])
    for n in needed:
        manifest = manifest.filter(F.col(f"n_{n}") > 0)
    return chunks, manifest


def bounded_leads(leads: DataFrame, lead: str, covered: str) -> DataFrame:
    """flagged, or the reason why not."""
    flagged = F.col(lead).isNotNull()
    return leads.withColumn("flagged", flagged).withColumn(
        "reason", F.when(~flagged & ~F.col(covered), "no_coverage").when(~flagged, "below_threshold")
    )


def riskiest_time(forecasts: DataFrame, t: str, p: str) -> DataFrame:
    """Default NOW: the earliest time of the highest risk."""
    return forecasts.agg((-F.max(F.struct(F.col(p).alias("p"), (-F.col(t)).alias("n"))).getField("n")).alias("now"))


def snapshot(samples: DataFrame, now: DataFrame, t: str, detector: str, window: int = 3 * 3600) -> DataFrame:
    """Trailing slice at NOW: samples, detectors online, last sample per detector."""
    rows = samples.join(F.broadcast(now), (F.col(t) > F.col("now") - window) & (F.col(t) <= F.col("now")))
    return rows.groupBy("now", detector).agg(F.count("*").alias("n"), F.max(t).alias("last_t"))


def one_struct(row: DataFrame, name: str, digits: int) -> DataFrame:
    """A one-row frame as one struct column, numbers rounded and safe for JSON."""
    fields = [json_round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes]
    return row.select(F.struct(*fields).alias(name))


def summary_document(
    forecasts: DataFrame, train: Column, test: Column, p: str, y: str, letter: str, watch: float, warning: float,
    counts: Mapping[str, DataFrame], detection: DataFrame, digits: int = 6,
) -> DataFrame:
    """The nested summary artefact: one row with a struct per topic.

    forecast (contingency and scores on test), baselines (train base rate and the scores of
    never and always warning follow from it), calibration, reliability (curves as arrays),
    per_class (recall of warned events), operating_points, counts, and detection (rows of
    :func:`skill.both_contingencies`). Every number is computed from its table; lists have
    as many entries as there are bins or classes.
    """
    judged = forecasts.filter(test)
    event, alarm = F.col(y) == 1, F.col(p) >= watch
    bins = reliability(judged, [], p, y)
    curve = F.array_sort(F.collect_list(F.struct("bin", json_round("mean_pred", digits).alias("pred"), json_round("obs_freq", digits).alias("obs"), "n")))
    recall = class_recall(judged.filter(event & F.col(letter).isNotNull()), [], letter, alarm)
    classes = F.array_sort(F.collect_list(F.struct(F.col(letter).alias("letter"), "hit", "n", json_round("recall", digits).alias("rate"))))
    kinds = F.array_sort(F.collect_list(F.struct("kind", "tp", "fp", "fn", "tn", json_round("tss", digits).alias("tss"))))
    points = {
        "watch": F.lit(watch), "warning": F.lit(warning),
        "far_at_watch": F.try_divide(F.count_if(alarm & ~event), F.count_if(alarm)),
        "precision_at_warning": F.try_divide(F.count_if((F.col(p) >= warning) & event), F.count_if(F.col(p) >= warning)),
    }
    parts = [
        one_struct(scores(contingency(judged, [], event, alarm)), "forecast", digits),
        one_struct(forecasts.filter(train).agg(F.avg(F.col(y).cast("double")).alias("climatology")), "baselines", digits),
        one_struct(brier_and_ece(judged, [], p, y), "calibration", digits),
        bins.agg(curve.alias("reliability")), recall.agg(classes.alias("per_class")), detection.agg(kinds.alias("detection")),
        one_struct(judged.agg(*[c.alias(n) for n, c in points.items()]), "operating_points", digits),
        one_struct(reduce(lambda a, b: a.join(F.broadcast(b)), [df.agg(F.count("*").alias(n)) for n, df in counts.items()]), "counts", digits),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
