"""Quality rules with thresholds that follow each language and source.

Every document gets word, symbol, line and repeat counts. For each measure a quantile
sketch is kept per (language, source), per language and for all documents: a histogram
over logarithmic cells (2 % wide), whose counts add up exactly in any order and hence
merge across tasks, days and runs. Upper and lower fences come from the quartiles of the
sketch (quartile plus ``spread`` interquartile ranges, at least ``slack``), and
documents are joined with the fences of their group. A group with fewer than
``min_group`` documents borrows the fences of its language, a small language those of
all documents.

Defined cases: null text has no words and fails the base rule; null language or source
is a group of its own; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from chronoflux.llm.common import table, texts_of
from chronoflux.session import stage_table

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: measure -> (numerator, denominator, least slack above, least slack below; per mille)
MEASURES = {
    "symbols": ("n_symbols", "n_words", 100, None),
    "dup_lines": ("n_dup_lines", "n_lines", 350, None),
    "repeats": ("n_repeat_words", "n_words", 300, None),
    "capitals": ("n_upper", "word_chars", 120, None),
    "word_length": ("word_chars", "n_words", 2500, 1500),
}
CELL = 1.02
_SYMBOL_BYTES, _UPPER_BYTES = [c.encode() for c in SYMBOLS], [bytes([c]) for c in range(65, 91)]
_SPACES = [bytes([c]) for c in (32, *range(9, 14))]


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1 << 20:  # keeps the product below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()]
    points = len(raw) - int((np.frombuffer(raw, np.uint8) & 0xC0 == 0x80).sum())
    return (len(words), points - sum(map(raw.count, _SPACES)), sum(map(raw.count, _SYMBOL_BYTES)), len(lines) - len(set(lines)),
            _repeat_words(words), len(lines), sum(map(raw.count, _UPPER_BYTES)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` as struct ``row`` beside their counts."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([packed.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def work(batches):
        for b in batches:
            rows = [counts_of(x) for x in texts_of(pc.struct_field(b.column("row"), text))]  # the text travels once
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *cols], ["row", *COUNTS])

    return packed.mapInArrow(work, schema)


def _value(name: str) -> Column:
    """Measure in per mille as a whole number, so that every engine agrees on it."""
    top, under, _, _ = MEASURES[name]
    return F.when(F.col(under) > 0, F.expr(f"({top} * 1000) div {under}"))


def _group(level: int, lang: Column, source: Column) -> list[Column]:
    """Key columns of a level: 0 language and source, 1 language, 2 everything."""
    return [F.lit(level).alias("level"), *(c.alias(n) for c, n in (
        (F.coalesce(lang, F.lit("")) if level < 2 else F.lit(""), "g_lang"), (lang.isNull() if level < 2 else F.lit(True), "g_no_lang"),
        (F.coalesce(source, F.lit("")) if level < 1 else F.lit(""), "g_source"), (source.isNull() if level < 1 else F.lit(True), "g_no_source")))]


KEYS = ("level", "g_lang", "g_no_lang", "g_source", "g_no_source")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: count of each cell of each measure, per group of each level."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), _value(m).alias("v")) for m in MEASURES))
    rows = measured.select(F.col(f"row.{lang}").alias("lang"), F.col(f"row.{source}").alias("source"), F.explode(values).alias("x"))
    rows = rows.where("x.v IS NOT NULL").select("lang", "source", "x.measure", F.floor(F.log1p(F.col("x.v")) / float(np.log(CELL))).cast("int").alias("cell"))
    finest = rows.groupBy(*_group(0, F.col("lang"), F.col("source")), "measure", "cell").agg(F.count("*").alias("n"))
    by_lang = finest.groupBy(F.lit(1).alias("level"), "g_lang", "g_no_lang", F.lit("").alias("g_source"), F.lit(True).alias("g_no_source"), "measure", "cell").agg(F.sum("n").alias("n"))
    overall = finest.groupBy(F.lit(2).alias("level"), F.lit("").alias("g_lang"), F.lit(True).alias("g_no_lang"), F.lit("").alias("g_source"), F.lit(True).alias("g_no_source"), "measure", "cell").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, [finest, by_lang, overall])


def fences(sketch: DataFrame, spread: float = 4.0, min_group: int = 100) -> DataFrame:
    """One row per group: upper (and lower) fence of each measure."""
    keys = [*KEYS, "measure"]
    whole = W.Window.partitionBy(*keys)
    ranked = sketch.select("*", F.sum("n").over(whole.orderBy("cell")).alias("upto"), F.sum("n").over(whole).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell")))
    q = ranked.groupBy(*keys).agg(F.first("total").alias("total"), at(0.25).alias("c1"), at(0.75).alias("c3")).where(F.col("total") >= F.when(F.col("level") == 2, 0).otherwise(min_group))
    middle = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.pow(F.lit(CELL), F.col(c) + 0.5) - 1)
    q = q.select(*keys, middle("c1").alias("q1"), middle("c3").alias("q3"))
    pick = lambda m, e: F.max(F.when(F.col("measure") == m, e))
    out = []
    for m, (_, _, above, below) in MEASURES.items():
        wide = spread * (F.col("q3") - F.col("q1"))
        out.append(pick(m, F.col("q3") + F.greatest(wide, F.lit(float(above)))).alias(f"{m}_max"))
        if below is not None:
            out.append(pick(m, F.col("q1") - F.greatest(wide, F.lit(float(below)))).alias(f"{m}_min"))
    return q.groupBy(*KEYS).agg(*out)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", spread: float = 4.0, min_group: int = 100,
          min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Struct ``row`` of each document, its counts, ``base_failed``, ``reasons`` and ``kept``.

    The text is measured twice (sketch, then filter) instead of being shuffled.
    """
    need = docs.select(*{text, lang, source})
    limits = stage_table(fences(sketches(measure(need, text), lang, source), spread, min_group))
    out = measure(docs, text)
    for level in (0, 1, 2):
        side = limits.where(F.col("level") == level)
        side = side.select(*(F.col(k).alias(f"{k}_{level}") for k in KEYS if k != "level"), F.struct(*(c for c in limits.columns if c not in KEYS)).alias(f"limits_{level}"))
        keys = _group(level, F.col(f"row.{lang}"), F.col(f"row.{source}"))[1:]
        match = reduce(Column.__and__, [k == F.col(f"{n}_{level}") for k, n in zip(keys, KEYS[1:], strict=True)])
        out = out.join(side, match, "left").drop(*(f"{k}_{level}" for k in KEYS))
    limit = lambda c: F.coalesce(*(F.col(f"limits_{i}.{c}") for i in (0, 1, 2)))
    reasons = []
    for m, (_, _, _, below) in MEASURES.items():
        reasons.append(F.when(_value(m) > limit(f"{m}_max"), F.lit(f"{m}_high")))
        if below is not None:
            reasons.append(F.when(_value(m) < limit(f"{m}_min"), F.lit(f"{m}_low")))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    out = out.withColumn("reasons", F.array_compact(F.array(*reasons))).drop("limits_0", "limits_1", "limits_2")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, **rules).where("kept").select("row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("row.doc_id", *COUNTS[:5], "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))
