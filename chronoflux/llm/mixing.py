"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a hash of their id and laid end to end as one
stream of words, cut into blocks of equal words. Slot k of the mix is the golden-ratio
point frac(k * 0.618...); the cumulative target shares map it to a source, its rank
within the source says which block it takes, so at any prefix of the mix every source
stands near its share. A source whose slots exceed its blocks begins another pass. Blocks
grow with the mix, so the slots of a source may come to more or fewer words than its
target; where they miss it by more than its longest document, or by more than a 500th of
it, the source takes its target to the word instead: whole passes, then the first words of
its stream. ``OP5_SQL`` has the schedule alone and holds where no source misses.

Targets: sources in code-point order (null last) carry the repeating ``weights`` and
share ``factor`` times all words; a target stops at ``cap`` times its source's words and
the excess goes to the others by weight (solved in closed form over the sources sorted by
cap over weight). Positions within a source are prefix sums over hash cells, so no task
holds a source; the one window without a key sees one row per source.

Defined cases: null text has no words and is taken 0 times; a null id sorts by the empty
text; rows that repeat an id are separate rows of the stream; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoflux.llm.common import WORD, table
from chronoflux.session import stage_table

GOLDEN = 0.6180339887498949
SLOTS = 1 << 16
#: Part of a target by which the slots of a source may miss it.
MISS = 0.002
#: Documents of a hash cell, and cells at most; they set the size of a task only.
CELL_ROWS, MAX_CELLS = 512, 1 << 16


def source_targets(sized: DataFrame, weights: tuple[int, ...], factor: float, cap: float) -> DataFrame:
    """(source, source_size, longest, target, lo, hi): lo and hi are the cumulative shares."""
    one = Window.orderBy(F.col("source").isNull(), "source")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest"))
    s = s.select("*", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    everything = Window.partitionBy(F.lit(0))
    s = s.select("*", (factor * F.sum("source_size").over(everything)).alias("total"), (cap * F.col("source_size")).alias("most"))
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    s = s.select("*", ((F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"))
    s = s.select("*", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level")))
                 .over(everything)["level"].alias("rate"))
    s = s.select("source", "source_size", "longest", F.least("most", F.coalesce(F.col("rate") * F.col("weight"), F.col("most"))).alias("target"))
    hi = F.sum("target").over(one.rowsBetween(Window.unboundedPreceding, 0))
    s = s.select("*", hi.alias("upto"), F.sum("target").over(everything).alias("all"))
    s = s.select("*", F.coalesce(F.lag("upto").over(one), F.lit(0.0)).alias("from"))
    return s.select("source", "source_size", "longest", "target", F.expr("from / all").alias("lo"), F.expr("upto / all").alias("hi"),
                    F.greatest(F.lit(1), F.ceil(F.col("all") / SLOTS)).alias("block_words"), F.col("all").alias("all_words"))


def slots(spark: SparkSession, targets: DataFrame, cells: int = 4096) -> DataFrame:
    """The schedule: (slot, source, turn, block, block_words), block by block of the mix."""
    point = spark.range(SLOTS).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("x"))
    point = point.withColumn("cell", F.floor(F.col("x") * cells))
    spans = targets.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    hit = point.join(spans, "cell").where("x >= lo AND x < hi AND slot * block_words < all_words")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    hit = hit.select("slot", "source", rank.alias("rank"), blocks.alias("n"), "block_words")
    return hit.select("slot", "source", F.expr("rank div n").alias("turn"), F.expr("rank % n").alias("block"), "block_words")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def exact_sources(targets: DataFrame, turns: DataFrame) -> DataFrame:
    """Targets with ``goal`` (whole words) and ``exact``: the slots miss the target by too much."""
    words = F.size("turns") * F.expr("least(t.block_words, t.source_size - b.block * t.block_words)")
    got = targets.alias("t").join(turns.alias("b"), _same(F.col("t.source"), F.col("b.source"))).groupBy("t.source").agg(F.sum(words).alias("got"))
    kept = targets.alias("t").join(F.broadcast(got).alias("g"), _same(F.col("t.source"), F.col("g.source")), "left")
    miss = F.abs(F.coalesce(F.col("g.got"), F.lit(0)) - F.col("t.target"))
    return kept.select("t.*", F.round("t.target").cast("long").alias("goal"), (miss > F.greatest(F.lit(1.0), F.least("t.longest", F.col("t.target") * MISS))).alias("exact"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), factor: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: size, source_size, target, and words taken in each pass (``taken`` array)."""
    spark, turns_at_most = docs.sparkSession, math.ceil(cap)
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sized = stage_table(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")))
    targets = stage_table(source_targets(sized, weights, factor, cap))
    turns = stage_table(slots(spark, targets).where(F.col("turn") < turns_at_most).groupBy("source", "block").agg(F.collect_set("turn").alias("turns")))
    targets = stage_table(exact_sources(targets, turns))
    cells = max(1, min(MAX_CELLS, -(-sized.count() // CELL_ROWS)))
    at = sized.withColumn("cell", F.expr(f"(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * {cells}) div 4294967296"))
    sums = at.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    sums = stage_table(sums.select("source", "cell", (F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")).alias("base")))
    inner = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = at.select("*", inner.alias("inside")).alias("a").join(sums.alias("b"), _same(F.col("a.source"), F.col("b.source")) & (F.col("a.cell") == F.col("b.cell")))
    placed = placed.select("a.doc_id", "a.source", "a.size", "a.key", (F.col("b.base") + F.col("a.inside")).alias("start"))
    placed = placed.alias("a").join(targets.alias("t"), _same(F.col("a.source"), F.col("t.source"))).select("a.*", "t.source_size", "t.target", "t.block_words", "t.goal", "t.exact")
    placed = stage_table(placed)
    cut = placed.where("size > 0 AND NOT exact").select("source", "start", "size", "block_words", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")).alias("block"))
    used = cut.alias("a").join(turns.alias("b"), _same(F.col("a.source"), F.col("b.source")) & (F.col("a.block") == F.col("b.block")))
    words = F.expr("least(start + size, (a.block + 1) * block_words) - greatest(start, a.block * block_words)")
    passes = [F.sum(F.when(F.array_contains("turns", F.lit(i).cast("long")), words).otherwise(0)).alias(f"p{i}") for i in range(turns_at_most)]
    taken = used.groupBy("a.source", "a.start").agg(*passes)
    back = placed.alias("a").join(taken.alias("b"), _same(F.col("a.source"), F.col("b.source")) & (F.col("a.start") == F.col("b.start")) & (F.col("a.size") > 0), "left")
    exactly = [F.expr(f"greatest(0L, least(a.start + a.size, a.goal - {i} * a.source_size) - a.start)") for i in range(turns_at_most)]
    each = (F.when(F.col("a.exact"), exactly[i]).otherwise(F.coalesce(F.col(f"b.p{i}"), F.lit(0))).cast("long") for i in range(turns_at_most))
    return back.select("a.doc_id", "a.source", "a.size", "a.source_size", "a.target", F.array(*each).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them: a pass counts if it takes at least half of the words."""
    plan = mix(docs, doc_id, **how)
    copies = F.size(F.filter("taken", lambda x: 2 * x >= F.col("size")))
    numbered = plan.where("size > 0").groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max(copies).alias("_mix_copies"))
    out = docs.join(numbered.where("_mix_copies > 0"), F.col(doc_id).eqNullSafe(F.col("_mix_id")))
    out = out.where(F.coalesce(F.regexp_count(F.col(how.get("text", "text")), F.lit(WORD)), F.lit(0)) > 0)
    return out.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy")).drop("_mix_copy")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", F.aggregate("taken", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"))


OP5_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, 2.0::DOUBLE * source_size AS most FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT arg_min(level, most / weight) FROM s2 WHERE level <= most / weight) AS rate FROM s2),
s4 AS (SELECT source, source_size, least(most, coalesce(rate * weight, most)) AS target FROM s3),
s5 AS (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(target) OVER () AS al FROM s4),
s6 AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY source NULLS LAST), 0) / al AS lo, upto / al AS hi, greatest(1, ceil(al / {SLOTS}))::BIGINT AS bw FROM s5),
points AS (SELECT k, k::DOUBLE * {GOLDEN}::DOUBLE - floor(k::DOUBLE * {GOLDEN}::DOUBLE) AS x FROM range({SLOTS}) t(k)),
hits AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS r, ceil(source_size / bw)::BIGINT AS n FROM points JOIN s6 ON x >= lo AND x < hi AND k * bw < al),
turns AS (SELECT source, r % n AS block, count(*) AS times FROM hits WHERE r // n < 2 GROUP BY ALL),
placed AS (SELECT s.*, t.source_size, t.target, t.bw, (sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start, row_number() OVER () AS line FROM sized s JOIN s6 t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT line, source, start, size, bw, unnest(range(start // bw, (start + size - 1) // bw + 1)) AS block FROM placed WHERE size > 0),
used AS (SELECT line, sum(times * (least(start + size, (c.block + 1) * bw) - greatest(start, c.block * bw)))::BIGINT AS taken FROM cut c JOIN turns t ON c.source IS NOT DISTINCT FROM t.source AND c.block = t.block GROUP BY line)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN used USING (line)
"""
