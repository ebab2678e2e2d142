"""Benchmark decontamination: short test items inside long documents.

Containment MinHash over items partitioned by size. An item's sketch is the set of its
smallest shingle hashes; how many it keeps and how many a document must hold grows with
the size class (``CLASSES``), so that an item of which 80 % stands in a document is
missed with probability below 0.0001 in every class, while a stray shingle of a long
item makes no candidate. Documents are never sketched, so their length does not matter:
each of their shingles is looked up. Candidates are verified by the exact share of the
item's distinct shingles (as texts) in the whole document.

Only DataFrame functions are used. The sketch table is broadcast if its measured size
allows; nothing else is.

Defined cases: null or empty documents and items match nothing; items below five words
are one shingle and match documents of just these words; items that share an id are searched
text by text, and a null item id stays in the result; rows that repeat an id and text give
one pair; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoflux.llm.common import lower_ascii, small, table
from chronoflux.session import stage_table

WORDS = 5
#: (largest number of shingles of the class, hashes kept, hashes a document must hold)
CLASSES = ((8, 8, 1), (32, 8, 2), (None, 16, 5))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _starts(w: Column) -> Column:
    """First word of each shingle, from 1; none for no words."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def shingle_texts(w: Column) -> Column:
    return F.array_distinct(F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i, WORDS), " ")))


def _class(column: int) -> Column:
    out = F.lit(CLASSES[-1][column])
    for limit, *values in CLASSES[-2::-1]:
        out = F.when(F.col("n") <= limit, F.lit(values[column - 1])).otherwise(out)
    return out


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_key, hash, need): the smallest hashes of each item text, by size class. ``items``: item_key, shingles, n."""
    hashes = items.select("item_key", "n", F.explode("shingles").alias("s")).select("item_key", "n", F.xxhash64("s").alias("hash"))
    rank = F.row_number().over(Window.partitionBy("item_key").orderBy("hash"))
    return hashes.select("item_key", "hash", _class(2).alias("need"), _class(1).alias("keep"), rank.alias("rank")).where("rank <= keep").select("item_key", "hash", "need")


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item_shingles, n_found) of every contained item."""
    named = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w"))
    named = named.select("item_id", shingle_texts(F.col("w")).alias("shingles")).select("item_id", F.xxhash64("shingles").alias("item_key"), "shingles", F.size("shingles").alias("n")).where("n > 0")
    named = stage_table(named.distinct())
    # each text is searched once, whatever ids share it; the ids come back at the end
    items = named.groupBy("item_key").agg(F.first("shingles").alias("shingles"), F.first("n").alias("n"))
    sketches = stage_table(item_sketches(items))
    body = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("body"))
    cut = body.select("doc_id", "text_hash", words(F.col("body")).alias("w"))
    looked = cut.select("doc_id", "text_hash", F.explode(F.transform(_starts(F.col("w")), lambda i: F.xxhash64(F.array_join(F.slice("w", i, WORDS), " ")))).alias("hash"))
    hits = looked.join(small(sketches), "hash").groupBy("doc_id", "text_hash", "item_key", "hash").agg(F.max("need").alias("need"))
    candidates = stage_table(hits.groupBy("doc_id", "text_hash", "item_key").agg(F.count("*").alias("held"), F.max("need").alias("need")).where("held >= need").select("doc_id", "text_hash", "item_key"))
    b, c = body.alias("b"), candidates.groupBy("doc_id", "text_hash").agg(F.collect_set("item_key").alias("items")).alias("c")
    near = b.join(c, F.col("b.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("b.text_hash") == F.col("c.text_hash")))
    # the words of a candidate are cut once, before they are put together to shingles
    near = near.select("b.doc_id", "b.text_hash", words(F.col("b.body")).alias("w"), "c.items").select("doc_id", "text_hash", "items", shingle_texts(F.col("w")).alias("have"))
    near = near.select("doc_id", "text_hash", "have", F.explode("items").alias("item_key"))
    pairs = near.join(named, "item_key").select("doc_id", "text_hash", "item_id", F.col("n").alias("n_item_shingles"), F.size(F.array_intersect("shingles", "have")).alias("n_found"))
    return pairs.where(100 * F.col("n_found") >= percent * F.col("n_item_shingles")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that hold no item, unchanged."""
    found = stage_table(find_items(docs, benchmark, doc_id, text, **how).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct())
    same = docs[doc_id].eqNullSafe(found["_leak_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["_leak_hash"])
    return docs.join(found, same, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = found.groupBy("doc_id", "item_id").agg(F.max("n_item_shingles").cast("long").alias("n_item_shingles"), F.max("n_found").cast("long").alias("n_found"))
    return pairs.select("*", (F.col("n_found") / F.col("n_item_shingles")).alias("containment"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS found FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, found::BIGINT AS n_found, found / n AS containment
FROM hit JOIN n USING (item_id) WHERE 100 * found >= 80 * n
"""
