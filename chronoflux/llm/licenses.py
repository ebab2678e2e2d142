"""License notices by a positional index of rare template words.

A template is the text of a notice with its mandatory key phrase in brackets. The index
holds, for each template, the ``RARE`` words of its key phrase with the highest idf over
all documents, with their positions. Each occurrence of an index word in a file looks up
its postings; a posting says where the template would begin. Postings that agree on the
beginning are intersected by relative position and the key phrase is verified word by
word there. A verified key phrase counts, whatever stands around it; the score tells the
share of template words that stand in their place. Base phrases are templates that are
all key phrase; every place counts.

Only DataFrame functions are used. Templates are a parameter of fixed size; their idf
table has one row per template word.

Defined cases: null text has no words; words of a template that would lie outside the
text do not agree; rows that repeat an id are each returned; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.llm.common import lower_ascii, table

RARE = 2
#: (label, phrase): exact phrases whose places all count
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: (label, notice with its key phrase in brackets)
NOTICES = (
    ("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    ("gpl-2", "this work is licensed under the [gnu general public license version 2]"),
    ("lgpl-3", "this work is licensed under the [gnu lesser general public license version 3]"),
    ("agpl-3", "this work is licensed under the [gnu affero general public license version 3]"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee"),
    ("cc-by-sa", "licensed under [cc by sa]"),
    ("cc-by-nd", "licensed under [cc by nd]"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
)


def _templates(base, notices) -> list[dict]:
    out = [{"id": i, "label": label, "base": True, "words": p.split(), "key": p.split(), "at": 0} for i, (label, p) in enumerate(base)]
    for label, text in notices:
        before, key, _ = (x.split() for x in text.replace("]", "[").split("["))
        out.append({"id": len(out), "label": label, "base": False, "words": text.replace("[", "").replace("]", "").split(), "key": key, "at": len(before)})
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def word_idf(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """idf of each word of ``vocabulary`` over all documents."""
    own = docs.select(F.explode(F.array_append(F.array_intersect(words(F.col(text)), _list(vocabulary)), F.lit(""))).alias("w"))
    df = {r["w"]: r["n"] for r in own.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in vocabulary}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, places of each row."""
    templates = _templates(base, notices)
    idf = word_idf(docs, sorted({w for t in templates for w in t["key"]}), text)
    postings = []
    for t in templates:
        rare = sorted(set(t["key"]), key=lambda w: (-idf[w], w))[:RARE]
        postings += [(w, t["id"], t["at"] + i, len([x for x in t["key"] if x in rare])) for i, w in enumerate(t["key"]) if w in rare]
    reach = max(len(t["words"]) for t in templates)
    index = sorted({p[0] for p in postings})
    spark = docs.sparkSession

    w = F.col("w")
    body = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("w"))
    seen = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"].isin(index))
    near = F.transform(seen, lambda h: F.struct(h["i"].alias("i"), h["x"].alias("word"), F.greatest(h["i"] - reach, F.lit(0)).alias("from"), F.slice(w, F.greatest(h["i"] - reach, F.lit(0)) + 1, 2 * reach + 1).alias("around")))
    head = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("array<string>").alias("around")))
    rows = body.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.explode(F.concat(head, near)).alias("h"))

    table_ = spark.createDataFrame([(w_, t, p, n) for w_, t, p, n in postings], "word string, template int, at int, need int")
    known = spark.createDataFrame([(t["id"], t["label"], t["base"], t["words"], t["key"], t["at"]) for t in templates], "template int, label string, base boolean, words array<string>, key array<string>, key_at int")
    lookup = F.broadcast(table_.join(known, "template"))  # as many rows as the templates have rare words
    placed = rows.select("doc_id", "text_hash", "n_words", "h.*").join(lookup, "word", "left").withColumn("start", F.col("i") - F.col("at"))
    first_key = F.col("start") + F.col("key_at")
    verified = (first_key >= 0) & (F.slice("around", F.greatest(first_key - F.col("from") + 1, F.lit(1)), F.size("key")) == F.col("key"))
    agree = F.aggregate(F.transform("words", lambda x, j: ((F.col("start") + j >= 0) & F.coalesce(F.get("around", F.col("start") + j - F.col("from")) == x, F.lit(False))).cast("int")), F.lit(0), lambda a, x: a + x)
    placed = placed.select("doc_id", "text_hash", "n_words", "i", "at", "need", "template", "label", "base", "start", "key_at", verified.alias("verified"), (agree / F.size("words")).alias("share"))
    # the empty first entry stands for the row itself; each of its copies brings one
    places = placed.groupBy("doc_id", "text_hash", "n_words", "template", "start").agg(
        F.count(F.when(F.col("i").isNull(), 1)).alias("copies"), F.count_distinct("at").alias("met"), F.first("need").alias("need"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.first("key_at").alias("key_at"), F.max("verified").alias("verified"), F.max("share").alias("share"))
    good = F.coalesce(F.col("verified") & (F.col("met") >= F.col("need")), F.lit(False))
    is_base = good & F.col("base")
    texts = places.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum("copies").alias("copies"), F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(good, F.col("label")))).alias("labels"), F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.count(F.when(good, 1)).alias("n_notices"))
    return texts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy", "copies", "text_hash")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "n_notices")


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{x}'" for x in ws) + "]"
    rows = ", ".join(f"({t['id']}, '{t['label']}', {str(t['base']).lower()}, {quoted(t['words'])}, {quoted(t['key'])}, {t['at']})" for t in _templates(BASE, NOTICES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS line, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(id, label, base, words, key, key_at) AS (VALUES {rows}),
p AS (SELECT line, label, base, words, key_at, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = key[1] AND w[i:i + len(key) - 1] = key)) AS i FROM d, t WHERE list_has_all(w, key)),
s AS (SELECT line, label, base, (i - 1 - key_at) AS start, list_sum(list_transform(range(1, len(words) + 1), lambda j: CASE WHEN i - key_at + j - 1 >= 1 AND w[i - key_at + j - 1] = words[j] THEN 1 ELSE 0 END)) / len(words) AS share FROM p),
g AS (SELECT line, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score, count(*) AS n_notices FROM s GROUP BY line)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 coalesce(score, 0)::DOUBLE AS score, coalesce(n_notices, 0)::BIGINT AS n_notices FROM d LEFT JOIN g USING (line)
"""


OP9_SQL = _sql()
