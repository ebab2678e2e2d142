"""Ranked lexical search by presence masks.

Every item (a short text) ranks all documents by the weights of the terms that both hold.
Documents are indexed in blocks: a block keeps the length of each of its documents and,
for every term of the items, a posting list (documents, frequencies) with its bitmap.

For an item, the bitmaps of its terms over a block are transposed, which gives each
document its presence mask (bit t: holds term t). Documents with one mask form a group
whose score is at most the sum of what each present term can reach in the block. Groups
are scored exactly in descending order of that bound, in waves, until the next bound lies
below the item's ``top``-th best score; a task carries its best from block to block, so
later blocks finish sooner. Only ``top`` rows per item and task are shuffled.

Weights need the document frequencies of the items' terms and two totals over all
documents; they are counted from the index, on Spark. Items are dealt by hash to groups
of about ``TERMS`` terms, so that the driver and each worker hold one group of items
(terms, weights) at a time; each group reads the documents once.

Defined cases: null and empty texts hold no term and are never found; an item's repeated
words count once; rows that repeat an item id are one item with the terms of all its
rows; rows that repeat a document id are documents of their own; documents without an id
are ranked after others of equal score; items without terms or hits give no rows; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoflux.llm.common import lower_ascii, table, texts_of
from chronoflux.session import stage_table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Distinct terms of a group of items; documents and postings of a block; groups of documents scored in the first wave.
TERMS, BLOCK_DOCS, BLOCK_POSTINGS, WAVE = 500_000, 8192, 2_000_000, 32
#: Lower-cases A-Z and turns every byte that ends a term into a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: Column) -> Column:
    """Distinct terms of a text; none for null."""
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)))


def _index(number: dict[bytes, int]):
    """Blocks of documents with the postings of the numbered terms."""

    def block(ids, sizes, counts):
        doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        key = np.concatenate([np.empty(0, np.int64), *counts]) << 32 | doc
        key, tf = np.unique(key, return_counts=True)
        term = key >> 32
        held, start = np.unique(term, return_index=True)
        raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        known = np.array([i is not None for i in ids])
        columns = (raw(np.array([i or 0 for i in ids], np.int64), np.int64), raw(known, np.bool_), raw(np.array(sizes), np.int64), raw(held, np.int32),
                   raw(np.append(start, len(key)), np.int64), raw(key & 0xFFFFFFFF, np.int32), raw(tf, np.int32))
        df = pa.array([[{"term": int(t), "df": int(n)} for t, n in zip(held, np.diff(np.append(start, len(key))), strict=True)]], pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())])))
        n = np.array(sizes)
        return pa.RecordBatch.from_arrays([*columns, df, pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                                          ["ids", "known", "sizes", "terms", "starts", "docs", "tf", "df", "n_docs", "n_terms"])

    def index(batches):
        ids, sizes, counts, postings = [], [], [], 0
        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), texts_of(b.column("body")), strict=True):
                words = raw.translate(_CLEAN).split()
                own = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
                ids.append(doc_id)
                sizes.append(len(words))
                counts.append(own[own >= 0])
                postings += len(counts[-1])
                if len(ids) == BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield block(ids, sizes, counts)
                    ids, sizes, counts, postings = [], [], [], 0
        if ids:
            yield block(ids, sizes, counts)

    return index


BLOCK = "ids binary, known binary, sizes binary, terms binary, starts binary, docs binary, tf binary, df array<struct<term:int,df:bigint>>, n_docs bigint, n_terms bigint"


class Block:
    """One block of the index, with the largest share of each of its terms."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        take = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known, self.terms, self.starts, self.docs = (take(*x) for x in (("ids", np.int64), ("known", np.bool_), ("terms", np.int32), ("starts", np.int64), ("docs", np.int32)))
        length = 10 + 90 * take("sizes", np.int64) * n_docs // n_terms
        #: what each posting's frequency is worth before the weight of its term
        tf = take("tf", np.int32).astype(np.int64)
        self.share = 1_000_000_000 * tf // (1000 * tf + 8 * length[self.docs])
        self.most = np.maximum.reduceat(self.share, self.starts[:-1]) if len(self.terms) else self.share
        self.n = len(self.ids)
        bits = np.zeros((len(self.terms), -(-self.n // 8) * 8), np.bool_)
        bits[np.repeat(np.arange(len(self.terms)), np.diff(self.starts)), self.docs] = True
        self.bitmaps = np.packbits(bits, axis=1)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents ordered by mask, first document of each group, presence of its terms), without the empty mask."""
        present = np.unpackbits(self.bitmaps[rows], axis=1, count=self.n)
        mask = np.packbits(present, axis=0)  # one row per eight terms
        mask = np.concatenate((mask, np.zeros((-len(mask) % 8, self.n), np.uint8))).T.copy().view(np.uint64)
        docs = np.flatnonzero(mask.any(1))
        docs = docs[np.lexsort(mask[docs].T)]
        ordered = mask[docs]
        first = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1)))[: len(docs)])
        return docs, first, present[:, docs[first]]

    def scores(self, rows: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for r, w in zip(rows.tolist(), weight.tolist(), strict=True):
            lo, hi = self.starts[r], self.starts[r + 1]
            at = np.minimum(np.searchsorted(self.docs[lo:hi], docs), hi - lo - 1) + lo
            total += np.where(self.docs[at] == docs, w * self.share[at], 0)
        return total

    def best(self, wanted: np.ndarray, weight: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least all that belong to the item's ``top`` best with a score of ``floor`` or more."""
        at = np.minimum(np.searchsorted(self.terms, wanted), max(len(self.terms) - 1, 0))
        here = self.terms[at] == wanted if len(self.terms) else np.zeros(len(wanted), np.bool_)
        rows, weight = at[here], weight[here]
        if not len(rows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, first, present = self.masks(rows)
        bound = (weight * self.most[rows]) @ present.astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        size = np.diff(np.append(first, len(docs)))
        found, score, done, wave = [], np.empty(0, np.int64), 0, WAVE
        while done < len(order) and bound[order[done]] >= floor:
            groups = order[done : done + wave]
            groups = groups[bound[groups] >= floor]
            row = np.repeat(np.arange(len(groups)), size[groups])
            members = docs[first[groups][row] + np.arange(len(row)) - np.repeat(np.cumsum(size[groups]) - size[groups], size[groups])]
            found.append(members)
            score = np.append(score, self.scores(rows, weight, members))
            if len(score) >= top:
                floor = max(floor, int(np.partition(score, -top)[-top]))
            done, wave = done + wave, 2 * wave
        return np.concatenate([np.empty(0, np.int64), *found]), score


def _search(items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> Callable:
    """The ``top`` best documents of each item among the blocks of a task."""

    def search(batches):
        best: list[list[tuple]] = [[] for _ in items]  # (-score, id is null, id)
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, n_docs, n_terms)
                for k, wanted in enumerate(items):
                    docs, score = block.best(wanted, weight[wanted], top, -best[k][-1][0] if len(best[k]) == top else 1)
                    keep = score > 0
                    if keep.sum() > top:
                        keep &= score >= np.partition(score, -top)[-top]
                    docs, score = docs[keep], score[keep]
                    order = np.lexsort((block.ids[docs], ~block.known[docs], -score))[:top]
                    new = [(-s, not known, i) for s, known, i in zip(score[order].tolist(), block.known[docs[order]].tolist(), block.ids[docs[order]].tolist(), strict=True)]
                    best[k] = sorted(best[k] + new)[:top]
        rows = [(k, None if unknown else i, -s) for k, found in enumerate(best) for s, unknown, i in found]
        item, doc_id, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return search


def _search_group(body: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """(item_id, doc_id, score): best rows of every task for one group of items (item_id, terms)."""
    spark = body.sparkSession
    asked = items.collect()
    words = sorted({t for r in asked for t in r["terms"]})
    number = {t.encode(): i for i, t in enumerate(words)}
    index = stage_table(body.mapInArrow(_index(number), BLOCK))
    counted = index.select(F.explode("df").alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).toArrow()
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    wanted = [np.array(sorted(number[t.encode()] for t in r["terms"]), np.int64) for r in asked]
    found = index.drop("df").mapInArrow(_search(wanted, weight, n_docs, max(n_terms, 1), top), "item int, doc_id long, score long")
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(asked)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 10, group_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(terms(F.col(item_text))).alias("term")).distinct()
    asked = own.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    total = own.count()
    groups = max(1, -(-total // group_terms))
    asked = stage_table(asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups))))
    found = None
    for part in range(groups):
        rows = _search_group(body, asked.where(F.col("part") == part).drop("part"), top)
        found = rows if found is None else found.unionByName(rows)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("item_id", F.row_number().over(best).alias("rank"), "doc_id", "score").where(F.col("rank") <= top)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY t, n_docs),
x AS (SELECT item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM i JOIN p USING (t) JOIN v USING (t), s GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
