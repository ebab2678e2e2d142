"""Exact repeated substrings by range-partitioned suffix sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts at another place
too. Not every suffix is sorted. The starts of a text fall into runs that share an anchor
(the least hashed 8-byte gram of the ``SPAN`` bytes from the start on, which equal strings
share), and one suffix stands for a run: its leading token is the fingerprint of the
bytes that all strings of the run have in common, its second token that of all bytes of
the run. Suffixes are range-partitioned by leading token with splitters that Spark
samples; ties are cut by second token and place, so a token of any frequency is spread
over tasks. Each bucket is sorted by multikey quicksort and neighbours are compared; the
ends of buckets are compared across boundaries.

- both tokens equal: every start of the run is repeated;
- leading token without partner: none is;
- otherwise the run is cut into blocks of ``STEP`` starts, and these into single starts,
  which are sorted the same way. One suffix of each repeated run goes along, so every
  single start meets all it could equal.

Tokens are 64-bit fingerprints (two independent ones make equality).

Defined cases: null text is empty; texts below ``LENGTH`` bytes keep everything; rows
that repeat an id and a text repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoflux.llm.common import mix64, table, texts_of
from chronoflux.session import stage_table

LENGTH, SPAN, GRAM, STEP = 200, 140, 8, 16
#: Starts of one piece of a text, and rows of one bucket: they bound the memory of a task.
PIECE, BUCKET_ROWS = 1 << 18, 500_000
_random = np.random.default_rng(7)
_BYTE = _random.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of both bases and of their inverses, made once per worker."""
    if not _POWERS:
        n = PIECE + 2 * LENGTH
        for base in [*_BASE, *(pow(b, -1, 1 << 64) for b in _BASE)]:
            _POWERS.append(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64))
    return _POWERS


class Prints:
    """Fingerprints of any substring of a piece of text."""

    def __init__(self, piece: bytes):
        x, p = np.frombuffer(piece, np.uint8), _powers()
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[i][x] * p[i][: len(x)]))) for i in (0, 1)]

    def raw(self, which: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[which][hi] - self.sums[which][lo]) * _powers()[2 + which][lo]

    def of(self, which: int, lo: np.ndarray, hi: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix64(self.raw(which, lo, hi) + salt.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)).view(np.int64)


def runs_of(raw: bytes):
    """Per piece of the text: (lead, tail, first start, starts, anchor minus first start)."""
    for base in range(0, len(raw) - LENGTH + 1, PIECE):
        piece = raw[base : base + PIECE + LENGTH - 1]
        m, starts = len(piece), len(piece) - LENGTH + 1
        prints = Prints(piece)
        grams = np.arange(m - GRAM + 1)
        least = (mix64(prints.raw(0, grams, grams + GRAM)) & np.uint64(0xFFFFFFFFFFF00000)) | grams.astype(np.uint64)
        size = 1
        while 2 * size <= SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        anchor = (np.minimum(least[:starts], least[SPAN - size : SPAN - size + starts]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [starts])) - 1
        p, n = anchor[first], last - first + 1
        lead = prints.of(0, p, p + LENGTH - SPAN + 1, np.zeros_like(p))
        yield lead, prints.of(1, first, last + LENGTH, (p - first) * 256 + n), first + base, n, p - first


def blocks_of(raw: bytes, at: np.ndarray, n: np.ndarray, d: np.ndarray, step: int):
    """Cut runs into blocks of ``step`` starts, aligned to their anchors; same columns as ``runs_of``."""
    for base in range(0, len(raw) - LENGTH + 1, PIECE):
        here = (at >= base) & (at < base + PIECE)
        if not here.any():
            continue
        prints = Prints(raw[base : base + PIECE + LENGTH - 1])
        lo = np.repeat(at[here] - base, n[here])
        start = lo + (np.arange(len(lo)) - np.repeat(np.cumsum(n[here]) - n[here], n[here]))
        anchor = np.repeat(at[here] - base + d[here], n[here])
        block = (anchor - start) // step
        cut = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
        first, last, p, j = start[cut], start[np.concatenate((cut[1:], [len(start)])) - 1], anchor[cut], block[cut]
        core = p - step * j
        lead = prints.of(0, core, core - step + 1 + LENGTH, j if step > 1 else np.zeros_like(j))
        yield lead, prints.of(1, first, last + LENGTH, (p - first) * 256 + (last - first + 1) if step > 1 else np.zeros_like(first)), first + base, last - first + 1, p - first


def multikey_sort(keys: list[np.ndarray], cutoff: int = 4096) -> np.ndarray:
    """Order of rows by their key columns: three-way partitions, equal parts go on with the next key."""
    out = np.empty(len(keys[0]), np.int64)
    todo, at = [(np.arange(len(out)), 0)], 0
    while todo:
        rows, depth = todo.pop()
        if depth == len(keys) or len(rows) < cutoff:
            out[at : at + len(rows)] = rows[np.lexsort([k[rows] for k in keys[depth:][::-1]])] if depth < len(keys) else rows
            at += len(rows)
            continue
        v = keys[depth][rows]
        pivot = np.sort(v[:: max(1, len(v) // 255)])
        pivot = pivot[len(pivot) // 2]
        todo += [(rows[v > pivot], depth), (rows[v == pivot], depth + 1), (rows[v < pivot], depth)]
    return out


ROW = "lead long, tail long, doc_id long, part int, place long"
_SCHEMA = pa.schema([("lead", pa.int64()), ("tail", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])


def _rows(found, doc_id, part) -> pa.RecordBatch | None:
    """Rows of one text; place packs first start, starts and anchor distance."""
    if not found:
        return None
    lead, tail, at, n, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(lead), pa.array(tail), pa.array([doc_id] * len(at), pa.int64()), pa.array(np.full(len(at), part, np.int32)), pa.array(at << 16 | n << 8 | d)], schema=_SCHEMA)


def _gathered(parts):
    """Row batches of many texts, joined to larger ones."""
    held, rows = [], 0
    for x in parts:
        if x is not None:
            held.append(x)
            rows += x.num_rows
        if rows >= 50_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bucket(batches):
    """Sort one bucket; mark repeated rows (span) and rows to cut further (probe), and its two ends."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    t = pa.Table.from_batches(held)
    lead, tail = (t.column(c).to_numpy() for c in ("lead", "tail"))
    order = multikey_sort([lead, tail])
    lead, tail, t = lead[order], tail[order], t.take(pa.array(order))
    n = len(lead)
    new_lead = np.concatenate(([True], lead[1:] != lead[:-1]))
    new_both = new_lead | np.concatenate(([True], tail[1:] != tail[:-1]))
    ends = np.concatenate((new_both[1:], [True]))
    span = ~(new_both & ends)
    group = np.cumsum(new_lead) - 1
    kinds = np.bincount(group, new_both)
    mixed = kinds > 1
    mixed[[0, -1]] = True  # it may go on in the next bucket
    probe = new_both & mixed[group]
    edge = np.zeros(n, np.int8)
    edge[0] |= 1
    edge[-1] |= 2
    keep = np.flatnonzero(span | probe | (edge > 0))
    out = t.take(pa.array(keep))
    for name, v in (("span", pa.array(span[keep])), ("probe", pa.array(probe[keep])), ("edge", pa.array(edge[keep]))):
        out = out.append_column(name, v)
    yield from out.combine_chunks().to_batches()


def marked(rows: DataFrame) -> DataFrame:
    """Repeated rows and probes of ``rows`` after one range-partitioned suffix sort."""
    rows = stage_table(rows)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = rows.repartitionByRange(max(buckets, rows.sparkSession.sparkContext.defaultParallelism), "lead", "tail", "doc_id", "place")
    found = stage_table(dealt.mapInArrow(_bucket, ROW + ", span boolean, probe boolean, edge byte").withColumn("bucket", F.spark_partition_id()))
    # a bucket of one row is both of its ends
    ends = found.where("edge > 0").select("*", F.explode(F.expr("filter(array(1, 2), e -> (edge & e) > 0)")).alias("end"))
    along = Window.orderBy("bucket", "end")  # two rows per bucket
    same = lambda by: (F.col("lead") == by("lead").over(along)) & (F.col("tail") == by("tail").over(along))
    across = ends.select("*", F.when(F.col("end") == 1, same(F.lag)).otherwise(same(F.lead)).alias("met")).where("met AND NOT span")
    across = across.select("doc_id", "part", "place", F.lit(True).alias("span"), F.lit(False).alias("probe"))
    return found.where("span OR probe").select("doc_id", "part", "place", "span", "probe").unionByName(across)


def _finer(step: int):
    def work(batches):
        def parts():
            for b in batches:
                for raw, doc_id, part, places in zip(texts_of(b.column("body")), b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("places"), strict=True):
                    x = np.unique(places.values.to_numpy())
                    yield _rows(list(blocks_of(raw, x >> 16, (x >> 8) & 255, x & 255, step)), doc_id, part)

        yield from _gathered(parts())

    return work


def _first(batches):
    def parts():
        for b in batches:
            for raw, doc_id, part in zip(texts_of(b.column("body")), b.column("doc_id").to_pylist(), b.column("part").to_pylist(), strict=True):
                yield _rows(list(runs_of(raw)), doc_id, part)

    yield from _gathered(parts())


def _cut(batches):
    """Remove the spans of each text."""
    for b in batches:
        out = []
        for raw, places in zip(texts_of(b.column("body")), b.column("places"), strict=True):
            x = places.values.to_numpy()
            lo, hi = x >> 16, (x >> 16) + ((x >> 8) & 255) - 1 + LENGTH
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
            lo, hi = lo[new], hi[np.concatenate((new[1:], [len(hi)])) - 1]
            digest, at = hashlib.sha256(), 0
            for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
                digest.update(raw[at:a])
                at = z
            digest.update(raw[at:])
            out.append((int((hi - lo).sum()), len(lo), digest.hexdigest(), [{"from": int(a), "upto": int(z)} for a, z in zip(lo, hi, strict=True)]))
        spans = pa.array([o[3] for o in out], pa.list_(pa.struct([("from", pa.int64()), ("upto", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string()), spans], ["doc_id", "part", "n_removed", "n_spans", "sha", "spans"])


def _with_places(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``texts`` with ``places`` to cut further and (more) ``spans``; texts without either drop out.

    Both sides grow with the corpus, so the join always shuffles.
    """
    found = marks.groupBy("doc_id", "part").agg(F.collect_set(F.when(F.col("probe"), F.col("place"))).alias("places"), F.collect_set(F.when(F.col("span"), F.col("place"))).alias("more"))
    t, g = texts.alias("t"), found.alias("g").hint("merge")
    join = F.col("t.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("t.part") == F.col("g.part"))
    if "spans" not in texts.columns:
        return t.join(g, join).select("t.doc_id", "t.part", "t.body", "g.places", F.col("g.more").alias("spans"))
    more = F.coalesce("g.more", F.array().cast("array<long>"))
    out = t.join(g, join, "left").select("t.doc_id", "t.part", "t.body", F.coalesce("g.places", F.array().cast("array<long>")).alias("places"), F.concat("t.spans", more).alias("spans"))
    return out.where("size(places) + size(spans) > 0")


def repeated_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    body = body.select("doc_id", F.hash("body").alias("part"), "body")
    long = body.where(F.octet_length("body") >= LENGTH)
    texts = stage_table(_with_places(long, marked(long.mapInArrow(_first, ROW))))
    for step in (STEP, 1):
        finer = texts.where("size(places) > 0").select("doc_id", "part", "body", "places").mapInArrow(_finer(step), ROW)
        texts = _with_places(texts, marked(finer))
        if step > 1:
            texts = stage_table(texts)
    schema = "doc_id long, part int, n_removed long, n_spans long, sha string, spans array<struct<from:bigint,upto:bigint>>"
    cut = stage_table(texts.where("size(spans) > 0").select("doc_id", "part", "body", F.col("spans").alias("places")).mapInArrow(_cut, schema))
    cut = cut.dropDuplicates(["doc_id", "part"])  # rows that repeat an id and a text
    plain = body.select("doc_id", "part", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    out = plain.alias("p").join(cut.alias("c"), F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.part") == F.col("c.part")), "left")
    return out.select("p.doc_id", "p.n_bytes", F.coalesce("c.n_removed", F.lit(0)).alias("n_removed"), F.coalesce("c.n_spans", F.lit(0)).alias("n_spans"),
                      F.coalesce("c.sha", "p.whole").alias("kept_sha256"), F.coalesce("c.spans", F.array()).alias("spans"))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("spans")
