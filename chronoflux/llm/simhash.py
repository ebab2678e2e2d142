"""SimHash near-duplicates: exact pairs of fingerprints by vantage-point trees.

A document's fingerprint has a bit set where more than half of its shingle hashes have
it (XXH64, seed 42, of ``WORDS`` words joined by spaces; shingles count as often as they
occur). Two documents are linked if their fingerprints differ in at most ``bits`` bits.

Equal fingerprints collapse to one row first (smallest id). Distances of random 64-bit
fingerprints lie so close together that balls of radius 4 around whole fingerprints cross
almost every border of a tree. The trees therefore stand on the Hamming distance of one
quarter (16 bits): two fingerprints within 4 bits have a quarter within 1, so every pair
is met in at least one of four trees, with radius 1.

1. Each tree is grown from the exact counts of its quarter's values (at most 65,536, the
   only thing the driver gets). A node has a vantage point and a radius; values inside go
   left, others right, until a leaf (shard) holds at most ``shard`` fingerprints.
2. A fingerprint lives in its home shard and also visits the shards that its ball reaches
   over a border (triangle bounds); of two shards only the one with the smaller number
   sends visitors to the other, which is enough to meet every pair once.
3. A shard sorts its rows by distance to a vantage point of its own and compares only
   rows whose distances differ by at most ``bits``, on all 64 bits. It returns a star for
   each component it sees, never the pairs.

A value that alone exceeds a shard, and visitors that do, are cut into blocks by hash;
every two blocks of homes and every block of homes with every block of visitors meet in a
task of their own. So memory is bounded whatever a value holds; nothing is dropped.

Defined cases: texts without words (null, empty) have fingerprint zero, which is linked
like any other; rows without an id get a fingerprint, a null component and link nothing;
rows that repeat an id each get that id's fingerprint of their own text, and the id joins
the components of all its texts; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.llm.common import mix64, table, texts_of
from chronoflux.llm.neardup import components
from chronoflux.session import stage_table

WORDS, SEED, BITS = 4, 42, 4
QUARTERS, VALUES = 4, 1 << 16
#: Fingerprints of a shard; of a block of a shard that cannot be split; vantage points tried per node.
SHARD, BLOCK, TRIED = 4096, 16_384, 8
#: Rows of a shard compared at once.
CHUNK = 128
#: Fingerprints above this share of all rows are joined back by broadcast: there are at most 1,000.
HOT = 0.001
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def shingle_hashes(raw: bytes) -> np.ndarray:
    """Hash of every shingle of a text; of all words if it has fewer than ``WORDS``."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(WORDS, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], SEED) for a, z in zip(first, last, strict=True)), np.uint64, len(first))


def fingerprint(raw: bytes) -> int:
    h = shingle_hashes(raw)
    if not len(h):
        return 0
    # one byte per bit; 255 hashes fit before a byte runs over
    lanes = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], np.arange(0, len(h), 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _prints(batches):
    for b in batches:
        found = np.array([fingerprint(t) for t in texts_of(b.column("body"))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def grow(weight: np.ndarray, radius: int, shard: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Vantage-point tree over the values with ``weight``: (home leaf of each value, visitors of each leaf)."""
    home, visitors = np.full(len(weight), -1, np.int32), []
    held = np.flatnonzero(weight)
    todo = [(held, held[:0])] if len(held) else []
    while todo:
        own, guests = todo.pop()
        if len(own) == 1 or weight[own].sum() <= shard:
            home[own] = len(visitors)
            visitors.append((len(visitors), guests))
            continue
        v, cut = _vantage(own, weight[own], radius)
        d, g = np.bitwise_count(own ^ v).astype(int), np.bitwise_count(guests ^ v).astype(int)
        todo.append((own[d > cut], np.concatenate((guests[g > cut - radius], own[(d <= cut) & (d > cut - radius)]))))
        todo.append((own[d <= cut], np.concatenate((guests[g <= cut + radius], own[(d > cut) & (d <= cut + radius)]))))
    return home, visitors


def _vantage(own: np.ndarray, weight: np.ndarray, radius: int) -> tuple[int, int]:
    """The vantage point and radius, of those tried, that send the least weight over the border of an even split."""
    best = None
    for v in own[np.linspace(0, len(own) - 1, min(TRIED, len(own))).astype(int)]:
        at = np.bincount(np.bitwise_count(own ^ v), weight, 17)
        inside = np.cumsum(at)[:-1]
        sides = inside * (inside[-1] + at[-1] - inside)
        crossing = np.array([at[max(0, c - radius + 1) : c + radius + 1].sum() for c in range(16)])
        cost = np.where(sides > 0, (crossing + 1) / np.maximum(sides, 1), np.inf)
        c = int(cost.argmin())
        if best is None or cost[c] < best[0]:
            best = (cost[c], int(v), c)
    return best[1:]


class Routes:
    """Where fingerprints go: per quarter value its leaves, per leaf the numbers of blocks."""

    def __init__(self, weights: list[np.ndarray], radius: int, shard: int, block: int):
        ptr, leaf, is_home, homes, guests, first = [], [], [], [], [], 0
        for weight in weights:
            home, visitors = grow(weight, radius, shard)
            value = [np.flatnonzero(home >= 0)]
            goes = [home[value[0]]]
            for at, who in visitors:
                who = who[home[who] < at]  # the other direction is met in their own leaf
                value.append(who)
                goes.append(np.full(len(who), at, np.int32))
                guests.append(weight[who].sum())
            n = len(visitors)
            homes += np.bincount(home[value[0]], weight[value[0]], n).tolist()
            own = np.concatenate([np.full(len(v), i == 0) for i, v in enumerate(value)])
            value, goes = np.concatenate(value), np.concatenate(goes)
            order = np.argsort(value, kind="stable")
            ptr.append(np.concatenate(([0], np.cumsum(np.bincount(value, minlength=len(weight))))) + sum(len(x) for x in leaf))
            leaf.append(goes[order] + first)
            is_home.append(own[order])
            first += n
        self.ptr, self.leaf, self.is_home = ptr, np.concatenate(leaf).astype(np.int32), np.concatenate(is_home)
        blocks = lambda n: np.maximum(1, np.ceil(np.array(n) / block)).astype(np.int64)
        self.home_blocks, self.guest_blocks = blocks(homes), blocks(guests)

    def cells(self, fp: np.ndarray):
        """(row, leaf, lo, hi, home) of every place where a fingerprint is compared."""
        part = mix64(fp).astype(np.int64) & 0x7FFFFFFF
        for q, ptr in enumerate(self.ptr):
            value = ((fp >> np.uint64(16 * q)) & np.uint64(VALUES - 1)).astype(np.int64)
            row, at = _runs(ptr[value], ptr[value + 1] - ptr[value])
            leaf, home = self.leaf[at], self.is_home[at]
            h, g = self.home_blocks[leaf], self.guest_blocks[leaf]
            single = h == 1
            n = np.where(single, np.where(home, g, 1), np.where(home, h + g, h))
            i, j = _runs(np.zeros_like(n), n)
            row, leaf, home, h, g, single = row[i], leaf[i], home[i], h[i], g[i], single[i]
            own = part[row] % np.where(home, h, g)
            lo = np.where(single, 0, np.where(home, np.minimum(own, j), j))
            hi = np.where(single, np.where(home, j, own), np.where(home, np.maximum(own, j), h + own))
            yield row, leaf, lo, hi, home


def _runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated ``n`` times, with ``start``, ``start`` + 1, ... of each."""
    row = np.repeat(np.arange(len(n)), n)
    return row, start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _deal(routes: Routes):
    def deal(batches):
        for b in batches:
            fp, rep = b.column("fp").to_numpy().view(np.uint64), b.column("rep").to_numpy()
            for row, leaf, lo, hi, home in routes.cells(fp):
                columns = (pa.array(leaf), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(home), pa.array(fp[row].view(np.int64)), pa.array(rep[row]))
                yield pa.RecordBatch.from_arrays(list(columns), ["leaf", "lo", "hi", "home", "fp", "rep"])

    return deal


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of a component) after edges (a, b)."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _stars(bits: int):
    """Links of one shard, as a star per component."""

    def compare(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        far = np.bitwise_count(fp ^ fp.min()).astype(np.int64)
        order = np.argsort(far, kind="stable")
        fp, far, rep = fp[order], far[order], t.column("rep").to_numpy()[order]
        home = np.flatnonzero(t.column("home").to_numpy(zero_copy_only=False)[order])
        label = np.arange(len(fp))
        for at in range(0, len(home), CHUNK):
            x = home[at : at + CHUNK]
            lo, hi = np.searchsorted(far, far[x[0]] - bits), np.searchsorted(far, far[x[-1]] + bits, "right")
            i, j = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[None, lo:hi]) <= bits)
            label = merged(label, x[i], j + lo)
        node = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(rep[label[node]]), "b": pa.array(rep[node])})

    return compare


def linked(prints: DataFrame, bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what pairs within ``bits`` connect; ``prints``: fp (distinct), rep."""
    value = lambda q: F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(VALUES - 1)).cast("int")
    quarters = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), value(q).alias("v")) for q in range(QUARTERS))))
    counts = prints.select(quarters.alias("x")).groupBy("x.q", "x.v").agg(F.count("*").alias("n")).toArrow()
    q, v, n = (counts.column(c).to_numpy() for c in ("q", "v", "n"))
    weights = [np.bincount(v[q == i], n[q == i], VALUES).astype(np.int64) for i in range(QUARTERS)]
    routes = Routes(weights, bits // QUARTERS, shard, block)
    dealt = prints.mapInArrow(_deal(routes), "leaf int, lo int, hi int, home boolean, fp long, rep long")
    return dealt.groupBy("leaf", "lo", "hi").applyInArrow(_stars(bits), "a long, b long")


def near_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    members = stage_table(body.mapInArrow(_prints, "doc_id long, fp long"))
    prints = stage_table(members.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    total = prints.agg(F.sum("n")).first()[0]
    if total is None:
        return members.select("doc_id", F.hex("fp").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    named = prints.where("rep IS NOT NULL").select("fp", "rep")
    # an id with several texts joins their components
    several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    texts = stage_table(members.join(several, "doc_id").distinct().join(named, "fp").select("doc_id", "rep"))
    ties = texts.join(texts.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    roots = components(linked(named, bits, shard, block).union(ties))
    found = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("comp"))
    found = stage_table(found.join(prints.select("fp", "n"), "fp"))
    # a fingerprint that many documents share goes by broadcast, so that no join key is hot
    hot = found.where(F.col("n") > max(1.0, HOT * total)).select("fp", "comp")
    often = members.join(F.broadcast(hot), "fp")
    seldom = members.join(F.broadcast(hot), "fp", "left_anti").join(found.where(F.col("n") <= max(1.0, HOT * total)).select("fp", "comp"), "fp", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("component_id")
    return often.unionByName(seldom).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), comp)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(table(spark, sf_dir, "documents"))
