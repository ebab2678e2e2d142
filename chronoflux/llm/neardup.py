"""Near-duplicate groups by MinHash with tensored banding, confirmed on full sets.

A document is the set of its distinct word shingles (64-bit hashes). Two collections of
``HALVES`` short signatures (``ROWS`` minhashes each) are computed; the key of table
(i, j) combines signature i of the first with signature j of the second, so
HALVES^2 tables need only 2 * HALVES * ROWS minhashes. Two sets of similarity 0.85 miss
every table with probability 0.0003, of 0.9 below 0.00001.

Equal sets collapse to one representative (the smallest id) first. Signatures that no
other set has are dropped before keys are combined, which loses no key that two sets
share. Sets that a chain of shared keys connects are a family; no pairs are emitted in it.

1. Each set is compared with the best-connected member of its buckets, and confirmed
   links merge components. That is linear and settles the copies of one original.
2. What the largest component of a family left over is compared with the whole family
   in blocks: a task gets two blocks of sets, counts all common shingles in memory and
   returns only links that connect components. Block sizes follow the family's size.

Defined cases: texts without words (null, empty) have an empty set, component their own
id, and are kept; rows without an id have a null component and are kept; rows that repeat
an id count as one vertex where that id stands for them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.llm.common import mix64, table, texts_of
from chronoflux.session import stage_table

HALVES, ROWS, WORDS = 12, 4, 5
#: Blocks of a family, and bounds of the members and shingles of a block.
BLOCKS, BLOCK_MEMBERS, BLOCK_SHINGLES = 32, (32, 512), 500_000
_random = np.random.default_rng(20)
_MULTIPLY = _random.integers(1, 2**63, 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; all words as one shingle if it has fewer than ``WORDS``."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    h = sum((w[i : len(w) - k + 1 + i] * _PLACE[i] for i in range(k)), np.uint64(k))
    return np.unique(mix64(h))


def half_signatures(h: np.ndarray) -> np.ndarray:
    """One 64-bit key for each of the 2 * HALVES short signatures."""
    if len(h) < 20_000:
        least = (h[None, :] * _MULTIPLY[:, None]).min(1)
    else:
        least = np.array([(h * m).min() for m in _MULTIPLY])
    parts = mix64(least).reshape(2 * HALVES, ROWS)
    key = np.arange(2 * HALVES, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(31) + parts[:, r])
    return key.view(np.int64)


def _sketches(batches):
    for b in batches:
        n, sets, keys = [], [], []
        for raw in texts_of(b.column("body")):
            h = shingles(raw)
            n.append(len(h))
            sets.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            keys.append(half_signatures(h) if len(h) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "set_id", "keys"])


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([shingles(t).tobytes() for t in texts_of(b.column("body"))], pa.binary())], ["rep", "set"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node of its component.

    Roots hook to the smallest root next to them, until no edge joins two roots.
    """
    edges = stage_table(edges.select("a", "b").distinct())
    labels = stage_table(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while True:
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = stage_table(ends.where("ra <> rb").groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("up")))
        if hooks.isEmpty():
            return labels
        two = hooks.alias("x").join(hooks.alias("y"), F.col("x.up") == F.col("y.root"), "left").select("x.root", F.coalesce("y.up", "x.up").alias("up"))
        labels = stage_table(labels.join(two, "root", "left").select("node", F.coalesce("up", "root").alias("root")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, rep) whose full sets reach the similarity."""

    def check(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("rep"), pa.array(good, pa.bool_())], ["hub", "rep", "good"])

    both = pairs.join(sets.select("rep", F.col("set").alias("sb")), "rep").join(sets.select(F.col("rep").alias("hub"), F.col("set").alias("sa")), "hub")
    return both.select("hub", "rep", "sa", "sb").mapInArrow(check, "hub long, rep long, good boolean").where("good").select("hub", "rep")


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The component table (rep, ..., comp) after links (a, b) between components."""
    moved = components(links).where("node <> root").select(F.col("node").alias("comp"), "root")
    return stage_table(comps.join(moved, "comp", "left").select(*(c for c in comps.columns if c != "comp"), F.coalesce("root", "comp").alias("comp")))


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the edges (a, b) that connects what they connect."""
    up: dict[int, int] = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x] = up.get(up[x], up[x])
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = top(x), top(y)
        if rx != ry:
            up[rx] = ry
            out.append((x, y))
    return out


def _compare_blocks(percent: int, width: int = 4096):
    """Links between the components of two blocks of sets (or within one)."""

    def compare(t: pa.Table) -> pa.Table:
        comp, block = t.column("comp").to_numpy(), t.column("block").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        shared = np.flatnonzero(count[token] > 1)
        token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(token.max(initial=-1)) + 1, width):
            here = (token >= lo) & (token < lo + width)
            x = np.zeros((len(sets), width), np.float32)
            x[owner[here], token[here] - lo] = 1
            both += x[left] @ x[right].T
        total = n[left][:, None] + n[right][None, :] - both
        i, j = np.nonzero((100 * both >= percent * total) & (comp[left][:, None] != comp[right][None, :]))
        edges = _spanning(comp[left[i]], comp[right[j]])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return compare


def _block_links(comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that full comparison finds between the components of each family; ``comps``: rep, n, family, comp."""
    groups = stage_table(comps.groupBy("family", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")))
    main = groups.groupBy("family").agg(F.max(F.struct("c", "s", "comp")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    least, most = BLOCK_MEMBERS
    size = lambda c: F.least(F.greatest(F.col(c) / BLOCKS, F.lit(least)), F.lit(most))
    blocks = lambda c, s: F.greatest(F.ceil(c / size("c")), F.ceil(s / F.lit(BLOCK_SHINGLES))).cast("int")
    plan = stage_table(main.select("family", F.col("m.comp").alias("main"), blocks(F.col("m.c"), F.col("m.s")).alias("n_main"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("n_rest")))
    # blocks of the rest are 0 to n_rest - 1, those of the main component follow
    rest = F.col("comp") != F.col("main")
    at = F.pmod(F.xxhash64("rep"), F.when(rest, F.col("n_rest")).otherwise(F.col("n_main"))).cast("int")
    placed = comps.join(plan, "family").withColumn("block", F.when(rest, at).otherwise(F.col("n_rest") + at))
    others = F.when(rest, F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_rest") - 1))
    dealt = placed.join(sets, "rep").select("family", "rep", "comp", "block", "set", F.explode(others).alias("other"))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "comp", "block", "set")
    return dealt.groupBy("family", "lo", "hi").applyInArrow(_compare_blocks(percent), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    members = stage_table(body.mapInArrow(_sketches, "doc_id long, n long, set_id binary, keys array<long>"))
    named = members.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    reps = stage_table(named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))

    halves = reps.select("rep", "n", F.posexplode("keys").alias("slot", "key"))
    shared = stage_table(halves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    of = lambda test: F.array_compact(F.array_agg(F.when(test, F.col("key"))))
    active = halves.join(shared, "key").groupBy("rep").agg(F.first("n").alias("n"), of(F.col("slot") < HALVES).alias("x"), of(F.col("slot") >= HALVES).alias("y"))
    keyed = stage_table(active.select("rep", "n", "y", F.explode("x").alias("x")).select("rep", "n", "x", F.explode("y").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep", "n"))
    sizes = stage_table(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    rows = stage_table(keyed.join(sizes, "key"))
    weight = stage_table(rows.groupBy("rep").agg(F.first("n").alias("n"), F.sum("size").alias("weight")))
    rows = stage_table(rows.select("key", "rep").join(weight, "rep"))
    hubs = stage_table(rows.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("low"), "rep", "n")).alias("hub"), F.min("rep").alias("least")))
    met = rows.join(hubs, "key")
    families = components(met.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")))

    ids = weight.select("rep")
    sets = stage_table(body.join(ids, body.doc_id == ids.rep).select("rep", "body").mapInArrow(_sets, "rep long, set binary"))
    comps = weight.select("rep", "n").join(families.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep").withColumn("comp", F.col("rep"))
    best = met.where((F.col("rep") != F.col("hub.rep")) & F.expr(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")).groupBy("rep").agg(F.max("hub")["rep"].alias("hub"))
    first = _confirmed(best, sets, percent)
    comps = _merge(comps, first.select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    comps = _merge(comps, _block_links(comps, sets, percent)).select("rep", "comp")

    found = stage_table(reps.select("set_id", "rep").join(comps, "rep", "left").select("set_id", F.coalesce("comp", "rep").alias("component_id")))
    out = members.select("doc_id", "n", "set_id").join(found, "set_id", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The documents that stay: one of each group; rows without an id stay."""
    kept = stage_table(near_duplicates(docs, doc_id, text, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct())
    one = docs.join(kept, docs[doc_id].cast("long") == kept["_kept_id"], "left_semi").dropDuplicates([doc_id])
    return one.unionByName(docs.where(F.col(doc_id).isNull()))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
