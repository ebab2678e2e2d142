"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Labelled examples (a bounded, documented sample of labelled rows) are vectors over the
terms whose use differs between the two labels (chi-square of documents); idf comes from
all documents. The examples stand in an inverted index cut into blocks of consecutive
examples, with the largest weight of each term in each block. A query visits blocks in
waves, in the order of their upper bound (its weights times the block maxima), and stops
when the bound falls below its k-th best cosine, so the k nearest are exact. Ties go to the lower
example id. Neighbours vote with weight cosine squared; a logistic curve fitted on the
examples' own left-out votes, weighted to the true share of labels, calibrates them.

Bounds: ``max_examples`` and ``max_terms`` bound the index, the only thing broadcast.

Defined cases: a text without indexed terms (null and empty included) has no neighbours
and gets the calibrated score of a zero vote; without examples of both labels every
score is the share of label 1 (0 if none); repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoflux.llm.common import id_remainder, table, texts_of
from chronoflux.session import stage_table

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = 64
#: Blocks scored before the first look at the bound; each later wave is four times as many.
FIRST_WAVE = 8


def terms_of(raw: bytes) -> Counter:
    return Counter(_TERM.findall(raw.lower()))


def _sample_ids(labelled: DataFrame, max_examples: int) -> DataFrame:
    """At most half of ``max_examples`` labelled ids per label, by hash of the id."""
    each = [labelled.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples // 2) for v in (0, 1)]
    return each[0].unionByName(each[1])


def _select_terms(examples: DataFrame, n: dict[int, int], chi2: float, max_terms: int) -> list[bytes]:
    """Terms whose document counts differ between labels, strongest first."""

    def distinct(batches):
        for b in batches:
            rows = [(t, y) for raw, y in zip(texts_of(b.column("body")), b.column("label").to_pylist(), strict=True) for t in terms_of(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], ["term", "label"])

    found = examples.mapInArrow(distinct, "term binary, label int").groupBy("term").agg(F.sum(F.col("label")).cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    c, d, total = n[1] - F.col("a"), n[0] - F.col("b"), float(n[0] + n[1])
    stat = total * F.pow(F.col("a") * d - F.col("b") * c, 2) / (F.lit(float(n[0] * n[1])) * (F.col("a") + F.col("b")) * F.greatest(c + d, F.lit(1e-9)))
    best = found.where(F.col("a") + F.col("b") >= 3).select("term", stat.alias("stat")).where(F.col("stat") >= chi2)
    return [bytes(r["term"]) for r in best.orderBy(F.desc("stat"), "term").limit(max_terms).collect()]


def _document_counts(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches):
        n, rows = np.zeros(len(sent.value), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for raw in texts_of(b.column("body")):
                n[[sent.value[t] for t in sent.value.keys() & set(_TERM.findall(raw.lower()))]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(n))], pa.int64()), pa.array([rows, *n], pa.int64())], ["term", "n"])

    sums = {r["term"]: r["n"] for r in docs.select("body").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(terms))], float), sums.get(-1, 0)


@dataclass
class Index:
    """Inverted index over examples, in blocks: postings of term t in block b are ``rows[ptr[t, b]:ptr[t, b + 1]]``."""

    terms: dict[bytes, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    ptr: np.ndarray
    most: np.ndarray

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(self.terms[t] for t in self.terms.keys() & counts.keys()), np.int64)
        if not len(at):
            return at, np.empty(0)
        names = {self.terms[t]: counts[t] for t in self.terms.keys() & counts.keys()}
        w = (1 + np.log([names[i] for i in at])) * self.idf[at]
        return at, w / np.linalg.norm(w)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Exact k nearest examples with a positive cosine: positions and cosines."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0)
        bound = w @ self.most[at]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        best_i, best_s = np.empty(0, np.int64), np.empty(0)
        wave = FIRST_WAVE
        while len(order):
            i, s = self._cosines(at, w, order[:wave])
            if skip >= 0:
                i, s = i[i != skip], s[i != skip]
            i, s = np.concatenate((best_i, i)), np.concatenate((best_s, s))
            if len(s) > k:
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                i, s = i[near], s[near]
            sort = np.lexsort((i, -s))[:k]
            best_i, best_s = i[sort], s[sort]
            order = order[wave:]
            if len(best_s) == k:
                order = order[bound[order] >= best_s[-1] - 1e-12]
            wave *= 4
        return best_i, best_s

    def _cosines(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the examples of some blocks that share a term with the query."""
        lo = self.ptr[at[:, None], blocks]
        n = (self.ptr[at[:, None], blocks + 1] - lo).ravel()
        posting = np.repeat(lo.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total = np.bincount(self.rows[posting], np.repeat(np.repeat(w, len(blocks)), n) * self.weights[posting])
        here = np.flatnonzero(total)
        return here, np.round(total[here], 12)

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        """Weighted share of label 1, drawn to zero when all neighbours are far."""
        return float((s**2 * self.labels[i]).sum() / (s**2).sum()) if len(i) else 0.0


def build_index(examples: list[tuple[int, int, Counter]], terms: list[bytes], df: np.ndarray, n_docs: int) -> Index:
    idf = np.log1p(n_docs / np.maximum(df, 1))
    index = Index({t: i for i, t in enumerate(terms)}, idf, np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], float), *[np.empty(0)] * 4)
    n_blocks = -(-len(examples) // BLOCK)
    vectors = [index.vector(e[2]) for e in examples]
    row = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    term = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int64)
    weight = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
    order = np.lexsort((row, term))
    index.rows, term, index.weights = row[order], term[order], weight[order]
    cell = term * n_blocks + index.rows // BLOCK
    starts = np.searchsorted(cell, np.arange(len(terms) * n_blocks + 1))
    index.ptr = np.stack([starts[t * n_blocks : (t + 1) * n_blocks + 1] for t in range(len(terms))]) if terms else np.zeros((0, n_blocks + 1), np.int64)
    index.most = np.zeros((len(terms), n_blocks))
    np.maximum.at(index.most.reshape(-1), cell, index.weights)
    return index


def _calibrate(votes: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic curve of label 1 over the vote; ``share`` is the true share of label 1."""
    if labels.min() == labels.max():
        return 0.0, 0.0
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    x, beta = np.stack([np.ones_like(votes), votes], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-6 * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def fit(docs: DataFrame, labelled: DataFrame, max_examples: int = 8000, max_terms: int = 2000, chi2: float = 15.0, k: int = 25) -> tuple[Index | None, tuple[float, float], float]:
    """Index, calibration and share of label 1. ``docs``: doc_id, body; ``labelled``: doc_id, label."""
    counts = {r["label"]: r["n"] for r in labelled.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return None, (0.0, 0.0), share
    chosen = _sample_ids(labelled, max_examples)
    examples = stage_table(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "body"))
    n = {0: 0, 1: 0} | {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        return None, (0.0, 0.0), share
    terms = _select_terms(examples, n, chi2, max_terms)
    df, n_docs = _document_counts(docs, terms)
    sent = docs.sparkSession.sparkContext.broadcast(set(terms))

    def shrink(batches):
        for b in batches:
            kept = [{t: c for t, c in terms_of(raw).items() if t in sent.value} for raw in texts_of(b.column("body"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([list(x) for x in kept], pa.list_(pa.binary())), pa.array([list(x.values()) for x in kept], pa.list_(pa.int64()))], ["doc_id", "label", "terms", "n"])

    small = examples.mapInArrow(shrink, "doc_id long, label int, terms array<binary>, n array<long>").orderBy("doc_id", "terms").collect()
    index = build_index([(r["doc_id"], r["label"], Counter(dict(zip(map(bytes, r["terms"]), r["n"], strict=True)))) for r in small], terms, df, n_docs)
    own = docs.sparkSession.sparkContext.broadcast(index)

    def left_out(batches):
        for b in batches:
            at = b.column(0).to_pylist()
            votes = []
            for i, names, c in zip(at, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                votes.append(own.value.vote(*own.value.nearest(*own.value.vector(Counter(dict(zip(names, c, strict=True)))), k, skip=i)))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(votes, pa.float64())], ["i", "vote"])

    spark = docs.sparkSession
    numbered = spark.createDataFrame([(i, [bytes(t) for t in r["terms"]], r["n"]) for i, r in enumerate(small)], "i long, terms array<binary>, n array<long>").repartition(64)
    votes = np.zeros(len(small))
    for r in numbered.mapInArrow(left_out, "i long, vote double").collect():
        votes[r["i"]] = r["vote"]
    return index, _calibrate(votes, index.labels, share), share


def score(docs: DataFrame, model: tuple[Index | None, tuple[float, float], float], text: str = "text", k: int = 25, shown: int = 3) -> DataFrame:
    """``row`` (struct), ``score``, ``evidence`` (nearest examples with cosine and label)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body"))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def work(batches):
        index, (a, b), share = sent.value
        for batch in batches:
            scores, shown_rows = [], []
            for raw in texts_of(batch.column("body")):
                if index is None:
                    scores.append(share), shown_rows.append([])
                    continue
                i, s = index.nearest(*index.vector(terms_of(raw)), k)
                scores.append(float(1 / (1 + np.exp(-(a + b * index.vote(i, s))))))
                shown_rows.append([{"doc_id": int(index.ids[j]), "cosine": float(c), "label": int(index.labels[j])} for j, c in zip(i[:shown], s[:shown], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(shown_rows, kind)], ["row", "score", "evidence"])

    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>")])
    return packed.mapInArrow(work, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    known = labels.where((id_remainder(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    scored = score(docs, fit(docs.withColumnRenamed("text", "body"), known))
    near = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), F.round(e["cosine"], 4).cast("string"), e["label"].cast("string"))), ",")
    return scored.select("row.doc_id", F.coalesce(id_remainder(F.col("row.doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), near.alias("evidence"))
