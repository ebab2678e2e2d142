"""Language proportions of each text by expectation-maximisation over n-gram likelihoods.

Training counts byte trigrams of letters, hashed to a fixed number of cells, for each
language over all training rows. A text is a mixture of languages: its proportions
maximise the likelihood of its trigrams. Its language set grows one language at a time,
largest proportion first, as long as the log-likelihood of the refitted mixture gains
more than a penalty of ``penalty * ln(trigrams)``.

The model has (languages x cells) numbers, whatever the corpus size, and is the only
thing sent to the tasks.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is
every text where nothing was learned; a letter text without known trigrams gets equal
proportions, ties go to the first language by code point; repeated rows are rated each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoflux.llm.common import id_remainder, table, texts_of

CELLS = 1 << 15
#: A language table beyond this is no list of languages.
MAX_LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def cells_of(raw: bytes) -> np.ndarray:
    """Cell of each trigram of a text; runs of other characters count as one space."""
    x = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    if len(x) < 3:
        return np.empty(0, np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(2654435769)) >> np.uint32(17)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of each cell, from all of ``rows``."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for raw, name in zip(texts_of(b.column("t")), b.column("l").to_pylist(), strict=True):
                if name not in sums:
                    sums[name] = np.zeros(CELLS, np.int64)
                sums[name] += np.bincount(cells_of(raw), minlength=CELLS)
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v[at])], ["l", "cell", "n"])

    named = rows.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    sums = named.mapInArrow(count, "l string, cell long, n long").groupBy("l", "cell").agg(F.sum("n").alias("n"))
    found = sums.groupBy("l").agg(F.array_agg(F.struct("cell", "n")).alias("v")).orderBy("l").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values in the language column")
    counts = np.zeros((len(found), CELLS))
    for i, r in enumerate(found):
        v = np.array(r["v"], np.int64)
        counts[i, v[:, 0]] = v[:, 1]
    p = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * CELLS)
    return [r["l"] for r in found], p


def _fit(p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of counts ``c``, and its logarithm."""
    share = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        each = share[:, None] * p
        new = each @ (c / each.sum(0)) / c.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(c @ np.log(share @ p))


def mixture(cells: np.ndarray, p: np.ndarray, penalty: float = 2.0, rounds: int = 25) -> tuple[np.ndarray, list[int]]:
    """Proportions over all languages, and the languages chosen by penalised likelihood."""
    count = np.bincount(cells, minlength=CELLS)
    at = np.flatnonzero(count)
    c, q = count[at].astype(float), p[:, at]
    share, _ = _fit(q, c, rounds)
    order = np.argsort(-share, kind="stable")
    chosen, best = [int(order[0])], float(c @ np.log(q[order[0]]))
    for nxt in order[1:]:
        if share[nxt] < 1e-3:
            break
        gain = _fit(q[[*chosen, nxt]], c, rounds)[1] - best
        if gain <= penalty * np.log(c.sum()):
            break
        chosen, best = [*chosen, int(nxt)], best + gain
    return share, chosen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 2.0) -> DataFrame:
    """``row`` (struct), ``lang_pred``, ``score`` and the ``mixture`` (language, share) of the chosen set."""
    names, p = model
    sent = docs.sparkSession.sparkContext.broadcast(p)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body"))

    def rate(raw: bytes):
        if not names or not _LETTER.search(raw.decode("utf-8", "replace")):
            return "und", 0.0, []
        cells = cells_of(raw)
        if not len(cells):
            return names[0], 1 / len(names), [(names[0], 1 / len(names))]
        share, chosen = mixture(cells, sent.value, penalty)
        top = max(chosen, key=lambda i: (share[i], -i))
        total = sum(share[i] for i in chosen)
        return names[top], float(min(1, share[top])), [(names[i], float(share[i] / total)) for i in chosen]

    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def work(batches):
        for b in batches:
            rows = [rate(x) for x in texts_of(b.column("body"))]
            sets = pa.array([[{"lang": n, "share": s} for n, s in r[2]] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), sets], ["row", "lang_pred", "score", "mixture"])

    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("lang_pred string, score double, mixture array<struct<lang:string,share:double>>")])
    return packed.mapInArrow(work, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = id_remainder(F.col("doc_id"), 3)
    model = train(docs.where(part.isNotNull() & (part != 1)))
    rated = predict(docs.select("doc_id", "text"), model)
    return rated.select("row.doc_id", F.coalesce(id_remainder(F.col("row.doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        F.array_join(F.transform("mixture", lambda m: F.concat_ws(":", m["lang"], F.round(m["share"], 4).cast("string"))), ",").alias("languages"))
