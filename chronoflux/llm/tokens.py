"""Token counts of whole texts, each distinct pre-token encoded once.

The vocabulary's pieces carry the space mark only at their start, so merges never cross
the point before a run of spaces. A text is cut there into pre-tokens; its token count
is the sum over them. Texts are read in blocks. A block becomes one row: its distinct
pre-tokens in packets by hash, and for each document which of them it has how often
(numbers, not texts). Packets of one hash meet in one task, where each distinct pre-token
is counted once; the counts are joined back to the blocks and summed there; no token id
is kept. Sizes of blocks are bounded by bytes of text; one text longer
than that is a block of its own.

Defined cases: null and empty texts have no tokens; repeated rows are counted each; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoflux.llm.common import table, texts_of
from chronoflux.session import stage_table

MARK = "\u2581".encode()
#: Between the pre-tokens of a packet; no byte of UTF-8 text.
END, BAD = b"\xff", "\ufffd".encode()
PACKETS = 1024
_RUNS = re.compile(b" *[^ ]+| +")


def pre_tokens(raw: bytes) -> list[bytes]:
    """Pre-tokens of a text, each without its first space (every text begins with one)."""
    if not raw:
        return []
    raw = raw.replace(MARK, b" ").replace(END, BAD)
    parts = raw.split(b" ")
    return parts if all(parts) else [x[1:] for x in _RUNS.findall(b" " + raw)]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, lowest bytes of all first: compresses better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches, block_bytes: int):
    """One row per block: ids, sizes, packets of its vocabulary, and (document, word, count) as numbers."""
    packet = pa.list_(pa.struct([("packet", pa.int32()), ("words", pa.binary())]))
    schema = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("packets", packet), ("dealt", pa.binary()), ("ptr", pa.binary()), ("word", pa.binary()), ("freq", pa.binary())])
    vocab: dict[bytes, int] = {}
    ids, sizes, found, counts = [], [], [], []

    def block():
        ptr = np.cumsum([0, *map(len, found)])
        both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (found, counts)]
        words = list(vocab)
        dealt = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % PACKETS
        order = np.argsort(dealt, kind="stable")
        names, first = np.unique(dealt[order], return_index=True)
        packets = [{"packet": int(k), "words": END.join([words[i] for i in part])} for k, part in zip(names, np.split(order, first[1:]), strict=bool(words))]
        steps = np.diff(both[0], prepend=0).astype(np.uint32)  # ascending within a document
        row = {"doc_id": [ids], "n_bytes": [sizes], "packets": [packets], "dealt": [_planes(dealt)], "ptr": [_planes(ptr)], "word": [_planes(steps)], "freq": [_planes(both[1])]}
        return pa.RecordBatch.from_pydict(row, schema)

    room = block_bytes
    for b in batches:
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), texts_of(b.column("body")), strict=True):
            if ids and len(raw) > room:
                yield block()
                vocab, ids, sizes, found, counts, room = {}, [], [], [], [], block_bytes
            words = pre_tokens(raw)
            at, n = np.unique(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int64, len(words)), return_counts=True)
            ids.append(doc_id), sizes.append(len(raw)), found.append(at), counts.append(n)
            room -= len(raw)
    if ids:
        yield block()


_MODELS: dict = {}


def _piece_counts(path: str, words: list[bytes]) -> np.ndarray:
    """Pieces of each pre-token; the library adds the space that ``pre_tokens`` took away."""
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    model = _MODELS[path]
    lone = 1 if model.piece_to_id("\u2581") != model.unk_id() else len(MARK)
    ids = model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
    return np.fromiter((len(x) if w else lone for x, w in zip(ids, words, strict=True)), np.int64, len(words))


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, for a sentencepiece model file."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"))
    packed = "doc_id array<long>, n_bytes array<long>, packets array<struct<packet:int,words:binary>>, dealt binary, ptr binary, word binary, freq binary"
    rows = body.mapInArrow(lambda it: _blocks(it, block_bytes), packed)
    blocks = stage_table(rows.withColumn("block", F.monotonically_increasing_id()))
    uses = blocks.select("block", F.inline("packets"))

    def pieces(batches):
        """Counts of the words of packets in order; each distinct word is encoded once."""
        now, known = None, {}
        for b in batches:
            found = []
            for packet, raw in zip(b.column("packet").to_pylist(), b.column("words").to_pylist(), strict=True):
                if packet != now:
                    now, known = packet, {}
                words = raw.split(END)
                new = [w for w in words if w not in known]
                known.update(zip(new, _piece_counts(model, new).tolist(), strict=True))
                found.append(np.array([known[w] for w in words], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("packet"), pa.array(found, pa.binary())], ["block", "packet", "n"])

    # the packets of one hash meet in one task, at most one from each block
    counted = uses.repartition("packet").sortWithinPartitions("packet").mapInArrow(pieces, "block long, packet int, n binary")
    back = counted.groupBy("block").agg(F.sort_array(F.array_agg(F.struct("packet", "n")))["n"].alias("found"))

    def total(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell = lambda name: b.column(name)[i]  # noqa: B023, E731
                order = np.argsort(_numbers(cell("dealt").as_py()), kind="stable")
                n = np.zeros(len(order), np.int64)
                n[order] = np.frombuffer(b"".join(cell("found").as_py() or ()), "<u4")
                word = np.cumsum(_numbers(cell("word").as_py()), dtype=np.uint32)
                sums = np.concatenate(([0], np.cumsum(n[word] * _numbers(cell("freq").as_py()))))
                ptr = _numbers(cell("ptr").as_py())
                yield pa.RecordBatch.from_arrays([cell("doc_id").values, cell("n_bytes").values, pa.array(sums[ptr[1:]] - sums[ptr[:-1]])], ["doc_id", "n_bytes", "n_tokens"])

    return blocks.drop("packets").join(back, "block", "left").drop("block").mapInArrow(total, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
