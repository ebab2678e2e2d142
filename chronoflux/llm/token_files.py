"""Token ids of a corpus in Huffman-coded files.

Texts are dealt by ranges of their id and encoded in id order; runs of whole documents
form blocks of about ``BLOCK_IDS`` ids. Global counts of the ids (one row per id of the
vocabulary) give a canonical Huffman code of limited length (package-merge). Each block
is coded on its own and holds the bits, and the bit length of every ``SEGMENT`` ids as
checkpoints, so that a reader starts anywhere and decodes all segments of a block side by
side from one table of prefixes.

Files (Parquet, in ``folder``): ``blocks`` with part, seq, start (ids before the block),
doc_id and n_tokens lists, n_ids, bits, checkpoints; ``codebook`` with id and bits of
each code, in canonical order.

Texts are cut before runs of white space and before the last space of a run, where the
byte-level pre-tokenizer cuts too, and words between letters and punctuation and around a
single line feed. The distinct parts of a run of texts are looked up once;
a worker remembers the ids of words it has met as columns (bounded; only saves time), from
one task to the next, and encodes new words in rows, told apart by the bytes of each id. Words
of letters alone are one pre-token each and go to the tokenizer's model as they are. If a
tokenizer file does not allow that cut, whole texts are encoded.

Defined cases: null and empty texts hold only the end id; ids repeat in the order of the
hash of their texts, null ids come first; an empty table gives empty files.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoflux.llm.common import table
from chronoflux.session import scratch_folder, stage_table

BLOCK_IDS, SEGMENT, MAX_BITS, REMEMBERED, LONGEST = 1 << 18, 256, 20, 500_000, 64
_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PART = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ENCODERS: dict = {}
OTHER, LETTER, NUMBER, MARK, FEED = range(5)


class Memory:
    """Ids of parts in two generations: what is not asked for in a while goes first."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def recall(self, parts: list[str], encode) -> list[bytes]:
        """Ids of distinct parts; ``encode`` gives those of unknown ones, in order."""
        got = list(map(self.young.get, parts))
        gaps = [i for i, ids in enumerate(got) if ids is None]
        for i in gaps:
            got[i] = self.old.get(parts[i])
        new = [i for i in gaps if got[i] is None]
        for i, ids in zip(new, encode([parts[i] for i in new]), strict=True):
            got[i] = ids
        if len(self.young) + len(gaps) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((parts[i], got[i]) for i in gaps if len(parts[i]) <= LONGEST)
        return got


def gather(flat: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    upto = np.cumsum(width)
    at = np.repeat(start - (upto - width), width)
    at += np.arange(len(at))
    return flat[at]


def kinds_of_characters(marks: str) -> np.ndarray:
    """LETTER, NUMBER, MARK (of ``marks``), FEED or OTHER for each code point up to 0xFFFF.

    Only what Unicode 3.2 and today's Unicode both call a letter or number is one, so that
    it does not matter which version the library has.
    """
    kinds = np.zeros(1 << 16, np.uint8)
    for i in range(len(kinds) - 1):  # the last one stands for all that follow
        a, b = unicodedata.category(chr(i))[0], unicodedata.ucd_3_2_0.category(chr(i))[0]
        if a == b and a in "LN":
            kinds[i] = LETTER if a == "L" else NUMBER
    kinds[[ord(c) for c in marks]] = MARK
    kinds[ord("\n")] = FEED
    return kinds


def byte_characters() -> np.ndarray:
    """Code point that stands for each byte in the pieces of a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[own] = own
    out[out == 0] = 256 + np.arange(256 - len(own))
    return out


def bytes_of(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of all strings, one after the other, and where each begins and the last ends."""
    if not len(words):
        return b"", np.zeros(1, np.int32)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return (words.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])].to_pybytes(), at - at[0]


class Words:
    """Distinct words and their ids, all in columns: a few dozen bytes a word."""

    def __init__(self, limit: int):
        self.limit, self.words = limit, pa.array([], pa.string())
        self.flat, self.width, self.again = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, bool)

    def recall(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, width) of distinct words; ``encode`` gives an order of unknown ones, their ids and widths."""
        found = pc.index_in(self.words, value_set=words)  # hashes the fewer words that are asked for
        known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(words), -1)
        at[found.drop_null().to_numpy()] = known
        gaps = np.flatnonzero(at < 0)
        self.again[known] = True
        order, flat, width = encode(words.take(pa.array(gaps)))
        gaps = gaps[order]
        at[gaps] = len(self.words) + np.arange(len(gaps))
        self.words = pa.concat_arrays([self.words, words.take(pa.array(gaps))])
        self.flat, self.width = np.concatenate((self.flat, flat)), np.concatenate((self.width, width))
        self.again = np.concatenate((self.again, np.zeros(len(gaps), bool)))
        flat, start, width = self.flat, (np.cumsum(self.width) - self.width)[at], self.width[at]
        self._forget_rare()
        return flat, start, width

    def _forget_rare(self) -> None:
        """Long words go at once; beyond the limit all that were not asked for again."""
        keep = pc.binary_length(self.words).to_numpy() <= LONGEST
        if keep.sum() > self.limit:
            keep &= self.again
            self.again[:] = False
            if keep.sum() > self.limit // 2:
                keep[:] = False
        if not keep.all():
            start = np.cumsum(self.width) - self.width
            self.words, self.flat = self.words.filter(pa.array(keep)), gather(self.flat, start[keep], self.width[keep])
            self.width, self.again = self.width[keep], self.again[keep]


class Encoder:
    """A tokenizer file with the parts it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.forget()
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre, added = d.get("pre_tokenizer") or {}, d.get("added_tokens") or ()
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(f"[{_SPACE}]", a["content"])) for a in added)
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and d.get("normalizer") is None and plain
        if self.cut:  # bytes of each id: one per character of a byte-level piece
            own = {a["id"]: len(a["content"].encode()) for a in added}
            vocab = self.model.get_vocab()
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            for piece, i in vocab.items():
                self.width[i] = own.get(i, len(piece))
            strings = "".join(a["content"] for a in added)
            self.kinds = kinds_of_characters("".join(c for c in string.punctuation if c != "'" and c not in strings))
            bpe = d["model"]
            whole = bpe.get("type") == "BPE" and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            whole = whole and not any(all(self._kind(a["content"]) == LETTER) for a in added)
            self.bpe = Tokenizer(self.model.model) if whole else None
            self.characters = byte_characters()

        self.spaced, self.joined = Words(REMEMBERED), Words(REMEMBERED // 5)

    def forget(self) -> None:
        self.met = Memory(REMEMBERED // 50)

    def _alone(self, parts: list[str]):
        """Ids of each part, encoded by itself."""
        for i in range(0, len(parts), 20_000):
            for e in self.model.encode_batch_fast(parts[i : i + 20_000], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def _kind(self, text: str) -> np.ndarray:
        return self.kinds[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(self.kinds) - 1)]

    def _coded(self, rows: list[str], letters: bool) -> list:
        """Rows as the library encodes them; rows of letters and single spaces without its pre-tokenizer."""
        if not letters:
            return self.model.encode_batch_fast(rows, add_special_tokens=False)
        rows = [self.characters[np.frombuffer(r.encode(), np.uint8)].tobytes().decode("utf-32-le") for r in rows]
        return self.bpe.encode_batch_fast(rows, add_special_tokens=False)

    def _rows(self, words: pa.Array, letters: bool = False, glue: str = " ", row: int = 256):
        """Ids and widths of words with a space before each; a row of words is one text for the library.

        With a line feed as ``glue`` the ids are those of the words without it. Where an id ends
        with each word, no merge crossed a word's end and each is coded as if alone.
        """
        apart = glue != " "
        for i in range(0, len(words), row * 64):
            some = words.slice(i, row * 64)
            cuts = np.append(np.arange(0, len(some), row), len(some)).astype(np.int32)
            rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), some), glue).to_pylist()
            coded = [np.array(e.ids, "<u4") for e in self._coded([glue + r for r in rows], letters)]
            size = pc.binary_length(some).to_numpy().astype(np.int64) + 1
            if apart:
                size, cuts = np.stack((np.ones(len(size), np.int64), size - 1), 1).ravel(), cuts * 2
            for lo, hi, ids in zip(cuts, cuts[1:], coded, strict=False):
                ends, upto = np.cumsum(size[lo:hi]), np.cumsum(self.width[ids])
                at = np.searchsorted(upto, ends)
                if len(upto) and upto[-1] == ends[-1] and np.array_equal(upto[at], ends):
                    n = np.diff(at, prepend=-1)
                    yield (ids[np.repeat(np.arange(len(n)) % 2 == 1, n)], n[1::2]) if apart else (ids, n)
                else:  # bytes unknown to the vocabulary, or a merge over a word's end
                    lo, hi = (lo // 2, hi // 2) if apart else (lo, hi)
                    yield self._each([("" if apart else " ") + w for w in some.slice(lo, hi - lo).to_pylist()])

    def _each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = list(self._alone(parts))
        return np.frombuffer(b"".join(alone), "<u4"), np.fromiter(map(len, alone), np.int64, len(alone)) // 4

    def _letters(self, words: pa.Array) -> np.ndarray:
        """Which words are letters alone; no word is empty."""
        raw, at = bytes_of(words)
        if not raw or not self.bpe:
            return np.zeros(len(words), bool)
        start, kind = self._characters(raw)
        strange = np.zeros(len(raw), bool)
        strange[start[kind != LETTER]] = True
        return ~np.logical_or.reduceat(strange, at[:-1])

    def _after_space(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order, ids and widths of words with a space before each; no word is empty or white space only."""
        ragged = pc.utf8_is_space(pc.utf8_slice_codeunits(words, -1)).to_numpy(zero_copy_only=False)
        group = np.where(ragged, 2, 1)
        group[self._letters(words)] = 0
        order = np.argsort(group, kind="stable")
        letters, mixed, alone = (words.filter(pa.array(group == g)) for g in range(3))
        made = [*self._rows(letters, True), *self._rows(mixed), self._each([" " + w for w in alone.to_pylist()])]
        ids, width = (np.concatenate(x) for x in zip(*made, strict=True))
        return order, ids, width

    def _after_cut(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for parts of words with nothing before them."""
        letters = self._letters(parts)
        order = np.argsort(~letters, kind="stable")
        made = [*self._rows(parts.filter(pa.array(letters)), True, "\n"), self._each(parts.filter(pa.array(~letters)).to_pylist())]
        ids, width = (np.concatenate(x) for x in zip(*made, strict=True))
        return order, ids, width

    def _characters(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First byte and kind of each character."""
        start = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        return start, self._kind(raw.decode())

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, width) of distinct words that follow a space.

        Words are cut where the pre-tokenizer always cuts: between letters or numbers and marks, and
        on both sides of a line feed between two such characters.
        """
        raw, at = bytes_of(words)
        if not raw:
            return np.empty(0, "<u4"), at[:0], at[:0]
        start, kind = self._characters(raw)
        head = np.zeros(len(raw) + 1, bool)  # where words begin
        head[at] = True
        inner = ~head[start[1:]]  # between a character and the next, in one word
        sure = (kind == LETTER) | (kind == NUMBER) | (kind == MARK)
        cut = inner & sure[:-1] & sure[1:] & ((kind[:-1] == MARK) != (kind[1:] == MARK))
        feed = np.flatnonzero(kind[1:-1] == FEED) + 1
        feed = feed[inner[feed - 1] & inner[feed] & sure[feed - 1] & sure[feed + 1]]
        cut[feed - 1] = cut[feed] = True
        border = head.copy()
        border[start[1:][cut]] = True
        ends = np.flatnonzero(border).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
        first = head[ends[:-1]]
        spaced, joined = (parts.filter(pa.array(x)).dictionary_encode() for x in (first, ~first))
        flat, begin, size = self.spaced.recall(spaced.dictionary, self._after_space)
        more, begin_more, size_more = self.joined.recall(joined.dictionary, self._after_cut)
        lo, width = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for x, coded, a, n in ((first, spaced, begin, size), (~first, joined, begin_more + len(flat), size_more)):
            which = coded.indices.to_numpy()
            lo[x], width[x] = a[which], n[which]
        flat = gather(np.concatenate((flat, more)), lo, width)
        width = np.add.reduceat(width, np.flatnonzero(first))
        return flat, np.cumsum(width) - width, width

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers.

        A text whose spaces stand alone is split at them, and the ids of its words are
        gathered by number. One with runs of spaces, or a part of white space only, is
        cut by ``_PART``.
        """
        if not self.cut:
            return list(self._alone(texts.to_pylist()))
        parts = pc.split_pattern(texts, " ")
        first, words = parts.offsets.to_numpy(), parts.flatten()
        later = np.ones(len(words), bool)
        later[first[:-1]] = False
        heads = words.take(pa.array(first[:-1])).to_numpy(zero_copy_only=False).tolist()
        coded = words.filter(pa.array(later)).dictionary_encode()
        vocab, which, sizes = coded.dictionary, coded.indices.to_numpy(), np.diff(first) - 1
        blank = pc.or_(pc.equal(pc.binary_length(vocab), 0), pc.utf8_is_space(vocab)).to_numpy(zero_copy_only=False)
        blanks = np.concatenate(([0], np.cumsum(blank[which])))[first - np.arange(len(first))]
        odd = (np.diff(blanks) > 0) | (sizes > 0) & np.fromiter((not h or h.isspace() for h in heads), bool, len(heads))
        which, sizes = which[np.repeat(~odd, sizes)], np.where(odd, 0, sizes)
        used = np.zeros(len(vocab), bool)
        used[which] = True
        which = (np.cumsum(used) - 1)[which]
        flat, start, width = self._words(vocab.filter(pa.array(used)))
        n = width[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = gather(flat, start[which], n)
        ends = upto[np.cumsum(sizes)].tolist()
        cut = [_PART.findall(texts[i].as_py()) if o else [h] if h else [] for i, (h, o) in enumerate(zip(heads, odd.tolist(), strict=True))]
        names = list({p for ps in cut for p in ps})
        met = dict(zip(names, self.met.recall(names, self._alone), strict=True)).__getitem__
        return [b"".join(map(met, ps)) + ids[lo:hi].tobytes() for ps, lo, hi in zip(cut, [0, *ends], ends, strict=False)]


def runs_of_texts(texts: pa.Array, most: int = 4 << 20):
    """(start, length) of runs of texts of about ``most`` bytes, or of one longer text."""
    lo, room = 0, most
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > lo and n > room:
            yield lo, i - lo
            lo, room = i, most
        room -= n
    if len(texts):
        yield lo, len(texts) - lo


def planes(ids: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all lowest bytes first: compresses better."""
    return b"".join((ids >> k).astype(np.uint8).tobytes() for k in (0, 8, 16, 24))


def numbers(raw: bytes) -> np.ndarray:
    out = np.zeros(len(raw) // 4, np.uint32)
    for k, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(4, -1)):
        if plane.any():
            out |= plane.astype(np.uint32) << (8 * k)
    return out


def id_blocks(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(part, seq, doc_id list, n_tokens list, n_ids, ids, counts) in id order.

    ``counts`` has how often each id stands in the task, as (id, n) on its last block alone.
    """
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("h", F.xxhash64("body"))
    dealt = body.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "body")
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        names, sizes, held, room, seq = [], [], [], BLOCK_IDS, 0
        kind = pa.schema([("seq", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))])
        sums = np.zeros(0, np.int64)

        def block(last=False):
            nonlocal sums
            ids = np.frombuffer(b"".join(held), "<u4")
            n = np.bincount(ids)
            if len(n) > len(sums):
                sums, n = n, sums
            sums[: len(n)] += n
            at = np.flatnonzero(sums) if last else sums[:0]
            counts = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays([pa.array(at), pa.array(sums[at])], ["id", "n"]))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([seq], [names], [sizes], [len(ids)], [planes(ids)]), kind, strict=False)] + [counts], schema=kind)

        for b in batches:
            for lo, length in runs_of_texts(b.column("body")):
                some = b.slice(lo, length)
                for name, raw in zip(some.column("doc_id").to_pylist(), _ENCODERS[tokenizer].encode(some.column("body")), strict=True):
                    n = len(raw) // 4 + 1
                    if names and n > room:
                        yield block()
                        names, sizes, held, room, seq = [], [], [], BLOCK_IDS, seq + 1
                    names.append(name), sizes.append(n), held.append(raw + end)
                    room -= n
            pa.default_memory_pool().release_unused()  # two workers and a JVM share an executor
        if names:
            yield block(last=True)
        _ENCODERS[tokenizer].forget()  # an idle worker holds no parts but the words in columns
        pa.default_memory_pool().release_unused()

    rows = dealt.mapInArrow(work, "seq long, doc_id array<long>, n_tokens array<long>, n_ids long, ids binary, counts array<struct<id:long,n:long>>")
    return rows.withColumn("part", F.spark_partition_id())


def code_lengths(count: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); counts above 0."""
    n = len(count)
    if n < 3:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(count, kind="stable")
    leaf = count[order].astype(float)
    row, leaves = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaf, pairs))
        at = np.argsort(both, kind="stable")
        row = both[at]
        leaves.append(at < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = length
    return out


class Codebook:
    """Canonical code of ids with given lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.most = int(self.bits.max()) if len(self.bits) else 1
        width = np.uint64(1) << (self.most - self.bits).astype(np.uint64)
        self.first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(width)))[:-1]  # left-aligned codes
        self._table: np.ndarray | None = None
        self._of_id: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids (most significant first) and the bit length of each segment."""
        if self._of_id is None:  # code of each id, and its bits (lowest 6)
            code = np.zeros(int(self.ids.max()) + 1, np.uint64)
            code[self.ids] = (self.first >> (self.most - self.bits).astype(np.uint64)) << np.uint64(6) | self.bits.astype(np.uint64)
            self._of_id = code
        code = self._of_id[ids]
        n = (code & np.uint64(63)).view(np.int64)
        upto = np.cumsum(n)
        off = upto - n
        # a code of at most 33 bits that begins in a half word lies in 64 bits from there
        head = (code >> np.uint64(6)) << (64 - (off & 31) - n).view(np.uint64)
        half = off >> 5
        cut = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
        head, half = np.bitwise_or.reduceat(head, cut), half[cut]
        halves = np.zeros(int(upto[-1] + 31) // 32 + 2, np.uint32)
        halves[half] = head >> np.uint64(32)
        halves[half + 1] |= head.astype(np.uint32)
        return halves.astype(">u4").tobytes()[: int(upto[-1] + 7) // 8], np.add.reduceat(n, np.arange(0, len(n), SEGMENT))

    def table(self) -> np.ndarray:
        """Id and length (lowest 6 bits) for each prefix of the longest code's length."""
        if self._table is None:
            width = 1 << (self.most - self.bits)
            fill = (1 << self.most) - int(width.sum())
            kind = np.uint32 if not len(self.ids) or self.ids.max() < 1 << 26 else np.uint64
            self._table = np.concatenate((np.repeat((self.ids << 6 | self.bits).astype(kind), width), np.ones(fill, kind)))
        return self._table

    def decode(self, bits: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        """All ids of a block; every segment starts at its checkpoint."""
        table = self.table()
        room = 4 if self.most <= 25 else 8  # bytes that hold a longest code at any bit of the first
        raw = np.frombuffer(bits + bytes(SEGMENT * self.most // 8 + 2 * room), np.uint8)  # a short last segment reads on
        kind = np.uint32 if room == 4 else np.uint64
        peeks = np.zeros(len(raw) - room, kind)
        for k in range(room):
            peeks = peeks << 8 | raw[k : k + len(peeks)]
        at = np.cumsum(checkpoints) - checkpoints
        out, down = np.empty((SEGMENT, len(at)), table.dtype), kind(8 * room - self.most)
        word, bit, cell = np.empty(len(at), kind), np.empty(len(at), kind), np.empty(len(at), np.intp)
        for row in out:
            np.take(peeks, np.right_shift(at, 3, out=cell), out=word, mode="clip")
            np.left_shift(word, np.bitwise_and(at, 7, out=bit, casting="unsafe"), out=word)  # bits before the code fall out
            np.take(table, np.right_shift(word, down, out=cell, casting="unsafe"), out=row, mode="clip")
            at += np.bitwise_and(row, 63, out=cell, casting="unsafe")
        return (out.T.ravel()[:n_ids] >> 6).astype(np.uint32)


_BOOKS: dict = {}


def _book(sent) -> Codebook:
    """The codebook of a broadcast, with its table kept by the worker."""
    if sent.id not in _BOOKS:
        _BOOKS.clear()
        _BOOKS[sent.id] = Codebook(*sent.value)
    return _BOOKS[sent.id]


class _Sent:
    def __init__(self, spark, ids, bits):
        self.cast = spark.sparkContext.broadcast((ids, bits))
        self.id = self.cast._jbroadcast.id()

    def __getstate__(self):
        return {"cast": self.cast, "id": self.id}

    @property
    def value(self):
        return self.cast.value


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> None:
    """Encode all texts and write the files."""
    spark = docs.sparkSession
    blocks = stage_table(id_blocks(docs, tokenizer, end_id, doc_id, text))

    counts = blocks.select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("id", "n"))
    bits = code_lengths(n, max_bits)
    spark.createDataFrame([(int(i), int(b)) for b, i in sorted(zip(bits, ids, strict=True))], "id long, bits long").coalesce(1).write.parquet(f"{folder}/codebook")
    sent = _Sent(spark, ids, bits)
    starts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # one row per task
    inner = blocks.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inner"))
    starts = stage_table(inner.join(starts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start")))

    def code(batches):
        for b in batches:
            coded = [_book(sent).encode(numbers(raw)) for raw in b.column("ids").to_pylist()]
            cols = [b.column(c) for c in ("part", "seq", "doc_id", "n_tokens", "n_ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.list_(pa.int32()))], ["part", "seq", "doc_id", "n_tokens", "n_ids", "bits", "checkpoints"])

    rows = blocks.select("part", "seq", "doc_id", "n_tokens", "n_ids", "ids").mapInArrow(code, "part int, seq long, doc_id array<long>, n_tokens array<long>, n_ids long, bits binary, checkpoints array<int>")
    rows.write.parquet(f"{folder}/blocks")
    starts.write.parquet(f"{folder}/starts")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the files."""
    book = spark.read.parquet(f"{folder}/codebook").toArrow()
    sent = _Sent(spark, book.column("id").to_numpy(), book.column("bits").to_numpy())

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = _book(sent).decode(r["bits"], np.array(r["checkpoints"], np.int64), r["n_ids"]).astype("<u4")
                upto = np.cumsum(r["n_tokens"])
                lo = upto - np.array(r["n_tokens"])
                for k in range(0, len(lo), 512):
                    pieces = [ids[a:z].tobytes() for a, z in zip(lo[k : k + 512], upto[k : k + 512], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"][k : k + 512], pa.int64()), pa.array(lo[k : k + 512] + r["start"]), pa.array(r["n_tokens"][k : k + 512], pa.int64()), pa.array(pieces, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/starts"), ["part", "seq"])
    return blocks.select("start", "doc_id", "n_tokens", "n_ids", "bits", "checkpoints").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files of ``docs`` to a fresh shared folder and describe what is read back."""
    folder = f"{scratch_folder(docs.sparkSession)}/tokens"
    write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
