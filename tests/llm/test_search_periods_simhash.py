"""Lexical search, periodic runs and SimHash groups against brute force, and their defined cases on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from chronoflux.llm import lexical, periods, simhash
from chronoflux.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, term string, rank string, words string, runs string, body string, score string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
SOME = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, clashing names."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, SOME), (5, SOME), (6, SOME), (7, "two words"), (7, "other text"), (None, SOME), (None, None), (8, "Two WORDS, two!")]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# lexical search


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top=10):
    """Brute force over (id, text) rows."""
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_search_matches_brute_force(spark, docs, texts):
    items = table(spark, SF, "benchmark")
    got = lexical.search(docs, items)
    want = ranked(texts.items(), [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == want
    # groups of items and small blocks give the same
    assert rows_of(lexical.search(docs, items, group_terms=40), "item_id", "rank", "doc_id", "score") == want


def test_masks_finish_early_and_keep_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WAVE", 1)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.choice([3, 3, 8, 40])))) for i in range(3000)]
    items = [(1, "a b c"), (2, "A, a! zebra"), (3, "l k j i h g f e d c b a"), (4, " ".join("abcdefghijkl") + " " + " ".join(f"m{i}" for i in range(90)))]
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string"), top=25)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == ranked(rows, items, 25)


def test_a_block_scores_only_the_masks_it_needs(monkeypatch):
    scored = []
    monkeypatch.setattr(lexical.Block, "scores", lambda self, rows, weight, docs, f=lexical.Block.scores: scored.append(len(docs)) or f(self, rows, weight, docs))
    number = {b"rare": 0, b"common": 1}
    import pyarrow as pa

    texts_ = ["rare common"] * 20 + ["common"] * 4000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts_)), pa.int64()), pa.array(texts_)], ["doc_id", "body"])
    (row,) = next(lexical._index(number)([batch])).to_pylist()
    block = lexical.Block(row, 4020, 4040)
    monkeypatch.setattr(lexical, "WAVE", 1)
    found, score = block.best(np.array([0, 1]), np.array([5000, 10]), 10, 1)
    assert sum(scored) == 20 and set(found) == set(range(20)) and len(set(score)) == 1


def test_search_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "two words"), (1, "other"), (None, "alpha"), (2, None), (3, "unseen"), (4, "?!"), (1, "two words")], "item_id long, text string")
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    got = rows_of(lexical.search(odd, items), "item_id", "rank", "doc_id", "score")
    assert got == ranked(plain, asked)
    assert [r[2] for r in got if r[0] is None] == [5, 5, 6, None]
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.where("item_id > 9")).count() == 0


# periodic runs


def all_runs(x, least_words=24, least_periods=3):
    """(start, end, period) by comparing words each period apart."""
    out = {}
    for q in range(1, len(x) // least_periods + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def made_sequences(rng, n):
    """Periodic, nested, Fibonacci and random sequences over few symbols."""
    for k in range(n):
        kind, size = k % 5, rng.randint(0, 400)
        if kind == 0:
            yield [rng.randint(0, 1) for _ in range(size)]
        elif kind == 1:
            x = []
            while len(x) < size:
                p = [rng.randint(0, 2) for _ in range(rng.randint(1, 60))]
                x += p * rng.randint(1, 6) + p[: rng.randint(0, len(p))]
            yield x
        elif kind == 2:
            u, v = [0], [0, 1]
            for _ in range(rng.randint(3, 11)):
                u, v = v, v + u
            x = (v * 3)[: rng.randint(1, 1200)]
            x[rng.randrange(len(x))] ^= rng.randint(0, 1)
            yield x
        elif kind == 3:
            yield (([0] * rng.randint(1, 40) + [1]) * rng.randint(2, 8) + [0] * rng.randint(0, 30)) * rng.randint(1, 4)
        else:
            p = [0, 1] * rng.randint(1, 20) + [rng.randint(0, 2)] + [0, 1] * rng.randint(0, 20)
            yield [rng.randint(0, 5) for _ in range(rng.randint(0, 30))] + p * rng.randint(2, 7)


def test_runs_match_brute_force_on_made_sequences():
    seen = 0
    for x in made_sequences(random.Random(4), 400):
        got = periods.Factors(np.array([*x, 9], np.int64)).runs(24, 3)
        want = all_runs(x)
        assert [tuple(r) for r in got.tolist()] == want
        seen += len(want)
    assert seen > 1000


def test_range_successor_matches_brute_force():
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    tree = periods.Wavelet(values, 500)
    lo = rng.integers(0, 500, 400)
    hi, x = rng.integers(lo + 1, 501), rng.integers(0, 501, 400)
    want = [min((v for v in values[a:b] if v >= c), default=500) for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.successor(lo, hi, x, 500).tolist() == want


def test_texts_of_a_batch_do_not_touch(spark, monkeypatch):
    monkeypatch.setattr(periods, "BATCH_WORDS", 300)
    rows = [(i, " ".join(f"w{v}" for v in x)) for i, x in enumerate(made_sequences(random.Random(7), 120))]
    rows += [(1000 + i, "same words again " * 5) for i in range(5)]  # 15 words each: no run, though the next text goes on
    got = {r["doc_id"]: r for r in periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for i, t in rows:
        w = t.split()
        want = all_runs(w)
        gone = {k for s, e, q in want for k in range(s + q, e)}
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in got[i]["runs"]] == want
        assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone) and got[i]["n_words"] == len(w)


def digests(doc_id, text):
    """The contract's columns by brute force."""
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {k for s, e, q in runs for k in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_periodic_query_matches_brute_force(spark, texts):
    short = {i: t for i, t in texts.items() if len(t) < 20_000}
    got = [tuple(r) for r in periods.op12_periodic_runs(spark, SF).collect()]
    assert len(got) == len(texts) and sum(r[1] > 0 for r in got) > 5
    assert sorted(r for r in got if r[0] in short) == sorted(digests(i, t) for i, t in short.items())


def test_periods_odd_rows(spark, odd, empty):
    rows = periods.periodic_runs(odd).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r["n_words"] == 0) == (r["collapsed"] == "") and (not r["runs"] or r["doc_id"] in (5, 6, None))
    repeated = [r for r in rows if r["doc_id"] == 5]
    assert repeated[0] == repeated[1] and repeated[0]["runs"][0].asDict() == {"start": 0, "length": 80, "period": 10}
    assert repeated[0]["collapsed"] == SOME[: len(SOME) // 8 - 1]
    assert periods.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(odd, least_periods=2)


# SimHash


def print_of(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def groups(prints, bits=4):
    """Smallest index reachable, by all pairs."""
    prints = np.array(prints, np.uint64)
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= bits) + i + 1:
            a, b = top(i), top(int(j))
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(docs, texts):
    ids = sorted(texts)
    want = groups([print_of(texts[i]) for i in ids])
    got = {r["doc_id"]: r for r in simhash.near_fingerprints(docs).collect()}
    for i, g in zip(ids, want, strict=True):
        assert got[i]["fingerprint"] == f"{print_of(texts[i]):016x}" and got[i]["component_id"] == ids[g]


@pytest.mark.parametrize(("shard", "block"), [(40, 16), (200, 1000)])
def test_trees_lose_no_link(spark, shard, block):
    """Random prints, chains of near ones, a dense ball and a quarter value that many share."""
    rng = np.random.default_rng(shard)
    prints = list(rng.integers(0, 2**63, 500, dtype=np.uint64))
    for p in prints[:60]:
        for _ in range(5):
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                p ^= np.uint64(1) << np.uint64(b)
            prints.append(p)
    centre = prints[0]
    prints += [centre ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(0, 64, 3) for b in range(a + 1, 64, 5)]
    prints += [np.uint64(0xBEEF) | (x << np.uint64(16)) for x in rng.integers(0, 2**47, 300, dtype=np.uint64)]
    prints = np.unique(np.array(prints, np.uint64))
    order = rng.permutation(len(prints))
    prints = prints[order]
    rows = [(p, i) for p, i in zip(prints.view(np.int64).tolist(), range(len(prints)), strict=True)]
    edges = simhash.linked(spark.createDataFrame(rows, "fp long, rep long"), shard=shard, block=block).collect()
    label = simhash.merged(np.arange(len(prints)), np.array([e["a"] for e in edges]), np.array([e["b"] for e in edges]))
    assert label.tolist() == groups(prints)


def test_tree_visits_every_ball():
    rng = np.random.default_rng(5)
    weight = np.bincount(rng.integers(0, 1 << 16, 3000), minlength=1 << 16)
    home, visitors = simhash.grow(weight, 1, 100)
    seen = {(int(v), at) for at, who in visitors for v in who}
    held = np.flatnonzero(weight)
    assert (home[held] >= 0).all() and np.bincount(home[held], weight[held]).max() <= 100
    for v in held[:400]:
        for w in held[np.bitwise_count(held ^ v) <= 1]:
            assert home[v] == home[w] or (int(v), int(home[w])) in seen


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.near_fingerprints(odd).collect()
    assert len(rows) == 12 and all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert by[1, zero] == by[2, zero] == by[3, zero] == 1 and by[None, zero] is None
    assert by[6, f"{print_of(SOME):016x}"] == 5
    assert by[7, f"{print_of('two words'):016x}"] == by[7, f"{print_of('other text'):016x}"] == 7
    assert simhash.near_fingerprints(empty).count() == 0
    # an id that stands for two texts joins their groups
    bridge = spark.createDataFrame([(1, "left side text"), (2, "left side text"), (2, "right side text"), (3, "right side text")], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_fingerprints(bridge).collect()} == {1}


def test_hot_fingerprint_is_whole(spark):
    rows = [(i, "one text for all of them") for i in range(1, 3000)] + [(i, f"text number {i} of its own kind") for i in range(3000, 3400)]
    got = simhash.near_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["doc_id"] < 3000} == {1}


# texts that share a benchmark id, and notices that are only their key phrase


def test_items_that_share_an_id_or_have_none_are_found(spark):
    from chronoflux.llm import decontaminate

    long, short, lone = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 120), ("b", 9), ("c", 11)))
    items = spark.createDataFrame([(1, long), (1, short), (None, lone), (2, lone)], "item_id long, text string")
    made = spark.createDataFrame([(10, f"x y z {short} x y z"), (11, f"so {lone} it goes"), (12, f"u {long} v"), (13, "none of them at all here")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item_shingles"]) for r in decontaminate.find_items(made, items).collect()}
    assert got == {(10, 1, 5), (11, None, 7), (11, 2, 7), (12, 1, 116)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(made, items).collect()] == [13]


def test_a_verified_key_phrase_is_enough(spark):
    from chronoflux.llm import licenses

    rows = [(1, "licensed under the Mozilla Public License, v. 2.0"), (2, "Permission is hereby granted, free of charge"), (3, "released into the public domain"), (4, "a public domain release")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == [["mpl-2"], ["mit"], ["unlicense"], []]
    assert all(0 < got[i]["score"] < 0.5 for i in (1, 2, 3))


# language mixtures and long repeated texts against brute force


def test_mixtures_match_a_slow_fit_and_all_subsets(docs, texts):
    """Proportions of a much longer EM, and the best of all sets of languages by penalised likelihood."""
    from itertools import combinations

    from chronoflux.llm import language

    names, p = language.train(docs)
    ids = [i for i in sorted(texts) if len(language.cells_of((texts[i] or "").encode())) > 20][:60]
    made = [texts[i].encode() for i in ids] + [(texts[i][:700] + " " + texts[j][:900]).encode() for i, j in zip(ids[:20], ids[20:40], strict=True)]
    several = 0
    for raw in made:
        cells = language.cells_of(raw)
        count = np.bincount(cells, minlength=language.CELLS)
        at = np.flatnonzero(count)
        c, q = count[at].astype(float), p[:, at]
        share = np.full(len(names), 1 / len(names))
        for _ in range(3000):
            each = share[:, None] * q
            share = each @ (c / each.sum(0)) / c.sum()
        got, chosen = language.mixture(cells, p)
        assert np.abs(got - share).max() < 0.02 and int(np.argmax(got)) == int(np.argmax(share))
        sets = {s: language._fit(q[list(s)], c, 500)[1] - 2.0 * np.log(c.sum()) * (len(s) - 1) for k in range(1, len(names) + 1) for s in combinations(range(len(names)), k)}
        best = max(sets.values())
        assert sets[tuple(sorted(chosen))] > best - 0.05 * np.log(c.sum())
        several += len(chosen) > 1
    assert several >= 5


def test_repeats_across_the_border_of_a_piece(spark):
    """Texts longer than one piece of the substring sort, with repeats on and beside its border."""
    from chronoflux.llm import substrings

    rng = random.Random(13)
    letters = "abcdefghij klmno"
    text = "".join(rng.choices(letters, k=substrings.PIECE + 3000))
    part = text[substrings.PIECE - 400 : substrings.PIECE + 300]
    other = "".join(rng.choices(letters, k=1500)) + part[:450] + "".join(rng.choices(letters, k=900)) + part[250:]
    again = text[:500] + text[500:] + text[substrings.PIECE - 150 : substrings.PIECE + 150]
    rows = [(1, text), (2, other), (3, again[-2000:])]
    seen = Counter()
    for _, t in rows:
        b = t.encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    got = {r["doc_id"]: r for r in substrings.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i
    assert got[1]["n_removed"] > 900 and got[3]["n_removed"] > 400
