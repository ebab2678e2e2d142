"""Text operators against brute force, and their defined cases on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoflux.llm import decontaminate, language, licenses, mixing, neardup, quality, substrings, token_files, tokens, toxicity
from chronoflux.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, row string, kept string, n_words string, body string, score string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, clashing names."""
    some = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, LONG, "en", "b"), (5, some, "en", "b"), (5, some, "en", "b"),
            (6, some, "de", None), (7, "two words", "de", "c"), (7, "other text", None, "c"), (None, some, "en", "a"), (None, None, None, None), (8, "Released under the MIT License. mit", "en", "c")]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words_of(text):
    return (text or "").encode().split()


# quality rules


def test_counts_match_brute_force(texts):
    for text in [*texts.values(), LONG, "a b c a b c", "x\n\nx\nx y", ""]:
        w = words_of(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        got = quality.counts_of(text.encode())
        assert got[:5] == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_sketches_merge_exactly(docs):
    m = quality.measure(docs)
    whole = {tuple(r) for r in quality.sketches(m).collect()}
    halves = [quality.sketches(quality.measure(docs.where(F.col("doc_id") % 2 == i))) for i in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy(*quality.KEYS, "measure", "cell").agg(F.sum("n"))
    assert {tuple(r) for r in merged.collect()} == whole


def test_rules_reject_junk_and_keep_prose(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice(["stone", "river", "of", "the", "and", "light", "small", "house"]) + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(150)]
    junk = [" ".join(w + "$$$" for w in p.split()) for p in prose[:5]]
    rows = [(i, t, "en", "s") for i, t in enumerate(prose + junk)]
    got = as_dict(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("row.doc_id", "kept", "base_failed"))
    assert all(got[i]["kept"] for i in range(150)) and not any(got[i]["kept"] for i in range(150, 155))


def test_quality_odd_rows(odd, empty):
    rows = quality.judge(odd).select("row.*", F.col("base_failed").alias("failed")).collect()
    assert len(rows) == 12 and all(r["failed"] for r in rows if not words_of(r["text"]))
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judge(empty).count() == 0


# language


def test_language_held_out_accuracy(docs):
    model = language.train(docs.where("doc_id % 3 <> 1"))
    got = language.predict(docs.where("doc_id % 3 = 1"), model).select("row.lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_language_set_of_a_mixed_text(docs, texts, spark):
    model = language.train(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 2500").collect()}
    mixed = spark.createDataFrame([(1, by["en"][:2000] + " " + by["de"][:2000]), (2, by["en"])], "doc_id long, text string")
    got = as_dict(language.predict(mixed, model).select("row.doc_id", "mixture"))
    assert {m["lang"] for m in got[1]["mixture"]} == {"en", "de"} and [m["lang"] for m in got[2]["mixture"]] == ["en"]
    assert all(0.3 < m["share"] < 0.7 for m in got[1]["mixture"])


def test_language_odd_rows(odd, empty):
    model = language.train(odd)
    rows = language.predict(odd, model).select("row.text", "lang_pred", F.col("score").alias("s")).collect()
    assert len(rows) == 12 and all((r["lang_pred"] == "und") == (not (r["text"] or "").strip()) and 0 <= r["s"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language.predict(odd, language.train(empty)).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


# toxicity


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    terms = [f"t{i}".encode() for i in range(40)]
    made = [(i, int(rng.integers(2)), Counter({terms[j]: int(rng.integers(1, 4)) for j in rng.integers(0, 40, 5)})) for i in range(500)]
    index = toxicity.build_index(made, terms, rng.integers(1, 300, 40).astype(float), 1000)
    dense = np.zeros((500, 40))
    for i, (_, _, c) in enumerate(made):
        at, w = index.vector(c)
        dense[i, at] = w
    for q in range(0, 500, 25):
        at, w = index.vector(made[q][2])
        i, s = index.nearest(at, w, 10)
        cosine = np.round(dense @ dense[q], 12)
        assert list(i) == [j for j in np.lexsort((np.arange(500), -cosine))[:10] if cosine[j] > 0] and np.allclose(s, cosine[i])


def test_toxicity_separates_and_handles_odd_rows(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join([*(f"w{rng.randint(0, 60)}" for _ in range(40)), *(["scum", "idiot"][: 1 + i % 2] if i % 4 == 0 else [])])) for i in range(240)]
    docs_ = spark.createDataFrame(rows, "doc_id long, body string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, label int")
    model = toxicity.fit(docs_, labels)
    got = as_dict(toxicity.score(docs_, model, text="body").select("row.doc_id", "score", "evidence"))
    assert all((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in range(160, 240)) and got[160]["evidence"][0]["label"] == 1
    scored = toxicity.score(odd, model).select("score").collect()
    assert len(scored) == 12 and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(docs_, labels.where("label = 1"))).select("score").collect()} == {1.0}


# token counts


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_match_the_library(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(2)
    bits = [" ", "  ", "a", "he", "\n", "<s>", "▁", "é", "日", ".", "1", "　", "\x00"]
    made = {10_000 + i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for i in range(400)}
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    got = as_dict(tokens.count_tokens(both, model_path(), block_bytes=50_000))
    for i, t in (texts | made).items():
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len(t.encode()), len(sp.encode(t)))


def test_token_counts_odd_rows(odd, empty):
    got = tokens.count_tokens(odd, model_path()).collect()
    assert len(got) == 12 and sorted(r["n_tokens"] for r in got)[:3] == [0, 0, 0]
    assert tokens.count_tokens(empty, model_path()).count() == 0


# mixing


def test_mix_meets_targets(docs, texts):
    rows = mixing.mix(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(words_of(texts[r["doc_id"]])) and 0 <= sum(r["taken"]) <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += sum(r["taken"])
        target[r["source"]] = r["target"]
    left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    total, want = 1.5 * sum(size.values()), {}
    while left:
        each = {s: total * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if each[s] > 2 * size[s]]
        for s in over or list(left):
            want[s] = 2 * size[s] if over else each[s]
            total -= want[s]
            del left[s]
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) < 0.02 * want[s]
    assert sorted(map(tuple, ((r["doc_id"], sum(r["taken"])) for r in rows))) == sorted((r["doc_id"], sum(r["taken"])) for r in mixing.mix(docs).collect())


def test_schedule_is_even_at_every_prefix(spark, docs):
    plan = mixing.mix(docs).select("source", "target").distinct().collect()
    sized = docs.select("source", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("size"))
    got = mixing.slots(spark, mixing.source_targets(sized, (3, 1, 2), 1.5, 2.0)).where("slot < 2000").groupBy("source").count().collect()
    total = sum(r["target"] for r in plan)
    share = {r["source"]: r["target"] / total for r in plan}
    assert all(abs(r["count"] / 2000 - share[r["source"]]) < 0.005 for r in got)


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 12 and all(sum(r["taken"]) <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0


def test_mix_gives_small_sources_their_target_beside_a_hot_one(spark):
    hot = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 20000)").alias("text"), F.lit("hot").alias("source"))
    small = [(1000 + i, "w " * n, source) for i, (n, source) in enumerate([(100, "a"), (100, "b"), (130, None), (100, "z"), (40, "many"), (70, "many"), (90, "many")])]
    docs_ = hot.unionByName(spark.createDataFrame(small, "doc_id long, text string, source string"))
    taken, target = Counter(), {}
    for r in mixing.mix(docs_).collect():
        assert sum(r["taken"]) <= 2 * r["size"]
        taken[r["source"]] += sum(r["taken"])
        target[r["source"]] = r["target"]
    assert len(target) == 6 and all(abs(taken[s] - target[s]) <= (20_000 if s == "hot" else 1) for s in target)
    kept = {r["doc_id"] for r in mixing.mixed_documents(docs_).where("doc_id >= 1000").select("doc_id").collect()}
    assert kept == {r[0] for r in small}


# near duplicates


def shingle_set(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_components(texts, percent=85):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    made = {}
    for family in range(6):  # chains of small changes: many members are no link of each other
        base = [f"v{rng.randint(0, 9999)}" for _ in range(120)]
        for _ in range(45):
            made[len(made) * 3 + 1] = " ".join(base)
            base[rng.randrange(120)] = f"u{rng.randint(0, 9999)}"
    made |= {1000 + i: made[1] for i in range(30)} | {2000: "Two Words", 2001: "two  words", 2002: ""}
    got = as_dict(neardup.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string")))
    for i, (n, c) in brute_components(made).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i)


def test_near_duplicates_odd_rows(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 12 and all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = neardup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 8]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one_of_each(empty).count() == 0


# repeated substrings


def test_repeated_substrings_match_brute_force(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(900))
    made = {i: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 700))) for i in range(60)}
    for i in range(0, 60, 4):
        lo = rng.randint(0, 600)
        made[i] = made[i][: rng.randint(0, 300)] + passage[lo : lo + rng.randint(150, 400)] + "é" + made[i][:100]
    made |= {100: "z" * 700, 101: "xy" * 99 + "x", 102: "xy" * 100, 103: passage, 104: passage, 105: "q" * 199, 106: "q" * 199}
    raw = {i: t.encode() for i, t in made.items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    got = as_dict(substrings.repeated_substrings(spark.createDataFrame(list(made.items()), "doc_id long, text string")))
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want = (len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
        assert tuple(got[i])[1:5] == want, i


def test_multikey_sort_orders_rows():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 5, 30_000), rng.integers(0, 1000, 30_000)]
    order = substrings.multikey_sort(keys, cutoff=64)
    assert np.array_equal(np.sort(order), np.arange(30_000)) and np.array_equal(np.stack(keys)[:, order], np.stack(keys)[:, np.lexsort(keys[::-1])])


def test_repeated_substrings_odd_rows(odd, empty):
    rows = substrings.repeated_substrings(odd).collect()
    assert len(rows) == 12 and all(r["n_removed"] == (r["n_bytes"] if r["doc_id"] in (5, 6) else 0) for r in rows if r["doc_id"] is not None)
    assert substrings.repeated_substrings(empty).count() == 0


# decontamination


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    items = {i: " ".join(f"k{rng.randint(0, 999)}" for _ in range(rng.choice([3, 6, 9, 20, 60]))) for i in range(40)}
    docs_ = {}
    for i in range(80):
        w = [f"n{rng.randint(0, 999)}" for _ in range(rng.randint(5, 400))]
        leak = items[i % 40].split()
        for _ in range(i % 4):
            leak[rng.randrange(len(leak))] = "changed"
        docs_[i] = " ".join([*w, *leak, *w[:3]]).upper() if i % 5 else items[i % 40]
    found = decontaminate.find_items(spark.createDataFrame(list(docs_.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["n_item_shingles"], r["n_found"]) for r in found.collect()}
    want = {}
    for d, t in docs_.items():
        for i, x in items.items():
            s = shingle_set(x)
            if 100 * len(s & shingle_set(t)) >= 80 * len(s):
                want[d, i] = (len(s), len(s & shingle_set(t)))
    assert got == want and len(want) > 20


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta", "x"), (2, None, "x"), (3, "", "x"), (None, "theta iota kappa alpha beta gamma", "x")], "item_id long, text string, body string")
    assert {r["doc_id"] for r in decontaminate.find_items(odd, items).collect()} == {5, 6, None}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontaminate.find_items(empty, items).count() == 0 and decontaminate.decontaminate(odd, items.limit(0)).count() == 12


# licence notices


def test_base_places_match_brute_force(spark):
    rng = random.Random(8)
    bits = ["under", "the", "mit", "license", "MIT-License", "apache", "version", "2", "cc", "by", "nc", "CC BY-NC", "é"]
    made = {i: " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for i in range(300)} | {900: "cc by nc by cc by nc cc by nc"}
    got = as_dict(licenses.scan(spark.createDataFrame(list(made.items()), "doc_id long, text string")))
    for i, t in made.items():
        w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
        at = [(k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == (len(w), len(at), min(places, default=None), max(places, default=None), sorted({x for _, x in at}))


def test_notices_and_odd_rows(spark, odd, empty):
    made = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3."), (2, "the GNU General Public License version three"), (3, "This work: GNU General Public License, version 3")], "doc_id long, text string")
    got = as_dict(licenses.scan(made))
    assert got[1]["labels"] == ["gpl-3"] and got[1]["score"] == 1.0 and got[2]["labels"] == [] and got[3]["labels"] == ["gpl-3"] and got[3]["score"] < 1
    rows = licenses.scan(odd).collect()
    assert len(rows) == 12 and [r["base_labels"] for r in rows if r["doc_id"] == 8] == [["mit"]]
    assert licenses.scan(empty).count() == 0


# token files


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(5)
    count = (1e6 / np.arange(1, 400) ** 2 + rng.integers(1, 5, 399)).astype(np.int64)
    free, tight = token_files.code_lengths(count, 40), token_files.code_lengths(count, 10)
    p = count / count.sum()
    assert tight.max() <= 10 and sum(2.0**-tight) <= 1 and sum(2.0**-free) <= 1
    assert -(p @ np.log2(p)) <= p @ free <= -(p @ np.log2(p)) + 1 and p @ free <= p @ tight
    book = token_files.Codebook(np.arange(399) * 7, tight)
    ids = rng.choice(np.arange(399) * 7, 5000, p=p)
    bits, check = book.encode(ids)
    assert np.array_equal(book.decode(bits, check, len(ids)), ids)


def test_encoder_matches_the_library(monkeypatch):
    """Spaces of all kinds, special strings and long parts, with a memory that forgets."""
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder, draw = token_files.Encoder(tokenizer_path()), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "B", "\u00e9", "1", ".", "'s", "<|endoftext|>", "\u3000", "word", "\x1c", "\xa0", "\u65e5\u672c", " x", " y", "z" * 70]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(4000)]
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.model.encode_batch(some, add_special_tokens=False)]
        assert encoder.encode(pa.array(some)) == want
    assert encoder.encode(pa.array([], pa.string())) == []


def test_known_words_are_encoded_once_for_a_worker(monkeypatch):
    """The next task asks the library for new words only; rare and long words do not stay."""
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    encoder, asked = token_files.Encoder(tokenizer_path()), []
    plain = encoder._after_space
    monkeypatch.setattr(encoder, "_after_space", lambda words: asked.append(words.to_pylist()) or plain(words))
    texts = pa.array(["a " + " ".join(f"w{i}" for i in range(12)) + " tail\n x" + " " + "y" * 80, "b w1 w2"])
    want = encoder.encode(texts)
    encoder.forget()
    assert encoder.encode(texts) == want and [len(x) for x in asked] == [15, 1] and asked[1] == ["y" * 80]
    encoder.encode(pa.array(["c " + " ".join(f"v{i}" for i in range(30))]))
    assert sorted(encoder.spaced.words.to_pylist()) == sorted([f"w{i}" for i in range(12)] + ["tail\n", "x"])
    assert encoder.encode(texts) == want == [np.array(e.ids, "<u4").tobytes() for e in encoder.model.encode_batch(texts.to_pylist(), add_special_tokens=False)]


def library_ids(model, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]


def test_words_are_known_without_marks_and_line_feeds(monkeypatch):
    """A word met with marks or a line feed beside it is asked for once, without them."""
    encoder, asked, rows = token_files.Encoder(tokenizer_path()), [], []
    spaced, joined, coded = encoder._after_space, encoder._after_cut, encoder._coded
    monkeypatch.setattr(encoder, "_after_space", lambda words: asked.extend(words.to_pylist()) or spaced(words))
    monkeypatch.setattr(encoder, "_after_cut", lambda parts: asked.extend(parts.to_pylist()) or joined(parts))
    monkeypatch.setattr(encoder, "_coded", lambda r, letters: rows.append((r, letters)) or coded(r, letters))
    texts = ["a leau\u00e8 leau\u00e8. leau\u00e8.\nNext (leau\u00e8, \u65e5\u672c. don't it's! x\n\ny", "b leau\u00e8; leau\u00e8\nNext"]
    assert encoder.encode(pa.array(texts)) == library_ids(encoder.model, texts)
    assert sorted(asked) == sorted(["leau\u00e8", "leau\u00e8", "Next", ".", ",", ";", "\n", "(", "\u65e5\u672c", "don't", "it's", "!", "x\n\ny"])
    assert [(sorted(r[0].split()), letters) for r, letters in rows] == [(["leau\u00e8", "\u65e5\u672c"], True), (sorted(["don't", "it's", "x", "y", "("]), False), (["Next", "leau\u00e8"], True)]


def test_cut_words_match_the_library():
    """Letters, numbers, marks, contractions and white space of many kinds beside each other."""
    encoder, draw = token_files.Encoder(tokenizer_path()), random.Random(4)
    bits = ["leau", "Word", "\u00e8", "e\u0301", "\u65e5", "\U0001d4d0", "\U00031350", "\u00d7", "\u00bd", "\u0663", "7", ".", ",", "!", "'", "'s", "'ll", "(", ")", "<|endoftext|>", "_", "\u2026", "\u2019", "\n", "\r\n", "\n\n", "\t", "\x85", "\xa0", "\x1c", "\x00", " ", " ", " ", "  "]
    for _ in range(8):
        texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(600)]
        assert encoder.encode(pa.array(texts)) == library_ids(encoder.model, texts)


def byte_tokenizer(path, merges=(), added=(), **kinds):
    """A byte-level file with a few merges."""
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    pieces = [*map(chr, token_files.byte_characters().tolist()), *(a + b for a, b in merges)]
    model = Tokenizer(models.BPE(vocab={x: i for i, x in enumerate(pieces)}, merges=list(merges), **kinds))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    model.add_tokens([AddedToken(x, normalized=False) for x in added])
    model.save(str(path))
    return str(path)


def test_words_are_coded_as_if_alone_with_any_merges(tmp_path):
    """Merges over a word's end, and added strings of letters or marks, do not reach into rows of words."""
    texts = ["x aa ba ab. foo a.b\naa, xa.bx foo.foo", "y a b a\nb a"]
    for i, (merges, added) in enumerate([([("a", "\u0120"), ("a", "\u010a"), ("a", "b")], []), ([("f", "o"), ("fo", "o")], ["foo"]), ([("a", "a")], ["a.b"])]):
        encoder = token_files.Encoder(byte_tokenizer(tmp_path / f"{i}.json", merges, added))
        assert encoder.cut and (encoder.bpe is None) == ("foo" in added)
        assert encoder.encode(pa.array(texts)) == library_ids(encoder.model, texts)
    whole = token_files.Encoder(byte_tokenizer(tmp_path / "whole.json", [("a", "b")], ignore_merges=True))
    assert whole.bpe is None and whole.encode(pa.array(texts)) == library_ids(whole.model, texts)


def test_planes_of_large_numbers():
    ids = np.array([0, 1, 255, 256, 65_535, 1 << 16, 1 << 24, (1 << 32) - 1], "<u4")
    for some in (ids, ids[:3], ids[:0]):
        assert len(token_files.planes(some)) == 4 * len(some) and np.array_equal(token_files.numbers(token_files.planes(some)), some)


def test_long_codes_cross_words():
    bits = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 21])
    book, ids = token_files.Codebook(np.arange(22), bits), np.random.default_rng(3).integers(0, 22, 1000)
    plain = "".join(f"{int(book.first[i]) >> (21 - bits[i]):0{bits[i]}b}" for i in ids)
    raw, check = book.encode(ids)
    assert "".join(f"{b:08b}" for b in raw)[: len(plain)] == plain and check.sum() == len(plain)
    assert np.array_equal(book.decode(raw, check, 1000), ids)


def test_runs_of_texts_cover_all():
    texts = pa.array(["a" * n for n in (3, 0, 9, 30, 1, 1)])
    assert list(token_files.runs_of_texts(texts, 10)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(token_files.runs_of_texts(texts.slice(0, 0), 10)) == []


def test_token_files_round_trip(spark, docs, texts, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    made = {9000: "a<|endoftext|> b", 9001: "\n  x \t\t y  ", 9002: "", 9003: "\x1c!　é"}
    both = docs.select("doc_id", "text").union(spark.createDataFrame(list(made.items()), "doc_id long, text string"))
    got, at = as_dict(token_files.digest(both, tokenizer_path())), 0
    for i, x in sorted((texts | made).items()):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = token_files.digest(odd, tokenizer_path()).collect()
    assert len(rows) == 12 and sorted(r["n_tokens"] for r in rows)[:3] == [1, 1, 1]
    assert token_files.digest(empty, tokenizer_path()).count() == 0


# pipeline


def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline as cp

    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "token_output"]
    good = steps["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in quality.op1_quality(spark, SF).where("kept").collect()}
    assert {r["doc_id"] for r in good.select("doc_id").collect()} == kept
    left = {i: texts[i] for i in kept}
    one = {r["doc_id"] for r in steps["near_dedup"](spark, docs.where(F.col("doc_id").isin(sorted(kept))), SF).collect()}
    assert one == {i for i, (_, c) in brute_components(left).items() if c == i}
    leaks = {r["doc_id"] for r in decontaminate.op8_decontamination(spark, SF).collect()}
    assert {r["doc_id"] for r in steps["decontamination"](spark, docs, SF).collect()} == set(texts) - leaks
    out = cp.run(spark, SF).collect()
    assert out and max(Counter(r["doc_id"] for r in out).values()) <= 2 and {r["doc_id"] for r in out} <= one - leaks
