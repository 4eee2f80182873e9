"""Substring dedup, suffix dedup, tokenizers and quality counts against brute force, on texts with hard cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from perilgrid.llm import bpe, exchange, phrases, quality, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, extra int, data string"


def corpus(seed=1):
    """Copies, near copies, shared passages, periodic and very long texts, blanks, empty texts and nulls."""
    rng = random.Random(seed)
    words = [bytes(rng.choice(b"abcdeXY") for _ in range(rng.randint(1, 7))).decode() for _ in range(300)] + ["é", "中文", "a\u00a0b", "#$%"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", " \x0b"]) for _ in range(n))
    texts = [text(rng.randint(0, 120)) for _ in range(25)]
    texts += [texts[3], texts[3], texts[4].strip(), texts[5][:200] + " changed " + texts[5][200:]]
    passage = text(70)
    texts += [text(30) + passage + text(20) for _ in range(6)] + [passage[:-9], passage + passage]
    texts += ["a" * 3000, "ab" * 900, "a" * 150, "x " * 400, ("q w e r t " * 40)[:-1], "", None, " \n\t", text(4000), texts[10] * 3, text(52), "é" * 300, "short"]
    rng.shuffle(texts)
    return texts


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], KIND).repartition(5)


def small_batches(monkeypatch, n):
    monkeypatch.setattr(exchange, "BATCH_BYTES", n)
    monkeypatch.setattr(exchange, "ROW_BYTES", 0)


def test_sizes_follow_the_corpus():
    small, large, huge = exchange.Scale(10**8), exchange.Scale(10**12), exchange.Scale(10**14)
    assert small.batch == exchange.BATCH_BYTES and large.batch < 60 << 20 and huge.batch < 500 << 20
    rows = [x.size / x.batch * x.buckets for x in (large, huge)]
    assert rows[1] < 110 * rows[0] and huge.tasks == exchange.TASKS


def brute_words(rows, window):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: exchange.LAST if i is None else i
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("window", "batch"), [(50, 8 << 20), (50, 3000), (8, 4000)])
def test_substrings(spark, monkeypatch, window, batch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    small_batches(monkeypatch, batch)
    texts = corpus()
    ids = list(range(len(texts)))
    ids[3], ids[7] = None, ids[8]  # a null and a repeated doc_id
    got = [tuple(r) for r in substrings.drop_repeats(spark, frame(spark, texts, ids), window).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_words(list(zip(ids, texts, strict=True)), window), key=key)
    assert sum(r[2] for r in got) > 100


def test_substrings_of_nothing(spark):
    assert substrings.drop_repeats(spark, frame(spark, ["a"]).limit(0)).count() == 0
    assert phrases.drop_repeated_bytes(spark, frame(spark, ["a"]).limit(0)).count() == 0


def brute_bytes(rows):
    first, out = {}, []
    rank = lambda i: exchange.LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            first[b[s : s + 100]] = min(rank(i), first.get(b[s : s + 100], exchange.LAST))
    for i, t in rows:
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for s in range(len(b) - 99):
            if b[s : s + 100] in own or first[b[s : s + 100]] < rank(i):
                gone[s : s + 100] = b"\1" * 100
            own.add(b[s : s + 100])
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("seed", "batch"), [(1, 8 << 20), (2, 3000), (3, 500), (4, 300), (5, 1000), (6, 2000)])
def test_repeated_bytes(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    small_batches(monkeypatch, batch)
    texts = corpus(seed)
    ids = list(range(len(texts)))
    ids[3], ids[4], ids[7], ids[12] = None, None, ids[8], ids[13]  # null and repeated doc_ids
    got = [(*r[:4], bytes(r[4])) for r in phrases.drop_repeated_bytes(spark, frame(spark, texts, ids)).collect()]
    assert sorted(got, key=str) == sorted(brute_bytes(list(zip(ids, texts, strict=True))), key=str)


def test_contexts_whose_hashes_agree_in_16_bits(spark, monkeypatch):
    small_batches(monkeypatch, 500)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(110)
    texts, seen, pairs = [], {}, []
    for _ in range(4000):
        texts.append(letters(250) + passage + letters(250))
        parse = phrases.Parse.of(exchange.Batch([0], [False], [texts[-1].encode()]))
        for key, one in zip(parse.key.tolist(), parse.one.tolist(), strict=True):
            other = seen.setdefault((key, one >> 48), (one, texts[-1]))
            if other[0] != one:
                pairs.append((other[1], texts[-1]))
    assert pairs
    for a, b in pairs[:3]:
        rows = [(0, a), (1, b)]
        got = [(*r[:4], bytes(r[4])) for r in phrases.drop_repeated_bytes(spark, frame(spark, [a, b])).collect()]
        assert sorted(got) == sorted(brute_bytes(rows)) and sum(r[2] for r in got) >= len(passage)


def test_triggers_depend_on_nearby_bytes():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, 400, np.uint8)
    b = np.r_[rng.integers(0, 4, 77, np.uint8), a[100:300], rng.integers(0, 4, 50, np.uint8)]
    reach = phrases.GAP - 1
    inside = lambda t, low: {int(x) for x in t - low if reach <= x <= 200 - reach - phrases.GRAM}
    assert inside(phrases.triggers(a), 100) == inside(phrases.triggers(b), 77)
    t = phrases.triggers(a)
    assert np.diff(t).max() <= phrases.GAP


LONG = ["x" * 5000, "ab" * 3000, "é" * 2000, " " * 3000 + "a", "\n \t" * 900, "abc'sdef" * 400, "中文字" * 900, "1234567890" * 300, "!?#" * 700, "aé中 " * 300]
LONG += ["<|endoftext|>" * 40, "a<|endoftext|>b" * 30 + "z" * 900, "<|startoftext|>x", "e\u0301" * 700, "ΑΣ ΣΑΣ", "İI", "𝒳" * 500, "\u200b" * 400, "a\u0085b", "", " ", "'s't're"]


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path(name))


@pytest.mark.parametrize(("leaf", "window"), [(256, 8), (16, 1)])
def test_tree_encoding(leaf, window):
    tree, plain = bpe.TreeEncoder(bpe.vocabulary_path(bpe.VOCABULARY), leaf, window), tokenizer(bpe.VOCABULARY)
    rng = random.Random(4)
    mixed = ["".join(rng.choice("thenatioSr'é中0 \n!") for _ in range(rng.randint(1, 900))) for _ in range(150)]
    for t in [*LONG, *(x or "" for x in corpus()), *mixed]:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert tree.encode(t) == ids
        assert tree.decode(ids) == plain.decode(ids, skip_special_tokens=False)


def test_common_characters_are_cut_alike():
    tree, plain = bpe.TreeEncoder(bpe.vocabulary_path(bpe.VOCABULARY)), tokenizer(bpe.VOCABULARY)
    for c in map(chr, [*range(0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]):
        t = f"a{c}b {c} 1{c}{c}  {c}s'{c}"
        assert tree.encode(t) == plain.encode(t, add_special_tokens=False).ids, hex(ord(c))


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 512), (200, 40), (60, 34)])
def test_chunked_counts(chunk, overlap):
    count, plain = tokens.ChunkCounter(bpe.vocabulary_path(tokens.VOCABULARY), chunk, overlap), tokenizer(tokens.VOCABULARY)
    rng = random.Random(5)
    mixed = ["".join(rng.choice("thenatioSr'é中0 \n!\u00a0\x1c\u0301Σ") for _ in range(rng.randint(1, 700))) for _ in range(150)]
    for t in [*LONG, *(x or "" for x in corpus()), *mixed]:
        assert count.count(t) == len(plain.encode(t, add_special_tokens=False).ids), t[:40]


def test_codec_on_frames(spark):
    texts = ["ab cd", None, "", "x" * 2000]
    docs = frame(spark, texts)
    encoded = bpe.encode_texts(spark, docs)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(spark, encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for r in bpe.digest_texts(spark, docs).collect():
        assert r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[r["doc_id"]])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.digest_texts(spark, docs.limit(0)).count() == 0


def test_counts_on_frames(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.count_tokens(spark, frame(spark, [None, "", "é", "a b " * 1025])).collect()}
    assert got == {0: (0, 0, False), 1: (0, 0, False), 2: (2, 1, False), 3: (4100, 2050, True)}


def brute_quality(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else {x for x in set(windows) if windows.count(x) > 1}
    cover = {j for i, x in enumerate(windows) if x in again for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_counts(spark):
    texts = [t for t in corpus() if len(t or "") < 9000]
    got = quality.score(spark, frame(spark, texts), None).collect()
    assert sorted(tuple(r)[:7] for r in got) == [(i, *brute_quality(t)) for i, t in enumerate(texts)]
    assert all(r["kept"] != r["base_failed"] for r in got)  # without a model every text passes


def plain_slots(text):
    """The frequencies of a text's hashed n-grams, one at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 31
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 32

    w = [xxhash.xxh64_intdigest(x, 42) for x in text.encode().split()]
    words = [h % quality.WORD_SLOTS for h in w] + [mixed((a * 3 + b) & mask) % quality.WORD_SLOTS for a, b in zip(w, w[1:])]
    c = [ord(x) for x in text]
    grams = []
    for k in (3, 4):
        for i in range(len(c) - k + 1):
            code = 0
            for x in c[i : i + k]:
                code = (code * 0x85EBCA6B + x) % 2**32
            grams.append(quality.WORD_SLOTS + (code * 2654435761 % 2**32 >> 19))
    out = {}
    for part in (words, grams):
        for s in part:
            out[s] = out.get(s, 0) + 1 / len(part)
    return out


def test_features_against_plain():
    texts = ["", "one", "Ein schöner Satz, наш текст 中文字符在这里 and more", "ab", "a b a b a b", "x" * 9]
    got = quality.Features([t.encode() for t in texts], quality.WordHashes()).vectors()
    weights = np.random.default_rng(1).normal(size=quality.SLOTS).astype(np.float32)
    scores = quality.Features([t.encode() for t in texts], quality.WordHashes()).scores(weights)
    for t, (slots, share), score in zip(texts, got, scores):
        want = plain_slots(t)
        assert slots.tolist() == sorted(want) and share == pytest.approx([want[s] for s in sorted(want)], rel=1e-5)
        assert score == pytest.approx(sum(float(weights[s]) * v for s, v in want.items()), abs=1e-5)


def test_fit_and_calibration_against_plain():
    rng = np.random.default_rng(2)
    n, k, ridge = 400, 5, 1e-2
    raw = rng.exponential(size=(n, k))
    y = (rng.random(n) < 1 / (1 + np.exp(-((raw - 1) @ rng.normal(size=k) * 2)))).astype(np.float32)
    held = np.arange(n) % 4 == 0
    head = quality.fit_head(np.c_[raw, np.ones(n)].astype(np.float32), y, held, ridge=ridge, steps=3000)
    # the same loss by plain gradient descent in double precision
    x = np.c_[raw, np.ones(n)]
    scale = np.r_[1 / np.sqrt(raw[~held].mean(0) + 1e-4), 1.0]
    share = y[~held].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * ~held
    w = np.zeros(k + 1)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x * scale) @ w))
        w -= 0.2 * ((weight * (p - y) / weight.sum()) @ (x * scale) + ridge * w)
    assert head.weights == pytest.approx((w * scale)[:-1], abs=0.02) and head.bias == pytest.approx(w[-1], abs=0.02)
    # calibration keeps the order and is as good as the best line that a search finds
    score = raw @ head.weights
    p = head.probability(score)
    assert np.all(np.diff(p[np.argsort(score)]) >= 0)
    s = (score + head.bias)[held]

    def loss(a, b):
        z = a * s + b
        return float(np.mean(np.logaddexp(0, z) - z * y[held]))

    best = min(loss(a * head.slope, b) for a in np.linspace(0.05, 4, 80) for b in np.linspace(-3, 3, 61))
    assert loss(head.slope, head.shift) <= best + 0.01 and abs(p[held].mean() - y[held].mean()) < 0.05


def test_quality_model(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(rng.choice(words) + rng.choice(["%%%", "###"]) for _ in range(80)) for _ in range(60)]
    docs = frame(spark, good + bad + [None])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 181) if i % 3], "doc_id long, quality int, toxic int")
    model = quality.train(spark, docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.score(spark, docs, model).collect()}
    held_out = [i for i in range(180) if i % 3 == 0]
    assert sum(kept[i] == (i < 120) for i in held_out) >= 0.95 * len(held_out) and kept[180] is False
    rows = quality.keep_good(spark, docs, model)
    assert rows.columns == docs.columns and {r["doc_id"] for r in rows.collect()} == {i for i, k in kept.items() if k}
    assert quality.train(spark, docs, labels.limit(0)) is None
    assert quality.train(spark, docs, labels.filter("quality = 1")) is None  # one class only
