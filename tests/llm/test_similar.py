"""The pipeline's near-dedup stage against all pairs."""

import random

import numpy as np

import corpus_pipeline
from perilgrid.llm import similar, simhash
from perilgrid.llm.hashing import shingle_hashes
from perilgrid.sources.frozen import Frozen


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def firsts(rows):
    """The smallest doc_id of each component of all pairs."""
    sets = [plain(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[a] = b
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_near_dedup_finds_every_pair_of_similarity_four_fifths(spark):
    rng = random.Random(7)
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for i in range(150):
        words = prose(rng, rng.choice([25, 60, 150, 400]))
        texts.append(" ".join(words))
        changed = list(words)
        for _ in range(1 + len(words) // rng.choice([30, 45, 60, 90])):  # similarities on both sides of 0.8
            changed[rng.randrange(len(words))] = f"x{i}"
        texts.append(" ".join(changed))
    chain = prose(rng, 100)  # a group whose ends are only linked through its middle
    texts += [" ".join(chain[:k] + [f"y{j}" for j in range(100 - k)]) for k in (100, 92, 84, 76)]
    dense = prose(rng, 200)
    texts += [" ".join([*dense[:k], "z", *dense[k + 1 :]]) for k in range(0, 200, 4)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, other int").repartition(7)
    stage = corpus_pipeline.STAGES[2][1]
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    want = firsts(rows)
    assert len(rows) - len(want) > 80
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert stage(spark, docs.limit(0), "").count() == 0


def test_members_of_a_cell_need_many_rounds(spark, monkeypatch):
    """Cells whose members are mostly unlike their smallest one, dealt to many tasks."""
    monkeypatch.setattr(similar, "TOGETHER", 7)
    monkeypatch.setattr(similar, "CENTRES", 9)
    rng = random.Random(8)
    base = prose(rng, 120)
    texts = []
    for g in range(12):  # groups at about 0.6 of each other, and linked inside
        own = list(base)
        for k in range(g % 5, 120, 11):
            own[k] = f"g{g}"
        texts += [" ".join([*own[:k], f"z{k}", *own[k + 1 :]]) for k in rng.sample(range(120), 6)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {similar.set_key(np.unique(shingle_hashes(t.encode(), 5))): i for i, t in rows}
    cells = spark.createDataFrame([(1, bytearray(k)) for k in fps] + [(2, bytearray(k)) for k, i in fps.items() if i % 3], "cell long, fp binary")
    named = spark.createDataFrame([(bytearray(k), texts[i]) for k, i in fps.items()], "fp binary, text string")
    sigs = spark.createDataFrame([(bytearray(k), bytearray(similar.signature(np.unique(shingle_hashes(texts[i].encode(), 5)))[1])) for k, i in fps.items()], "fp binary, sig binary")
    pairs = spark.createDataFrame([], "a binary, b binary")
    roots = similar.verified_roots(cells, pairs, sigs, lambda some: named.join(some, "fp", "left_semi"), 5, Frozen(spark, "rounds"))
    group = {bytes(r["node"]): bytes(r["root"]) for r in roots.collect()}
    least = {}
    for k, i in fps.items():
        least[group.get(k, k)] = min(i, least.get(group.get(k, k), i))
    assert sorted(least.values()) == firsts(rows) and 1 < len(least) < len(texts)
    assert docs.count() == len(fps)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    text, other = " ".join(prose(rng, 50)), " ".join(prose(rng, 50))
    rows = [(3, text, "x"), (3, text, "x"), (None, text, "x"), (5, text + " more", "x"), (None, other, "x"), (None, other, "y"), (7, None, "x"), (6, "", "x")]
    got = simhash.keep_one_similar(spark, spark.createDataFrame(rows, "doc_id long, text string, `key` string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("3", text), ("None", other), ("6", "")])


def test_links_are_exact():
    base = np.arange(90, dtype=np.uint64)
    assert similar.Centres([base[:80], base[:71], base[:72], base + np.uint64(500)]).similar(base) == [0, 2]  # 72 of 90 is exactly 0.8
    some = similar.Centres([base[:80], base[:90]])
    assert some.similar(base[:60]) == [] and some.similar(base[:72]) == [0, 1] and some.similar(base[:1] + np.uint64(900)) == []
