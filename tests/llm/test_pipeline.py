"""The pipeline against a plain version of each stage, and the registered queries on the smallest tables."""

import hashlib
import os
import random
import re

import pytest

import corpus_pipeline
from perilgrid.llm import bpe, lines, quality
from perilgrid.llm import catalog as llm_catalog

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOOTER = "subscribe to our letter for more of this"


def prose(rng, n, words=[f"word{i}" for i in range(700)]):  # noqa: B006
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    items = [prose(rng, 35) for _ in range(4)]
    texts = ["\n".join([prose(rng, 60), FOOTER, prose(rng, 60)]) if i % 3 == 0 else prose(rng, 130) for i in range(90)]
    junk = ["%%% ".join(prose(rng, 90).split()) for _ in range(40)]
    leaks = [prose(rng, 60) + " " + t + " " + prose(rng, 60) for t in items]
    near = texts[8].split()
    near[10] = near[60] = "other"  # 10 of some 126 shingles: 0.85
    far = texts[10].split()
    far[::20] = ["other"] * len(far[::20])  # below 0.8
    rows = texts + junk + leaks + [texts[1], texts[4], texts[7].replace("word1", "word2", 1), None, "", "too short", prose(rng, 12) + "\n" + FOOTER + "\n" + prose(rng, 12), " ".join(near), " ".join(far)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", f"s{i % 9}", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(130) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(rows))


def shingles(text):
    """Five words in a row, lower-cased; of fewer words all of them."""
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    """A Jaccard similarity of 0.8 or more."""
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def expected(docs, kept):
    docs = {i: docs[i] for i in sorted(kept)}
    sites = {}
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(line) >= lines.MIN_CHARS:
                sites.setdefault(line, set()).add(i % 9)
    seen, out = set(), {}
    for i, t in docs.items():
        left = []
        for line in (t or "").split("\n"):
            if len(sites.get(line, ())) < lines.MIN_SITES or line not in seen:
                left.append(line)
            seen.add(line)
        out[i] = "\n".join(left)
    sets = {i: shingles(t) for i, t in out.items()}
    up = {i: i for i in out}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in out:
        for j in out:
            if j < i and alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: t for i, t in out.items() if find(i) == i}


def test_pipeline(spark, folder):
    path, docs = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(spark, table, spark.read.parquet(f"{path}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(spark, table, model).collect() if r["kept"]}
    assert set(range(90)) - kept == set() and not kept & set(range(90, 130)) and {134, 135, 136} <= kept and not kept & {137, 138, 139}
    want = {i: t for i, t in expected(docs, kept).items() if i not in range(130, 134)}
    assert 134 not in want and 135 not in want and 141 not in want and 142 in want
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        ids = plain.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _ = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, path).columns == table.columns
        assert stage(spark, table.limit(0), path).count() == 0


TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(llm_catalog.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    got = llm_catalog.queries()[name](spark, TABLES)
    names = sorted(got.columns)
    want = con.sql(llm_catalog.oracle_sql()[name])
    assert sorted(want.columns) == names
    order = [want.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
