"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

import corpus_pipeline
from perilgrid.llm import bpe, decontam, licenses, lines, phrases, quality, simhash, substrings, tokens, urls

#: Names that operators might use inside.
CLASHES = ["key", "fp", "row", "drop", "all", "bands", "batch", "data", "line", "cell", "n", "x", "y", "rkey", "item_id", "first", "root"]
LONG = " ".join(f"w{i * 7919 % 60_013}" for i in range(60_000)) + " " + "z" * 70_000
ROWS = [
    (1, "a b c d e f g\n%%% a b c", "s1"),
    (1, "a b c d e f g\n%%% a b c", "s1"),  # a repeated row
    (1, "another text of the same id", "s2"),
    (None, "no id at all", "s1"),
    (None, "no id at all", None),
    (2, None, "s1"),
    (None, None, None),
    (3, "", "s3"),
    (4, " \n\t ", "s3"),
    (5, LONG, "s4"),
]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, source string" + "".join(f", `{c}` int" for c in CLASHES)
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in ROWS], kind).repartition(3).cache()


def ids(rows):
    return sorted(str(r["doc_id"]) for r in rows)


ALL_IDS = sorted(str(r[0]) for r in ROWS)


def test_token_counts(spark, docs):
    got = tokens.count_tokens(spark, docs).collect()
    assert ids(got) == ALL_IDS and all((r["n_tokens"] == 0) == (r["n_bytes"] == 0) or not r["n_tokens"] for r in got)
    assert {r["n_bytes"] for r in got if r["doc_id"] in (2, 3)} == {0} and {r["over_limit"] for r in got if r["doc_id"] == 5} == {True}
    assert tokens.count_tokens(spark, docs.limit(0)).count() == 0


def test_codec(spark, docs):
    encoded = bpe.encode_texts(spark, docs)
    assert ids(encoded.collect()) == ALL_IDS
    back = sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode_ids(spark, encoded).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in ROWS)
    nulls = spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>")
    assert {r["text"] for r in bpe.decode_ids(spark, nulls).collect()} == {""}
    got = bpe.digest_texts(spark, docs).collect()
    assert ids(got) == ALL_IDS and {r["ids_sha256"] for r in got if r["doc_id"] in (2, 3)} == {EMPTY_SHA}
    assert bpe.digest_texts(spark, docs.limit(0)).count() == 0


def test_quality(spark, docs):
    got = quality.score(spark, docs, None).collect()
    assert ids(got) == ALL_IDS and {r["doc_id"] for r in got if r["kept"]} == {5} and len({tuple(r) for r in got if r["doc_id"] == 1}) == 2
    kept = quality.keep_good(spark, docs, None)
    assert kept.columns == docs.columns and ids(kept.collect()) == ["5"]
    assert quality.score(spark, docs.limit(0), None).count() == 0 and quality.keep_good(spark, docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    assert quality.train(spark, docs, labels) is None


def test_lines(spark, docs):
    got = lines.drop_boilerplate(spark, docs, 2)
    assert got.columns == docs.columns and ids(got.collect()) == ALL_IDS
    assert sum(r["text"] is None for r in got.collect()) == 2 and lines.drop_boilerplate(spark, docs.limit(0)).count() == 0


def test_exact_dedup(spark, docs):
    words = substrings.drop_repeats(spark, docs).collect()
    assert ids(words) == ALL_IDS and not any(r["n_removed"] for r in words)
    got = phrases.drop_repeated_bytes(spark, docs).collect()
    assert ids(got) == ALL_IDS and all(r["n_removed"] == 0 for r in got if r["doc_id"] != 5) and sum(r["n_removed"] > 0 for r in got) == 1


def test_simhash(spark, docs):
    got = simhash.near_duplicates(spark, docs).collect()
    assert ids(got) == ALL_IDS and {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    assert {r["fingerprint"] for r in got if r["doc_id"] in (2, 3)} == {"0" * 16}
    for keep in (simhash.keep_one, simhash.keep_one_similar):
        rows = keep(spark, docs)
        assert rows.columns == docs.columns and ids(rows.collect()) == ["1", "1", "2", "5", "None"]


def test_contamination_and_licenses(spark, docs):
    benchmark = spark.createDataFrame([(1, "no id at all", "k"), (None, LONG, "k"), (2, None, "k"), (3, LONG[500:700], "k")], "item_id long, text string, `key` string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark, docs, benchmark).collect()}
    assert got == {(None, 1), (5, 3)}
    left = decontam.drop_contaminated(spark, docs, benchmark)
    assert left.columns == docs.columns and ids(left.collect()) == sorted(["1", "1", "1", "2", "None", "3", "4"])
    assert licenses.scan_licenses(spark, docs).count() == 0


def test_urls(spark):
    names = ", ".join(f"`{c}` string" for c in ("host", "path", "fit", "node", "component", "bad", "root"))
    page = ("http://x.io/a", '<link rel="canonical" href="http://bad.net/b">' + "<p>" * 50_000, *"abcdefg")
    rows = [(1, *page), (1, *page), (None, *page), (2, None, None, *"abcdefg"), (3, "", "", *"abcdefg")]
    got = [tuple(r)[:5] for r in urls.judge_urls(spark, spark.createDataFrame(rows, f"page_id long, url string, html string, {names}")).collect()]
    assert sorted(got, key=str) == sorted([(1, "x.io", "/a", None, "block")] * 2 + [(None, "x.io", "/a", None, "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow")], key=str)


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no id at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality_rules": ["5"], "line_dedup": ALL_IDS, "simhash_near_dedup": ["1", "1", "2", "5", "None"], "benchmark_decontamination": sorted(["1", "1", "1", "2", "None", "3", "4", "5"]), "bpe_encoding": ALL_IDS}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert name == "bpe_encoding" or got.columns == docs.columns
        assert ids(got.collect()) == want[name]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
