"""Chat formatting, the filter audit and run detection against plain versions, and on hard cases."""

import hashlib
import json
import random
import re
from itertools import permutations
from zlib import crc32

import duckdb
import pytest

from perilgrid.llm import audit, chats, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# chats ----------------------------------------------------------------------------------------------------------------

HARD = ["", "<", "[", "|", "<|", "<\\|end|>", "<\\\\|turn|>", "</s>", "<\\/s>", "<s>[INST]<<SYS>>a<</SYS>>[/INST]", "[\\INST]", "[\\\\/INST]\\", "<<|says|>", "<|image|>", "é\n\n", "\\", "<|end|><|turn|>x<|says|>y"]


def test_escape_is_reversible():
    rng, letters = random.Random(3), ["<", "[", "\\", "|", "/", "s>", "s", "INST]", "/INST]", "<SYS>>", "/SYS>>", "a", "end|>"]
    seen = {}
    for text in HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]:
        done = chats.escape(text)
        assert chats.unescape(done) == text and seen.setdefault(done, text) == text
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", done)


def plain_digests(rows):
    out, groups = [], {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    for conv, turns in groups.items():
        said = [(r, t) for *_, r, _, t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        out.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_chats_read_back(spark, chunk):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>", "a\nb", ""]), "".join(rng.choice(HARD) for _ in range(3))) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "a"), (None, None, None, None), (None, 1, "assistant", "b"), (40, 0, None, None), (40, 0, "assistant", "z"), (40, 0, "assistant", "z"), (40, None, "user", "first")]
    rows += [(41, k, "assistant", "x" * 3000 + "</s>") for k in range(40)] + [(42, 0, "assistant", "<|" * 300_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, loss int").repartition(5)
    formatted = chats.format_chats(spark, df, chunk=chunk)
    for got in (chats.read_back(spark, formatted, in_order=True), chats.read_back(spark, formatted)):
        assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()), key=str) == plain_digests(rows)
    sizes = {}
    for r in formatted.collect():
        assert len(r.text) < chunk + 901_000 and r.n_turns == r.text.count(chats.END)
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + 1
    assert (max(sizes.values()) == 1) == (chunk > 40)
    assert chats.format_chats(spark, df.limit(0)).count() == 0 and chats.read_back(spark, formatted.limit(0)).count() == 0


def test_typed_parts(spark):
    deep = "[" * 200_000 + "]" * 200_000
    content = [
        [{"type": "text", "text": "look: <"}, "|image|> here", {"type": "image", "url": "a.png", "width": 57, "height": 28}, {"type": "text", "text": "and"}],
        [{"type": "audio", "ref": "b.wav", "seconds": 2.1}, {"type": "document", "path": "c.pdf", "pages": 3, "content": [{"type": "text", "text": "[INST] inner"}, {"type": "image"}, None]}, {"type": "text", "text": " end"}],
        [{"type": "video", "x": 1}, 7, None, {"type": "image", "width": -1, "height": True}, {"type": "document", "pages": 1e400}],
    ]
    rows = [(1, k, "assistant", None, json.dumps(c)) for k, c in enumerate(content)]
    rows += [(2, 0, "user", "plain", None), (2, 1, "user", "ignored", "not JSON </s>"), (2, 2, "user", None, '{"a": 1}'), (2, 3, "user", None, deep), (2, 4, "user", None, '["\\ud800"]'), (2, 5, "user", None, "[]")]
    formatted = chats.format_chats(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string"))
    one, two = sorted(formatted.collect(), key=lambda r: r.conv_id)
    turns = list(chats.read_turns(one.text))
    assert [p for _, p in turns] == [
        [("text", "look: <|image|> here"), ("image", "<|image|>"), ("text", "and")],
        [("audio", "<|audio|>"), ("document", "<|document|>"), ("text", "[INST] inner"), ("image", "<|image|>"), ("text", " end")],
        [("text", '{"type": "video", "x": 1}7'), ("image", "<|image|>"), ("document", "<|document|>")],
    ]
    assert [(a.kind, a.ref, a.n_tokens) for a in one.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 53), ("document", "c.pdf", 1536), ("image", None, 256), ("image", None, 256), ("document", None, 256)]
    assert all(one.text[a.at :].startswith(f"<|{a.kind}|>") for a in one.attachments) and len(one.loss) == 3
    assert one.text[one.loss[0].start : one.loss[0].end] == "look: <\\|image|> here<|image|>and"
    assert ["".join(x for _, x in p) for _, p in chats.read_turns(two.text)] == ["plain", "not JSON </s>", '{"a": 1}', deep, "�" * 3, ""]
    totals = {r.conv_id: (r.n_attachments, r.attachment_tokens) for r in chats.read_back(spark, formatted).collect()}
    assert totals == {1: (6, 3 + 53 + 1536 + 3 * 256), 2: (0, 0)}
    for broken in ("x", "<|turn|>a", "<|turn|>a<|says|>b", "<|end|>", "<|turn|>a<|says|>b<|turn|>"):
        with pytest.raises(ValueError):
            list(chats.read_turns(broken))


# audit ----------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(e is not None and e < d and (u or "") == text for e, u, _ in docs),
        }
        rows.append((part or "", fails, d in good, d in toxic))
    out = []
    for part in sorted({p for p, *_ in rows}):
        mine, found, shapley = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                lost, all_fail = [r for r in left if r[1][f]], sum(r[1][f] for r in mine)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(lost)
                found.append((part, "".join(order), step, len(left), len(lost), all_fail - len(lost), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, source string, mask int, key string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.audit(spark, d, lab).collect())


def test_audit(spark, monkeypatch):
    rng = random.Random(2)
    long = [" ".join(f"w{rng.randrange(900)}" for _ in range(230)) for _ in range(5)]
    texts = [*long, long[0] + " #", long[1].replace("w", "W"), "a b " * 150, "A" * 50, None, "", " \n", "é" * 10 + "Z", "Ab $", "x y z"]
    docs = [(i % 70 if i % 9 else None, rng.choice(texts), rng.choice(["s1", "s2", "s3", None, ""])) for i in range(150)]
    docs += [(1000 + i, texts[0], "s1") for i in range(80)] + [docs[3]] * 2 + [(-4, "x y z", "s2")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    want = plain_audit(docs, labels)
    assert len(want) == 4 * 600 and audited(spark, docs, labels) == want
    monkeypatch.setattr(audit, "PARTS", 1)
    assert audited(spark, docs, labels) == want
    assert audited(spark, docs, labels[:0] or [(None, None, None)]) == plain_audit(docs, [])
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert all(table[1 << "ABCDE".index(f), k] == order.index(f) for k, order in enumerate(audit.ORDERS) for f in "ABCDE")


def test_audit_counts_are_exact(spark):
    big = spark.createDataFrame([("p", 3, 1, (1 << 60) + 1), ("p", 3, 1, 1)], "part string, mask int, label int, n long").coalesce(1)
    (row,) = audit.partial_counts(big).collect()
    assert sum(row.counts[: audit.REMOVALS]) == 120 * ((1 << 60) + 2) and row.counts[audit.REMOVALS + 3] == (1 << 60) + 2


# runs -----------------------------------------------------------------------------------------------------------------


def plain_runs(w, least=6, periods=4):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i - q, j), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def hard_words(rng):
    kind, n = rng.randrange(7), rng.randint(0, 140)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        block = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        return [rng.randrange(4) for _ in range(rng.randint(0, 9))] + block * rng.randint(3, 9) + block[: rng.randrange(9)] + [rng.randrange(3) for _ in range(rng.randint(0, 9))]
    if kind == 3:  # Fibonacci words are full of squares and cubes
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b * rng.randint(1, 5)
    if kind == 4:  # runs of runs
        inner = [0] * rng.randint(4, 8) + [1]
        return inner * rng.randint(3, 8) + inner[:3]
    if kind == 5:
        w = [rng.randrange(2)] * n
        for _ in range(3):
            if w:
                w[rng.randrange(n)] = 5
        return w
    return [rng.randrange(400) for _ in range(n)]


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(6000):
        w = hard_words(rng)
        assert runs.find_runs(w) == plain_runs(w), w
    for periods, least in ((4, 4), (5, 6), (7, 30)):
        for _ in range(400):
            w = hard_words(rng)
            assert runs.find_runs(w, least, periods) == plain_runs(w, least, periods), w
    with pytest.raises(ValueError):
        runs.find_runs([1], periods=3)


def test_very_long_runs_take_no_quadratic_time():
    n = 200_000
    assert runs.find_runs([7] * n) == [(0, n, 1)]
    assert runs.find_runs([1, 2, 3] * (n // 3)) == [(0, n // 3 * 3, 3)]
    assert runs.find_runs(list(range(n // 5)) * 5) == [(0, n, n // 5)]
    nested = ([0] * 8 + [1]) * (n // 9)
    assert len(runs.find_runs(nested)) == n // 9 + 1


def plain_collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_collapse(spark):
    texts = ["a a a a a a a b", "x y x y x y x y x", "one two three", "", None, " \n\t", "p\x0bq r " * 6, "la " * 90_000, "é " * 7]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "n n n n n n"), (0, texts[0]), (0, texts[0])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, start string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse_runs(spark, df).collect()), key=str)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        found = [(0, 90_000, 1)] if len(w) == 90_000 else plain_runs(w)
        want.append((i, len(w), found, plain_collapsed(w, found)))
    assert got == sorted(want, key=str) and runs.collapse_runs(spark, df.limit(0)).count() == 0


def plain_row(doc, text):
    w = WORD.findall(text or "")
    h, n = crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g, original = h // 10, list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else original[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(said), sha(plain_collapsed(w, found)))


def test_run_digests(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in hard_words(rng))) for i in range(400)] + [(-7, "a b c d e f g h"), (None, "m m m m m m m"), (None, None), (3, "q q q q q q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = [tuple(r) for r in runs.run_digests(spark, df).collect()]
    assert sorted(got, key=str) == sorted((plain_row(*r) for r in rows), key=str) and sum(r[1] > 0 for r in got) > 100
    assert runs.run_digests(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_filter_audit"])
def test_queries_equal_sql(spark, name):
    module = chats if name.startswith("op11") else audit
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = getattr(module, name)(spark, FOLDER)
    want = con.sql(module.OP11_SQL if module is chats else module.OP12_SQL)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall()), key=str)
