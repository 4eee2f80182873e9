"""Near duplicates, line dedup, decontamination, licenses and URLs against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from perilgrid.llm import decontam, licenses, lines, simhash, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, source string, key string, row string, `all` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", "r", 1) for i, t, s in rows], KIND).repartition(3)


def prose(rng, n, words=[f"w{i}" for i in range(500)]):  # noqa: B006
    return " ".join(rng.choice(words) for _ in range(n))


def plain_fingerprint(text, k=4):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    some = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(values, most):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", "One", "a b c", "a b c d", "A\tb\x0bC d\n e É", "x y " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("most", [2, 3, 4, 5, 6])
def test_links_lose_nothing(spark, most):
    rng = random.Random(most)
    values = {rng.getrandbits(64) for _ in range(60)} | {0, 1, (1 << 64) - 1}
    for v in list(values)[:30]:
        for _ in range(4):
            for _ in range(rng.randint(1, most)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    centre = rng.getrandbits(64)  # a dense group
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, fp long")
    from perilgrid.llm.runtime import Frozen

    got = {r["fp"]: r["component_id"] for r in simhash.classes(spark, prints, Frozen(spark, "t"), most).collect()}
    assert [got[v] for v in signed] == roots(values, most)


@pytest.mark.parametrize("dense", [2, 64])
def test_dense_cells_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(dense)
    values = set()
    for _ in range(40):  # many fingerprints of the same counts
        v = sum(rng.choice([1, 2]) << 2 * k for k in range(32))
        values.add(v)
        for _ in range(12):
            values.add(v ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 5))}))
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for r in simhash.links(spark, frame, 4).collect():
        a, b = (x % (1 << 64) for x in r)
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = roots(values, 4)
    assert [find(v) for v in values] == [values[k] for k in want]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 1000)).astype(np.uint64)
    counts = lambda x: np.stack([(x >> np.uint64(2 * s) & np.uint64(1)) + (x >> np.uint64(2 * s + 1) & np.uint64(1)) for s in range(32)]).astype(int)
    want = np.abs(counts(a) - counts(b)).sum(0)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == want).all() and (want <= np.bitwise_count(a ^ b)).all()


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [prose(rng, 300) for _ in range(20)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    rows += [(100 + i, t.replace("w1 ", "v ", 1), "s") for i, t in enumerate(base)] + [(200, base[0], "s"), (201, None, "s"), (202, "", "s"), (203, " \n", "s"), (5, base[5], "s")]
    docs = frame(spark, rows)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark, docs).collect())
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    groups = roots(fps, 4)
    least = {g: min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in set(groups)}
    assert got == sorted((rows[i][0], f"{fps[i]:016x}", least[groups[i]]) for i in range(len(rows)))
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0 and simhash.keep_one(spark, docs.limit(0)).count() == 0


def test_null_ids(spark):
    docs = frame(spark, [(None, "a b c d e", "s"), (None, "a b c d e", "s"), (None, "q r s t u v", "s"), (3, "q r s t u v", "s")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark, docs).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (None, 3), (3, 3)], key=str)
    assert sorted((r["doc_id"] for r in simhash.keep_one(spark, docs).collect()), key=str) == [3, None]


def test_lines(spark):
    rng = random.Random(7)
    footer, rare = "all rights are reserved here, friends", "a line that seven sites have, no more"
    rows = []
    for i in range(60):
        own = [prose(rng, 8), footer, prose(rng, 5), "short"] + ([rare] if i % 10 < 7 else []) + ([footer] if i % 9 == 0 else [])
        rows.append((i, "\n".join(own), f"s{i % 10}"))
    rows += [(60, None, "s1"), (61, "", "s1"), (62, footer, None), (63, "\n\n", "s2"), (5, rows[5][1], "s5")]
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["text"]) for r in lines.drop_boilerplate(spark, docs).collect()}
    want, seen = set(), False
    for i, t, _ in rows[:-1]:
        out = []
        for line in (t or "").split("\n"):
            if line != footer or not seen:
                out.append(line)
            seen = seen or line == footer
        want.add((i, None if t is None else "\n".join(out)))
    assert got == want
    assert lines.drop_boilerplate(spark, docs).columns == docs.columns and lines.drop_boilerplate(spark, docs).count() == len(rows)
    assert lines.drop_boilerplate(spark, docs.limit(0)).count() == 0


def test_exact_counts_decide_near_the_threshold(spark):
    line = "the very same line on many sites"
    rows = [(i, line, f"s{i % n}") for n in (29,) for i in range(200)]
    assert sum(not r["text"] for r in lines.drop_boilerplate(spark, frame(spark, rows), 29).collect()) == 199
    assert sum(not r["text"] for r in lines.drop_boilerplate(spark, frame(spark, rows), 30).collect()) == 0


def least_edits(unit, text):
    """The least edits between a unit and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(unit, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain_leaks(items, texts):
    """Every pair whose item has passages side by side, of 48 bytes together, that the text holds within the budget."""
    out = set()
    for n, t in enumerate(texts):
        text = decontam.framed(decontam.normalise(t.encode()))
        for k, item in enumerate(items):
            units, exact = decontam.passages(decontam.normalise(item.encode()))
            if exact:
                good = any(u in text for _, u in units)
            else:
                near = [s for s, u in units if u in text or least_edits(u, text) <= decontam.EDITS]
                good = any(b - a <= decontam.STRIDE and b + decontam.LENGTH - a >= decontam.LEAST for a, b in zip(near, near[1:]))
            if good:
                out.add((n, k))
    return out


def test_alignment_against_plain():
    rng = random.Random(8)
    m, width = 12, 6
    units, windows, want = [], [], []
    for _ in range(400):
        unit = bytes(rng.choice(b"abc") for _ in range(m))
        spoiled = list(unit)
        for _ in range(rng.randint(0, 5)):
            spoiled.insert(rng.randrange(len(spoiled) + 1), rng.choice(b"abc")) if rng.random() < 0.5 else spoiled.pop(rng.randrange(len(spoiled)))
        window = (bytes(rng.randint(1, 3)) + bytes(spoiled) + bytes(40))[: m + width - 1]
        units.append(unit)
        windows.append(window)
        want.append(least_edits(unit, window))
    got = decontam.align(*(np.frombuffer(b"".join(x), np.uint8).reshape(400, -1) for x in (units, windows)))
    near = [k for k, w in enumerate(want) if w <= 1]  # these stay on the window's diagonals
    assert all(g >= w for g, w in zip(got, want)) and len(near) > 50 and all(got[k] == want[k] for k in near)


@pytest.mark.parametrize("seed", [9, 10])
def test_contamination_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [prose(rng, n) for n in (1, 2, 3, 5, 8, 12, 13, 14, 20, 40)] + ["x y", "What is the capital of Peru? Lima.", prose(rng, 14), "a b a b a b a b a b a b a b a b a b a b a b a b a b a b"]
    texts = [prose(rng, 60) for _ in range(6)] + ["", items[1], "a b " * 40, "x y", "So: what is the capital of Peru -- LIMA!", items[3] + "x"]
    for _ in range(60):
        item = rng.choice(items[4:])
        a = rng.randrange(max(1, len(item) - 30))
        leak = list(item[a : a + rng.randint(40, 130)])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            k = rng.randrange(len(leak))
            leak[k : k + 1] = rng.choice(["", "#", "zq", leak[k].upper()])
        texts.append(prose(rng, rng.randint(0, 30)) + rng.choice([" ", "", "\n"]) + "".join(leak) + " " + prose(rng, rng.randint(0, 30)))
    want = plain_leaks(items, texts)
    assert len(want) > 15 and {k for _, k in decontam.find([x.encode() for x in items], [b""])} == set()
    assert {(n, k) for n, k, *_ in decontam.find([x.encode() for x in items], [t.encode() for t in texts])} == want
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "?!"), (None, items[9]), (93, items[9])], "item_id long, text string")
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(700, None, "s"), (None, items[9], "s"), (701, items[9], "s"), (701, items[9], "s"), (702, " ".join(texts) * 3, "s")])
    want |= {(n, 93) for n, k in want if k == 9}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark, docs, benchmark).collect()}
    assert {x for x in got if x[0] is not None and x[0] < 700} == want
    assert {x for x in got if x[0] in (None, 701)} == {(None, 9), (None, 93), (701, 9), (701, 93)}
    whole = {k for k, t in enumerate(items) if decontam.normalise(t.encode()).count(b" ") < 2}
    assert {x[1] for x in got if x[0] == 702} >= {k for _, k in want} - whole
    clean = decontam.drop_contaminated(spark, docs, benchmark)
    left = [r["doc_id"] for r in clean.collect()]
    assert clean.columns == docs.columns and sorted(left) == sorted({*range(len(texts)), 700} - {n for n, _ in want})
    assert decontam.contaminated(spark, docs, benchmark.limit(0)).count() == 0 and decontam.drop_contaminated(spark, docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize(("length", "least"), [(48, 0.9), (52, 1.0), (64, 1.0), (100, 1.0), (180, 1.0)])
def test_short_leaks_are_found(length, least):
    rng = random.Random(length)
    item = prose(rng, 80)
    places = range(0, len(item) - length, 3)
    texts = [(prose(rng, 5) + " " + item[a : a + length] + " " + prose(rng, 5)).encode() for a in places]
    assert len(decontam.find([item.encode()], texts)) >= least * len(places)


def test_repetitive_texts_take_little(spark):
    import time

    start = time.time()
    benchmark = spark.createDataFrame([(0, "0 " * 2000), (1, "0 1 " * 30)], "item_id long, text string")
    docs = frame(spark, [(0, "0 " * 500_000, "s"), (1, "0 1 1 " * 100_000, "s"), (2, "1 0 " * 100_000, "s"), (3, "2 " * 400_000, "s")])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark, docs, benchmark).collect()}
    assert got == {(0, 0), (2, 1)} and time.time() - start < 60


def test_patience():
    a, b = b"a b c d e f g".split(), b"x a b y c q e f z g".split()
    assert [a[i] for i, _ in licenses.aligned(a, b)] == b"a b c e f g".split()
    assert licenses.aligned([], b) == [] and licenses.aligned(a, a) == [(i, i) for i in range(7)]
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij").encode() for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


SCANNER = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("Released under the BSD License.", None),
        ("The film was released under the working license", None),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("Licensed under the Apache License, Version 1.0.", "Apache-1.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Released under the\nMIT License", "MIT"),
        ("Distributed under the terms of the GPLv3", "GPL-3.0"),
        ("available under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
        ("All rights reserved.", "All-rights-reserved"),
        ("He read about the MIT License in the news.", None),
    ],
)
def test_notices(line, name):
    assert [m.name for m in SCANNER.scan(("so it is. " + line + " and on it goes.").encode())] == ([name] if name else [])


def spoiled(rng, text, telling, share):
    """Some words of a text dropped, replaced or doubled, but for telling ones."""
    out = []
    for w in text.split():
        plain = decontam.normalise(w.encode()).split()
        if rng.random() < share and not set(plain) & telling:
            out += rng.choice([[], ["zzz"], [w, "zzz"], [w, w]])
        else:
            out.append(w)
    return " ".join(out)


def test_altered_texts_have_their_own_name():
    rng = random.Random(12)
    right = wrong = total = 0
    for name, (text, _) in licenses.TEMPLATES.items():
        telling = set().union(*(t.telling for t in SCANNER.templates))
        for _ in range(12):
            words = prose(rng, rng.randint(0, 60)) + " " + spoiled(rng, text, telling, rng.choice([0, 0.05, 0.1])) + " " + prose(rng, rng.randint(0, 60))
            found = {m.name for m in SCANNER.scan(words.encode()) if m.kind == "text"}
            total, right, wrong = total + 1, right + (name in found), wrong + len(found - {name})
    assert right >= 0.98 * total and wrong == 0


def test_windows_against_all_windows():
    rng = random.Random(13)
    vocabulary = [f"t{i}" for i in range(40)]
    text = " ".join(rng.choice(vocabulary) for _ in range(60)) + " tell"
    t = licenses.Template("x", text, "tell", 0.8)
    found = missed = 0
    for _ in range(60):
        noise = [rng.choice([*vocabulary, *(f"n{i}" for i in range(60))]) for _ in range(90)]
        at = rng.randrange(90)
        words = " ".join([*noise[:at], spoiled(rng, text, {b"tell"}, rng.choice([0.05, 0.15, 0.25, 0.4])), *noise[at:]]).encode().split()
        every = [t.judge(words, s, s + n) for s in range(len(words)) for n in (len(t.words), len(t.words) * 3 // 2)]
        places = {b"tell": [i for i, w in enumerate(words) if w == b"tell"]}
        if any(every):
            found += 1
            missed += not t.find(words, places)
        else:
            assert not t.find(words, places) or max(m.coverage for m in t.find(words, places)) >= 0.8
    assert found > 20 and missed <= 0.02 * found


def test_licenses(spark):
    rng = random.Random(12)
    mit = licenses.TEMPLATES["MIT"][0]
    words = mit.split()
    partly = " ".join(w for i, w in enumerate(words) if i % 12)  # eleven of twelve words
    rows = [(0, prose(rng, 100), "s"), (1, prose(rng, 40) + "\n" + mit.upper() + "\n" + prose(rng, 40), "s"), (2, partly, "s"), (3, " ".join(words[:90]), "s")]
    rows += [(4, "x\nReleased under the MIT\nLicense. y. Released under the MIT License.", "s"), (5, None, "s"), (6, "", "s"), (7, "Licensed gnu 2 " * 20_000, "s")]
    rows += [(8, " ".join([mit] * 3), "s"), (None, "All rights reserved", "s"), (9, "All rights reserved. " * 20_000, "s"), (10, "ISC License", "s"), (10, "under ISC License", "s"), (10, "under ISC License", "s")]
    got = [tuple(r) for r in licenses.scan_licenses(spark, frame(spark, rows)).collect()]
    by = {(r[0], r[1], r[2]): r[3:] for r in got}
    assert set(by) == {(1, "MIT", "text"), (2, "MIT", "text"), (4, "MIT", "notice"), (8, "MIT", "text"), (None, "All-rights-reserved", "notice"), (9, "All-rights-reserved", "notice"), (10, "ISC", "notice")}
    assert by[1, "MIT", "text"] == (1.0, 1, 40) and by[2, "MIT", "text"][0] > 0.9 and by[4, "MIT", "notice"] == (1.0, 2, 4) and by[8, "MIT", "text"][1] == 3
    assert by[9, "All-rights-reserved", "notice"][1] == 20_000 and len(got) == len(by) + 1  # repeated rows have their own
    assert licenses.scan_licenses(spark, frame(spark, rows).limit(0)).count() == 0


def judged(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(spark, pages).collect()}


def test_rules(spark):
    rows = [
        (0, "http://A.net/x", ""), (1, "http://example.NET/en/1?q#f", None), (2, "x://shop.example.com/de/", ""), (3, "http://b.org/fr/x", ""), (4, "http://net", ""),
        (5, None, ""), (6, "no scheme", ""), (7, "http://notnet/x", ""), (8, "http://xexample.net/en/", ""), (9, "http://a.org/fr", ""), (10, "http://É.NET/", ""), (0, "http://A.net/x", ""),
    ]
    got = judged(spark, rows)
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow") and got[4] == ("net", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2] is None and got[8][2] == "net/" and got[9][2] is None and got[10][0] == "É.net"
    assert judged(spark, rows[:1])[0][3] == "block" and judged(spark, rows)[0] == got[0]


def test_decisions_reach_aliases(spark):
    link = '<LINK href="{}" rel=canonical>'.format
    meta = "<meta http-equiv='refresh' content='0; url={}'>".format
    rows = [
        (0, "http://a.io/1", link("http://b.io/2?x=1&amp;y=2")), (1, "http://b.io/2?x=1&y=2#frag", meta("https://c.io/3")), (2, "https://c.io/3", link("//bad.net/z")),
        (3, "http://d.io/dir/4", link("5")), (4, "http://d.io/dir/5", meta("/6")), (5, "http://d.io/6", ""), (6, "http://e.io/7", link("http://bad.net/w")),
        (7, "http://f.org/fr/8", link("http://bad.net/w")), (8, "http://g.io/9", link("http://g.io/9")), (9, "http://b.io/2", ""),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert [got[k] for k in (0, 1, 2)] == ["block"] * 3  # along a chain to a blocked address
    assert [got[k] for k in (3, 4, 5, 8, 9)] == ["allow"] * 5
    assert got[6] == got[7] == "allow"  # an explicit allow in the component comes first


def test_no_pages(spark):
    assert judged(spark, [(0, "a", "b")][:1]) and urls.judge_urls(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("line", "names"),
    [
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: Apache-2.0 */ text", ["Apache-2.0"]),
        ("SPDX-License-Identifier: (MIT OR GPL-3.0-or-later) AND BSD-3-Clause", ["MIT", "GPL-3.0", "BSD-3-Clause"]),
        ("SPDX-License-Identifier: GPL-2.0-only WITH something", ["GPL-2.0"]),
        ("SPDX-License-Identifier: unknown MIT", []),
        ("Licensed under Apache 2.0.", ["Apache-2.0"]),
        ("license: MIT", ["MIT"]),
        ("Apache-2.0 license", ["Apache-2.0"]),
        ("This file is released under the MIT License.", ["MIT"]),
        ("the license is GPL 2", ["GPL-2.0"]),
        ("We published a study of why GPL 2 fails", []),
        ("The driver held a licence and GPL 3 was his badge", []),
        ("under GPL 2 1", []),
        ("under LGPL 2.1", ["LGPL-2.1"]),
        ("not licensed under the MIT License", []),
        ("This is not licensed under the MIT License", []),
        ("MIT", []),
        ("GPL", []),
        ("SPDX-License-Identifier:", []),
        ("under the GPL", []),
    ],
)
def test_license_lines(line, names):
    for text in (line, f"some words before\n{line}\n", f"{line}\nand words after"):
        if text.startswith("some") or not line.endswith(":"):
            assert [m.name for m in SCANNER.scan(text.encode())] == names


def test_shared_sentences_are_searched_once(spark):
    """Items and documents that all hold one sentence: work and rows grow with their number, and every link is there."""
    rng = random.Random(5)
    common = "please answer the following question as well as you can and explain every step"
    n = 60
    items = [f"{prose(rng, 12)} {common} {prose(rng, 12)}" for _ in range(n)]
    texts = [f"{prose(rng, 40)} {common} {prose(rng, 40)}" for _ in range(n)] + [f"{prose(rng, 20)} {items[7]} {prose(rng, 20)}", prose(rng, 90), None, items[3], items[3]]
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)])
    benchmark = spark.createDataFrame([(100 + k, t, 1) for k, t in enumerate([*items, items[5], None, ""])], "item_id long, text string, skey int")
    pairs = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, docs, benchmark).collect()}
    want = {(i, 100 + k) for i in ids if i not in (n + 1, n + 2) for k in range(n + 1)}
    assert pairs == want
    got = {r.doc_id: r for r in decontam.contaminated_documents(spark, docs, benchmark).collect()}
    assert set(got) == {i for i, _ in want} and all(n // 8 < r.n_items <= n + 1 and r.item_id == 100 and r.least_edits == 0 for r in got.values())
    assert got[n].n_stretches > got[0].n_stretches
    left = decontam.drop_contaminated(spark, docs, benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [n + 1, n + 2]
    cleans = [decontam.normalise(t.encode()) for t in items]
    homes = {}
    for c in cleans:
        for key, _ in decontam.stretches(c):
            homes.setdefault(key, c)
    shared = [key for key, _ in decontam.stretches(decontam.normalise(common.encode()))]
    assert len(homes) < sum(len(decontam.stretches(c)) for c in cleans) and shared


def test_stretches_are_what_runs_are_made_of():
    rng = random.Random(6)
    for size in [1, 20, 47, 48, 49, 50, 51, 52, 53, 100, 230]:
        clean = decontam.normalise(prose(rng, 80).encode())[:size].strip()
        units, exact = decontam.passages(clean)
        starts = [s for s, _ in units]
        parts = [p for _, p in decontam.stretches(clean)]
        assert {s for p in parts for s in p} == set(starts)
        for a in range(len(starts)):
            for b in range(a, len(starts)):
                counts = exact or starts[b] + decontam.LENGTH - starts[a] >= decontam.LEAST
                inside = [s for p in parts if set(p) <= set(starts[a : b + 1]) for s in p]
                assert set(inside) == (set(starts[a : b + 1]) if counts else set())
