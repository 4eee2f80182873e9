"""License scans by patience alignment.

A template and a window of a text are aligned on the words that are unique in both: the longest increasing subsequence of
their places is kept, and the gaps between are aligned the same way. The share of the template's words that are aligned is its
coverage. A template's telling words (what it is called, its version, the clause that sets it apart) must be among the aligned
ones. So every match has a telling word, and windows are only tried around the one that the text has least often.

One-line notices are names with versions: those must be there in full, unbroken, shortly after a word such as "licensed", or
right beside "license". A further number behind a name is another version, and a "not" before the lead is no notice. The
identifiers of an SPDX line are read one by one.
Where templates compete for a place, the one with the most aligned words wins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from perilgrid.llm.decontam import normalise
from perilgrid.llm.runtime import ship, slices, texts_of

COVERAGE = 0.8
#: Words after a word of LEADS at most, before a notice's name.
LEAD = 8

_WARRANTY = (
    "IN NO EVENT SHALL THE COPYRIGHT {holder} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + _WARRANTY.format(holder="HOLDER OR CONTRIBUTORS")
)
_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{condition}. THE SOFTWARE IS PROVIDED "
    "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License "
    "for more details."
)
#: Public license texts, and for each the telling words that must be aligned.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "sublicense substantial",
    ),
    "ISC": (_ISC.format(condition=", provided that the above copyright notice and this permission notice appear in all copies"), "appear fee"),
    "0BSD": (_ISC.format(condition=""), "fee"),
    "BSD-2-Clause": (_BSD.format(third=""), "redistributions reproduce"),
    "BSD-3-Clause": (_BSD.format(third=_THIRD), "redistributions reproduce endorse neither"),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
        "apache 2",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla 2",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and "
        "this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, "
        "in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object "
        "code generated by a source language processor.",
        "derivative transmit",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution.",
        "misrepresented altered",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered domain",
    ),
    "GPL-2.0": (_GNU.format(it="This program", kind="", version="2"), "gnu 2"),
    "GPL-3.0": (_GNU.format(it="This program", kind="", version="3"), "gnu 3"),
    "LGPL-2.1": (_GNU.format(it="This library", kind="Lesser", version="2.1"), "lesser 2 1"),
    "LGPL-3.0": (_GNU.format(it="This library", kind="Lesser", version="3"), "lesser 3"),
    "AGPL-3.0": (_GNU.format(it="This program", kind="Affero", version="3"), "affero 3"),
}
#: What licenses are called in notices, by identifier without version; and their versions.
NAMES = {
    "MIT": (["MIT License"], []),
    "ISC": (["ISC License"], []),
    "Unlicense": (["Unlicense"], []),
    "BSD-2-Clause": (["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"], []),
    "BSD-3-Clause": (["BSD 3-Clause License", "BSD-3-Clause License", "New BSD License", "Modified BSD License"], []),
    "Apache": (["Apache License", "Apache Software License"], ["1.0", "1.1", "2.0"]),
    "MPL": (["Mozilla Public License", "MPL"], ["1.1", "2.0"]),
    "GPL": (["GNU General Public License", "GNU GPL", "GPL"], ["2.0", "3.0"]),
    "LGPL": (["GNU Lesser General Public License", "GNU LGPL", "LGPL"], ["2.1", "3.0"]),
    "AGPL": (["GNU Affero General Public License", "GNU AGPL", "AGPL"], ["3.0"]),
    "CC0": (["CC0", "CC0 Universal", "Creative Commons Zero"], ["1.0"]),
}
#: The parts of a Creative Commons license, in order, and how they are written out.
CC_PARTS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
#: Words of which one must shortly precede a notice's name, nouns with nothing but FILLERS between; words that undo
#: them; and notices that need none.
LEADS = frozenset(b"licensed licenced released distributed under".split())
NOUNS = frozenset(b"license licence".split())
FILLERS = frozenset(b"a an the this is of by to in see under terms version gnu s".split())
DENIALS = frozenset(b"not never nor neither without".split())
#: License identifiers of SPDX lines.
IDENTIFIERS = [
    "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-1.0", "Apache-1.1", "Apache-2.0", "MPL-1.1", "MPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "GPL-2.0", "GPL-3.0",
    "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0",
]
PLAIN_NOTICES = {"All-rights-reserved": "All rights reserved"}


def notices() -> dict[tuple[bytes, ...], tuple[str, bool]]:
    """From the words of every notice's name to (license, does it need a lead)."""
    found: dict[tuple[bytes, ...], tuple[str, bool]] = {}

    def add(text: str, name: str, lead: bool = True):
        found[tuple(normalise(text.encode()).split())] = (name, lead)

    def versioned(called: str, version: str, name: str):
        short = [version, version.removesuffix(".0")]
        for v in dict.fromkeys(short):
            for form in ("{} {}", "{} v{}", "{} v {}", "{} version {}"):
                add(form.format(called, v), name)

    for name, (forms, versions) in NAMES.items():
        for called in forms:
            for version in versions:
                versioned(called, version, f"{name}-{version}")
            if not versions:
                add(called, name)
    for version in ("2.0", "3.0"):
        add(f"GPLv{version[0]}", f"GPL-{version}")
    for parts, called in CC_PARTS.items():
        for version in CC_VERSIONS:
            for form in (f"CC {parts}", f"CC-{parts}", f"Creative Commons {called}", f"Creative Commons {called} License"):
                versioned(form, version, f"CC-{parts}-{version}")
            add(f"Creative Commons {called} {version} International License", f"CC-{parts}-{version}")
    for version in ("1.0", "1.1", "2.0"):
        versioned("Apache", version, f"Apache-{version}")
    for form, name in identifiers().items():
        for beside in (b"license", b"licence"):
            found.setdefault((beside, *form), (name, False))
            if len(form) > 1:  # "MIT license" alone is a name, which needs a lead
                found.setdefault((*form, beside), (name, False))
    for name, text in PLAIN_NOTICES.items():
        add(text, name, lead=False)
    return found


def identifiers() -> dict[tuple[bytes, ...], str]:
    """From the words of every SPDX identifier to the license."""
    names = IDENTIFIERS + [f"CC-{parts}-{v}" for parts in CC_PARTS for v in CC_VERSIONS]
    return {tuple(normalise(n.encode()).split()): n for n in names}


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places with equal words, rising in both."""
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        i, n, j, m = waiting.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        once = {w: k + i for k, w in enumerate(a[i:n])}
        times, there = Counter(a[i:n]), Counter(b[j:m])
        pairs = [(once[w], k) for k, w in enumerate(b[j:m], j) if there[w] == 1 and times[w] == 1]
        if not pairs:
            continue
        tails: list[int] = []  # the longest increasing subsequence of the places in a
        ends: list[int] = []
        before = []
        for k, (x, _) in enumerate(pairs):
            at = bisect_left(tails, x)
            before.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [x], [k]
        k, chain = ends[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = before[k]
        out += chain
        for (x, y), (to_x, to_y) in zip([(i - 1, j - 1), *chain[::-1]], [*chain[::-1], (n, m)], strict=True):
            waiting.append((x + 1, to_x, y + 1, to_y))
    return sorted(out)


@dataclass(order=True)
class Match:
    """A place of a text that a template covers; ordered by the words aligned."""

    aligned: int
    coverage: float
    name: str
    kind: str
    start: int
    end: int


@dataclass
class Template:
    name: str
    text: str
    telling_words: str
    coverage: float
    words: list[bytes] = field(init=False)
    telling: set[bytes] = field(init=False)

    def __post_init__(self):
        self.words = normalise(self.text.encode()).split()
        self.need = -int(-self.coverage * len(self.words) // 1)
        self.telling = set(normalise(self.telling_words.encode()).split())
        self.vocabulary = set(self.words)
        if not self.telling or not self.telling <= self.vocabulary:
            raise ValueError(f"telling words must be words of the template: {self.name}")
        self.first = {w: self.words.index(w) for w in self.telling}

    def judge(self, words: list[bytes], start: int, end: int) -> Match | None:
        """The match in a window, if its coverage is enough and all telling words are aligned."""
        window = words[start:end]
        n = len(self.words)
        if len(self.vocabulary.intersection(window)) < len(self.vocabulary) - (n - self.need):
            return None
        pairs = aligned(self.words, window)
        if len(pairs) < self.need or not self.telling <= {self.words[i] for i, _ in pairs}:
            return None
        return Match(len(pairs), len(pairs) / n, self.name, "text", start + pairs[0][1], start + pairs[-1][1] + 1)

    def find(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[Match]:
        """The best match around each place of the telling word that the text has least often. Wherever in a match the word is,
        a window of one and a half template lengths that starts in these steps holds the match but for an eighth of its
        length; the next tries are aligned with the match's own ends."""
        if any(w not in places for w in self.telling):
            return []
        anchor = min(sorted(self.telling), key=lambda w: len(places[w]))
        n, out, done = len(self.words), [], -1
        step = max(1, n // 8)
        tried: dict[int, Match | None] = {}
        for p in places[anchor]:
            if p < done:
                continue
            best = None
            for k in range(max(0, p - self.first[anchor] - n // 2) // step, p // step + 1):
                if k not in tried:
                    tried[k] = self.judge(words, k * step, k * step + n + n // 2)
                got = tried[k]
                if got and got.start <= p < got.end and (best is None or got > best):
                    best = got
            if best:
                best = max(filter(None, (best, self.judge(words, best.start, best.start + n + n // 4), self.judge(words, max(0, best.end - n - n // 4), best.end))))
                out.append(best)
                done = best.end
        return out


def led(words: list[bytes], i: int) -> bool:
    """Whether a word of LEADS or NOUNS leads to the name at place i, and nothing undoes it."""
    for k in range(i - 1, max(-1, i - 1 - LEAD), -1):
        w = words[k]
        if w in LEADS or (w in NOUNS and FILLERS.issuperset(words[k + 1 : i])):
            return DENIALS.isdisjoint(words[max(0, k - 3) : k])
    return False


def find_notices(words: list[bytes], known: dict[tuple[bytes, ...], tuple[str, bool]], by_first: dict[bytes, list[int]]) -> list[Match]:
    """Names of licenses in full; of those at one place the longest."""
    out = []
    for i, w in enumerate(words):
        for n in by_first.get(w, ()):  # longest first
            if i + n > len(words):
                continue
            got = known.get(tuple(words[i : i + n]))
            if got and words[i + n - 1].isdigit() and i + n < len(words) and words[i + n].isdigit() and len(words[i + n]) < 3:
                break  # a longer version
            if got and (led(words, i) if got[1] else DENIALS.isdisjoint(words[max(0, i - 2) : i])):
                out.append(Match(n, 1.0, got[0], "notice", i, i + n))
                break
    return out


SPDX = [b"spdx", b"license", b"identifier"]


def find_spdx(words: list[bytes], known: dict[tuple[bytes, ...], str]) -> list[Match]:
    """The licenses of lines such as "SPDX-License-Identifier: MIT OR Apache-2.0": identifiers with "and", "or" and "with" between,
    up to the first word that is none."""
    longest, out = max(map(len, known)), []
    for i in (k for k, w in enumerate(words) if w == SPDX[0] and words[k : k + 3] == SPDX):
        at = i + 3
        while True:
            n = next((n for n in range(longest, 0, -1) if tuple(words[at : at + n]) in known), 0)
            if not n:
                break
            out.append(Match(n + 3, 1.0, known[tuple(words[at : at + n])], "notice", at, at + n))
            at += n
            at += 2 if words[at : at + 2] == [b"or", b"later"] else 1 if words[at : at + 1] == [b"only"] else 0
            if words[at : at + 1] not in ([b"and"], [b"or"], [b"with"]):
                break
            at += 1
    return out


def winners(found: list[Match]) -> list[Match]:
    """Of matches that overlap the one with the most aligned words; then the one with the larger coverage; then by name."""
    kept: list[Match] = []
    starts: list[int] = []
    for m in sorted(found, key=lambda m: (-m.aligned, -m.coverage, m.name, m.start)):
        i = bisect_left(starts, m.end)  # the ones before i start before this one ends
        if not i or kept[i - 1].end <= m.start:
            starts.insert(i, m.start)
            kept.insert(i, m)
    return kept


class Scanner:
    """All templates and notices."""

    def __init__(self, templates: dict[str, tuple[str, str]], coverage: float):
        self.templates = [Template(k, text, telling, coverage) for k, (text, telling) in templates.items()]
        self.notices = notices()
        lengths: dict[bytes, set[int]] = {}
        for form in self.notices:
            lengths.setdefault(form[0], set()).add(len(form))
        self.by_first = {w: sorted(n, reverse=True) for w, n in lengths.items()}
        self.identifiers = identifiers()
        self.telling = set().union(*(t.telling for t in self.templates)) if self.templates else set()
        self.any = self.telling | set(self.by_first) | {SPDX[0]}

    def scan(self, text: bytes) -> list[Match]:
        words = normalise(text).split()
        there = self.any.intersection(words)
        if not there:
            return []
        found = find_notices(words, self.notices, self.by_first) if not there.isdisjoint(self.by_first) else []
        if SPDX[0] in there:
            found += find_spdx(words, self.identifiers)
        if any(t.telling <= there for t in self.templates):
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in self.telling:
                    places.setdefault(w, []).append(i)
            for t in self.templates:
                found += t.find(words, places)
        return winners(found)


HITS = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("kind", pa.string()), ("coverage", pa.float64()), ("n_matches", pa.int64()), ("first_word", pa.int64())])


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, kind (text or notice), coverage (best, 4 decimals), n_matches, first_word: a row for each row of
    ``docs``, license and kind found in it; a template is a text with its telling words. Case, punctuation and line ends don't
    count. Null and empty texts have none, null doc_ids keep their rows, repeated rows have their own result rows; other
    columns are left out; no rows give no rows. Texts are scanned whole, in time that grows with their length and with the
    places of the telling word that they have least often."""
    ship(spark)
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in slices(batches, most=1 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                by_name: dict[tuple[str, str], list[Match]] = {}
                for m in scanner.scan(text):
                    by_name.setdefault((m.name, m.kind), []).append(m)
                for (name, kind), own in sorted(by_name.items()):
                    rows.append((doc_id, name, kind, round(max(m.coverage for m in own), 4), len(own), own[0].start))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), HITS, strict=True)], schema=HITS)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(
        run, "doc_id long, license string, kind string, coverage double, n_matches long, first_word long"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice and text in ``documents``."""
    return scan_licenses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
