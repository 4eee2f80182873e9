"""Repeated byte strings by prefix-free parsing.

A rolling hash triggers phrase boundaries: a place is a trigger if its hash is the smallest of some ``GAP`` consecutive places
that include it, so boundaries depend on nearby bytes only, any GAP consecutive places have one, and equal passages are cut
alike. A phrase is told by the trigger behind it and, since a match must not depend on what follows a phrase, is extended by
what a string of ``SPAN`` bytes starting in it can reach. The extended phrases are the dictionary; the parse is the list of
their occurrences in corpus order (doc_id, place).

Order is settled on the dictionary, not on the corpus: all occurrences of an extended phrase but the first hold nothing new.
For first occurrences the dictionary's suffixes, that is the places inside extended phrases, are ranked among each other. Only
classes of suffixes that share SPAN bytes are needed, so suffixes are ordered by hashes of SPAN bytes, not alphabetically; and
only phrases whose trigger string occurs in another extended phrase as well can share a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm import exchange
from perilgrid.llm.exchange import Answers, Batch, Questions, Round
from perilgrid.llm.hashing import U64, covered, mix, prefix, sums_by, windows
from perilgrid.llm.runtime import Frozen

#: Bytes of a string that counts as a repeat, and places between triggers at most.
SPAN, GAP = 100, 31
GRAM = 8  # bytes that a rolling hash sees
KEY = SPAN - 2 * (GAP - 1) - 4  # bytes of a trigger string: it lies inside every string of SPAN bytes that is assigned to it
#: A random number for each byte value, and for each of two hashes.
_VALUE = mix(np.arange(1, 513, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, 256)


def triggers(raw: np.ndarray) -> np.ndarray:
    """The places of triggers."""
    n = len(raw) - GRAM + 1
    if n < GAP:
        return np.empty(0, np.int64)
    code = np.empty(n, U64)
    data = raw.tobytes()
    for i in range(min(GRAM, n)):
        part = np.frombuffer(data, "<u8", (len(data) - i) // 8, i)
        code[i::GRAM] = part[: len(code[i::GRAM])]
    h = (mix(code) >> U64(32)).astype(np.uint32)
    low = _sliding(h, np.minimum)
    high = np.zeros(n, np.uint32)
    high[GAP - 1 : n - GAP + 1] = _sliding(low, np.maximum)
    for i in range(min(GAP - 1, len(low))):  # the ends, where fewer windows hold a place
        high[i] = low[: i + 1].max()
        high[n - 1 - i] = low[len(low) - 1 - i :].max()
    return np.flatnonzero(high == h)


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """The least (or largest) of every GAP consecutive numbers, by doubling."""
    span, out = 1, x
    while span < GAP:
        step = min(span, GAP - span)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        span += step
    return out


@dataclass
class Piece:
    """Some documents of a batch, end to end, and the extended phrases of their parse: ``low`` to ``high`` are the places
    where a phrase's strings start, ``trigger`` the trigger behind it."""

    raw: np.ndarray
    at: np.ndarray  # where documents start and end
    first_doc: int

    def __post_init__(self):
        t = triggers(self.raw)
        reach = GAP - 1
        before = np.r_[-(1 << 40), t[:-1]] if len(t) else t
        low, high = before - reach + 1, t - reach
        # the strings of a phrase may start in several documents: one row for each
        doc_from = np.clip(np.searchsorted(self.at, np.maximum(low, 0), "right") - 1, 0, None)
        doc_to = np.clip(np.searchsorted(self.at, high, "right") - 1, -1, len(self.at) - 2)
        times = np.maximum(0, doc_to - doc_from + 1)
        k = np.repeat(np.arange(len(t)), times)
        doc = doc_from[k] + (np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times))
        low, high = np.maximum(low[k], self.at[doc]), np.minimum(high[k], self.at[doc + 1] - SPAN)
        good = low <= high
        self.low, self.high, self.doc, self.trigger = low[good], high[good], doc[good], t[k[good]]
        self._sums: dict[int, np.ndarray] = {}

    def sums(self, which: int) -> np.ndarray:
        if which not in self._sums:
            self._sums[which] = prefix(_VALUE[which][self.raw], which)
        return self._sums[which]

    def keys(self) -> np.ndarray:
        return windows(self.sums(0), self.trigger, self.trigger + KEY)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(windows(self.sums(i), self.low, self.high + SPAN, i) for i in (0, 1))

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the chosen phrases' strings, and two hashes of each."""
        n = self.high[chosen] - self.low[chosen] + 1
        place = np.repeat(self.low[chosen] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return place, *(windows(self.sums(i), place, place + SPAN, i) for i in (0, 1))


def pieces(batch: Batch) -> Iterator[Piece]:
    for a, b in batch.pieces(1 << 19):
        raw = np.frombuffer(b"".join(batch.texts[a:b]), np.uint8)
        yield Piece(raw, np.r_[0, np.cumsum([len(t) for t in batch.texts[a:b]])].astype(np.int64), a)


@dataclass
class Rounds:
    phrase: Round
    context: Round
    suffix: Round


@dataclass
class Sorted:
    """Hashes in order: ``order`` sorts the items, ``group`` numbers the distinct ones (of sorted items), ``first`` is where
    each begins; the first item of a group is its first in corpus order."""

    order: np.ndarray
    group: np.ndarray
    first: np.ndarray
    high: np.ndarray
    low: np.ndarray

    @staticmethod
    def of(this: Round, high: np.ndarray, low: np.ndarray) -> Sorted:
        high, low = this.cut(high, low)
        order = this.order(high, low)
        high, low = high[order], low[order]
        head = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.empty(0, bool)
        first = np.flatnonzero(head)
        return Sorted(order, np.cumsum(head) - 1, first, high[first], low[first])

    def back(self, values: np.ndarray) -> np.ndarray:
        """From one value for each sorted item to the items' own order."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = values
        return out

    def leads(self, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which items are the first of their group: in a document of the group's smallest doc_id, and the first one there.
        ``doc`` is the place of each item's document in ``ids``."""
        if not len(self.order):
            return np.empty(0, bool)
        doc = doc[self.order]
        head = np.r_[True, (self.group[1:] != self.group[:-1]) | (doc[1:] != doc[:-1])]
        return self.back(head & (ids[doc] == ids[doc[self.first]][self.group]))


@dataclass
class Parse:
    """All extended phrases of a batch, in corpus order."""

    key: np.ndarray
    one: np.ndarray
    two: np.ndarray
    doc: np.ndarray
    sizes: list[int]

    @staticmethod
    def of(batch: Batch) -> Parse:
        key, one, two, doc = [np.empty(0, U64)], [np.empty(0, U64)], [np.empty(0, U64)], [np.empty(0, np.int64)]
        for p in pieces(batch):
            key.append(p.keys())
            a, b = p.contexts()
            one.append(a)
            two.append(b)
            doc.append(p.doc + p.first_doc)
        return Parse(*(np.concatenate(x) for x in (key, one, two, doc)), [len(x) for x in key[1:]])

    def ask_phrases(self, rounds: Rounds) -> tuple[Sorted, Questions]:
        """One question for each trigger string: the context hash of one of its extended phrases, and as flags whether it has
        several here, and whether it occurs more than once here. Contexts are only compared within a trigger string, so 64
        bits err on fewer than one in a million corpora up to 100 TB."""
        s = Sorted.of(rounds.phrase, self.key, np.zeros(len(self.key), U64))
        n = len(s.first)
        tag = self.one[s.order]
        other = np.zeros(n, bool)
        lead = s.order[s.first][s.group] if n else s.group
        other[s.group[(self.one[s.order] != self.one[lead]) | (self.two[s.order] != self.two[lead])]] = True
        many = np.diff(np.r_[s.first, len(s.order)]) > 1
        return s, Questions(s.high, s.low, np.stack([tag[s.first], other.astype(U64) | many.astype(U64) << U64(1)], 1))

    def known(self, rounds: Rounds, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase: is its trigger string shared, and in several extended phrases?"""
        s, _ = self.ask_phrases(rounds)
        got = s.back(answers.of(rounds.phrase)[s.group]) if len(s.order) else np.empty(0, np.uint8)
        return (got & 1) > 0, (got & 2) > 0

    def ask_contexts(self, batch: Batch, rounds: Rounds, answers: Answers) -> tuple[np.ndarray, Sorted, Questions]:
        shared, _ = self.known(rounds, answers)
        at = np.flatnonzero(shared)
        s = Sorted.of(rounds.context, self.one[at], self.two[at])
        return at, s, Questions(s.high, s.low, exchange.first_of(batch.ids[self.doc[at[s.order[s.first]]]]))

    def firsts(self, batch: Batch, rounds: Rounds, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases are later occurrences, and which first ones have suffixes that may be shared."""
        _, several = self.known(rounds, answers)
        at, s, _ = self.ask_contexts(batch, rounds, answers)
        later = np.zeros(len(self.key), bool)
        if len(at):
            later[at] = ~(s.leads(self.doc[at], batch.ids) & (s.back(answers.of(rounds.context)[s.group]) > 0))
        return later, several & ~later

    def ask_suffixes(self, batch: Batch, rounds: Rounds, chosen: np.ndarray):
        """The suffixes of the chosen phrases: (piece, place, document) of each in corpus order, sorted hashes and questions."""
        number, place, one, two, doc = [], [], [], [], []
        start = 0
        for k, p in enumerate(pieces(batch)):
            own = np.flatnonzero(chosen[start : start + self.sizes[k]])
            start += self.sizes[k]
            if len(own):
                x, a, b = p.suffixes(own)
                place.append(x)
                one.append(a)
                two.append(b)
                number.append(np.full(len(x), k))
                doc.append(np.searchsorted(p.at, x, "right") - 1 + p.first_doc)
        none = np.empty(0, np.int64)
        number, place, doc = (np.concatenate([none, *x]) for x in (number, place, doc))
        one, two = (np.concatenate([np.empty(0, U64), *x]) for x in (one, two))
        s = Sorted.of(rounds.suffix, one, two)
        return number, place, doc, s, Questions(s.high, s.low, exchange.first_of(batch.ids[doc[s.order[s.first]]]))


def _phrase_answers(group: np.ndarray, extra: np.ndarray) -> np.ndarray:
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    tag = extra[:, 0]
    flags = np.bitwise_or.reduceat(extra[:, 1], head)
    several = ((flags & U64(1)) > 0) | (np.minimum.reduceat(tag, head) != np.maximum.reduceat(tag, head))
    shared = (np.diff(np.r_[head, len(group)]) > 1) | (flags > 0)
    return (shared + 2 * several.astype(np.uint8))[group].astype(np.uint8)


def _kept(batch: Batch, rounds: Rounds, answers: Answers) -> Iterator[tuple[int, int, int, bytes]]:
    """For every document: bytes, removed bytes, removed runs, what is left."""
    parse = Parse.of(batch)
    later, chosen = parse.firsts(batch, rounds, answers)
    number, place, doc, s, _ = parse.ask_suffixes(batch, rounds, chosen)
    again = ~(s.leads(doc, batch.ids) & (s.back(answers.of(rounds.suffix)[s.group]) > 0)) if len(place) else np.empty(0, bool)
    number, place = number[again], place[again]
    start = 0
    for k, p in enumerate(pieces(batch)):
        own = np.flatnonzero(later[start : start + parse.sizes[k]])
        start += parse.sizes[k]
        n = p.high[own] - p.low[own] + 1
        whole = np.repeat(p.low[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        gone = covered(np.r_[whole, place[number == k]], SPAN, len(p.raw))
        rises = gone & ~np.r_[False, gone[:-1]]
        inner = p.at[:-1][p.at[:-1] < len(gone)]
        rises[inner] = gone[inner]
        n_removed, n_spans = sums_by(gone, p.at), sums_by(rises, p.at)
        for d in range(len(p.at) - 1):
            a, b = int(p.at[d]), int(p.at[d + 1])
            yield b - a, int(n_removed[d]), int(n_spans[d]), (p.raw[a:b][~gone[a:b]] if n_removed[d] else p.raw[a:b]).tobytes()


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every document.

    A byte goes if it is covered by a string of ``SPAN`` bytes that also starts earlier: in a document with a smaller doc_id,
    or earlier in the same one. Strings never cross documents and are judged on the input. A null text counts as empty. Rows
    of equal doc_id are judged against smaller ones and against themselves, not against each other. A null doc_id counts as
    larger than all others. Other columns are left out; no rows give no rows."""
    frozen = Frozen(spark, "phrases")
    batches, scale = exchange.pack_batches(spark, docs, frozen)
    size, dealt = scale.size, (scale.buckets, scale.tasks)
    rounds = Rounds(
        Round("phrase", exchange.width(size // 8, False), *dealt, 2),
        Round("context", exchange.width(size // 8, True), *dealt, 1),
        Round("suffix", exchange.width(size, True), *dealt, 1),
    )
    first = exchange.run_round(batches, frozen, rounds.phrase, lambda b, _: Parse.of(b).ask_phrases(rounds)[1], _phrase_answers, 9)
    second = exchange.run_round(
        batches, frozen, rounds.context, lambda b, got: Parse.of(b).ask_contexts(b, rounds, got)[2], exchange.owner, 8, first
    )

    def suffixes(b: Batch, got: Answers) -> Questions:
        parse = Parse.of(b)
        return parse.ask_suffixes(b, rounds, parse.firsts(b, rounds, got)[1])[4]

    both = first.unionByName(second)
    third = exchange.run_round(batches, frozen, rounds.suffix, suffixes, exchange.owner, 8, both)

    def finish(_, data: bytes, answers: Answers) -> pa.Table:
        batch = Batch.unpack(data)
        rows = list(zip(*_kept(batch, rounds, answers), strict=True)) or [[]] * 4
        ids = pa.array(batch.ids, pa.int64(), mask=batch.null_id)
        n = [pa.array(x, pa.int64()) for x in rows[:3]]
        return pa.table([ids, *n, pa.array(rows[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return exchange.over_batches(
        batches, both.unionByName(third), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", scale.tasks
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the byte strings that occur earlier."""
    got = drop_repeated_bytes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, {2 * SPAN})) AS k FROM (SELECT doc_id, h, unnest(range(0, n - {SPAN - 1})) AS s FROM d WHERE n >= {SPAN})),
f AS (SELECT k, min(row(doc_id, s)) AS first FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.s FROM w JOIN f USING (k) WHERE row(w.doc_id, w.s) <> f.first),
r AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {SPAN} THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
u AS (SELECT doc_id, run, min(s) AS a, max(s) + {SPAN} AS b FROM i GROUP BY doc_id, run),
p AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM u),
x AS (SELECT p.doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""
