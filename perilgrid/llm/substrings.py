"""Substring dedup with fixed-block anchors.

Every document's non-overlapping blocks of half a window are the reference index: any window holds one of its document's blocks
whole. All rolling windows of a block's length probe the index; where a probe hits a block of another document, the windows
around it are candidates. Hits are extended to maximal exact repeats: candidate windows are settled by exact hashes, and
overlapping ones run together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm import exchange
from perilgrid.llm.exchange import Answers, Batch, Questions, Round
from perilgrid.llm.hashing import U64, WordHashes, covered, prefix, rolling, sums_by, word_hashes
from perilgrid.llm.runtime import Frozen

WINDOW = 50
_store = WordHashes()


def _first_places(at: np.ndarray, k: int) -> np.ndarray:
    """The starts of windows of k items that stay in one document, given where documents start and end."""
    n = np.maximum(0, np.diff(at) - k + 1)
    return np.repeat(at[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


@dataclass
class Words:
    """The word hashes of a batch."""

    hashes: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(batch: Batch) -> Words:
        parts, ends = [], [np.zeros(1, np.int64)]
        for a, b in batch.pieces():
            h, at = word_hashes([t.split() for t in batch.texts[a:b]], _store)
            parts.append(h)
            ends.append(at[1:] + ends[-1][-1])
        return Words(np.concatenate([np.empty(0, U64), *parts]), np.concatenate(ends))

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, "right") - 1


def _heads(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.empty(0, bool)


def _anchors(words: Words, this: Round, window: int):
    """Probes: their places, in hash order, where distinct hashes begin, and the questions."""
    k = window // 2
    place = _first_places(words.at, k)
    high = rolling(prefix(words.hashes), k)[place]
    high, low = this.cut(high, np.zeros(len(high), U64))
    order = this.order(high, low)
    high, place = high[order], place[order]
    head = _heads(high, low)
    group = np.cumsum(head) - 1
    n = int(head.sum())
    doc = words.owner(place)
    block = np.zeros(n, bool)
    block[group[(place - words.at[doc]) % k == 0]] = True
    many = np.zeros(n, bool)
    first = np.flatnonzero(head)
    many[group[doc != doc[first][group]]] = True
    return place, group, Questions(high[first], np.zeros(n, U64), block + 2 * many.astype(U64))


def _shared(group: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1 if a hash is a block somewhere, and in two documents."""
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    flags = np.bitwise_or.reduceat(extra, head)
    times = np.diff(np.r_[head, len(group)])
    return (((flags & U64(1)) > 0) & ((times > 1) | ((flags & U64(2)) > 0)))[group].astype(np.uint8)


def _candidates(batch: Batch, words: Words, anchor: Round, settle: Round, window: int, answers: Answers):
    """Candidate windows: their places, in hash order, their group, and the questions."""
    k = window // 2
    place, group, _ = _anchors(words, anchor, window)
    hit = np.zeros(len(words.hashes) + 1, np.int32)
    hit[place[answers.of(anchor)[group] > 0]] = 1
    sums = np.r_[0, np.cumsum(hit)]
    place = _first_places(words.at, window)
    place = place[sums[place + window - k + 1] > sums[place]]
    high, low = (rolling(prefix(words.hashes, i), window, i)[place] for i in (0, 1))
    high, low = settle.cut(high, low)
    order = settle.order(high, low)
    high, low, place = high[order], low[order], place[order]
    head = _heads(high, low)
    group, first = np.cumsum(head) - 1, np.flatnonzero(head)
    ids = batch.ids[words.owner(place)]
    least = np.minimum.reduceat(ids, first) if len(first) else ids
    return place, group, least, Questions(high[first], low[first], exchange.first_of(least))


def _removed(batch: Batch, words: Words, anchor: Round, settle: Round, window: int, answers: Answers) -> np.ndarray:
    """Which words go."""
    place, group, least, _ = _candidates(batch, words, anchor, settle, window, answers)
    mine = answers.of(settle)[group] > 0
    gone = ~mine | (batch.ids[words.owner(place)] > least[group])
    return covered(place[gone], window, len(words.hashes))


def drop_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by single blanks) for every document.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts in a document with a
    smaller doc_id. A null text has no words. Rows of equal doc_id are judged against smaller ones only, so of repeated rows
    each keeps its words; a null doc_id counts as larger than all others. Other columns are left out; no rows give no rows."""
    frozen = Frozen(spark, "substrings")
    batches, scale = exchange.pack_batches(spark, docs, frozen)
    size, dealt = scale.size, (scale.buckets, scale.tasks)
    anchor = Round("anchor", exchange.width(size // 2, False), *dealt, 1)
    settle = Round("settle", exchange.width(size // 2, True), *dealt, 1)
    first = exchange.run_round(batches, frozen, anchor, lambda b, _: _anchors(Words.of(b), anchor, window)[2], _shared, 1)
    second = exchange.run_round(
        batches, frozen, settle, lambda b, got: _candidates(b, Words.of(b), anchor, settle, window, got)[3], exchange.owner, 8, first
    )

    def finish(_, data: bytes, answers: Answers) -> pa.Table:
        batch = Batch.unpack(data)
        words = Words.of(batch)
        gone = _removed(batch, words, anchor, settle, window, answers)
        n_removed = sums_by(gone, words.at)
        kept = []
        for i, t in enumerate(batch.texts):
            own = t.split()
            if n_removed[i]:
                own = [w for w, x in zip(own, gone[words.at[i] : words.at[i + 1]].tolist(), strict=True) if not x]
            kept.append(b" ".join(own).decode())
        ids = pa.array(batch.ids, pa.int64(), mask=batch.null_id)
        return pa.table([ids, pa.array(np.diff(words.at)), pa.array(n_removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return exchange.over_batches(batches, first.unionByName(second), finish, "doc_id long, n_words long, n_removed long, kept string", scale.tasks)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the passages that a document with a smaller doc_id has."""
    got = drop_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, i, md5_number(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM h JOIN m USING (h) WHERE doc_id > first),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, x.gone, CASE WHEN x.gone IS NULL THEN d.w ELSE list_filter(d.w, lambda v, i: NOT list_contains(x.gone, i)) END AS kept FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
