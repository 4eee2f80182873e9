"""Periodic run detection: stretches of words that repeat with a period, found by divide and conquer at midpoints.

A run that crosses the midpoint of a segment and is at least four periods long holds two periods on one side of it. So the
side starts (ends, on the left) with a square of that period, which the Z-function of the side shows: a shift p whose common
prefix with the side is at least p long. Each such shift is extended to the other side, and to the ends of the segment.
A run belongs to the largest segment whose midpoint it crosses; what reaches over a segment's ends is left to the segment
around it. Shifts that are multiples of a smaller period give the same interval and are skipped, and of equal intervals the
smallest period stays.

Every text is a row of its own: the work is a map without a shuffle, and n words take O(n log n) steps.
"""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.runtime import ship, slices, texts_of

#: A run has so many words at least, and so many periods.
LEAST, PERIODS = 6, 4
#: Segments up to this length are left where too few of their words repeat.
SMALL = 64


def squares(side: list[int]) -> list[tuple[int, int]]:
    """(p, z) for the periods of squares at the start of ``side``: z is the length of the common prefix of the side and its
    suffix from p on, and z >= p. Multiples of a smaller period inside its repetition are left out.

    The Z-function, with places that don't start with the side's first word passed over by ``list.index``."""
    n, most = len(side), len(side) // 2
    first, z = side[0], [0] * (most + 1)
    found: list[tuple[int, int]] = []
    left = right = covered = 0
    p = 1
    while p <= most:
        if p >= right:
            try:
                p = side.index(first, p, most + 1)
            except ValueError:
                break
            same = 1
        else:
            same = z[p - left]
            if same < right - p:
                z[p] = same
                p += 1
                continue
            same = right - p
        while p + same < n and side[p + same] == side[same]:
            same += 1
        z[p] = same
        left, right = p, p + same
        if same >= p and p > covered:
            found.append((p, same))
            covered = same  # shifts up to p + same - p inside this repetition are multiples of p
        p += 1
    return found


def find_runs(ids: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids``, by start and period: ``period`` is the smallest one of the stretch, its
    length is at least ``least`` and ``periods`` (4 or more) periods, and no neighbour extends it."""
    if periods < 4:
        raise ValueError("runs of fewer than four periods need not hold a square on one side of a midpoint")
    n, found = len(ids), {}
    open_segments = [(0, n)]
    while open_segments:
        lo, hi = open_segments.pop()
        size = hi - lo
        if size < least:
            continue
        if size <= SMALL and size - len(set(ids[lo:hi])) < least - 1:
            continue  # a run repeats least - 1 words at least
        mid = (lo + hi) // 2
        for q, same in squares(ids[mid:hi]):
            start, end = mid, mid + q + same
            while start > lo and ids[start - 1] == ids[start - 1 + q]:
                start -= 1
            _add(found, ids, lo, hi, start, end, q, least, periods)
        for q, same in squares(ids[lo:mid][::-1]) if mid > lo else ():
            start, end = mid - q - same, mid
            while end < hi and ids[end] == ids[end - q]:
                end += 1
            _add(found, ids, lo, hi, start, end, q, least, periods)
        open_segments += [(lo, mid), (mid, hi)]
    return sorted((start, end - start, q) for (start, end), q in found.items())


def _add(found: dict, ids: list[int], lo: int, hi: int, start: int, end: int, q: int, least: int, periods: int) -> None:
    if end - start < max(least, periods * q):
        return
    if (start == lo > 0 and ids[lo - 1] == ids[lo - 1 + q]) or (end == hi < len(ids) and ids[hi] == ids[hi - q]):
        return
    found[start, end] = min(q, found.get((start, end), q))


def intern_words(words: list[bytes]) -> list[int]:
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    kept, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if end > at:
            kept += words[at : max(start, at)]
            at = end
    return kept + words[at:]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equals the one with the smallest start, then period."""
    best = None
    for run in runs:  # in order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def collapse_runs(spark: SparkSession, docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed: each text's runs, and its words joined by blanks with one period
    left of each run. A null text has no words; repeated rows and null doc_ids keep their rows; other columns are left out; no
    rows give no rows. A text is a row of one task, which holds its words."""
    ship(spark)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                words = text.split()
                runs = find_runs(intern_words(words), least, periods)
                collapsed = b" ".join(kept_words(words, runs)).decode("utf-8", "replace")
                rows.append((doc, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, RUNS, strict=True)], schema=RUNS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: one in ten, by a checksum of the doc_id, is periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


DIGEST = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
DIGEST_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The query's row for each document, its planted run included: number of runs, the strongest one, digests of all runs and of
    the collapsed text. Nulls, repeats, extra columns and empty tables as in ``collapse_runs``."""
    ship(spark)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                words = with_planted_run(doc, text.split())
                runs = find_runs(intern_words(words))
                best = strongest(runs)
                said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                rows.append(
                    (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(said.encode()).hexdigest(),
                     sha256(b" ".join(kept_words(words, runs))).hexdigest())
                )
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, DIGEST, strict=True)], schema=DIGEST)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST_DDL)


def op13_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs."""
    return run_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
