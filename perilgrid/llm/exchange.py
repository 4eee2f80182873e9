"""Which strings does the corpus hold elsewhere? Packed rounds of questions between batches of documents and buckets of hashes.

Documents are packed into batches of bounded size, one compressed row each, and frozen: from then on a batch is a fixed set of
documents that any task can read again. In a round every batch asks once about each distinct hash that it holds (a copied
string costs one question for each batch, not for each copy), questions go to buckets by hash, a bucket answers with a few bits
for each question, and the answers return to the batch, in the order asked. Questions of one bucket are one packed row.

A hash takes as many bytes as the corpus asks for, see ``width``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.hashing import U64
from perilgrid.llm.runtime import Frozen, ship, slices

#: Bytes of text of a batch, and of the text whose questions meet in a bucket, at least. Memory of a task is a small multiple.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Both grow with the root of the corpus, so that a row of packed questions stays for about so many bytes of text, and the number
#: of rows grows with the corpus and not with its square: 49 MB at 1 TB, 490 MB at 100 TB.
ROW_BYTES = 2400
#: Tasks of a round at most; each takes its batches or buckets one after the other.
TASKS = 20_000
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: behind all others


@dataclass
class Batch:
    """Documents in order of doc_id."""

    ids: np.ndarray
    null_id: np.ndarray
    texts: list[bytes]

    @staticmethod
    def pack(rows: list[tuple[int | None, bytes]]) -> bytes:
        rows = sorted((LAST if i is None else i, i is None, t) for i, t in rows)
        head = np.array([len(rows)], "<i8").tobytes()
        ids, null = np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], np.uint8)
        sizes = np.array([len(r[2]) for r in rows], "<i8")
        return zstandard.ZstdCompressor(level=3).compress(b"".join([head, ids.tobytes(), sizes.tobytes(), null.tobytes(), *(r[2] for r in rows)]))

    @staticmethod
    def unpack(data: bytes) -> Batch:
        data = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        ids, sizes = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
        null = np.frombuffer(data, np.uint8, n, 8 + 16 * n).astype(bool)
        ends = np.cumsum(sizes) + 8 + 17 * n
        return Batch(ids, null, [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)])

    def pieces(self, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Runs of documents of about so many bytes, one document at least."""
        start, held = 0, 0
        for i, t in enumerate(self.texts):
            if held and held + len(t) > most:
                yield start, i
                start, held = i, 0
            held += len(t)
        if start < len(self.texts):
            yield start, len(self.texts)


@dataclass
class Scale:
    """Sizes that follow the bytes of text in all."""

    size: int

    def share(self, least: int) -> int:
        return max(least, int((ROW_BYTES * self.size) ** 0.5))

    @property
    def batch(self) -> int:
        return self.share(BATCH_BYTES)

    @property
    def buckets(self) -> int:
        return self.size // self.share(BUCKET_BYTES) + 1

    @property
    def tasks(self) -> int:
        """One for each bucket, while there aren't too many."""
        return min(TASKS, max(self.buckets, self.size // self.batch + 1))


def pack_batches(spark: SparkSession, docs: DataFrame, frozen: Frozen) -> tuple[DataFrame, Scale]:
    """The frozen batches (batch, data, n_bytes), and the sizes that follow from the text. A null text counts as empty."""
    ship(spark)
    scale = Scale(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    size = scale.batch
    schema = pa.schema([("data", pa.binary()), ("n_bytes", pa.int64())])

    def run(batches):
        rows, held = [], 0

        def close():
            return pa.record_batch([pa.array([Batch.pack(rows)], pa.binary()), pa.array([held], pa.int64())], schema=schema)

        for batch in slices(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                t = t or b""
                if rows and held + len(t) > size:
                    yield close()
                    rows, held = [], 0
                rows.append((i, t))
                held += len(t)
        if rows:
            yield close()

    packed = docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "data binary, n_bytes long")
    return frozen(packed.withColumn("batch", F.monotonically_increasing_id()), "batches"), scale


def width(items: int, exact: bool) -> int:
    """Bytes of a hash. A filter may err on one in 4096 (its errors are settled by what follows); an exact round errs on fewer
    than one in a million corpora of this size."""
    bits = np.log2(max(2, items)) * (2 if exact else 1)
    return int(min(16, max(4, np.ceil((bits + (20 if exact else 12)) / 8))))


@dataclass
class Round:
    """One round: ``name``, hash ``bytes``, the number of ``buckets`` and of ``tasks``, ``bits`` of an answer."""

    name: str
    bytes: int
    buckets: int
    tasks: int
    bits: int

    def cut(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keeps as much of two independent hashes as the round sends: the highest bits of the first, then of the second."""
        if self.bytes <= 8:
            return (high >> U64(64 - 8 * self.bytes) if self.bytes < 8 else high), np.zeros(len(high), U64)
        return high, (low >> U64(64 - 8 * (self.bytes - 8)) if self.bytes < 16 else low)

    def order(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        order = np.argsort(high, kind="stable")
        if self.bytes > 8:
            h = high[order]
            if len(h) > 1 and ((h[1:] == h[:-1]) & (low[order][1:] != low[order][:-1])).any():
                order = np.lexsort((low, high))
        return order

    def bucket_of(self, high: np.ndarray) -> np.ndarray:
        """Rising with the hash, so that sorted questions are grouped by bucket."""
        top = high >> U64(max(0, 8 * min(8, self.bytes) - 32))
        return (top.astype(U64) * U64(self.buckets) >> U64(32)).astype(np.int64)


def planes(values: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, place by place: sorted numbers compress well like this."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n][:, ::-1].T.tobytes()


def unplanes(data: bytes, at: int, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, count * n, at).reshape(n, count).T[:, ::-1]
    return out.view("<u8").reshape(-1)


@dataclass
class Questions:
    """A batch's distinct hashes in order, and for each an ``extra`` number that the bucket needs (of ``extra_bytes``; over 8
    bytes, two columns, of which the first has 8)."""

    high: np.ndarray
    low: np.ndarray
    extra: np.ndarray


def run_round(
    batches: DataFrame,
    frozen: Frozen,
    this: Round,
    ask: Callable[[Batch, Answers], Questions],
    answer: Callable[[np.ndarray, np.ndarray], np.ndarray],
    extra_bytes: int,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """The frozen answers (batch, round, bucket, n, bits) of one round.

    ``ask`` gives a batch's questions, knowing the answers of earlier rounds. ``answer`` gets, for one bucket, the number of
    the group of equal hashes and the extra of each question, ordered by group, and gives the answers as small integers."""
    parts_of_extra = [min(8, extra_bytes), *([extra_bytes - 8] if extra_bytes > 8 else [])]
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def questions(key, data, answers):
        q = ask(Batch.unpack(data), answers)
        bucket = this.bucket_of(q.high)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        ends = np.r_[cut[1:], len(bucket)] if len(bucket) else cut
        rows = []
        for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
            parts = [planes(q.high[a:b], min(8, this.bytes))]
            if this.bytes > 8:
                parts.append(planes(q.low[a:b], this.bytes - 8))
            columns = q.extra[a:b].reshape(b - a, -1).T
            parts += [planes(x, n) for x, n in zip(columns, parts_of_extra, strict=True)]
            rows.append(zstandard.ZstdCompressor(level=1).compress(b"".join(parts)))
        return pa.table([pa.array(np.full(len(cut), key), pa.int64()), pa.array(bucket[cut], pa.int64()), pa.array(ends - cut, pa.int64()), pa.array(rows, pa.binary())], schema=schema)

    asked = over_batches(batches, earlier, questions, "batch long, bucket long, n long, data binary", this.tasks)

    def settle(table: pa.Table) -> pa.Table:
        ns = table.column("n").to_pylist()
        high, low, extra = [], [], []
        for n, data in zip(ns, table.column("data"), strict=True):
            data = zstandard.ZstdDecompressor().decompress(data.as_py())
            high.append(unplanes(data, 0, n, first := min(8, this.bytes)))
            low.append(unplanes(data, n * first, n, this.bytes - 8) if this.bytes > 8 else np.zeros(n, U64))
            ends = np.cumsum([this.bytes, *parts_of_extra])
            columns = [unplanes(data, n * int(at), n, k) for at, k in zip(ends, parts_of_extra, strict=False)]
            extra.append(np.stack(columns, 1) if len(columns) > 1 else columns[0])
        high, low, extra = np.concatenate(high), np.concatenate(low), np.concatenate(extra)
        order = this.order(high, low)
        high, low = high[order], low[order]
        group = np.cumsum(np.r_[False, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        got = np.empty(len(order), np.uint8)
        got[order] = answer(group, extra[order])
        ends = np.cumsum(ns)
        bits = [pack_bits(got[e - n : e], this.bits) for e, n in zip(ends.tolist(), ns, strict=True)]
        return pa.table([table.column("batch"), table.column("bucket"), table.column("n"), pa.array(bits, pa.binary())], names=["batch", "bucket", "n", "bits"])

    answered = asked.repartition(this.tasks, "bucket").groupBy("bucket").applyInArrow(settle, "batch long, bucket long, n long, bits binary")
    return frozen(answered.withColumn("round", F.lit(this.name)), f"answers-{this.name}")


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    return b"".join(np.packbits(values >> k & 1).tobytes() for k in range(bits))


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    step = (n + 7) // 8
    out = np.zeros(n, np.uint8)
    for k in range(bits):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, step, k * step), count=n) << k
    return out


class Answers(dict):
    """By round: the (bucket, n, bits) that a batch has got."""

    def of(self, this: Round) -> np.ndarray:
        """The answers to the questions in the order asked."""
        parts = [unpack_bits(bits, n, this.bits) for _, n, bits in sorted(self.get(this.name, ()))]
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def over_batches(batches: DataFrame, answers: DataFrame | None, run: Callable, schema: str, tasks: int) -> DataFrame:
    """``run(batch number, data, answers) -> table`` over all batches with what they have been answered, in so many tasks."""
    if answers is None:

        def alone(parts):
            for part in parts:
                for key, data in zip(part.column("batch").to_pylist(), part.column("data"), strict=True):
                    yield from run(key, data.as_py(), Answers()).to_batches()

        return batches.select("batch", "data").mapInArrow(alone, schema)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        got = Answers()
        for name, *rest in zip(*(right.column(c).to_pylist() for c in ("round", "bucket", "n", "bits")), strict=True):
            got.setdefault(name, []).append(tuple(rest))
        row = left.slice(0, 1).to_pylist()[0]
        return run(row["batch"], row["data"], got)

    ours, theirs = (x.repartition(tasks, "batch").groupBy("batch") for x in (batches.select("batch", "data"), answers))
    return ours.cogroup(theirs).applyInArrow(together, schema)


def owner(group: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """1 for questions whose extra is the smallest of their group, else 0."""
    if not len(group):
        return np.empty(0, np.uint8)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(extra, head)
    return (extra == least[group]).astype(np.uint8)


def first_of(ids: np.ndarray) -> np.ndarray:
    """doc_ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(U64) ^ U64(1 << 63)
