"""Quality rules: fixed counts, and a hashed n-gram logistic regression trained on labelled rows.

Features are the relative frequencies of hashed word 1- and 2-grams and of hashed character (code point) 3- and 4-grams. Probabilities are
calibrated on rows left out of the fit and hold against a fixed threshold. Texts are scored in Arrow batches with the weights
alone, without a feature vector for each text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.hashing import U64, WordHashes, covered, mix, prefix, rolling, sums_by, word_hashes
from perilgrid.llm.runtime import BLANKS, ship, slices, texts_of

WORD_SLOTS, CHAR_SLOTS = 1 << 12, 1 << 13
SLOTS = WORD_SLOTS + CHAR_SLOTS
#: The bound of the labelled sample, in rows: those with the smallest hash of doc_id.
SAMPLE = 2500
KEEP_FROM = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_FACTOR = np.uint32(0x85EBCA6B)


@dataclass
class Features:
    """A run of texts: words, bytes and characters laid end to end. Bytes that aren't UTF-8 count as one replacement character."""

    texts: list[bytes]
    store: WordHashes
    words: list[list[bytes]] = field(init=False)

    def __post_init__(self):
        self.words = [t.split() for t in self.texts]
        self.hashes, self.word_at = word_hashes(self.words, self.store)
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        self.byte_at = np.zeros(len(self.texts) + 1, np.int64)
        np.cumsum([len(t) for t in self.texts], out=self.byte_at[1:])
        decoded = [t.decode("utf-8", "replace") for t in self.texts]
        self.chars = np.frombuffer("".join(decoded).encode("utf-32-le"), "<u4")
        self.char_at = np.zeros(len(decoded) + 1, np.int64)
        np.cumsum([len(t) for t in decoded], out=self.char_at[1:])

    def inside(self, at: np.ndarray, k: int) -> np.ndarray:
        """Which windows of k items, by start, stay in one text."""
        n = int(at[-1])
        good = np.ones(max(0, n - k + 1), bool)
        for i in range(1, k):
            cut = at[1:-1] - i
            good[cut[(cut >= 0) & (cut < len(good))]] = False
        return good

    def slots(self):
        """Arrays of (slot, text number) for each kind of n-gram."""
        for k in (1, 2):
            if len(self.hashes) >= k:
                good = self.inside(self.word_at, k)
                h = self.hashes if k == 1 else mix(self.hashes[:-1] * U64(3) + self.hashes[1:])
                yield (h & U64(WORD_SLOTS - 1)).astype(np.int32), good, self.word_at
        if len(self.chars) >= 3:
            three = (self.chars[:-2] * _FACTOR + self.chars[1:-1]) * _FACTOR + self.chars[2:]
            yield self._char_slot(three), self.inside(self.char_at, 3), self.char_at
            if len(self.chars) >= 4:
                yield self._char_slot(three[:-1] * _FACTOR + self.chars[3:]), self.inside(self.char_at, 4), self.char_at

    @staticmethod
    def _char_slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(2654435761) >> np.uint32(32 - 13)).astype(np.int32) + WORD_SLOTS

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: slots and relative frequencies (words and characters sum up to 1 each)."""
        total = np.zeros((len(self.texts), SLOTS), np.float32)
        for slot, good, at in self.slots():
            owner = np.searchsorted(at, np.flatnonzero(good), "right") - 1
            np.add.at(total, (owner, slot[good]), 1)
        for part in (slice(0, WORD_SLOTS), slice(WORD_SLOTS, SLOTS)):
            total[:, part] /= np.maximum(1, total[:, part].sum(1, keepdims=True))
        return [(x := np.flatnonzero(row).astype(np.int32), row[x]) for row in total]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The sums of weight * frequency, for each text."""
        top = np.zeros((2, len(self.texts)))
        n = np.zeros((2, len(self.texts)))
        for slot, good, at in self.slots():
            part = int(at is self.char_at)
            w = np.where(good, weights[slot], np.float32(0))
            ends = np.minimum(at, len(w))
            top[part] += sums_by(w, ends)
            n[part] += sums_by(good, ends)
        return (top / np.maximum(1, n)).sum(0)

    def base(self) -> dict[str, np.ndarray]:
        blank = np.zeros(256, bool)
        blank[list(BLANKS)] = True
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        chars = ((self.raw & 0xC0) != 0x80) & ~blank[self.raw]
        dup = []
        for t in self.texts:
            lines = [x for x in t.split(b"\n") if x.strip(BLANKS)]
            dup.append(len(lines) - len(set(lines)))
        return {
            "n_words": np.diff(self.word_at),
            "word_chars": sums_by(chars, self.byte_at),
            "n_symbols": sums_by(symbol[self.raw], self.byte_at),
            "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": self.repeats(),
        }

    def repeats(self) -> np.ndarray:
        """Words in windows that a text has at least twice."""
        n = len(self.hashes)
        if n < WINDOW:
            return np.zeros(len(self.texts), np.int64)
        good = np.flatnonzero(self.inside(self.word_at, WINDOW))
        owner = (np.searchsorted(self.word_at, good, "right") - 1).astype(U64)
        one = rolling(prefix(self.hashes), WINDOW)[good] ^ (owner * U64(0xD6E8FEB86659FD93))
        two = rolling(prefix(self.hashes, 1), WINDOW, 1)[good]
        order = np.argsort(one)
        one, two, owner = one[order], two[order], owner[order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (owner[1:] == owner[:-1])
        twice = np.zeros(len(good), bool)
        twice[1:] |= same
        twice[:-1] |= same
        return sums_by(covered(good[order[twice]], WINDOW, n), self.word_at)


@dataclass
class Head:
    """One calibrated linear classifier: probability = sigmoid(slope * (score + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (scores + self.bias) + self.shift, -40, 40)))


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Accelerated gradient descent on the weighted logistic loss; the last column of x is 1, rows of weight 0 don't count."""
    w = v = np.zeros(x.shape[1], np.float32)
    total = np.float32(max(1e-6, weight.sum()))
    rate = np.float32(4 / max(1e-6, float(weight @ np.einsum("ij,ij->i", x, x)) / total))
    momentum = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        grad = (weight * (p - y) / total) @ x + np.float32(ridge) * v
        new = v - rate * grad
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, w, momentum = new + np.float32((momentum - 1) / after) * (new - w), new, after
    return w


def fit_head(x: np.ndarray, y: np.ndarray, held_out: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> Head | None:
    """Fits on the rows that aren't held out, calibrates on those that are. None if a class has no row on either side. The last
    column of x is 1; the others are scaled in place."""
    if not len(y) or any(len(set(y[rows])) < 2 for rows in (held_out, ~held_out)):
        return None
    ours = (~held_out).astype(np.float32)
    scale = (1 / np.sqrt((ours @ x) / ours.sum() + 1e-4)).astype(np.float32)
    scale[-1] = 1
    x *= scale
    share = y[~held_out].mean()
    w = _descend(x, y, ours * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32), ridge, steps)
    score = (x @ w)[held_out]
    spread = max(1e-3, float(score.std()))
    line = np.stack([score / spread, np.ones(len(score), np.float32)], 1).astype(np.float32)
    ab = _descend(line, y[held_out], np.ones(len(score), np.float32), 1e-3, 300)
    if ab[0] <= 0:
        ab = np.array([spread, 0], np.float32)
    return Head((w * scale)[:-1].astype(np.float32), float(w[-1]), float(ab[0] / spread), float(ab[1]))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Head | None:
    """Fits the quality classifier on at most ``sample`` labelled texts. Labels without a text, or null, are left out; of
    several labels, or texts, of one doc_id the smallest counts. Without both classes there is no classifier (None), and the
    base rules alone decide."""
    ship(spark)
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        store = WordHashes()
        for batch in slices(batches, most=1 << 18):
            got = Features(texts_of(batch.column("text")), store).vectors()
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([x.astype(np.uint16).tobytes() for x, _ in got], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary()),
                ],
                names=["doc_id", "quality", "slots", "shares"],
            )

    found = rows.mapInArrow(run, "doc_id long, quality int, slots binary, shares binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("slots", "shares", "quality")).alias("row"))  # one text for each doc_id
    got = found.select("doc_id", "row.*").toArrow().sort_by("doc_id").to_pylist()
    x = np.zeros((len(got), SLOTS + 1), np.float32)
    x[:, -1] = 1
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["slots"], np.uint16)] = np.frombuffer(r["shares"], np.float32)
    ids = np.array([r["doc_id"] for r in got], np.int64).astype(U64)
    held = (mix(ids) & U64(3)) == 0
    return fit_head(x, np.array([r["quality"] for r in got], np.float32), held)


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64())]
    + [("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [("quality_prob", pa.float64())]
)
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, quality_prob double"
)


def judge(batch: pa.RecordBatch, model: Head | None, store: WordHashes) -> dict[str, np.ndarray]:
    f = Features(texts_of(batch.column("text")), store)
    out = f.base()
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["quality_prob"] = model.probability(f.scores(model.weights)) if model else np.ones(len(f.texts))
    out["kept"] = ~out["base_failed"] & (out["quality_prob"] >= KEEP_FROM)
    return out


def score(spark: SparkSession, docs: DataFrame, model: Head | None) -> DataFrame:
    """Counts and decisions for every whole text (columns: ``DDL``). A null or empty text has no words and fails the base
    rule. Repeated rows and null doc_ids keep their rows; other columns are left out; no rows give no rows."""
    ship(spark)

    def run(batches):
        store = WordHashes()
        for batch in slices(batches, most=1 << 20):
            out = judge(batch, model, store)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(out[k]) for k in OUT.names[1:])], schema=OUT)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, DDL)


def keep_good(spark: SparkSession, docs: DataFrame, model: Head | None) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    ship(spark)

    def run(batches):
        store = WordHashes()
        for batch in slices(batches, most=1 << 20):
            yield batch.filter(pa.array(judge(batch, model, store)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the base rules and the classifier trained on ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(spark, docs, train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
