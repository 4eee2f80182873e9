"""Filter interaction audit: what each of five filters removes under every order in which they can be applied.

A document is a mask of the filters that it fails. A table of 32 masks by 120 orders, computed once, has the step at which a
mask is removed first. ``mapInArrow`` looks rows up in it and ``np.bincount`` counts removals by part, order, step and label;
each task gives an array for each part it saw, and the arrays are summed.

Copies are settled before: rows that agree in text, part and label are counted together, so a text that a third of all
documents share is a few rows when copies are compared, and what comes to the lookup is a count for each part, mask and label.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.runtime import Frozen, ship, slices, texts_of

FILTERS = "ABCDE"
ORDERS = ["".join(x) for x in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Labels of a row as a number: 1 for good, 2 for toxic, 3 for both.
LABELS = 4
#: Arrays for so many parts are held by a task before they are given.
PARTS = 256

CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"


def first_failures() -> np.ndarray:
    """32 masks by 120 orders: the step (from 0) whose filter removes the mask first; STEPS for the mask of no failure."""
    bits = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> bits) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def text_mask(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.decode("utf-8", "replace"))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * points) << 2
        | (len(text) != len(text.translate(None, MARKS))) << 3
    )


MASKED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("key", pa.binary())])


def mask_texts(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, key): the filters A to D that each text fails, and 128 bits that stand for the text."""

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("part").fill_null(""),
                    pa.array([text_mask(t) for t in texts], pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                ],
                schema=MASKED,
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{part}`").cast("string").alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, mask int, key binary")


def with_labels(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label``. A document is good (toxic) if any row of ``labels`` with its doc_id says so."""
    says = lambda c, x: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)) * x
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((says("quality", 1) + says("toxic", 2)).alias("label"))
    known = masked.filter("doc_id is not null").join(said, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return known.unionByName(masked.filter("doc_id is null").withColumn("label", F.lit(0)))


def with_copies(labelled: DataFrame) -> DataFrame:
    """(part, mask, label, n): counts of documents, with filter E in the mask: failed by a document whose text a smaller doc_id
    has too. Without a doc_id a document has none that is smaller, and is smaller than none."""
    same = ["key", "mask", "part", "label"]
    # for each kind of copies: how many there are, how many have no doc_id, and the smallest doc_id with its count
    once = labelled.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    kinds = once.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("free"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    least = kinds.groupBy("key").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("kinds"))
    # a text of one kind is its own first; only texts in several parts or labels need the others' doc_ids
    joined = kinds.join(least.filter("kinds > 1").select("key", "first"), "key", "left")
    first = (F.col("first").isNull() | (F.col("least.doc_id") == F.col("first"))) & F.col("least").isNotNull()
    kept = F.col("free") + F.when(first, F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))
    return joined.select("part", "label", F.inline(split)).filter("n > 0").groupBy("part", "mask", "label").agg(F.sum("n").alias("n"))


#: A part's array: removals by order, step and label, then counts by mask.
REMOVALS = len(ORDERS) * (STEPS + 1) * LABELS
WIDTH = REMOVALS + (1 << STEPS)


def partial_counts(counted: DataFrame) -> DataFrame:
    """(part, counts): arrays of removals by first-failure lookup, a row for each part that a task saw."""

    def arrays(held: dict[str, np.ndarray]):
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], names=["part", "counts"])

    def run(batches):
        table, held = first_failures(), {}
        for batch in batches:
            codes = batch.column("part").dictionary_encode()
            parts, which = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            mask, label, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "label", "n"))
            for at in range(0, len(parts), PARTS):
                here = np.flatnonzero((which >= at) & (which < at + PARTS))
                width = min(PARTS, len(parts) - at)
                sums = np.zeros((width, WIDTH), np.int64)
                for low in range(0, len(here), 4096):
                    rows = here[low : low + 4096]
                    place = (np.arange(len(ORDERS)) * (STEPS + 1) + table[mask[rows]]) * LABELS + label[rows, None]
                    place = np.concatenate([place, REMOVALS + mask[rows, None]], axis=1) + (which[rows] - at)[:, None] * WIDTH
                    # bincount's weights are doubles, so sums over 2^53 are added in two halves
                    for shift in (0, 26):
                        half = (n[rows] >> shift) if shift else n[rows] & ((1 << 26) - 1)
                        found = np.bincount(place.ravel(), np.repeat(half, place.shape[1]), width * WIDTH)
                        sums += found.astype(np.int64).reshape(width, WIDTH) << shift
                for k in range(width):
                    held[parts[at + k]] = held.get(parts[at + k], 0) + sums[k]
                if len(held) > PARTS:
                    yield from arrays(held)
                    held = {}
        if held:
            yield from arrays(held)

    return counted.select("part", "mask", "label", "n").repartition("part").mapInArrow(run, "part string, counts array<long>")


REPORT = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)
REPORT_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report_of(part: str, counts: np.ndarray) -> pa.RecordBatch:
    """A part's rows from its summed array."""
    removals = counts[:REMOVALS].reshape(len(ORDERS), STEPS + 1, LABELS)
    masks = counts[REMOVALS:]
    bits = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    fails, alone = masks @ bits, masks[1 << np.arange(STEPS)]
    which = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    removed = removals[:, :STEPS].sum(axis=2)
    shapley = np.zeros(STEPS, np.int64)
    np.add.at(shapley, which.ravel(), removed.ravel())
    kept = masks.sum() - removed.cumsum(axis=1)
    columns = [kept, removed, fails[which] - removed, alone[which], removals[:, :STEPS, [1, 3]].sum(axis=2), removals[:, :STEPS, [2, 3]].sum(axis=2), shapley[which]]
    names = [x for order in ORDERS for x in [order] * STEPS]
    steps = np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
    return pa.record_batch([pa.array([part] * len(names)), pa.array(names), pa.array(steps), *(pa.array(c.ravel()) for c in columns)], schema=REPORT)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """How the filters A to E interact, for each part of ``docs`` (doc_id, text and the part's column), order and step: kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null part the empty string. A null doc_id has no label and no smaller or larger doc_ids, so it never
    fails E. Repeated rows count each, rows of one doc_id are no copies of each other. A text that is very long is one row of a
    task, and its words are held there. Columns of other names play no role; without documents there are no rows."""
    ship(spark)
    masked = Frozen(spark, "audit")(mask_texts(docs, part), "masks")
    counted = with_copies(with_labels(masked, labels))
    arrays = partial_counts(counted).repartition("part").sortWithinPartitions("part")

    def run(batches):
        part, counts = None, 0
        for batch in batches:
            for name, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != part and part is not None:
                    yield report_of(part, counts)
                    counts = 0
                part, counts = name, counts + np.array(more, np.int64)
        if part is not None:
            yield report_of(part, counts)

    return arrays.mapInArrow(run, REPORT_DDL)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents`` by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT d.*, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f, count(*) AS n
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, o, k AS step, o[k] AS filter, good, toxic, n, f[o[k]] AS fails, len(list_filter(o[:k - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda b: b)) = 1 AS one FROM m, o, x),
g AS (SELECT part, o, step, filter, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed, sum(n) FILTER (WHERE fails AND gone) AS redundant,
  sum(n) FILTER (WHERE fails AND one) AS unique_fails, sum(n) FILTER (WHERE fails AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (WHERE fails AND NOT gone AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM g
"""
