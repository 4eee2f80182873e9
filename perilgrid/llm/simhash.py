"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is embedded as the bit counts of its segments of two bits. The Manhattan distance of two embeddings is
at most the Hamming distance of the fingerprints, so a range join under it loses no link. The segments are dealt to
``distance + BLOCKS`` blocks: two fingerprints within the distance have BLOCKS blocks without any difference, so their
embeddings meet in one of the cells of an integer grid that a choice of so many blocks makes. Every distinct fingerprint goes to
the cell of every choice; in a cell, candidates are filtered by the Manhattan distance of the whole embedding and verified by
the exact Hamming distance. A dense cell is split by the bits behind its counts, which such a pair shares as well.

A cell never lists all pairs of a dense group: it only links what isn't linked yet (a spanning forest). Equal fingerprints
are one point, so groups of exact copies have no weight here.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm import similar
from perilgrid.llm.hashing import U64, mix, shingle_hashes
from perilgrid.llm.runtime import Frozen, ship, slices, texts_of
from perilgrid.operators.components import connected_components

SHINGLE, DISTANCE = 4, 4
#: Blocks that a cell is made of, and fingerprints of a cell that is split.
BLOCKS, DENSE = 4, 64
_EVEN = U64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles; 0 if it has none."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(h: np.ndarray) -> int:
    """The SimHash of some hashes, by majority of each bit; 0 if there are none."""
    if not len(h):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        set_bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): key is a hash of the text, fp the fingerprint as a signed long. A null or empty text has fingerprint
    zero."""
    ship(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts_of(batch.column("text"))], U64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(fp, pa.int64())], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments of two bits, two bits for each."""
    return (fp & _EVEN) + (fp >> U64(1) & _EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of two embeddings of counts 0, 1 and 2."""
    # with counts written in unary (1 -> 01, 2 -> 11) the distance is the number of differing bits
    return np.bitwise_count(unary(a) ^ unary(b))


def unary(x: np.ndarray) -> np.ndarray:
    two = x >> U64(1) & _EVEN
    return x & _EVEN | two | two << U64(1)


def choices(distance: int) -> np.ndarray:
    """For every choice of blocks, a mask of their bits."""
    n = distance + BLOCKS
    edges = [2 * (32 * k // n) for k in range(n + 1)]
    masks = [sum(1 << bit for bit in range(low, high)) for low, high in zip(edges, edges[1:], strict=False)]
    return np.array([sum(some) for some in combinations(masks, BLOCKS)], U64)


def cells(fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The grid cell of each fingerprint for every choice: a row for each fingerprint. A hash of the counts and the choice stands
    for a cell; should two cells ever share one, they are searched together."""
    return mix((embed(fp)[:, None] & masks) ^ mix(masks.copy()))


def link_cell(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The components of one cell's distinct fingerprints, in order: pairs of places, of a component's smallest fingerprint and
    of each other one. A fingerprint is compared with those that nothing reached yet, so a dense group costs little more than
    its size."""
    x = unary(embed(fp))
    rest, left, right = np.arange(1, len(fp)), [], []
    waiting, first = [0], 0
    while len(rest):
        if not waiting:
            first, rest = int(rest[0]), rest[1:]
            waiting = [first]
            continue
        i = waiting.pop()
        near = np.flatnonzero(np.bitwise_count(x[rest] ^ x[i]) <= distance)
        near = near[np.bitwise_count(fp[rest[near]] ^ fp[i]) <= distance]
        if len(near):
            got = rest[near]
            left.append(np.full(len(got), first))
            right.append(got)
            waiting += got.tolist()
            rest = np.delete(rest, near)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def split_dense(cell: np.ndarray, fp: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (cell, fp) with cells of over DENSE fingerprints split by the bits of their blocks."""
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length = np.diff(np.r_[head, len(cell)])
    dense = np.repeat(length > DENSE, length)
    if not dense.any():
        return cell, fp
    own_cell, own = cell[dense], fp[dense]
    lead = head[length > DENSE]
    mask = masks[np.argmax(cells(fp[lead], masks) == cell[lead].view(U64)[:, None], axis=1)]
    key = mix((own & np.repeat(mask, length[length > DENSE])) ^ own_cell.view(U64))
    order = np.lexsort((own, key))
    return np.concatenate([cell[~dense].view(U64), key[order]]), np.concatenate([fp[~dense], own[order]])


def link_sorted(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all cells of sorted (cell, fp)."""
    left, right = [], []
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length = np.diff(np.r_[head, len(cell)])
    x = unary(embed(fp))
    small = length <= 32
    if small.any():
        size = np.repeat(length, length)
        place = np.arange(len(cell)) - np.repeat(head, length)
        for k in range(1, int(length[small].max())):
            i = np.flatnonzero((size <= 32) & (place + k < size))
            i = i[np.bitwise_count(x[i] ^ x[i + k]) <= distance]
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= distance]
            left.append(fp[i])
            right.append(fp[i + k])
    for at, n in zip(head[~small].tolist(), length[~small].tolist(), strict=True):
        own = fp[at : at + n]
        i, j = link_cell(own, distance)
        left.append(own[i])
        right.append(own[j])
    if not left:
        return np.empty(0, U64), np.empty(0, U64)
    return np.concatenate(left), np.concatenate(right)


def links(spark: SparkSession, distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all pairs within the distance."""
    ship(spark)
    masks = choices(distance)
    key_schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(U64)
            for at in range(0, len(fp), 1 << 12):
                part = fp[at : at + (1 << 12)]
                cell = cells(part, masks).reshape(-1)
                yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], schema=key_schema)

    def join(batches):
        def close(cell, fp):
            a, b = link_sorted(*split_dense(cell, fp.view(U64), masks), distance)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        waiting = []
        for batch in batches:
            cell, fp = (batch.column(c).to_numpy() for c in ("cell", "fp"))
            if not len(cell):
                continue
            waiting.append((cell, fp))
            if cell[0] == cell[-1] == waiting[0][0][0]:
                continue  # one cell so far
            held_cell, held_fp = (np.concatenate(z) for z in zip(*waiting, strict=True))
            cut = np.searchsorted(held_cell, held_cell[-1])
            yield close(held_cell[:cut], held_fp[:cut])
            waiting = [(held_cell[cut:], held_fp[cut:])]
        if waiting:
            yield close(*(np.concatenate(z) for z in zip(*waiting, strict=True)))

    keyed = distinct.select("fp").mapInArrow(spread, "cell long, fp long")
    return keyed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(join, "a long, b long")


def classes(spark: SparkSession, prints: DataFrame, frozen: Frozen, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id): for each distinct fingerprint the smallest fingerprint and the smallest doc_id reachable by
    links (null if all of them are null)."""
    distinct = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = connected_components(frozen(links(spark, distinct, distance), "links"), frozen)
    known = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = known.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    return frozen(known.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every document.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable. Null and empty
    texts have fingerprint zero and link like any other. Repeated rows keep their rows; null doc_ids never name a component
    unless all of it is null; other columns are left out; no rows give no rows."""
    frozen = Frozen(spark, "simhash")
    prints = frozen(fingerprints(spark, docs, shingle), "prints")
    found = classes(spark, prints, frozen, distance)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rows_of(docs: DataFrame, prints: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that (kept_id, kept_key) name, one of equal ones; ``prints`` has doc_id and key of every row."""
    names = docs.columns
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64("text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("all"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    unique = prints.groupBy("doc_id", "key").count().filter("count > 1").limit(1).isEmpty()
    return (rows if unique else rows.dropDuplicates(["id", "key"])).select("all.*")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns. Among equal doc_ids of a group the
    smallest hash of the text decides, and of equal rows one stays; null doc_ids come last."""
    frozen = Frozen(spark, "simhash")
    prints = frozen(fingerprints(spark, docs, shingle), "prints")
    found = classes(spark, prints, frozen, distance)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = prints.join(found, "fp").groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    kept = frozen(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key")), "kept")
    return rows_of(docs, prints, kept)


def _described(spark: SparkSession, docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, fp, sim, bands, sig): key is a hash of the text, fp one of the set of its shingles, sim the SimHash, bands and
    sig tell the set's minima. Null and empty texts have the empty set."""
    ship(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.binary()), ("sim", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            hashes = [shingle_hashes(t, shingle) for t in texts_of(batch.column("text"))]
            sets = [np.unique(h) for h in hashes]
            sim = np.array([of_hashes(h) for h in hashes], U64).view(np.int64)
            cells, sigs = zip(*(similar.signature(own) for own in sets), strict=True)
            at = np.cumsum([0, *map(len, cells)]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cells).view(np.int64)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array([similar.set_key(own) for own in sets], pa.binary()), pa.array(sim), cells, pa.array(sigs, pa.binary())], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, fp binary, sim long, bands array<long>, sig binary")


def keep_one_similar(spark: SparkSession, docs: DataFrame, shingle: int = 5, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with all its columns.

    Links are texts whose sets of shingles have a Jaccard similarity of ``similar.SIMILAR`` or more. Candidates are texts whose
    SimHashes are linked, and texts that share a band of minima; every link is verified, so a SimHash link alone joins nothing.
    Null and empty texts are copies of each other. Among equal doc_ids of a group the smallest hash of the text decides, and of
    equal rows one stays; null doc_ids come last; no rows give no rows. Other columns may have any names."""
    frozen = Frozen(spark, "simhash")
    every = frozen(_described(spark, docs, shingle), "described")
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    distinct = frozen(every.groupBy("fp").agg(rank, F.first("sim").alias("sim"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "sets")
    cells = distinct.select("fp", F.explode("bands").alias("cell"))
    # candidates by SimHash: texts of one fingerprint, and the first texts of linked ones
    heads = frozen(distinct.filter(F.size("bands") > 0).groupBy("sim").agg(F.min("fp").alias("head")), "prints")
    same = distinct.filter(F.size("bands") > 0).join(heads, "sim").filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    ends = [heads.select(F.col("sim").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b")]
    linked = links(spark, heads.select(F.col("sim").alias("fp")), distance).distinct()
    linked = linked.join(ends[0], "a").join(ends[1], "b").select(F.greatest("head_a", "head_b").alias("a"), F.least("head_a", "head_b").alias("b"))

    def texts(fps: DataFrame) -> DataFrame:
        named = distinct.join(fps, "fp", "left_semi").select("fp", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"))
        rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64("text").alias("key"), "text")
        rows = rows.join(named, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
        return rows.select("fp", "text").dropDuplicates(["fp"])

    roots = similar.verified_roots(cells, same.unionByName(linked), distinct.select("fp", "sig"), texts, shingle, frozen)
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = known.groupBy("root").agg(F.min("first").alias("first"))
    kept = frozen(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key")), "kept")
    return rows_of(docs, every, kept)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
