"""Verified links between near copies: texts whose sets of shingles have a Jaccard similarity of ``SIMILAR`` or more.

No radius of 64-bit fingerprints covers a similarity of 0.8 (see the README), so fingerprints alone can't decide. Candidates meet
in *cells*: texts that agree in all minima of one MinHash band; links of SimHash are candidates as well. Two texts of similarity s differ in
every band with a probability of ``(1 - s**ROWS)**BANDS``: 3e-6 at 0.8, and less above.

The members of a cell are compared in rounds. The first compares every member with the cell's smallest one. Members that aren't
connected with it then (centres) are compared with all members, some SLICES * CENTRES of a cell in a round, chosen by hash, until all
have been; members whose smallest one reached them all need no second round. A comparison first
counts the minima that two signatures share: at least ``LIKELY`` of BANDS * ROWS, which a pair at 0.8 misses with a probability of
4e-6. Only texts with such a partner are fetched, and verified on their whole shingle sets inside the task. Members of a cell are
dealt to tasks by hash: no task gets a whole cell. Pairs are never listed: a task gives the texts concerned, and then the links that
connect what wasn't connected yet. Texts with equal sets are one point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.hashing import U64, mix, shingle_hashes
from perilgrid.llm.runtime import Frozen, slices, texts_of
from perilgrid.operators.components import HEAVY, connected_components, join_sized

#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 5
#: Minima that a pair must share before it is verified.
LIKELY = int(BANDS * ROWS * 0.66)
#: Members of a cell in one task, and centres of a cell; so many times as many centres are compared in a round.
TOGETHER, CENTRES, SLICES = 500, 1024, 8
_FACTORS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_BAND = np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)


def set_key(own: np.ndarray) -> bytes:
    """A hash of a set of shingles."""
    return xxhash.xxh3_128_digest(own.tobytes())


def signature(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One number for each band of a set's minima, and a byte of each minimum; none for an empty set."""
    if not len(own):
        return np.empty(0, U64), b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    low = own.astype(np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024, None] * _FACTORS).min(0), out=least)
    a, b, c, d, e = least.astype(U64).reshape(BANDS, ROWS).T
    return mix(mix(mix(a << U64(32) | b) + (c << U64(32) | d)) + e + _BAND), (least >> np.uint32(8)).astype(np.uint8).tobytes()


class Centres:
    """Some non-empty sets that others are compared with, as one sorted list of shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(c) for c in sets])
        item = np.concatenate(sets)
        order = np.argsort(item, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.item, self.first, self.count = np.unique(item[order], return_index=True, return_counts=True)

    def similar(self, own: np.ndarray) -> list[int]:
        """The numbers of the sets that are similar to a non-empty one."""
        up, down = SIMILAR
        k = np.searchsorted(self.item, own)
        k[k == len(self.item)] = 0
        k = k[self.item[k] == own]
        n = self.count[k]
        at = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else n
        both = np.bincount(self.owner[at], minlength=len(self.size))
        # both / (all of the two - both) >= up / down
        return np.flatnonzero(both * (up + down) >= up * (self.size + len(own))).tolist()


def _parted(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "member", "fp")


def _heavy_from(sized: DataFrame) -> int | None:
    """From how many rows on a key is heavy; None if none is."""
    total, most = sized.agg(F.sum("n"), F.max("n")).first()
    least = max(TOGETHER, (total or 0) // HEAVY)
    return least if most and most > least else None


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _likely(rows: DataFrame) -> DataFrame:
    """Those of the rows (cell, part, member, fp, root, sig), without sig, that share enough minima with a centre (or member) of
    their part that they aren't connected with yet. A part has TOGETHER members or so and a round's centres."""
    schema = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("member", pa.bool_()), ("fp", pa.binary()), ("root", pa.binary())])

    def near(part, members, centres, hit):
        if members and centres:
            roots = [c[1] for c in centres]
            theirs = np.frombuffer(b"".join(c[2] for c in centres), np.uint8).reshape(len(centres), -1)
            for fp, root, sig in members:
                like = [c for c in np.flatnonzero((theirs == np.frombuffer(sig, np.uint8)).sum(1) >= LIKELY).tolist() if roots[c] != root]
                if like:
                    hit.update(like)
                    yield (*part, True, fp, root)

    def run(batches):
        part, centres, members, hit = None, [], [], set()
        for batch in batches:
            out = []
            for cell, k, member, fp, root, sig in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "member", "fp", "root", "sig")), strict=True):
                if (cell, k) != part:
                    out += near(part, members, centres, hit)
                    out += [(*part, False, *centres[c][:2]) for c in hit]
                    part, centres, members, hit = (cell, k), [], [], set()
                (members if member else centres).append((fp, root, sig))
            out += near(part, members, centres, hit)
            members = []
            if out:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if hit:
            out = [(*part, False, *centres[c][:2]) for c in hit]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = _parted(rows.select("cell", "part", "member", "fp", "root", "sig"))
    return rows.mapInArrow(run, "cell long, part int, member boolean, fp binary, root binary")


def _linked(rows: DataFrame, shingle: int) -> DataFrame:
    """(a, b): links of the rows (cell, part, member, fp, root, text) that connect what wasn't connected in their part yet. A part
    has the centres' sets in memory and one member's at a time."""

    def run(batches):
        part, centres, sets, known, up = None, [], [], None, {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in slices(batches, most=1 << 20):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("cell", "part", "member", "fp", "root"))
            for cell, k, member, fp, root, text in zip(*columns, texts_of(batch.column("text")), strict=True):
                if (cell, k) != part:
                    part, centres, sets, known, up = (cell, k), [], [], None, {}
                own = np.unique(shingle_hashes(text, shingle))
                if not member:
                    centres.append((fp, root))
                    sets.append(own)
                elif centres:
                    if known is None:
                        known, sets = Centres(sets), []
                    for c in known.similar(own):
                        theirs, mine = find(centres[c][1]), find(root)
                        if theirs != mine:
                            up[theirs] = mine
                            out.append((fp, centres[c][0]))
            if out:
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], schema=LINKS)

    return _parted(rows).mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts, shingle: int, frozen: Frozen, name: str) -> DataFrame:
    """Those of the distinct pairs (a, b) that are similar. The partners of one b are dealt to parts; a part has b's set in memory
    and one partner's at a time."""
    pairs = frozen(pairs, f"likely-{name}")
    degrees = pairs.groupBy(F.col("b").alias("cell")).agg(F.count("*").alias("n"))
    degrees = frozen(degrees.withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int")), f"degrees-{name}")
    ours = join_sized(pairs.select(F.col("b").alias("cell"), F.col("a").alias("fp")), "cell", degrees, _heavy_from(degrees))
    ours = ours.select("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "fp")
    theirs = degrees.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("cell").alias("fp"))
    named = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct()
    rows = ours.unionByName(theirs).join(texts(named), "fp")

    def run(batches):
        part, known, centre = None, None, None
        for batch in slices(batches, most=1 << 20):
            out = []
            columns = (batch.column(c).to_pylist() for c in ("cell", "part", "member", "fp"))
            for cell, k, member, fp, text in zip(*columns, texts_of(batch.column("text")), strict=True):
                own = np.unique(shingle_hashes(text, shingle))
                if not member:
                    part, known, centre = (cell, k), Centres([own]), fp
                elif (cell, k) == part and known.similar(own):
                    out.append((fp, centre))
            if out:
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], schema=LINKS)

    return _parted(rows).mapInArrow(run, "a binary, b binary")


def verified_roots(cells: DataFrame, pairs: DataFrame, signatures: DataFrame, texts, shingle: int, frozen: Frozen) -> DataFrame:
    """(node, root) for every fp that has a verified link: the smallest fp of its component. ``cells`` has (cell, fp) of every
    candidate, ``pairs`` candidates (a, b) besides them, ``signatures`` (fp, sig), ``texts(fps)`` gives (fp, text) for some."""
    known = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("centre"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("mark"))
    same = known.filter("n > 1").groupBy("n", "centre", "mark").agg(F.min("cell").alias("cell"))  # of cells with the same members one
    same = frozen(same.select("cell", "n", "centre"), "cells")
    heavy_from = _heavy_from(same)
    members = join_sized(cells, "cell", same, heavy_from).withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int"))
    members = members.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    members = frozen(members.join(signatures, "fp"), "members")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    placed = members.withColumn("root", F.col("fp"))
    centres = placed.filter("fp = centre").withColumns({"slices": F.lit(1), "slice": F.lit(0)})
    in_slice = (F.col("part") * SLICES + F.col("slice")).alias("part")
    edges, roots, done, k = None, None, None, 0
    while True:
        if roots is None:
            ours = placed.withColumn("slice", F.lit(0))
        else:
            ours = join_sized(placed.drop("n"), "cell", centres.select("cell", "n", "slices").distinct(), heavy_from)
            ours = ours.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        rows = ours.select("cell", in_slice, F.lit(True).alias("member"), "fp", "root", "sig")
        theirs = centres.select("cell", every_part, "slice", "fp", "root", "sig")
        rows = rows.unionByName(theirs.select("cell", in_slice, F.lit(False).alias("member"), "fp", "root", "sig"))
        found = frozen(_likely(rows), f"found-{k}")
        more = _linked(found.join(texts(found.select("fp").distinct()), "fp"), shingle)
        if roots is None:
            more = more.unionByName(_verified(pairs, texts, shingle, frozen, "simhash"))
        edges = frozen(more if edges is None else edges.unionByName(more), f"links-{k}")
        roots = frozen(connected_components(edges, frozen, f"components-{k}"), f"roots-{k}")
        if k:
            new = centres.select("cell", "fp")
            done = new if done is None else frozen(done.unionByName(new), f"done-{k}")
        placed = members.join(roots, members["fp"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))
        main = placed.filter("fp = centre").select("cell", "n", F.col("root").alias("main"))
        others = join_sized(placed.drop("n"), "cell", main, heavy_from).filter("root <> main").drop("main")
        if done is not None:
            others = others.join(done, ["cell", "fp"], "left_anti")
        k += 1
        others = frozen(others.withColumn("h", F.xxhash64("fp", F.lit(k))), f"others-{k}")
        # of each cell an even share by hash, and its first in any case, so that every round gets on
        waiting = others.groupBy("cell").agg(F.count("*").alias("waiting"), F.min("h").alias("least"), F.first("n").alias("n"))
        chosen = join_sized(others.drop("n"), "cell", waiting, heavy_from)
        share = F.ceil(F.col("waiting") / (SLICES * CENTRES))
        slices = F.least(F.lit(SLICES), F.ceil(F.col("waiting") / CENTRES)).cast("int")
        chosen = chosen.filter((F.pmod("h", share) == 0) | (F.col("h") == F.col("least")))
        chosen = chosen.withColumns({"slices": slices, "slice": F.pmod(F.xxhash64(F.lit(-k), "fp"), slices).cast("int")})
        centres = frozen(chosen.drop("h", "least", "waiting"), f"centres-{k}")
        if centres.isEmpty():
            return roots
