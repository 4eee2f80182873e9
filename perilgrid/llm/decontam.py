"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are cut into passages of ``LENGTH`` bytes, one every ``STRIDE``. If a region of a document is within ``EDITS``
edits of a passage, the two share at least ``LENGTH - Q + 1 - Q * EDITS`` q-grams, on diagonals that differ by at most EDITS.

1. A bitmap of the benchmark's q-grams goes to every task. The only pass over the documents keeps the regions that are dense
   enough in q-grams of any item; the same region of many documents is one row from there on.
2. Regions and items are joined on q-grams and shared ones are counted by aggregation. Each passage is indexed by its rarest
   q-grams only, as many as a region within the budget must share some of, so that common q-grams join nothing.
3. For the pairs left, shared q-grams are counted in overlapping diagonal bands, bands that meet the bound are retained, and a
   banded alignment verifies all of a batch at once. Passages found side by side must cover ``LEAST`` bytes of the item: such a
   *stretch* is what a region holds or not.

A stretch that several items have is searched in one of them only, its home, so that a sentence that all items share meets each
region once. Whoever asks for pairs of documents and items gets them from the stretches; the query and the pipeline don't.

Shorter items are found unchanged, as whole words, and those of one or two words only as a whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.hashing import U64
from perilgrid.llm.runtime import Frozen, ship, slices, texts_of

Q, LENGTH, STRIDE, LEAST = 8, 44, 4, 48
#: Edits in a passage.
EDITS = 2
NEED = LENGTH - Q + 1 - Q * EDITS
#: How many more q-grams than the bound asks for a passage is indexed by; a pair must share as many more.
SLACK = 8
#: Regions are cut into pieces of so many bytes that overlap by more than LEAST and its edits.
PIECE, OVERLAP = 1024, 64
#: Slots of the bitmap for each byte of benchmark text, and its size at most (64 MB): beyond, it only passes more.
SLOTS, MOST_BITS = 16, 26
#: Passages that are counted, and bands that are aligned, at once.
BLOCK, TOGETHER = 128, 4096
_SPREAD = U64(0x9E3779B97F4A7C15)
_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_START, _END = b"\x02\x02\x02 ", b" \x03\x03\x03"


def normalise(text: bytes) -> bytes:
    """Lower case, ASCII punctuation as blanks, single blanks."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split())


def framed(clean: bytes) -> bytes:
    """A document with marks that no text has at both ends."""
    return _START + clean + _END


def passages(clean: bytes, among: list[int] | None = None) -> tuple[list[tuple[int, bytes]], bool]:
    """(place, passage) of a normalised item, and whether they must be found unchanged. Of a long item only the places ``among``
    those given."""
    if len(clean) < LEAST:
        short = b" " + clean + b" "
        whole = clean.count(b" ") < 2 or len(short) < Q
        return ([(0, framed(clean) if whole else short)] if clean else []), True
    starts = list(range(0, len(clean) - LENGTH + 1, STRIDE))
    if starts[-1] + LENGTH < len(clean):
        starts.append(len(clean) - LENGTH)
    if among is not None:
        starts = sorted(set(starts).intersection(among))
    return [(s, clean[s : s + LENGTH]) for s in starts], False


def stretches(clean: bytes) -> list[tuple[bytes, list[int]]]:
    """(key, places) of the shortest runs of passages that cover LEAST bytes of an item: any run that counts is made of such. A key
    stands for the bytes and the places in them. A shorter item is one stretch."""
    units, exact = passages(clean)
    if exact:
        return [(xxhash.xxh3_128_digest(b"whole " + clean), [0])] if clean else []
    starts = [s for s, _ in units]
    found = set()
    for i, s in enumerate(starts):
        j = next((j for j in range(i, len(starts)) if starts[j] + LENGTH - s >= LEAST), None)
        k = next((k for k in range(i, -1, -1) if s + LENGTH - starts[k] >= LEAST), None)
        found |= {(a, b) for a, b in ((i, j), (k, i)) if a is not None and b is not None}
    out = []
    for a, b in sorted(found):
        places = starts[a : b + 1]
        own = bytes(p - places[0] for p in places) + clean[places[0] : places[-1] + LENGTH]
        out.append((xxhash.xxh3_128_digest(own), places))
    return out


def codes(data: bytes) -> np.ndarray:
    """The q-grams at every place, as numbers."""
    n = len(data) - Q + 1
    out = np.empty(max(0, n), U64)
    for i in range(min(Q, max(0, n))):
        part = np.frombuffer(data, "<u8", (len(data) - i) // 8, i)
        out[i::Q] = part[: len(out[i::Q])]
    return out


def slots(code: np.ndarray, bits: int) -> np.ndarray:
    return (code * _SPREAD >> U64(64 - bits)).astype(np.int64)


def dense(data: bytes, ends: np.ndarray, bitmap: np.ndarray, bits: int, run: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(document, start, end, its q-grams that hit) of the pieces of regions that may hold a passage. ``data`` are framed
    documents that end at ``ends``; the bitmap has bit 0 for q-grams of long items and bit 1 for those of short ones, of which
    ``run`` in a row are needed (0: there are none)."""
    code = codes(data)
    flags = bitmap[slots(code, bits)]
    edge = np.zeros(len(data) + 1, np.int32)
    for bit, need, span in ((1, NEED, LENGTH + EDITS - Q + 1), (2, run, run)):
        if not need:
            continue
        sums = np.zeros(len(code) + 1, np.int32)
        np.cumsum(flags & bit > 0, out=sums[1:])
        span = min(span, len(code))
        at = np.flatnonzero(sums[span:] - sums[:-span] >= need)
        if len(at):
            cut = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            np.add.at(edge, at[cut], 1)
            np.add.at(edge, at[np.r_[cut[1:] - 1, len(at) - 1]] + span + Q - 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    if not inside.any():
        return []
    first, last = np.r_[True, ~inside[:-1]], np.r_[~inside[1:], True]
    first[ends[:-1]] = last[ends - 1] = True  # no region goes on into the next document
    out = []
    for a, b in zip(np.flatnonzero(inside & first).tolist(), (np.flatnonzero(inside & last) + 1).tolist(), strict=True):
        doc = int(np.searchsorted(ends, a, "right"))
        for x in range(a, max(a + 1, b - OVERLAP), PIECE - OVERLAP):
            y = min(b, x + PIECE)
            if y - x >= Q:
                own = slice(x, y - Q + 1)
                out.append((doc, x, y, np.unique(code[own][flags[own] > 0])))
    return out


@dataclass
class Index:
    """The q-grams of some distinct passages, of which ``offsets`` are the places in the item: sorted codes, and for each its
    places (passage, place in it)."""

    units: list[bytes]
    offsets: list[list[int]]

    def __post_init__(self):
        got = [codes(u) for u in self.units]
        code = np.concatenate(got)
        unit = np.repeat(np.arange(len(got)), [len(g) for g in got])
        off = np.concatenate([np.arange(len(g)) for g in got])
        order = np.argsort(code, kind="stable")
        self.unit, self.off = unit[order], off[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)

    def bands(self, code: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, lowest diagonal) of the bands of 2 * (2 * EDITS + 1) diagonals that meet the bound, for passages not found
        unchanged, in a region of these q-grams."""
        k = np.searchsorted(self.code, code)
        k[k == len(self.code)] = 0
        at = np.flatnonzero(self.code[k] == code)
        k = k[at]
        n = self.count[k]
        place = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else n
        unit, diagonal = self.unit[place], np.repeat(at, n) - self.off[place] + LENGTH
        mine = missing[unit]
        unit, band = unit[mine], diagonal[mine] // (2 * EDITS + 1)
        key = np.concatenate([unit << 32 | band, unit << 32 | np.maximum(0, band - 1)])
        key, times = np.unique(key, return_counts=True)
        key = key[times >= NEED]
        return key >> 32, (key & (1 << 32) - 1) * (2 * EDITS + 1) - LENGTH


@dataclass
class Item:
    """A normalised item's distinct passages in blocks."""

    blocks: list[Index]
    exact: bool

    @staticmethod
    def of(clean: bytes, among: list[int] | None = None) -> Item:
        found, exact = passages(clean, among)
        places: dict[bytes, list[int]] = {}
        for s, u in found:
            places.setdefault(u, []).append(s)
        every = list(places.items())
        return Item([Index(*map(list, zip(*every[i : i + BLOCK], strict=True))) for i in range(0, len(every), BLOCK)], exact)


def align(units: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The least edits between each unit (a row of m letters) and a part of its window that starts on one of the window's
    first len(window) - m + 1 diagonals, and stays there. One letter of all units at a time; 0 in a window is no letter."""
    m = units.shape[1]
    width = windows.shape[1] - m + 1
    steps = np.arange(width, dtype=np.int16)
    row = np.zeros((len(units), width), np.int16)
    for i in range(m):
        new = row + (windows[:, i : i + width] != units[:, i : i + 1])  # letter for letter
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # a letter of the unit left out
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # letters of the window added
    return row.min(1)


WIDTH = 2 * (2 * EDITS + 1) + 2 * EDITS  # diagonals of a band, and EDITS on either side


def matches(pairs: list[tuple[bytes, Item]]) -> list[dict[int, int]]:
    """For each (region, item) the places of the item's passages that the region holds, and their least edits. Passages side by
    side that cover fewer than LEAST bytes don't count."""
    found: list[dict[int, int]] = [{} for _ in pairs]
    waiting: list[tuple[int, list[int], bytes, bytes]] = []

    def settle():
        units, windows = (np.frombuffer(b"".join(x), np.uint8).reshape(len(waiting), -1) for x in zip(*(w[2:] for w in waiting), strict=True))
        for (k, places, *_), n in zip(waiting, align(units, windows).tolist(), strict=True):
            if n <= EDITS:
                for s in places:
                    found[k][s] = min(n, found[k].get(s, n))
        waiting.clear()

    for k, (region, item) in enumerate(pairs):
        code = codes(region)
        padded = bytes(LENGTH + EDITS) + region + bytes(WIDTH + 2 * LENGTH)
        for index in item.blocks:
            missing = np.ones(len(index.units), bool)
            for u, (unit, places) in enumerate(zip(index.units, index.offsets, strict=True)):
                if unit in region:
                    missing[u] = False
                    found[k].update(dict.fromkeys(places, 0))
            if item.exact or not missing.any():
                continue
            for u, low in zip(*(x.tolist() for x in index.bands(code, missing)), strict=True):
                at = low + LENGTH  # the band's lowest diagonal less EDITS, in the padded region
                waiting.append((k, index.offsets[u], index.units[u], padded[at : at + LENGTH + WIDTH - 1]))
                if len(waiting) >= TOGETHER:
                    settle()
    if waiting:
        settle()
    for (_, item), own in zip(pairs, found, strict=True):
        if not item.exact and own:
            places = np.array(sorted(own))
            run = np.split(places, np.flatnonzero(np.diff(places) > STRIDE) + 1)
            for part in run:
                if part[-1] + LENGTH - part[0] < LEAST:
                    for s in part.tolist():
                        del own[s]
    return found


def find(items: list[bytes], texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(number of the text, of the item, passages found, least edits), by comparing every text with every item: the operator
    without its search, for few and short ones."""
    known = [Item.of(normalise(t)) for t in items]
    out = []
    for n, t in enumerate(texts):
        for k, own in enumerate(matches([(framed(normalise(t)), x) for x in known])):
            if own:
                out.append((n, k, len(own), min(own.values())))
    return out


def _items(benchmark: DataFrame, frozen: Frozen) -> DataFrame:
    """(item_id, ikey, clean): items with their normalised texts, by a hash of which equal ones are one."""
    schema = pa.schema([("item_id", pa.int64()), ("ikey", pa.binary()), ("clean", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            clean = [normalise(t) for t in texts_of(batch.column("text"))]
            keys = [xxhash.xxh3_128_digest(c) for c in clean]
            yield pa.record_batch([batch.column("item_id"), pa.array(keys, pa.binary()), pa.array(clean, pa.binary())], schema=schema)

    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    return frozen(rows.mapInArrow(run, "item_id long, ikey binary, clean binary").filter(F.octet_length("clean") > 0), "items")


def _grams(distinct: DataFrame) -> DataFrame:
    """(ikey, code, short): every distinct q-gram of each item's passages."""
    schema = pa.schema([("ikey", pa.binary()), ("code", pa.int64()), ("short", pa.int32())])

    def run(batches):
        for batch in slices(batches, "clean"):
            for key, clean in zip(batch.column("ikey").to_pylist(), batch.column("clean").to_pylist(), strict=True):
                units, exact = passages(clean)
                code = np.unique(codes(units[0][1] if exact else clean)).view(np.int64)
                short = len(units[0][1]) - Q + 1 if exact else 0
                yield pa.record_batch([pa.array([key] * len(code), pa.binary()), pa.array(code), pa.array(np.full(len(code), short, np.int32))], schema=schema)

    return distinct.select("ikey", "clean").mapInArrow(run, "ikey binary, code long, short int")


def _bitmap(spark: SparkSession, grams: DataFrame, n_bytes: int) -> tuple[np.ndarray, int, int]:
    """The bitmap, its bits, and the shortest run of a short item (0 without any). At most 2**MOST_BITS slots of two bits; the
    driver gets them eight to a number."""
    bits = int(np.clip(np.ceil(np.log2(SLOTS * max(1, n_bytes))), 16, MOST_BITS))

    def run(batches):
        for batch in batches:
            at = slots(batch.column("code").to_numpy().view(U64), bits)
            flag = np.where(batch.column("short").to_numpy() > 0, 2, 1).astype(np.int64)
            yield pa.record_batch([pa.array(at >> 3), pa.array(flag << (8 * (at & 7)))], names=["word", "flags"])

    words = grams.select("code", "short").mapInArrow(run, "word long, flags long").groupBy("word").agg(F.bit_or("flags").alias("flags"))
    table = words.toArrow()
    out = np.zeros(1 << bits - 3, np.int64)
    out[table.column("word").to_numpy()] = table.column("flags").to_numpy()
    shortest = grams.filter("short > 0").agg(F.min("short")).first()[0]
    return out.view(np.uint8), bits, shortest or 0


def _index(distinct: DataFrame, grams: DataFrame) -> DataFrame:
    """(code, ikey, need): the q-grams that each item is indexed by, and how many of them a region must share. Of every
    passage the rarest q-grams are taken; one task holds one item at a time."""
    schema = pa.schema([("code", pa.int64()), ("ikey", pa.binary()), ("need", pa.int32())])

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        code = left.column("code").to_numpy().view(U64)
        order = np.argsort(code)
        code, often = code[order], left.column("often").to_numpy()[order]
        rank = np.empty(len(code), np.int64)
        rank[np.lexsort((code, often))] = np.arange(len(code))
        clean, key, among = (right.column(c)[0].as_py() for c in ("clean", "ikey", "starts"))
        chosen, needs = np.zeros(len(code), bool), []
        units, exact = passages(clean, among)
        for unit in {u for _, u in units}:
            own = np.unique(np.searchsorted(code, codes(unit)))
            need = len(own) if exact else max(1, len(own) - Q * EDITS)
            most = min(len(own), len(own) - need + 1 + SLACK)
            chosen[own[np.argsort(rank[own])[:most]]] = True
            needs.append(need - (len(own) - most))
        code = code[chosen].view(np.int64)
        return pa.table([pa.array(code), pa.array([key] * len(code), pa.binary()), pa.array(np.full(len(code), min(needs), np.int32))], schema=schema)

    often = grams.groupBy("code").agg(F.count("*").alias("often"))
    left = grams.join(often, "code").join(distinct.select("ikey"), "ikey", "left_semi").select("ikey", "code", "often").groupBy("ikey")
    return left.cogroup(distinct.select("ikey", "clean", "starts").groupBy("ikey")).applyInArrow(choose, "code long, ikey binary, need int")


def _stretches(distinct: DataFrame) -> DataFrame:
    """(skey, ikey, places): every item's stretches."""
    schema = pa.schema([("skey", pa.binary()), ("ikey", pa.binary()), ("places", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, "clean"):
            for key, clean in zip(batch.column("ikey").to_pylist(), batch.column("clean").to_pylist(), strict=True):
                keys, places = zip(*stretches(clean), strict=True)
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([key] * len(keys), pa.binary()), pa.array(places, pa.list_(pa.int64()))], schema=schema)

    return distinct.select("ikey", "clean").mapInArrow(run, "skey binary, ikey binary, places array<long>")


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, frozen: Frozen) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, x, y, rkey) of the documents' regions, (rkey, skey, edits) of the stretches found in them, (skey, ikey, places) of
    the items' stretches, and (item_id, ikey); x and y are hashes of the document's text, edits are those of the stretch's
    passages."""
    ship(spark)
    items = _items(benchmark, frozen)
    whole = frozen(items.dropDuplicates(["ikey"]).select("ikey", "clean"), "distinct-items")
    parts = frozen(_stretches(whole), "stretches")
    # a stretch is searched in the first item that has it; items without such stretches aren't searched
    homes = parts.groupBy("skey").agg(F.min(F.struct("ikey", "places")).alias("home")).select("home.*")
    homes = homes.groupBy("ikey").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("starts"))
    distinct = frozen(whole.join(homes, "ikey"), "homes")
    grams = frozen(_grams(whole), "grams")
    n_bytes = whole.agg(F.sum(F.octet_length("clean"))).first()[0] or 0
    bitmap, bits, shortest = _bitmap(spark, grams, n_bytes)
    sent = spark.sparkContext.broadcast(bitmap)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("rkey", pa.binary()), ("text", pa.binary()), ("codes", pa.list_(pa.int64()))])

    def regions(batches):
        bitmap = sent.value
        for batch in slices(batches, most=1 << 20):
            data = [framed(normalise(t)) for t in texts_of(batch.column("text"))]
            ends = np.cumsum([len(c) for c in data])
            data = b"".join(data)
            got = dense(data, ends, bitmap, bits, shortest)
            if got:
                doc = pa.array([d for d, *_ in got])
                parts = [data[a:b] for _, a, b, _ in got]
                keys = [xxhash.xxh3_128_digest(p) for p in parts]
                at = np.cumsum([0, *(len(c) for *_, c in got)]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([c for *_, c in got]).view(np.int64)))
                own = [batch.column(c).take(doc) for c in ("doc_id", "x", "y")]
                yield pa.record_batch([*own, pa.array(keys, pa.binary()), pa.array(parts, pa.binary()), grams], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), *text_key(), "text")
    every = frozen(rows.mapInArrow(regions, "doc_id long, x long, y long, rkey binary, text binary, codes array<long>"), "regions")
    once = frozen(every.groupBy("rkey").agg(F.first("text").alias("text"), F.first("codes").alias("codes")), "distinct-regions")
    shared = once.select("rkey", F.explode("codes").alias("code")).join(frozen(_index(distinct, grams), "index"), "code")
    pairs = shared.groupBy("rkey", "ikey").agg(F.count("*").alias("n"), F.first("need").alias("need")).filter("n >= need").select("rkey", "ikey")
    pairs = pairs.join(once.select("rkey", "text"), "rkey").join(distinct, "ikey")
    verdicts = pa.schema([("rkey", pa.binary()), ("skey", pa.binary()), ("edits", pa.list_(pa.int64()))])

    def verify(batches):
        known: dict[bytes, tuple[Item, list[tuple[bytes, list[int]]]]] = {}
        for batch in slices(batches, "clean", 1 << 20):
            rkeys, ikeys, texts, cleans, among = (batch.column(c).to_pylist() for c in ("rkey", "ikey", "text", "clean", "starts"))
            held = {}
            for k, c, starts in zip(ikeys, cleans, among, strict=True):
                if k not in held:
                    if len(known) > 1000:
                        known.clear()
                    held[k] = known[k] = known.get(k) or (Item.of(c, starts), stretches(c))
            got = matches([(t, held[k][0]) for t, k in zip(texts, ikeys, strict=True)])
            out = [(rkeys[n], key, [own[p] for p in places]) for n, own in enumerate(got) if own for key, places in held[ikeys[n]][1] if own.keys() >= set(places)]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), verdicts, strict=True)], schema=verdicts)

    verified = frozen(pairs.mapInArrow(verify, "rkey binary, skey binary, edits array<long>"), "verified")
    return every.select("doc_id", "x", "y", "rkey"), verified, parts, items.select("item_id", "ikey")


def text_key() -> list:
    """Two hashes of a text, for joins on its content."""
    return [F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), F.col("text")).alias("y")]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_passages, least_edits: a row for each document and benchmark item of which it holds a passage within
    the edit budget. Null and empty texts hold none, null and empty items are found nowhere; rows of one doc_id (null among
    them) are one document; other columns are left out; an empty table on either side gives no rows."""
    every, found, parts, items = _found(spark, docs, benchmark, Frozen(spark, "decontam"))
    hits = every.select("doc_id", "rkey").distinct().join(found, "rkey").join(parts, "skey").join(items, "ikey")
    hits = hits.select("doc_id", "item_id", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("edits").alias("edits"))))
    places = hits.groupBy("doc_id", "item_id", "place").agg(F.min("edits").alias("edits"))
    return places.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_passages"), F.min("edits").alias("least_edits"))


def contaminated_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_stretches, least_edits, item_id, n_items: a row for each document that holds a stretch of any item, with the number
    of distinct stretches, the least edits of a passage in them, the smallest item that has one of them, and how many items have
    the one that most items share. Items are cut every STRIDE bytes, so a sentence of many items is up to STRIDE stretches in the same
    place, each of some of the items. Rows and work don't grow with the number of items that share a text. Nulls, repeats, other
    columns and empty tables as in ``contaminated``."""
    every, found, parts, items = _found(spark, docs, benchmark, Frozen(spark, "decontam"))
    classes = parts.join(items, "ikey").groupBy("skey").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    held = found.groupBy("rkey", "skey").agg(F.min(F.array_min("edits")).alias("edits")).join(classes, "skey")
    hits = every.select("doc_id", "rkey").distinct().join(held, "rkey").groupBy("doc_id", "skey")
    hits = hits.agg(F.min("edits").alias("edits"), F.first("item_id").alias("item_id"), F.first("n_items").alias("n_items"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_stretches"), F.min("edits").alias("least_edits"), F.min("item_id").alias("item_id"), F.max("n_items").alias("n_items"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark passage, with all their columns, whatever their doc_id. Texts that hold one are
    joined away by 128 bits of hash."""
    every, found, _, _ = _found(spark, docs, benchmark, Frozen(spark, "decontam"))
    bad = every.join(found.select("rkey").distinct(), "rkey", "left_semi").select(F.col("x").alias("bad_x"), F.col("y").alias("bad_y")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("all"), *text_key())
    return rows.join(bad, (F.col("x") == F.col("bad_x")) & (F.col("y") == F.col("bad_y")), "left_anti").select("all.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated_documents(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
