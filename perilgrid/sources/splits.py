"""CSV records that go over several lines, read in splits.

Whether a line starts inside a quoted field depends on everything before it, but only as one of two states. So each split is a
function from the state at its start to the state at its end. The functions of all splits are found in one pass, composed in
file order, and then each split starts with its true state: it parses the records that start and end in it, and gives the
pieces of those that reach over its ends, which are put together by record. No task holds more than a split's batch and one
record.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilgrid.sources.frozen import Frozen

_TOKEN = re.compile(rb'[",]|[^",]+')
#: Places in a record: before a field, in an unquoted one, in a quoted one, behind a quote in a quoted one.
START, PLAIN, QUOTED, QUOTE = range(4)


def ends_open(line: bytes, is_open: bool) -> bool:
    """Whether the next line starts inside a quoted field, if this one does (or not). A quote opens a field only at its start."""
    if b'"' not in line:
        return is_open
    at = QUOTED if is_open else START
    for token in _TOKEN.findall(line):
        if token == b'"':
            at = {START: QUOTED, PLAIN: PLAIN, QUOTED: QUOTE, QUOTE: QUOTED}[at]
        elif at != QUOTED:
            at = START if token == b"," else PLAIN
    return at == QUOTED


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): the lines of all files as bytes, with the place where their split starts."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def split_functions(lines: DataFrame) -> DataFrame:
    """(file, split, closed, opened): whether a split ends inside a quoted field, if it starts outside (inside) one."""

    def run(batches):
        now, state = None, [False, True]
        for batch in batches:
            for file, split, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, split) != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([x]) for x in (*now, *state)], names=["file", "split", "closed", "opened"])
                    now, state = (file, split), [False, True]
                if b'"' in value:
                    state = [ends_open(value, x) for x in state]
        if now is not None:
            yield pa.record_batch([pa.array([x]) for x in (*now, *state)], names=["file", "split", "closed", "opened"])

    return lines.mapInArrow(run, "file string, split long, closed boolean, opened boolean")


def split_states(functions: DataFrame) -> DataFrame:
    """(file, split, is_open): whether a split starts inside a quoted field. The last split before it that ends the same way from
    either state settles it, up to the flips since."""
    order = Window.partitionBy("file").orderBy("split")
    flips = F.sum((F.col("closed") & ~F.col("opened")).cast("int")).over(order)
    fixed = F.when(F.col("closed") == F.col("opened"), F.struct(F.col("closed").alias("to"), F.col("flips").alias("at")))
    last = F.last(fixed, ignorenulls=True).over(order)
    after = functions.withColumn("flips", flips).withColumn("last", last)
    after = after.withColumn("ends", (F.coalesce(F.col("last.to"), F.lit(False)).cast("int") + F.col("flips") - F.coalesce(F.col("last.at"), F.lit(0))) % 2 == 1)
    return after.select("file", "split", F.coalesce(F.lag("ends").over(order), F.lit(False)).alias("is_open"))


#: Pieces of records: whole ones, the end of one that starts before the split, the start of one that ends after it, and both.
WHOLE, TAIL, HEAD, MIDDLE = range(4)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """From batches (file, split, value, is_open) of lines: lists of (file, split, number of the first line in the split, kind, raw)."""
    now, held, first, line, started, is_open = None, [], 0, 0, False, False

    def left() -> list[tuple]:
        if not held:
            return []
        kind = (HEAD if started else MIDDLE) if is_open else (WHOLE if started else TAIL)
        return [(*now, first, kind, b"\n".join(held))]

    for batch in batches:
        out = []
        for file, split, value, opened in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, split) != now:
                out += left()
                now, held, line, is_open, started = (file, split), [], 0, opened, not opened
            if not held:
                first = line
            held.append(value)
            is_open = ends_open(value, is_open)
            if not is_open:
                out += left()
                held, started = [], True
            line += 1
        yield out
    yield left()


def fields_of(raws: list[bytes], encoding: str) -> list[list[str]]:
    """The fields of records. A record may hold line ends in its quoted fields only; the one behind it doesn't count."""
    texts = (x.decode("utf-8" if encoding == "utf-8-sig" else encoding).removesuffix("\r") for x in raws)
    return [next(csv.reader([t]), []) for t in texts]


def read_split(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, list[str]]:
    """(_row_id, fields) of every record but the headers, and the header's fields. Ids rise in file order; files of a folder follow
    each other in the order of their names."""
    frozen, lines = Frozen(spark, "csv"), lines_of(spark, path)
    states = frozen(split_states(split_functions(lines)), "states")
    # a row of a hundred bytes for each split, for which the driver plans a task anyway; lines stay where they are, in order
    marked = lines.join(F.broadcast(states), ["file", "split"]).select("file", "split", "value", "is_open")
    files = {name: k for k, name in enumerate(sorted(r["file"] for r in states.select("file").distinct().collect()))}  # the driver lists them to read them

    def ids(file: str, split: int, line: int) -> int:
        return (files[file] << 42) + split + line - 1

    def cut(batches):
        """The pieces of records that reach over splits, and the first record of the first file."""
        for some in pieces(batches):
            rows = [x for x in some if x[3] != WHOLE or (x[1] == x[2] == 0 and files[x[0]] == 0)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["file", "split", "line", "kind", "raw"])

    parts = frozen(marked.mapInArrow(cut, "file string, split long, line long, kind int, raw binary"), "pieces")
    broken = parts.filter(F.col("kind") != WHOLE)
    number = F.sum((F.col("kind") == HEAD).cast("int")).over(Window.partitionBy("file").orderBy("split", "line", "kind"))
    joined = broken.withColumn("record", number).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("split", "line", "kind", "raw"))).alias("all")  # the pieces of one record
    )
    joined = frozen(joined.select("file", F.col("all")[0]["split"].alias("split"), F.col("all")[0]["line"].alias("line"), F.col("all.raw").alias("raws")), "joined")
    top = min(
        [(r["split"], r["line"], r["raw"]) for r in parts.filter((F.col("kind") == WHOLE) & (F.col("split") == 0) & (F.col("line") == 0)).collect()]  # one record
        + [(r["split"], r["line"], b"\n".join(r["raws"])) for r in joined.filter((F.col("split") == 0) & (F.col("line") == 0)).collect() if files[r["file"]] == 0],
        default=None,
    )
    head = fields_of([top[2].removeprefix(b"\xef\xbb\xbf")], encoding)[0] if top else []
    schema = pa.schema([("_row_id", pa.int64()), ("fields", pa.list_(pa.string()))])

    def close(rows: list[tuple]) -> pa.RecordBatch:
        fields = fields_of([raw for *_, raw in rows], encoding)
        kept = [(ids(f, s, k), x) for (f, s, k, _), x in zip(rows, fields, strict=True) if x]
        return pa.record_batch([pa.array([i for i, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.list_(pa.string()))], schema=schema)

    def parse(batches):
        for some in pieces(batches):
            yield close([(f, s, k, raw) for f, s, k, kind, raw in some if kind == WHOLE and s + k > 0])

    def mend(batches):
        for batch in batches:
            yield close([(f, s, k, b"\n".join(raws)) for f, s, k, raws in zip(*(c.to_pylist() for c in batch.columns), strict=True) if s + k > 0])

    ddl = "_row_id long, fields array<string>"
    return marked.mapInArrow(parse, ddl).unionByName(joined.select("file", "split", "line", "raws").mapInArrow(mend, ddl)), head
