"""Line dedup by distinct-site spread.

For every line a HyperLogLog sketch of the sites that hold it is built and merged by partial aggregation. Lines whose estimate
is clearly over the threshold are boilerplate, lines clearly below are not, and those near it get an exact distinct count.
Boilerplate lines go from all documents but the first that has them (and from their later places in it), so no content is
lost.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm.runtime import Frozen, ship, slices, texts_of

#: A line is boilerplate if so many sites have it; shorter lines never are.
MIN_SITES, MIN_CHARS = 8, 20
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over six standard errors of a sketch of this size.
NEAR = 0.15


def _row_key():
    """128 bits that stand for a row when decisions are joined back: the same for equal rows, which get the same decisions."""
    return F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit(1), F.col("text"), F.col("doc_id")).alias("y"))


def _lines(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    return (
        docs.select("doc_id", _row_key().alias("row"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter(F.length("line") >= MIN_CHARS)
        .select("doc_id", "row", "site", "pos", F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("y")).alias("line"))
    )


def boilerplate(docs: DataFrame, frozen: Frozen, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first): the hashes of lines that at least ``min_sites`` distinct sites have, with their first place."""
    lines = _lines(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")).alias("first")
    found = (
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), first, F.count("site").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("line", "first", F.hll_sketch_estimate("sites").alias("sites"))
    )
    found = frozen(found.filter(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = found.filter(F.col("sites") <= min_sites * (1 + NEAR))
    exact = (
        lines.join(near.select("line"), "line", "left_semi")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("site").alias("n"))
        .filter(F.col("n") >= min_sites)
    )
    sure = found.filter(F.col("sites") > min_sites * (1 + NEAR)).select("line", "first")
    return frozen(sure.unionByName(near.select("line", "first").join(exact.select("line"), "line", "left_semi")), "boilerplate")


def _with_drops(docs: DataFrame, frozen: Frozen, min_sites: int) -> DataFrame:
    drops = (
        _lines(docs)
        .join(boilerplate(docs, frozen, min_sites), "line")
        .filter(~((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy("row")
        .agg(F.collect_set("pos").alias("drop"))
    )
    return docs.withColumn("row", _row_key()).join(frozen(drops, "drops"), "row", "left").drop("row")


def _keep(text: bytes, drop: list[int] | None) -> bytes:
    if not drop:
        return text
    gone = set(drop)
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without boilerplate lines, with the columns they came with. A null text stays null, a null site counts
    as no site. Repeated rows get the same decisions. Columns may have any names; no rows give no rows."""
    ship(spark)
    frozen = Frozen(spark, "lines")
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in names)).alias("all"))
    marked = _with_drops(plain, frozen, min_sites).select("drop", "all")
    schema = marked.select("all.*").schema

    def run(batches):
        for batch in batches:
            columns = batch.column("all").flatten()
            kept = [_keep(t, d) for t, d in zip(texts_of(columns[at]), batch.column("drop").to_pylist(), strict=True)]
            null = columns[at].is_null().to_pylist()
            columns[at] = pa.array([None if x else k.decode() for k, x in zip(kept, null, strict=True)], pa.string())
            yield pa.record_batch(columns, names=names)

    return marked.mapInArrow(run, schema)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_lines, n_removed, kept_sha256 of the kept lines joined by line ends. A null text is one empty
    line."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    marked = _with_drops(docs, Frozen(spark, "lines"), MIN_SITES).select(F.col("doc_id").cast("long"), "text", "drop")

    def run(batches):
        for batch in slices(batches):
            rows = list(zip(texts_of(batch.column("text")), batch.column("drop").to_pylist(), strict=True))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([t.count(b"\n") + 1 for t, _ in rows], pa.int64()),
                    pa.array([len(d or ()) for _, d in rows], pa.int64()),
                    pa.array([sha256(_keep(t, d)).hexdigest() for t, d in rows], pa.string()),
                ],
                schema=DIGEST,
            )

    return marked.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


OP5_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT line, min(row(doc_id, pos)) AS first FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND row(l.doc_id, l.pos) <> b.first AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
