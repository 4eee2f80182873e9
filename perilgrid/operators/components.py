"""Distributed connected components by alternating large-star and small-star steps.

Each step is a partial aggregation (the smallest neighbour of every node) and a join back. Nodes that hold more than one in
``HEAVY`` of all edges, of which there can be fewer than HEAVY, are joined by broadcast, so that their edges stay where they
are: no task gets all edges of a hub. Every round is frozen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.sources.frozen import Frozen

#: A node with more than this share of the edges (and FEW of them) is heavy.
HEAVY, FEW = 500, 16


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))


def join_sized(rows: DataFrame, key: str, sized: DataFrame, heavy_from: int | None) -> DataFrame:
    """``rows`` with the other columns of ``sized`` (key, n and more), n being the number of rows of the key. Keys with more than
    ``heavy_from`` rows are joined by broadcast; none are if it isn't given. At ``total // HEAVY`` there are fewer than HEAVY."""
    if heavy_from is None:
        return rows.join(sized, key)
    heavy = F.broadcast(sized.filter(F.col("n") > heavy_from))
    light = rows.join(heavy.select(key), key, "left_anti").join(sized.filter(F.col("n") <= heavy_from), key)
    return light.unionByName(rows.join(heavy, key))


def _large_star(edges: DataFrame, heavy_from: int | None) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_sized(both.filter("v > u"), "u", least, heavy_from).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, heavy_from: int | None) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_sized(edges, "a", least, heavy_from).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, frozen: Frozen, label: str = "edges") -> DataFrame:
    """``edges`` has columns a and b of one orderable type; gives (node, root) for every node of an edge, root being the
    smallest node of its component. Self-loops, repeated and reversed edges change nothing; null ends are ignored; no
    edges give no rows. The rounds grow with the logarithm of the longest path. ``label`` names the frozen tables."""
    edges = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, seen, k = frozen(edges.distinct(), f"{label}-0"), None, 0
    while True:
        degrees = _both(edges).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
        total, mark, most = degrees.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
        if not total or (total, mark) == seen:
            break
        seen, k = (total, mark), k + 1
        heavy_from = max(FEW, total // HEAVY)
        if most > heavy_from:
            stars = frozen(_large_star(edges, heavy_from), f"{label}-large-{k}")
            edges = frozen(_small_star(stars, heavy_from), f"{label}-{k}")
            frozen.drop(f"{label}-{k - 1}", f"{label}-large-{k}")
        else:
            edges = frozen(_small_star(_large_star(edges, None), None), f"{label}-{k}")
            frozen.drop(f"{label}-{k - 1}")
    roots = edges.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
