"""Grid DBSCAN as a relational plan: cells, neighbours by offset equi-joins, core cells, connected components, borders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perilgrid.functions import fixed
from perilgrid.operators.components import connected_components
from perilgrid.sources.frozen import Frozen

_HALF = 1 << 31


def cell_size(eps_m: float) -> float:
    return max(eps_m / 4, 1.0)


def offsets(eps_m: float) -> list[tuple[int, int]]:
    """The cells whose centres are within eps of a cell's centre."""
    most = (eps_m / cell_size(eps_m)) ** 2 + 1e-9
    reach = math.isqrt(int(most))
    return [(x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) if x * x + y * y <= most]


def grid(points: DataFrame, eps_m: float = fixed.EPS_M, lat0: float | None = None) -> DataFrame:
    """Adds cx and cy, the cell in an equirectangular plane around the mean latitude (or ``lat0``)."""
    if lat0 is None:
        lat0 = points.agg(F.avg("lat")).first()[0] or 0.0
    size = F.lit(cell_size(eps_m))
    x = fixed.EARTH_M * F.radians("lon") * F.cos(F.radians(F.lit(lat0)))
    y = fixed.EARTH_M * F.radians("lat")
    return points.withColumns({"cx": F.floor(x / size), "cy": F.floor(y / size)})


def cell_counts(gridded: DataFrame) -> DataFrame:
    return gridded.groupBy("cx", "cy").agg(F.count("*").alias("w"))


def neighbours(counts: DataFrame, eps_m: float) -> DataFrame:
    """(cx, cy, nx, ny, nw): every cell's neighbours, itself included, by an equi-join for each of the fixed offsets."""
    table = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets(eps_m)))
    asked = counts.select("cx", "cy", F.explode(table).alias("o"))
    asked = asked.select("cx", "cy", (F.col("cx") + F.col("o.dx")).alias("nx"), (F.col("cy") + F.col("o.dy")).alias("ny"))
    there = counts.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("w").alias("nw"))
    return asked.join(there, ["nx", "ny"]).select("cx", "cy", "nx", "ny", "nw")


def core_cells(near: DataFrame, min_samples: int = fixed.MIN_SAMPLES) -> DataFrame:
    return near.groupBy("cx", "cy").agg(F.sum("nw").alias("n")).filter(F.col("n") >= max(2, min_samples)).select("cx", "cy")


def _code(x: str, y: str):
    """A cell as one number of the same order as (x, y)."""
    return F.shiftleft(F.col(x), 32) + F.col(y) + F.lit(_HALF)


def numbered(roots: DataFrame, frozen: Frozen) -> DataFrame:
    """(root, cluster): distinct roots numbered from 0 in order, without a window over all of them: they are dealt out by
    ranges, counted by range, and numbered inside each."""
    dealt = roots.select("root").distinct().repartitionByRange("root")
    dealt = frozen(dealt.withColumn("part", F.spark_partition_id()), "roots")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("root")) - 1
    dealt = dealt.join(before, "part").withColumn("place", place)
    return dealt.select("root", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("cluster"))


def cluster_cells(spark: SparkSession, counts: DataFrame, eps_m: float, min_samples: int, frozen: Frozen) -> DataFrame:
    """(cx, cy, cluster) for cells that belong to a cluster. Clusters are numbered by their smallest core cell; a cell that is
    no core takes the smallest cluster next to it."""
    near = frozen(neighbours(counts, eps_m), "near")
    core = frozen(core_cells(near, min_samples), "core")
    to_core = near.join(core.select(F.col("cx").alias("nx"), F.col("cy").alias("ny")), ["nx", "ny"], "left_semi")
    edges = to_core.join(core, ["cx", "cy"], "left_semi").filter("nx > cx or (nx = cx and ny > cy)")
    edges = edges.select(_code("cx", "cy").alias("a"), _code("nx", "ny").alias("b"))
    joined = connected_components(edges, frozen)
    rooted = core.withColumn("node", _code("cx", "cy")).join(joined, "node", "left")
    rooted = frozen(rooted.select("cx", "cy", F.coalesce("root", "node").alias("root")), "rooted")
    inner = rooted.join(numbered(rooted, frozen), "root").select("cx", "cy", "cluster")
    border = (
        to_core.join(core, ["cx", "cy"], "left_anti")
        .join(inner.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), "cluster"), ["nx", "ny"])
        .groupBy("cx", "cy")
        .agg(F.min("cluster").alias("cluster"))
    )
    return frozen(inner.unionByName(border), "clusters")


#: What can be asked for; a hierarchical method isn't at hand, and asking for it gives the density method, as ``auto`` does.
ALGORITHMS = {"auto": "DBSCAN", "dbscan": "DBSCAN", "hdbscan": "DBSCAN"}


def cluster_points(
    spark: SparkSession,
    points: DataFrame,
    eps_m: float = fixed.EPS_M,
    min_samples: int = fixed.MIN_SAMPLES,
    lat0: float | None = None,
    algorithm: str = "auto",
) -> DataFrame:
    """Adds ``cluster`` (-1: noise). Fewer points than ``max(2, min_samples)`` are all noise; no points give no rows."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm}")
    if points.limit(max(2, min_samples)).count() < max(2, min_samples):
        return points.withColumn("cluster", F.lit(-1).cast("long"))
    frozen = Frozen(spark, "cluster")
    gridded = grid(points, eps_m, lat0)
    found = cluster_cells(spark, frozen(cell_counts(gridded), "cells"), eps_m, min_samples, frozen)
    joined = gridded.join(found, ["cx", "cy"], "left")
    return joined.select(*points.columns, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def cluster_info(clustered: DataFrame) -> DataFrame:
    """One row: n_clusters, n_noise."""
    return clustered.agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"),
    )


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """cluster, count, lat, lon (means), road_address (most frequent, the smallest of equals, "" without any), hazard_types
    (the first five in order of appearance)."""
    valid = clustered.filter("cluster >= 0")
    base = valid.groupBy("cluster").agg(F.count("*").alias("count"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    road = (
        valid.filter("road_address is not null")
        .groupBy("cluster", "road_address")
        .agg(F.count("*").alias("n"))
        .groupBy("cluster")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "road_address")).alias("best"))
        .select("cluster", "best.road_address")
    )
    types = (
        valid.filter("hazard_type is not null")
        .groupBy("cluster", "hazard_type")
        .agg(F.min("_row_id").alias("first"))
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list(F.struct("first", "hazard_type"))).alias("all"))
        .select("cluster", F.array_join(F.slice("all.hazard_type", 1, 5), ", ").alias("hazard_types"))
    )
    out = base.join(road, "cluster", "left").join(types, "cluster", "left")
    return out.select(
        "cluster",
        "count",
        "lat",
        "lon",
        F.coalesce("road_address", F.lit("")).alias("road_address"),
        F.coalesce("hazard_types", F.lit("")).alias("hazard_types"),
    )


def top_clusters(summary: DataFrame, n: int = 10) -> DataFrame:
    return summary.orderBy(F.desc("count"), "cluster").limit(n)
