"""Spatial joins without cross joins, right anywhere on the globe: radius joins on cubes, nearest neighbours down a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from perilgrid.functions import fixed
from perilgrid.functions.columns import haversine, strip
from perilgrid.operators.sphere import LEAST_M, PLACED, SLACK, Tree, cell_of, chord, counts_within, near_cells, unit
from perilgrid.sources.frozen import Frozen


def within(points: DataFrame, targets: DataFrame, radius_m: float = fixed.RADIUS_M) -> DataFrame:
    """Pairs of targets (target_id, lat, lon) and points (lat, lon and more) at most the radius apart: the points' columns,
    target_id and dist_m. An equi-join on cubes: targets go to those that their radius reaches, points to their own; exact
    distances decide. Rows without coordinates pair with nothing."""
    reach = chord(max(radius_m, LEAST_M))
    asked = targets.filter(PLACED).select("target_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    asked = near_cells(asked, unit(F.col("_lat"), F.col("_lon")), reach, "_cell")
    placed = points.filter(PLACED).withColumn("_cell", cell_of(unit(F.col("lat"), F.col("lon")), reach * SLACK))
    dist = haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    return placed.join(asked, "_cell").withColumn("dist_m", dist).filter(F.col("dist_m") <= radius_m).drop("_cell", "_lat", "_lon")


def radius_counts(points: DataFrame, targets: DataFrame, radius_m: float = fixed.RADIUS_M) -> DataFrame:
    """target_id and n, the points within the radius; 0 without any. Points are counted by cubes, not paired."""
    n = counts_within(points, targets, radius_m, Frozen(points.sparkSession, "counts"))
    n = targets.filter(PLACED).select("target_id", "lat", "lon").join(n, ["lat", "lon"]).groupBy("target_id").agg(F.sum("n").alias("n"))
    return targets.select("target_id").join(n, "target_id", "left").select("target_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Distinct places up to which the nearest one is found by comparing each target with all of them, in one pass.
FEW = 1024


def _nearest_of_few(places: list, targets: DataFrame) -> DataFrame:
    """The nearest of ``places`` (lat, lon) by squared chords in Arrow batches; its great-circle distance is worked out as elsewhere."""

    def units(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        y, x = np.radians(lat), np.radians(lon)
        return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])

    lat, lon = (np.array([p[c] for p in places], float) for c in ("lat", "lon"))
    held = units(lat, lon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = units(*(batch.column(c).to_numpy() for c in ("lat", "lon")))
            best = np.empty(len(batch), np.int64)
            for k in range(0, len(best), ROWS):
                apart = sum((a[k : k + ROWS, None] - h) ** 2 for a, h in zip(at, held, strict=True))
                best[k : k + ROWS] = apart.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(lat[best]), pa.array(lon[best])], names=[*batch.schema.names, "_lat", "_lon"])

    asked = targets.filter(PLACED).select("target_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    double = [StructField(c, DoubleType()) for c in ("_lat", "_lon")]
    found = asked.mapInArrow(run, StructType([*asked.schema.fields, *double]))
    found = found.select("target_id", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("nearest_m"))
    rest = targets.filter(~F.coalesce(F.expr(PLACED), F.lit(False)))
    return found.unionByName(rest.select("target_id", F.lit(None).cast("double").alias("nearest_m")))


#: Targets that are compared with all places at once.
ROWS = 256


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id and nearest_m, the distance to the nearest point; null without points or without coordinates. How far the point
    is makes no difference to the work: targets go down a tree of the places, or are compared with all of them if there are few."""
    frozen = Frozen(points.sparkSession, "nearest")
    places = frozen(points.filter(PLACED).select("lat", "lon").distinct(), "points")
    few = places.limit(FEW + 1).collect()
    if 0 < len(few) <= FEW:
        return _nearest_of_few(few, targets.select("target_id", "lat", "lon"))
    found = Tree(places, frozen).nearest(targets.select("target_id", "lat", "lon"), frozen)
    return targets.select("target_id").join(found, "target_id", "left")


def road_key(damage: DataFrame) -> str | None:
    """The column that tells road segments: node_link if any row has one, else road_address. One action."""
    names = [c for c in ("node_link", "road_address") if c in damage.columns]
    has = damage.agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in names)).first() if names else {}
    return next((c for c in names if has[c]), None)


def importance_table(damage: DataFrame, key: str | None = None) -> DataFrame:
    """key and count: damages of each road segment, blanks left out."""
    key = key or road_key(damage)
    if key is None:
        return damage.limit(0).select(F.lit("").alias("key"), F.lit(0).cast("long").alias("count"))
    return damage.select(strip(F.col(key)).alias("key")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("count"))


def representative_roads(pairs: DataFrame, key: str) -> DataFrame:
    """target_id and road_key: the most frequent key among a target's points, the smallest of equals, untrimmed."""
    return (
        pairs.filter(F.col(key).isNotNull())
        .groupBy("target_id", key)
        .agg(F.count("*").alias("n"))
        .groupBy("target_id")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(key).alias("road_key"))).alias("best"))
        .select("target_id", "best.road_key")
    )


def route_matrix(points: DataFrame) -> DataFrame:
    """(route_id, i, j, dist_m) for all pairs of stops of a route; a route is a short list of stops."""
    a = points.select("route_id", F.col("pos").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select("route_id", F.col("pos").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    dist = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "route_id").select("route_id", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(dist).alias("dist_m"))
