"""Cells over unit vectors: neighbours anywhere on the globe, without meridians, poles or bands.

A place is a point (x, y, z) of the unit sphere, and a great-circle distance is a chord, so "within a radius" is "within a
chord" and cells are cubes. ``near_cells`` gives the cubes around a place that can hold anything within a chord.

``Tree`` is for the nearest place. Cubes are split in four along each axis until they hold few places; each node keeps
the box around its places and one of them. A search goes down from a small set of nodes for all targets at once: a node's
own place bounds the distance from above, its box from below, and nodes that can't hold the nearest place are left.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.functions.columns import haversine, once
from perilgrid.sources.frozen import Frozen

#: Cubes are this much wider than the chord, so that rounding loses no pair.
SLACK = 1.0001
#: Rows with coordinates.
PLACED = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) < 1e9 and abs(lon) < 1e9"
AXES = ("x", "y", "z")
#: Radii below this are searched in cubes of this size.
LEAST_M = 0.5


def chord(metres: float) -> float:
    return 2 * math.sin(min(metres / (2 * fixed.EARTH_M), math.pi / 2))


def unit(lat: Column, lon: Column) -> dict[str, Column]:
    flat = F.cos(F.radians(lat))
    return {"x": flat * F.cos(F.radians(lon)), "y": flat * F.sin(F.radians(lon)), "z": F.sin(F.radians(lat))}


def cell_of(at: dict[str, Column], side: float) -> Column:
    return F.struct(*(F.floor(at[a] / side).cast("int").alias(a) for a in AXES))


def near_cells(rows: DataFrame, at: dict[str, Column], reach: float, name: str) -> DataFrame:
    """A row for each cube of side ``reach * SLACK`` that can hold a place of the sphere within the chord ``reach`` of ``at``.
    Axis by axis, cubes too far away or off the sphere are dropped."""
    side = reach * SLACK
    kept = rows.columns
    rows = rows.withColumns({f"_{a}": at[a] for a in AXES}).withColumns({"_gap": F.lit(0.0), "_in": F.lit(0.0), "_out": F.lit(0.0)})
    for a in AXES:
        v, base = F.col(f"_{a}"), F.floor(F.col(f"_{a}") / side)
        choices = []
        for i in (-1, 0, 1):
            low, high = (base + i) * side, (base + i + 1) * side
            gap = {-1: v - high, 0: F.lit(0.0), 1: low - v}[i]
            nearest = F.greatest(low, -high, F.lit(0.0))
            choices.append(
                F.struct(
                    (base + i).cast("int").alias(f"_c{a}"),
                    (F.col("_gap") + gap * gap).alias("_gap2"),
                    (F.col("_in") + nearest * nearest).alias("_in2"),
                    (F.col("_out") + F.greatest(low * low, high * high)).alias("_out2"),
                )
            )
        rows = rows.select("*", F.inline(F.array(*choices))).filter((F.col("_gap2") <= side * side) & (F.col("_in2") <= 1 + 1e-9))
        rows = rows.drop("_gap", "_in", "_out").withColumnsRenamed({"_gap2": "_gap", "_in2": "_in", "_out2": "_out"})
    return rows.filter(F.col("_out") >= 1 - 1e-9).select(*kept, F.struct(*(F.col(f"_c{a}").alias(a) for a in AXES)).alias(name))


#: Cubes of a reach are split in four along each axis this often; one with so few places is compared place by place.
SPLITS, SOME = 5, 64


def counts_within(points: DataFrame, targets: DataFrame, metres: float, frozen: Frozen) -> DataFrame:
    """(lat, lon, n) for the distinct places of ``targets`` that have any of ``points`` (lat, lon) within so many metres, and how many.

    Equal places are one, with their number. Cubes that lie within the radius as a whole are counted whole and those outside are left;
    only what the radius cuts is split, and what is left at the end, or has few places, is compared by distance. So a target costs what
    lies at its circle, not what lies in it."""
    reach = chord(max(metres, LEAST_M))
    side, near = reach * SLACK / 4**SPLITS, chord(metres)
    least, most = near**2 * (1 - 1e-9) - near * 1e-13, reach**2 * (1 + 1e-9) + reach * 1e-13
    at = unit(F.col("lat"), F.col("lon"))
    cell = lambda k: F.struct(*(F.shiftright(f"_{a}", 2 * (SPLITS - k)).alias(a) for a in AXES))
    placed = points.filter(PLACED).groupBy("lat", "lon").agg(F.count("*").alias("w")).select("*", *(c.alias(a) for a, c in at.items()))
    placed = frozen(placed.select("*", *(F.floor(F.col(a) / side).cast("long").alias(f"_{a}") for a in AXES)), "places")
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), cell(k).alias("cell")) for k in range(SPLITS + 1)))).alias("at")
    bounds = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    up = F.struct(*(F.shiftright(f"at.cell.{a}", 2).alias(a) for a in AXES))
    nodes = placed.select(*AXES, "w", level).groupBy("at").agg(F.count("*").alias("places"), F.sum("w").alias("w"), *bounds)
    nodes = frozen(nodes.select("at.level", "at.cell", up.alias("up"), *nodes.columns[1:]), "nodes")

    asked = targets.filter(PLACED).select("lat", "lon").distinct().select("*", *(c.alias(a) for a, c in at.items()))
    keys = ("lat", "lon", *AXES)
    asked = near_cells(asked, {a: F.col(a) for a in AXES}, reach, "cell")
    asked = asked.select(*keys, F.struct(*(F.col(f"cell.{a}").cast("long").alias(a) for a in AXES)).alias("cell"))
    apart = {
        "low": _square((F.greatest(F.col(f"min_{a}"), F.least(F.col(f"max_{a}"), F.col(a))), F.col(a)) for a in AXES),
        "high": reduce(add, (F.greatest(F.pow(F.col(a) - F.col(f"min_{a}"), F.lit(2)), F.pow(F.col(a) - F.col(f"max_{a}"), F.lit(2))) for a in AXES)),
    }
    found, cut = [], []
    for k in range(SPLITS + 1):
        here = nodes.filter(F.col("level") == k)
        met = asked.join(here, "cell") if not k else asked.join(here, "up")
        met = once(met, apart).filter(F.col("low") <= most)
        kind = F.when(F.col("high") <= least, "whole").when((F.col("places") <= SOME) | F.lit(k == SPLITS), "leaf").otherwise("open")
        met = frozen(met.select(*keys, "level", "cell", "w", kind.alias("kind")), f"met-{k}")
        found.append(met.filter("kind = 'whole'").select("lat", "lon", "w"))
        cut.append(met.filter("kind = 'leaf'").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.struct("level", "cell").alias("at")))
        asked = met.filter("kind = 'open'").select(*keys, F.col("cell").alias("up"))
        if asked.isEmpty():
            break
    cut = reduce(DataFrame.unionByName, cut)
    pairs = placed.select("lat", "lon", "w", level).join(cut.select("at").distinct(), "at", "left_semi").join(cut, "at")
    close = pairs.filter(haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= metres)
    found.append(close.select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "w"))
    return reduce(DataFrame.unionByName, found).groupBy("lat", "lon").agg(F.sum("w").alias("n"))


#: A node with more places than LEAF is split into cubes of a quarter of its side, DEPTH levels of which end at some 20 cm. A
#: search starts from at most START nodes.
LEAF, DEPTH, START = 16, 13, 24


def _square(pairs) -> Column:
    return reduce(add, ((a - b) * (a - b) for a, b in pairs))


def _own(node: Column, at: dict[str, Column]) -> Column:
    """The squared chord from ``at`` to a node's own place."""
    return _square((node["box"][f"own_{a}"], at[a]) for a in AXES)


def _low(node: Column, at: dict[str, Column]) -> Column:
    """The least squared chord from ``at`` to anything in a node's box."""
    return _square((F.greatest(node["box"][f"min_{a}"], F.least(node["box"][f"max_{a}"], at[a])), at[a]) for a in AXES)


class Tree:
    """The nodes of all places (lat, lon) of ``points``. Equal places count once."""

    def __init__(self, points: DataFrame, frozen: Frozen):
        self.places = frozen(points.filter(PLACED).select("lat", "lon").distinct(), "places")
        levels = [F.struct(F.lit(k).alias("level"), *(F.floor((F.col(a) + 1) * (4**k / 2)).cast("int").alias(a) for a in AXES)) for k in range(DEPTH + 1)]
        placed = self.places.withColumns(unit(F.col("lat"), F.col("lon")))
        bounds = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
        own = F.min(F.struct(*(F.col(a).alias(f"own_{a}") for a in AXES)))
        nodes = placed.select(*AXES, F.explode(F.array(*levels)).alias("node")).groupBy("node").agg(F.count("*").alias("n"), own.alias("own"), *bounds)
        up = F.struct((F.col("node.level") - 1).alias("level"), *(F.shiftright(f"node.{a}", 2).alias(a) for a in AXES))
        nodes = frozen(nodes.select("node", up.alias("up"), (F.col("n") <= LEAF).alias("few"), F.struct("own.*", *(b for x in ("min", "max") for b in (f"{x}_{a}" for a in AXES))).alias("box")), "every")
        # the nodes below one that holds few places are no nodes
        split = nodes.filter(~F.col("few")).select(F.col("node").alias("up"))
        below = nodes.join(split, "up", "left_semi").unionByName(nodes.filter("node.level = 0"))
        below = below.withColumn("leaf", F.col("few") | (F.col("node.level") == DEPTH))
        self.nodes = frozen(below.select("up", F.struct("node", "leaf", "box").alias("node")), "nodes")
        sizes = {(r["level"], r["leaf"]): r["n"] for r in self.nodes.groupBy("node.node.level", "node.leaf").agg(F.count("*").alias("n")).collect()}
        self.last = max((level for level, _ in sizes), default=-1)

        def start(k: int) -> int:
            return sum(n for (level, leaf), n in sizes.items() if level == k or (leaf and level < k))

        self.first = max((k for k in range(self.last + 1) if start(k) <= START), default=0)

    def nearest(self, targets: DataFrame, frozen: Frozen) -> DataFrame:
        """(target_id, nearest_m) for every target (target_id, lat, lon) with coordinates, if there is any place."""
        at = {a: F.col(a) for a in AXES}
        asked = targets.filter(PLACED).select("target_id", "lat", "lon", *(c.alias(a) for a, c in unit(F.col("lat"), F.col("lon")).items()))
        top = self.nodes.filter((F.col("node.node.level") == self.first) | (F.col("node.leaf") & (F.col("node.node.level") < self.first)))
        top = top.agg(F.collect_list("node").alias("kids"))  # one row with START nodes at most
        rows = once(asked.join(F.broadcast(top), F.lit(True)), {"best": F.array_min(F.transform("kids", lambda k: _own(k, at)))})
        kids = self.nodes.filter(F.col("node.node.level") > self.first).groupBy("up").agg(F.collect_list("node").alias("kids"))
        slim = lambda k: F.struct(k["node"].alias("node"), k["leaf"].alias("leaf"), _low(k, at).alias("low"))
        keys, done = ["target_id", "lat", "lon", *AXES], None
        for level in range(self.first, self.last + 1):
            rows = once(rows, {"kids": F.filter(F.transform("kids", slim), lambda k: k["low"] <= F.col("best") * (1 + 1e-12) + 1e-15)})
            leaves = rows.select("target_id", "lat", "lon", "best", F.explode(F.filter("kids", lambda k: k["leaf"])).alias("kid"))
            leaves = leaves.select("target_id", "lat", "lon", "best", F.col("kid.node").alias("node"), F.col("kid.low").alias("low"))
            if level == self.last:
                done = leaves if done is None else done.unionByName(leaves)
                break
            rows = frozen(rows, f"level-{level}")
            leaves = rows.select("target_id", "lat", "lon", "best", F.inline(F.filter("kids", lambda k: k["leaf"]))).drop("leaf")
            done = leaves if done is None else done.unionByName(leaves)
            open_nodes = rows.select(*keys, "best", F.inline(F.filter("kids", lambda k: ~k["leaf"]))).select(*keys, "best", F.col("node").alias("up"))
            rows = open_nodes.join(kids, "up").withColumn("best", F.least("best", F.array_min(F.transform("kids", lambda k: _own(k, at)))))
            rows = rows.groupBy(*keys).agg(F.min("best").alias("best"), F.flatten(F.collect_list("kids")).alias("kids"))
        if done is None:
            return targets.limit(0).select("target_id", F.lit(None).cast("double").alias("nearest_m"))
        tightest = done.groupBy("target_id").agg(F.min("best").alias("least"))
        done = done.join(tightest, "target_id").filter(F.col("low") <= F.col("least") * (1 + 1e-12) + 1e-15) if self.last > self.first else done
        leaf_of = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), *(F.floor((F.col(a) + 1) * (4**k / 2)).cast("int").alias(a) for a in AXES)) for k in range(self.last + 1))))
        held = self.places.withColumns(unit(F.col("lat"), F.col("lon"))).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), leaf_of.alias("node"))
        held = held.join(self.nodes.filter("node.leaf").select("node.node"), "node", "left_semi")
        dist = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
        return done.join(held, "node").groupBy("target_id").agg(F.min(dist).alias("nearest_m"))
