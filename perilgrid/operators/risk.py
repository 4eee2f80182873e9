"""Composite risk: a weighted mean of the components at hand, row by row, in column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.functions.columns import clamp, density_score, printed, rain_score, road_score, rounded, strip, zone_score
from perilgrid.operators import geo

NAMES = tuple(fixed.WEIGHTS)


def weight_sum(scores: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """The weights of the components that aren't null."""
    weights = weights or fixed.WEIGHTS
    total = F.lit(0.0)
    for name in NAMES:
        total = total + F.when(scores[name].isNotNull(), float(weights.get(name, 0.0))).otherwise(0.0)
    return total


def risk(scores: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """A struct: total, total_raw (not rounded), used, excluded (arrays of names), components (a map from name to label,
    score, base_weight, effective_weight, contribution, available). Null scores drop out and the other weights are scaled to a
    sum of 1; without any, the total is 0 and all components are excluded. ``formula`` writes it out."""
    weights = weights or fixed.WEIGHTS
    whole = weight_sum(scores, weights)
    usable = whole > 0
    raw, parts = F.lit(0.0), []
    for name in NAMES:
        there = scores[name].isNotNull() & usable
        score, base = clamp(scores[name].cast("double")), F.lit(float(weights.get(name, 0.0)))
        share = F.when(there, base / whole).otherwise(0.0)
        gain = F.when(there, score * share).otherwise(0.0)
        raw = raw + gain
        parts += [
            F.lit(name),
            F.struct(
                F.lit(fixed.LABELS[name]).alias("label"),
                F.when(there, rounded(score, 2)).alias("score"),
                base.alias("base_weight"),
                rounded(share, 4).alias("effective_weight"),
                rounded(gain, 2).alias("contribution"),
                there.alias("available"),
            ),
        ]
    total = rounded(clamp(raw), 2)
    names = [(F.lit(n), scores[n].isNotNull()) for n in NAMES]
    return F.struct(
        total.alias("total"),
        clamp(raw).alias("total_raw"),
        F.array_compact(F.array(*(F.when(has & usable, n) for n, has in names))).alias("used"),
        F.array_compact(F.array(*(F.when(~has, n) for n, has in names))).alias("excluded"),
        F.create_map(*parts).alias("components"),
    )


def formula(risk: Column) -> Column:
    """How a ``risk`` came about, as text. It costs more than the risk itself, so it is made where it is shown."""
    pieces = []
    for name in NAMES:
        part = risk["components"][name]
        text = F.concat(printed(part["effective_weight"], 3), F.lit(f" × {fixed.LABELS[name]}("), printed(part["score"], 1), F.lit(")"))
        pieces.append(F.when(part["available"], text))
    shown = F.concat(F.concat_ws(" + ", *pieces), F.format_string(" = %.2f", risk["total"]))
    return F.when(F.size(risk["used"]) > 0, shown).otherwise(fixed.NO_FORMULA)


def with_risk(frame: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds ``risk`` from columns named like the components; a missing column counts as null."""
    scores = {n: F.col(n) if n in frame.columns else F.lit(None).cast("double") for n in NAMES}
    return frame.withColumn("risk", risk(scores, weights))


def target_scores(
    damage: DataFrame,
    zones: DataFrame,
    targets: DataFrame,
    radius_m: float = fixed.RADIUS_M,
    reference: float = fixed.REFERENCE_COUNT,
    zone_limit_m: float | None = None,
    rain_mm: float | None = 0.0,
    photo: float | None = None,
) -> DataFrame:
    """Targets (target_id, lat, lon and more) with n_hist, nearest_m, road_key and the component scores. Each point is paired
    with its targets once, for the count and the representative road alike. ``photo`` counts where a target has is_photo."""
    key = geo.road_key(damage)
    pairs = geo.within(damage, targets.select("target_id", "lat", "lon"), radius_m)
    road = F.col(key).cast("string") if key else F.lit(None).cast("string")
    by_road = pairs.groupBy("target_id", road.alias("road_key")).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("road_key").isNotNull(), F.struct((-F.col("n")).alias("n"), "road_key")))  # the most frequent, then the smallest
    found = by_road.groupBy("target_id").agg(F.sum("n").alias("n_hist"), best.alias("best")).select("target_id", "n_hist", "best.road_key")
    out = targets.join(found, "target_id", "left").withColumn("n_hist", F.coalesce("n_hist", F.lit(0)).cast("long"))
    out = out.join(geo.nearest(zones, targets), "target_id", "left")
    if key is None:
        out = out.withColumn("road_importance", F.lit(None).cast("double"))
    else:
        table = geo.importance_table(damage, key)
        most = table.agg(F.max("count").alias("most"))
        table = table.select(F.col("key").alias("_key"), F.col("count").alias("_count"))
        out = out.join(table, strip(F.col("road_key")) == F.col("_key"), "left")
        out = out.join(F.broadcast(most), F.lit(True), "left")  # one row
        out = out.withColumn("road_importance", road_score(F.col("road_key"), F.col("_count"), F.col("most"))).drop("_key", "_count", "most")
    is_photo = F.coalesce(F.col("is_photo"), F.lit(False)) if "is_photo" in targets.columns else F.lit(False)
    return out.withColumns(
        {
            "history_density": density_score(F.col("n_hist"), reference),
            "photo_severity": F.when(is_photo, F.lit(photo).cast("double")),
            "school_zone": zone_score(F.col("nearest_m"), zone_limit_m),
            "rainfall": rain_score(F.lit(rain_mm).cast("double")),
        }
    )


def priority(damage: DataFrame, zones: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Targets ranked by total risk, the smaller target_id first among equals."""
    return with_risk(target_scores(damage, zones, targets, **options)).orderBy(F.desc("risk.total"), "target_id")


def with_photo_target(targets: DataFrame, lat: float, lon: float, road: str = "") -> DataFrame:
    """The targets and the place of an analysed photo, behind the others."""
    spark, last = targets.sparkSession, targets.agg(F.max("target_id")).first()[0]
    photo = spark.createDataFrame(
        [((-1 if last is None else last) + 1, float(lat), float(lon), road, True)], "target_id bigint, lat double, lon double, road_address string, is_photo boolean"
    )
    return targets.withColumn("is_photo", F.lit(False)).unionByName(photo, allowMissingColumns=True)


def route_candidates(targets: DataFrame, n: int = 5) -> DataFrame:
    """The stops that a route starts out with: the first targets in their own order, not by score."""
    return targets.orderBy("target_id").limit(n)
