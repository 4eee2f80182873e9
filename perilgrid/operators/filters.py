"""Filters and projections of the history map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.functions.columns import strip


def by_region(zones: DataFrame, keyword: str = fixed.KEYWORD) -> DataFrame:
    """Zones whose district, address or province matches the pattern; all of them if none does. A null never matches.

    Whether any matches is one row, joined to the rows: no driver action and no window over the whole table."""
    hit = F.lit(False)
    for c in ("sigungu", "address", "sido"):
        if c in zones.columns:
            hit = hit | F.coalesce(F.col(c).rlike(keyword), F.lit(False))
    some = zones.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_some"))
    return zones.join(F.broadcast(some), hit | ~F.col("_some")).drop("_some")


def by_hazard(frame: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """An empty choice is no filter; a choice leaves out rows without a type."""
    return frame.filter(F.col("hazard_type").isin(list(chosen))) if chosen else frame


def by_dates(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Days from start to end, both included; rows without a date stay."""
    c = F.col("collected_at")
    return frame.filter(c.isNull() | F.to_date(c).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def by_road(frame: DataFrame, pattern: str) -> DataFrame:
    """Rows whose road matches the pattern; an empty pattern is no filter, a null never matches."""
    return frame.filter(F.coalesce(F.col("road_address").rlike(pattern), F.lit(False))) if pattern else frame


def hazard_options(frame: DataFrame) -> DataFrame:
    return frame.filter(strip(F.col("hazard_type")) != "").select("hazard_type").distinct().orderBy("hazard_type")


def date_bounds(frame: DataFrame) -> DataFrame:
    c = F.to_date("collected_at")
    return frame.agg(F.min(c).alias("min_date"), F.max(c).alias("max_date"))


def first_rows(frame: DataFrame, n: int = 5000) -> DataFrame:
    """Markers: the first rows in ingestion order (a map shows no more)."""
    return frame.orderBy("_row_id").limit(n)


def heat_points(frame: DataFrame) -> DataFrame:
    return frame.select("lat", "lon")


def centre(frame: DataFrame) -> DataFrame:
    return frame.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def marker_sizes(summary: DataFrame) -> DataFrame:
    """Cluster markers: radius 8 to 30 by count."""
    most = summary.agg(F.max("count").alias("_most"))
    return summary.join(F.broadcast(most), F.lit(True)).withColumn("radius", 8 + 22 * F.col("count") / F.col("_most")).drop("_most")
