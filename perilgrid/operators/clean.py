"""Cleaning: coordinates with a reason for every row left out, dates, text, and keep-first deduplication.

Everything is lazy. The kept rows and the report are two views of one classified table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.functions.columns import bare, date_of, date_text, number_of, number_reason, once, strip

ROW = "_row_id"


def out_of_box(lat: Column, lon: Column, bbox: Mapping[str, float] | None = None) -> Column:
    box = bbox or fixed.BBOX
    return ~(lat.between(box["lat_min"], box["lat_max"]) & lon.between(box["lon_min"], box["lon_max"]))


def classify(frame: DataFrame, bbox: Mapping[str, float] | None = None) -> DataFrame:
    """Makes lat and lon numbers and adds ``reason``: why a row is left out, null if it is kept. The latitude's reason comes
    before the longitude's, and the box counts only where both are numbers. Missing columns count as missing values."""
    for name in ("lat", "lon"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast("string"))
    order = frame.columns
    texts = once(frame, {f"_{c}_text": bare(F.col(c).cast("string")) for c in ("lat", "lon")})
    numbers = once(texts, {c: number_of(F.col(f"_{c}_text")) for c in ("lat", "lon")})
    reason = F.coalesce(
        number_reason(F.col("_lat_text"), F.col("lat"), fixed.LAT_MISSING, fixed.LAT_NOT_NUMERIC),
        number_reason(F.col("_lon_text"), F.col("lon"), fixed.LON_MISSING, fixed.LON_NOT_NUMERIC),
        F.when(out_of_box(F.col("lat"), F.col("lon"), bbox), fixed.OUT_OF_BBOX),
    )
    return once(numbers, {"reason": reason}).select(*(F.col(f"`{c}`") for c in order if c != "reason"), "reason")


def keep_first(frame: DataFrame, subset: Sequence[str] = (), order: str = ROW) -> DataFrame:
    """The first row, in ingestion order, of each combination of the subset (of all columns if it is empty); nulls count as
    equal. A partial aggregation, so a combination that very many rows share is reduced before the shuffle."""
    subset = list(subset) or [c for c in frame.columns if c != order]
    first = frame.groupBy(*subset).agg(F.min_by(F.struct(*frame.columns), order).alias("row"))
    return first.select("row.*")


def default_subset(frame: DataFrame) -> list[str]:
    """By category_no (with source, if there is one) if any row has one, else by place, type and date. Needs one action,
    because it chooses columns."""
    if "category_no" in frame.columns and not frame.filter("category_no is not null").limit(1).isEmpty():
        return ["source", "category_no"] if "source" in frame.columns else ["category_no"]
    return [c for c in ("lat", "lon", "hazard_type", "collected_at") if c in frame.columns]


def tidy(kept: DataFrame) -> DataFrame:
    """Parses dates and trims the text columns that are compared."""
    dates = [c for c in ("collected_at", "base_date") if c in kept.columns]
    texts = {c: strip(F.col(c)) for c in ("hazard_type", "road_address", "category_no") if c in kept.columns}
    names = kept.columns
    kept = once(kept.withColumns(texts), {c: date_text(F.col(c).cast("string")) for c in dates}) if dates else kept.withColumns(texts)
    return kept.withColumns({c: date_of(F.col(c)) for c in dates}).select(*(F.col(f"`{c}`") for c in names))


def exclusion_counts(classified: DataFrame) -> DataFrame:
    return classified.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@dataclass
class CleaningReport:
    rows_in: int = 0
    rows_out: int = 0
    excluded_counts: dict[str, int] = field(default_factory=dict)
    rows_before_dedup: int = 0
    rows_after_dedup: int = 0
    messages: list[str] = field(default_factory=list)

    @property
    def duplicates_removed(self) -> int:
        return self.rows_before_dedup - self.rows_after_dedup

    @property
    def excluded_total(self) -> int:
        return sum(self.excluded_counts.values())

    def to_dict(self) -> dict:
        names = ("rows_in", "rows_out", "excluded_total", "excluded_counts", "rows_before_dedup", "rows_after_dedup")
        return {n: getattr(self, n) for n in (*names, "duplicates_removed", "messages")}


@dataclass
class Cleaned:
    """The kept rows, the classified input and the columns of deduplication; ``report`` runs one aggregation on each."""

    kept: DataFrame
    classified: DataFrame
    subset: list[str]

    def counts(self) -> DataFrame:
        """One row: rows_in, excluded_total, rows_before_dedup, rows_after_dedup, duplicates_removed, rows_out."""
        before = self.classified.agg(F.count("*").alias("rows_in"), F.count("reason").alias("excluded_total"))
        after = self.kept.agg(F.count("*").alias("rows_out"))
        return before.join(F.broadcast(after), F.lit(True)).select(  # one row on either side
            "rows_in",
            "excluded_total",
            (F.col("rows_in") - F.col("excluded_total")).alias("rows_before_dedup"),
            F.col("rows_out").alias("rows_after_dedup"),
            (F.col("rows_in") - F.col("excluded_total") - F.col("rows_out")).alias("duplicates_removed"),
            "rows_out",
        )

    def report(self) -> CleaningReport:
        n = self.counts().first()
        reasons = {r["reason"]: r["n"] for r in exclusion_counts(self.classified).collect()}  # five reasons at most
        text = f"deduplicated by: {', '.join(self.subset) or 'all columns'}"
        return CleaningReport(n["rows_in"], n["rows_out"], reasons, n["rows_before_dedup"], n["rows_after_dedup"], [text])


def clean_damage(frame: DataFrame, bbox: Mapping[str, float] | None = None, subset: Sequence[str] | None = None) -> Cleaned:
    """Damage history with numbers for coordinates, dates, trimmed texts, and first rows only."""
    classified = classify(frame, bbox)
    kept = tidy(classified.filter("reason is null").drop("reason"))
    subset = list(subset or default_subset(kept))
    return Cleaned(keep_first(kept, subset), classified, subset)


def clean_zones(frame: DataFrame, bbox: Mapping[str, float] | None = None) -> Cleaned:
    """Zones with numbers for coordinates, one for each place."""
    classified = classify(frame, bbox)
    return Cleaned(keep_first(classified.filter("reason is null").drop("reason"), ["lat", "lon"]), classified, ["lat", "lon"])


def base_date(frame: DataFrame) -> DataFrame:
    """One row: the latest base date as text, null without any."""
    return frame.agg(F.date_format(F.max("base_date"), "yyyy-MM-dd").alias("base_date"))
