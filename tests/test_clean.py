"""Cleaning, deduplication and filters."""

from perilgrid.functions import fixed
from perilgrid.operators import clean, filters
from pyspark.sql import functions as F

RAW = "_row_id long, category_no string, hazard_type string, collected_at string, lat string, lon string, road_address string, base_date string"


def rows(spark, *items):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(items)], RAW)


def point(no="1", kind="a", day="2024-05-01", lat="37.40", lon="126.92", road="r", base="2024-01-31"):
    return (no, kind, day, lat, lon, road, base)


def test_mixed_coordinates(spark):
    frame = rows(spark, point("1"), point("2"), point("3", lat="text"), point("4", lat="35.1"), point("5"))
    got = clean.clean_damage(frame)
    assert sorted(r["category_no"] for r in got.kept.collect()) == ["1", "2", "5"]
    report = got.report()
    assert report.excluded_counts == {fixed.LAT_NOT_NUMERIC: 1, fixed.OUT_OF_BBOX: 1}
    assert (report.rows_in, report.excluded_total, report.rows_before_dedup, report.rows_out) == (5, 2, 3, 3)
    assert report.to_dict()["duplicates_removed"] == 0


def test_reason_priority(spark):
    frame = rows(spark, point(lat="", lon="x"), point(lat="37.4", lon="x"), point(lat="1", lon=None), point(lat="inf"), point(lat="37.34", lon="127.00"))
    got = [r["reason"] for r in clean.classify(frame).orderBy("_row_id").collect()]
    assert got == [fixed.LAT_MISSING, fixed.LON_NOT_NUMERIC, fixed.LON_MISSING, fixed.OUT_OF_BBOX, None]


def test_types_and_quotes(spark):
    got = clean.clean_damage(rows(spark, point(lat='"37.40"', lon=' 126.92 ')))
    assert dict(got.kept.dtypes)["lat"] == "double" and dict(got.kept.dtypes)["collected_at"] == "timestamp_ntz"
    assert got.kept.first()["lon"] == 126.92


def test_missing_columns(spark):
    got = clean.clean_damage(spark.createDataFrame([(0, "x")], "_row_id long, hazard_type string"))
    assert got.report().excluded_counts == {fixed.LAT_MISSING: 1}


def test_dedup_by_id(spark):
    got = clean.clean_damage(rows(spark, point("1", "first"), point("1", "second"), point("2")))
    assert {(r["category_no"], r["hazard_type"]) for r in got.kept.collect()} == {("1", "first"), ("2", "a")}
    assert got.counts().first()["duplicates_removed"] == 1


def test_dedup_by_place(spark):
    got = clean.clean_damage(rows(spark, point(None), point(None), point(None, day="2024.05.02")))
    assert got.subset == ["lat", "lon", "hazard_type", "collected_at"]
    assert got.kept.count() == 2


def test_null_ids_of_a_source_are_equal(spark):
    frame = rows(spark, point(None), point(None), point("1")).withColumn("source", F.lit("A"))
    got = clean.clean_damage(frame)
    assert got.subset == ["source", "category_no"] and got.kept.count() == 2


def test_order_of_partitions_changes_nothing(spark):
    frame = rows(spark, *(point(str(i % 7), f"k{i}") for i in range(60)))
    want = {(r["category_no"], r["hazard_type"]) for r in clean.clean_damage(frame).kept.collect()}
    again = {(r["category_no"], r["hazard_type"]) for r in clean.clean_damage(frame.repartition(9, "hazard_type")).kept.collect()}
    assert want == again == {(str(i), f"k{i}") for i in range(7)}


def test_empty_table(spark):
    got = clean.clean_damage(rows(spark).limit(0))
    assert got.kept.count() == 0 and got.report().rows_in == 0
    assert clean.base_date(got.kept).first()[0] is None


def test_zones(spark):
    frame = spark.createDataFrame([(0, "a", "37.4", "126.9"), (1, "b", "37.4", "126.9"), (2, "c", "35", "126.9")], "_row_id long, zone_name string, lat string, lon string")
    assert [r["zone_name"] for r in clean.clean_zones(frame).kept.collect()] == ["a"]


def test_region_filter(spark):
    zones = spark.createDataFrame([("안양시", "x", None), (None, "안양로 1", None), ("b", None, "c")], "sigungu string, address string, sido string")
    assert filters.by_region(zones).count() == 2
    assert filters.by_region(zones, "nowhere").count() == 3
    assert filters.by_region(zones.limit(0)).count() == 0


def test_history_filters(spark):
    frame = clean.clean_damage(rows(spark, point("1", "a", "2024-05-01"), point("2", "b", None), point("3", None, "2024-06-01", road="안양로"))).kept
    assert filters.by_hazard(frame, []).count() == 3
    assert [r["category_no"] for r in filters.by_hazard(frame, ["a"]).collect()] == ["1"]
    assert {r["category_no"] for r in filters.by_dates(frame, "2024-05-01", "2024-05-31").collect()} == {"1", "2"}
    assert [r["category_no"] for r in filters.by_road(frame, "안양").collect()] == ["3"]
    assert filters.by_road(frame, "").count() == 3
    assert [r[0] for r in filters.hazard_options(frame).collect()] == ["a", "b"]
