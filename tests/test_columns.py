"""Scalar functions at their edges."""

import itertools

import pytest
from pyspark.sql import functions as F

from perilgrid.functions import columns as X
from perilgrid.functions import fixed
from perilgrid.operators import risk


def values(spark, kind, items, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_numbers(spark):
    got = values(spark, "string", ["37.4", ' "126.92" ', "1,234", "1d", "nan", "1e2", "+3", ".5", "5.", "", None, "x", "1_000", "0x10"], X.numeric)
    assert got == [37.4, 126.92, 1234.0, None, None, 100.0, 3.0, 0.5, 5.0, None, None, None, None, None]


def test_reasons(spark):
    got = values(spark, "string", ["", None, " ", '""', "x", "1", "nan"], lambda c: X.numeric_reason(c, "missing", "no number"))
    assert got == ["missing"] * 4 + ["no number", None, "no number"]


def test_infinity_is_a_number(spark):
    assert values(spark, "string", ["inf"], X.numeric) == [float("inf")]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2024-05-01", "2024-05-01"), ("2024.05.01", "2024-05-01"), ("2024/05/01", "2024-05-01"), ("20240501", "2024-05-01"), (" 2024-5-1 ", "2024-05-01"),
        ("없음", None), ("", None), (None, None), ("2024-13-01", None), ("2024-02-30", None), ("202405", None), ("5", None), ("2024", "2024-01-01"),
        ("2024-05", "2024-05-01"), ("2024115", "2024-11-05"), ("01-02-2024", "2024-01-02"), ("Nov 3 2021", "2021-11-03"), ("20240501123000", "2024-05-01"),
        ("2024-05-01 10:20:30", "2024-05-01"), ("2024-05-01 10:20:30.5", None),
    ],
)
def test_dates(spark, text, day):
    got = values(spark, "string", [text], X.parse_date)[0]
    assert (got and got.strftime("%Y-%m-%d")) == day


def test_times_do_not_depend_on_the_session(spark):
    texts = ["2024-03-10 02:30:00", "2024-3-10T02:30:00", "20240310023000", "2024.3.10 02:30", "2024-03-10 25:00:00", "02/30/2024", "Mar 10 2024", "Foo 10 2024", "anf 1 2024", "2024-1", "1/2/2024"]
    want = ["2024-03-10 02:30:00"] * 4 + [None, None, "2024-03-10 00:00:00", None, None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert values(spark, "string", texts, lambda c: X.parse_date(c).cast("string")) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_strip_knows_all_blanks(spark):
    assert values(spark, "string", ["　a b ", "\ta\n"], X.strip) == ["a b", "a"]


def test_haversine(spark):
    got = spark.range(1).select(X.haversine(F.lit(37.0), F.lit(127.0), F.lit(38.0), F.lit(127.0))).first()[0]
    assert got == pytest.approx(111194.92664455889)
    assert spark.range(1).select(X.haversine(F.lit(37.0), F.lit(127.0), F.lit(37.0), F.lit(127.0))).first()[0] == 0


def test_clamp(spark):
    assert values(spark, "double", [-5.0, 0.0, 42.0, 1000.0, float("nan"), None], X.clamp) == [0, 0, 42, 100, 0, None]


def test_density(spark):
    assert values(spark, "int", [0, 10, 20, 50], X.density_score) == [0, 50, 100, 100]
    assert values(spark, "int", [5], lambda c: X.density_score(c, 0)) == [0]


def test_zone_score(spark):
    assert values(spark, "double", [0.0, 250.0, 500.0, 900.0, None], X.zone_score) == [100, 50, 0, 0, None]
    assert values(spark, "double", [250.0], lambda c: X.zone_score(c, 0)) == [50]  # 0 means the default
    assert values(spark, "double", [250.0, None], lambda c: X.zone_score(c, -1)) == [0, None]


def test_rain_score(spark):
    assert values(spark, "double", [0.0, 15.0, 90.0, -1.0, None], X.rain_score) == [0, 50, 100, 0, None]
    assert values(spark, "double", [5.0, None], lambda c: X.rain_score(c, 0)) == [0, None]


def test_road_score(spark):
    rows = spark.createDataFrame([("a", 2, 4), ("a", None, 4), ("", 2, 4), (None, 2, 4), (" ", None, 4), ("a", 2, None)], "k string, n int, m int")
    assert [r[0] for r in rows.select(X.road_score(F.col("k"), F.col("n"), F.col("m"))).collect()] == [50, 0, None, None, 0, None]


def test_rain_text(spark):
    texts = ["강수없음", "", "-", "null", None, "1.0mm 미만", "3.5mm", "50.0mm 이상", "30.0~50.0mm", "heavy"]
    assert values(spark, "string", texts, X.rain_of_text) == [0, 0, 0, 0, 0, 0.5, 3.5, 50, 30, 0]


def test_forecast_base(spark):
    times = ["2024-05-02 02:44:00", "2024-05-02 02:45:00", "2024-05-02 23:59:00", "2024-05-02 00:10:00", "2024-05-02 12:00:00"]
    got = values(spark, "string", times, lambda c: X.forecast_base(c.cast("timestamp_ntz")))
    assert [tuple(g) for g in got] == [("20240501", "2300"), ("20240502", "0200"), ("20240502", "2300"), ("20240501", "2300"), ("20240502", "1100")]


def test_distance_text(spark):
    assert values(spark, "double", [0.0, 999.0, 1000.0, 1234567.0], X.distance_text) == ["0 m", "999 m", "1.00 km", "1,234.57 km"]


def test_dms(spark):
    rows = spark.createDataFrame([(37.0, 23.0, 39.48, False), (200.0, 0.0, 0.0, False), (10.0, 30.0, 0.0, True)], "d double, m double, s double, n boolean")
    got = [r[0] for r in rows.select(X.dms_degrees(F.col("d"), F.col("m"), F.col("s"), F.col("n"), 90)).collect()]
    assert got[0] == pytest.approx(37.3943) and got[1:] == [None, -10.5]


def test_flags(spark):
    assert values(spark, "int", [1, 0, None, 7], X.flag_text) == ["예", "아니오", None, None]


def test_overlap(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 3.0, 2.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0))], f"a {box}, b {box}")
    assert [r[0] for r in rows.select(X.overlap(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0]


def test_letterbox(spark):
    got = spark.range(1).select(X.letterbox(F.lit(1280), F.lit(720))).first()[0]
    assert tuple(got) == (0.5, 640, 360, 0, 140)


def test_photo_severity(spark):
    kind = "array<struct<class_name:string,confidence:double>>"
    rows = [None, [], [("D40", 0.9)], [("D00", 0.9)], [("D40", 1.0)] * 20, [("other", 1.0)], [(None, None)]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, d {kind}").orderBy("i")
    got = [r[0] for r in frame.select(X.photo_severity(F.col("d"), F.lit(1.0))).collect()]
    assert got[0] is None and got[1] == 0 and got[2] > got[3] and got[4] == 100
    assert got[5] == pytest.approx(30 + 4 + 20) and got[6] == pytest.approx(24)


def _scores(spark, rows):
    return risk.with_risk(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in risk.NAMES)))


def test_every_pattern_of_missing_components(spark):
    rows = [tuple(100.0 if x else None for x in some) for some in itertools.product([0, 1], repeat=5)]
    for row, got in zip(rows, _scores(spark, rows).collect(), strict=True):
        there = [n for n, x in zip(risk.NAMES, row, strict=True) if x is not None]
        assert got["risk"]["used"] == there
        assert got["risk"]["excluded"] == [n for n in risk.NAMES if n not in there]
        assert got["risk"]["total"] == (100 if there else 0)
        shares = [got["risk"]["components"][n]["effective_weight"] for n in there]
        assert not there or sum(shares) == pytest.approx(1, abs=1e-3)


def test_risk_totals(spark):
    rows = [(1000.0, -50.0, 200.0, 100.0, 100.0), (100.0, 0.0, 0.0, 0.0, 0.0), (42.0, None, None, None, None), (float("nan"), None, None, None, 50.0)]
    totals = [r["risk"]["total"] for r in _scores(spark, rows).collect()]
    assert totals == [75.0, 30.0, 42.0, 12.5]


def test_risk_formula(spark):
    rows = _scores(spark, [(50.0, None, None, None, 20.0), (None,) * 5]).select(risk.formula(F.col("risk")).alias("formula"))
    got = [r["formula"] for r in rows.collect()]
    assert got[0] == "0.750 × 과거 파손 이력 밀도(50.0) + 0.250 × 강수 영향(20.0) = 42.50"
    assert got[1] == fixed.NO_FORMULA


def test_custom_weights(spark):
    frame = spark.createDataFrame([(10.0, 90.0)], "history_density double, rainfall double")
    assert risk.with_risk(frame, {"history_density": 1.0, "rainfall": 3.0}).first()["risk"]["total"] == 70
    assert risk.with_risk(frame, {"photo_severity": 1.0}).first()["risk"]["total"] == 0


def test_printed_as_in_python(spark):
    frame = spark.range(10_001).select((F.col("id") / 10_000).alias("x"), (F.col("id") / 100).alias("y"))
    for x, a, y, b in frame.select("x", X.printed(F.col("x"), 3), "y", X.printed(F.col("y"), 1)).collect():
        assert (a, b) == (f"{x:.3f}", f"{y:.1f}")


def test_totals_round_as_sql_does(spark):
    """A total of 45.714999999999996 is 4571.5 hundredths when it is scaled."""
    row = _scores(spark, [(1.74, 85.0, None, 90.0, 13.0)]).select("risk.total", "risk.total_raw", risk.formula(F.col("risk")).alias("formula")).first()
    assert row["total_raw"] == 45.714999999999996 and row["total"] == 45.72 and row["formula"].endswith(" = 45.72")
