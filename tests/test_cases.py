"""Cases as events."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.operators import cases as C
from perilgrid.streaming import history as H
from perilgrid.streaming import status as S

REQUEST = "seq int, created_at timestamp_ntz, lat double, lon double, road_address string, ai_available boolean, ai_risk_score double, detections array<struct<class_name:string,confidence:double>>"
T0 = datetime(2024, 5, 1)


def request(spark, seq=0, available=True, found=(("D00", 0.5), ("D40", 0.9), ("D20", 0.9))):
    return spark.createDataFrame([(seq, T0, 37.4, 126.9, "r", available, 55.0, list(found) if found is not None else None)], REQUEST)


def test_new_case(spark):
    cases, history = C.new_cases(request(spark))
    row = cases.first()
    assert (row["id"], row["ai_detection_count"], row["ai_top_class"], row["ai_top_confidence"], row["status"]) == (1, 3, "D40", 0.9, "접수")
    assert row["ai_detections_json"].startswith('[{"class_name":"D00"')
    assert tuple(history.first())[2:] == (None, "접수", fixed.NEW_CASE_NOTE)


def test_analysis_that_did_not_run(spark):
    row = C.new_cases(request(spark, available=False, found=None))[0].first()
    assert [row[c] for c in ("ai_detection_count", "ai_top_class", "ai_top_confidence", "ai_detections_json")] == [None] * 4
    row = C.new_cases(request(spark, found=()))[0].first()
    assert row["ai_detection_count"] == 0 and row["ai_detections_json"] is None


def test_store(spark, tmp_path):
    store = C.CaseStore(spark, f"file://{tmp_path}/store")
    assert store.current() is None and not store.change(1, "점검예정", T0)
    store.create(request(spark))
    store.create(request(spark, 5))
    assert store.change(1, "점검예정", datetime(2024, 5, 2)) and store.change(1, "처리완료", datetime(2024, 5, 3), "done")
    assert not store.change(99, "점검예정", T0)
    with pytest.raises(ValueError, match="not a status"):
        store.change(1, "닫힘", T0)
    assert {(r["id"], r["status"]) for r in store.current().collect()} == {(1, "처리완료"), (2, "접수")}
    history = C.case_history(store.table("events"), 1).collect()
    assert [(r["from_status"], r["to_status"]) for r in history] == [(None, "접수"), ("접수", "점검예정"), ("점검예정", "처리완료")]
    store.append("reviews", spark.createDataFrame([(1, T0, "minor", "n", "desk")], "id long, reviewed_at timestamp_ntz, reviewer_judgement string, reviewer_note string, reviewer_name string"))
    row = store.current().filter("id = 1").first()
    assert row["reviewer_judgement"] == "minor" and row["ai_top_class"] == "D40" and row["ai_risk_score"] == 55
    assert store.delete(1) and not store.delete(1)
    assert [r["id"] for r in store.current().collect()] == [2]
    with pytest.raises(ValueError, match="no such table"):
        store.append("other", store.current())


def test_counts_keep_unknown_statuses(spark):
    rows = spark.createDataFrame([(1, "접수"), (2, "접수"), (3, "odd")], "id long, status string")
    got = dict(tuple(r) for r in C.status_counts(spark, rows).collect())
    assert got == dict.fromkeys(fixed.STATUSES, 0) | {"접수": 2, "odd": 1}


def test_list_and_display(spark):
    rows = spark.createDataFrame([(i, "접수" if i % 2 else "처리완료", i % 3 == 0) for i in range(10)], "id long, status string, ai_available boolean")
    assert [r["id"] for r in C.list_cases(rows, "접수", 2).collect()] == [9, 7]
    assert C.list_cases(rows).count() == 10
    assert C.display(rows).filter("id = 3").first()["ai_available"] == "예"
    assert C.labelled(rows).columns == ["번호", "처리상태", "AI 분석 수행"]


def test_unknown_events_fail(spark):
    rows = spark.createDataFrame([(1, T0, 1, "odd")], "inspection_id long, changed_at timestamp_ntz, id long, to_status string")
    with pytest.raises(Exception, match="not a status"):
        C.checked_events(rows).collect()


def test_route_stops_become_requests(spark):
    routes = spark.createDataFrame([(1, [0, 2, 1])], "route_id long, order array<int>")
    stops = spark.createDataFrame([(1, i, f"s{i}") for i in range(3)], "route_id long, pos int, road_address string")
    assert [r["road_address"] for r in C.stops_to_requests(routes, stops).orderBy("seq").collect()] == ["s0", "s2", "s1"]


def test_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 5, 1), 1, "접수"), (1, datetime(2024, 5, 2), 2, "점검예정"), (2, datetime(2024, 5, 1), 3, "접수")]
    kind = "inspection_id long, changed_at timestamp, id long, to_status string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    query = S.latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["inspection_id"], r["status"]) for r in spark.table("latest").collect()} == {(1, "점검예정"), (2, "접수")}
    query = S.append_events(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    query = S.changes_by_window(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").count() <= 3


@pytest.mark.parametrize("seed", [1, 2])
def test_history_of_a_stream_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["접수", "점검예정", "현장확인", "보수필요", "처리완료"]
    rows = [(rng.randrange(12), T0 + timedelta(hours=rng.randrange(300), microseconds=rng.randrange(3)), i, rng.choice(names)) for i in range(250)]
    kind = "inspection_id long, changed_at timestamp, id long, to_status string"
    want = {tuple(r) for r in C.with_from_status(spark.createDataFrame(rows, kind)).select("id", "inspection_id", "from_status", "to_status").collect()}
    rng.shuffle(rows)
    late = [(99, T0 + timedelta(days=400 + k), 1000 + k, "접수") for k in range(2)]  # moves the watermark past everything
    parts = [rows[k::5] + (rows[:9] if k else []) for k in range(5)] + [late[:1], late[1:]]  # with repeated events
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        (file,) = [x for x in os.listdir(f"{tmp_path}/in{k}") if x.endswith(".parquet")]
        os.rename(f"{tmp_path}/in{k}/{file}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = H.history_stream(stream, "100 days").writeStream.outputMode("append").format("memory").queryName(f"history{seed}").option("checkpointLocation", f"{tmp_path}/cp").start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [tuple(r) for r in spark.table(f"history{seed}").filter("id < 1000").select("id", "inspection_id", "from_status", "to_status").collect()]
    assert len(got) == len(set(got)) == 250 and set(got) == want
