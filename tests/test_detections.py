"""Detections: suppression, areas, decoding."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilgrid.operators import crowded
from perilgrid.operators import detections as D

KIND = "image_id long, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def frame(spark, *boxes):
    return spark.createDataFrame([(1, i, "D00", c, *map(float, b)) for i, (c, b) in enumerate(boxes)], KIND)


def kept(rows):
    return [b["det_id"] for b in rows.first()["kept"]]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0


def test_confidence_bound_is_included(spark):
    assert D.confident(frame(spark, (0.25, (0, 0, 1, 1)), (0.2499, (0, 0, 1, 1)))).count() == 1


def test_greedy_against_brute_force(spark):
    rng = np.random.default_rng(1)
    boxes = [(float(c), (x, y, x + w, y + h)) for c, x, y, w, h in zip(rng.random(40), *rng.integers(0, 20, (2, 40)), *rng.integers(1, 20, (2, 40)), strict=True)]
    want = []
    for i in sorted(range(40), key=lambda i: (-boxes[i][0], i)):
        if all(iou(boxes[i][1], boxes[j][1]) <= 0.45 for j in want):
            want.append(i)
    assert kept(D.nms(frame(spark, *boxes))) == want
    area = [(b[2] - b[0]) * (b[3] - b[1]) for _, b in boxes]
    want = []
    for i in sorted(range(40), key=lambda i: (-area[i], i)):
        if all(iou(boxes[i][1], boxes[j][1]) < 0.3 for j in want):
            want.append(i)
    assert kept(D.suppress_boxes(frame(spark, *boxes))) == want


def test_empty_boxes_never_clash(spark):
    assert kept(D.nms(frame(spark, (0.9, (5, 5, 5, 5)), (0.8, (5, 5, 5, 5))))) == [0, 1]


def test_area_ratio(spark):
    rng = np.random.default_rng(2)
    boxes = [(0.5, (x, y, x + w, y + h)) for x, y, w, h in zip(*rng.uniform(-5, 30, (2, 12)), *rng.uniform(0, 20, (2, 12)), strict=True)]
    mask = np.zeros((32, 32), bool)
    for _, (x1, y1, x2, y2) in boxes:
        x1, y1, x2, y2 = (round(float(v)) for v in (x1, y1, x2, y2))
        mask[max(0, y1) : max(0, min(32, y2)), max(0, x1) : max(0, min(32, x2))] = True
    assert D.area_ratios(frame(spark, *boxes), 32, 32).first()["ratio"] == pytest.approx(mask.mean())


def test_wide_images(spark):
    boxes = [(0.5, (3, 0, 59.6, 2)), (0.5, (60, 1, 121, 3)), (0.5, (0, 2, 400, 3)), (0.5, (119, 0, 120, 1))]
    mask = np.zeros((5, 300), bool)
    for _, (x1, y1, x2, y2) in boxes:
        mask[round(y1) : round(y2), round(x1) : round(x2)] = True
    assert D.area_ratios(frame(spark, *boxes), 300, 5).first()["ratio"] == pytest.approx(mask.mean())


def test_half_edges_go_to_even(spark):
    assert D.area_ratios(frame(spark, (0.5, (0.5, 0, 2.5, 1))), 10, 10).first()["ratio"] == pytest.approx(0.02)
    assert D.area_ratios(frame(spark, (0.5, (5, 5, 5, 5))), 10, 10).first()["ratio"] == 0
    assert D.area_ratios(frame(spark, (0.5, (0, 0, 1, 1))), 0, 10).first()["ratio"] == 0


def test_top_is_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.5, *[0.0] * 4), (1, 1, "b", 0.9, *[0.0] * 4), (1, 2, "c", 0.9, *[0.0] * 4)], KIND)
    assert tuple(D.top_detections(rows).first()) == (1, "b", 0.9, 3)


def test_decoding(spark):
    out = np.zeros((1, 8, 20), np.float32)
    out[0, :4, 3] = [320, 320, 64, 64]
    out[0, 4 + 3, 3] = 0.8
    out[0, :4, 7] = [10, 150, 40, 40]
    out[0, 4, 7] = 0.25
    rows = [(1, list(out.shape), out.ravel().tolist()), (2, list(out.shape[::-1]), out.T.ravel().tolist()), (3, [4, 20], [0.0] * 80)]
    raw = spark.createDataFrame(rows, "image_id long, shape array<int>, values array<float>")
    got = D.decode_output(raw).orderBy("image_id", "det_id").collect()
    assert [(r["image_id"], r["det_id"], r["class_name"]) for r in got] == [(1, 3, "D40"), (1, 7, "D00"), (2, 3, "D40"), (2, 7, "D00")]
    place = D.decode_output(raw, ["only"]).withColumns({"scale": F.lit(0.5), "pad_x": F.lit(0), "pad_y": F.lit(140), "width": F.lit(1280), "height": F.lit(720)})
    boxes = D.unletterbox(place).filter("image_id = 1").orderBy("det_id").collect()
    assert [boxes[0][c] for c in ("class_name", "x1", "y1", "x2", "y2")] == ["3", 576, 296, 704, 424]
    assert [boxes[1][c] for c in ("x1", "y1", "x2", "y2")] == [0, 0, 60, 60]


def heap(rng, n, images=1):
    """Boxes in heaps, with equal confidences, some without an area or without numbers, and repeated rows."""
    rows = []
    for i in range(n):
        x, y = rng.integers(0, 4, 2) * 60 + rng.normal(0, 5, 2)
        w, h = np.exp(rng.normal(3, 0.5, 2))
        rows.append([i % images, i, "D00", float(rng.integers(0, 20)) / 20, float(x), float(y), float(x + w), float(y + h)])
    for i in range(0, n, 37):
        rows[i][6] = rows[i][4] - (i % 2)
    return [tuple(r) for r in rows]


def test_crowded_images_against_the_fold(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame(heap(rng, 500, 3) + [(None, i, "D00", 0.5, 0.0, 0.0, 9.0, 9.0) for i in range(9)], KIND)
    pick = lambda df: sorted((str(r["image_id"]), r["det_id"]) for r in df.collect())
    want = pick(D.kept_rows(D.nms(frame)))
    assert pick(D.kept_boxes(frame, crowd=10**6)) == want == pick(D.kept_boxes(frame, crowd=5)) and 9 < len(want) < 450
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    some = frame.filter("x2 > x1 and image_id = 1")
    for iou in (0.3, 0.05, 0.9):
        got = crowded.suppress(some, [-area, F.col("det_id")], iou, equal=True)
        assert pick(got) == pick(D.kept_rows(D.suppress_boxes(some, iou)))


def test_crowded_edges(spark):
    box = (1, 1, "D00", 0.5, 0.0, 0.0, 10.0, 10.0)
    rows = [box, box, (1, 2, "D00", None, 0.0, 0.0, 10.0, 10.0), (1, 3, "D00", 0.9, 0.0, 0.0, float("nan"), 5.0), (1, 4, "D00", 0.9, None, 0.0, 9.0, 9.0), (1, 5, "D00", 0.9, 3.0, 3.0, 3.0, 3.0)]
    got = crowded.suppress(spark.createDataFrame(rows, KIND), [-F.col("confidence"), F.col("det_id")], 0.45)
    assert sorted(r["det_id"] for r in got.collect()) == [2, 3, 4, 5]  # an unknown confidence comes first, as in the fold
    assert crowded.suppress(spark.createDataFrame([], KIND), [F.col("det_id")], 0.45).count() == 0 == D.kept_boxes(spark.createDataFrame([], KIND)).count()
    half = [(1, 0, "D00", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, "D00", 0.8, 0.0, 0.0, 10.0, 5.0)]  # they overlap by exactly a half
    for equal, n in ((False, 2), (True, 1)):
        assert crowded.suppress(spark.createDataFrame(half, KIND), [-F.col("confidence"), F.col("det_id")], 0.5, equal).count() == n
    with pytest.raises(ValueError):
        crowded.suppress(spark.createDataFrame(half, KIND), [F.col("det_id")], 0.0)


def test_suppression_of_many_boxes(spark):
    """Images of very different sizes side by side, in time: the fold in the JVM took minutes for the largest of them."""
    rng = np.random.default_rng(8)
    sizes, rows, want = (1, 3000, 2, 40, 40), [], set()
    for image, n in enumerate(sizes):
        xy, wh = rng.integers(0, 4000, (n, 2)), rng.integers(1, 30, (n, 2))
        rows += [(image, i, "D00", float(rng.integers(0, 9)) / 9, *map(float, (*xy[i], *(xy[i] + wh[i])))) for i in range(n)]
    for image in range(len(sizes)):
        kept = np.zeros((0, 4))
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[3], r[1])):
            b = np.array(r[4:])
            side = np.maximum(0, np.minimum(kept[:, 2:], b[2:]) - np.maximum(kept[:, :2], b[:2]))
            both = side[:, 0] * side[:, 1]
            if not (both / ((b[2:] - b[:2]).prod() + (kept[:, 2:] - kept[:, :2]).prod(1) - both) > 0.45).any():
                kept = np.vstack([kept, b])
                want.add((image, r[1]))
    frame = spark.createDataFrame(rows, KIND)
    start = time.monotonic()
    assert {(r["image_id"], r["det_id"]) for r in D.kept_rows(D.nms(frame)).collect()} == want
    assert time.monotonic() - start < 20


def test_boxes_without_numbers_stay_in_small_images_too(spark):
    rows = [(1, 0, "D00", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, "D00", 0.8, None, 0.0, 5.0, 10.0), (1, 2, "D00", 0.7, 0.0, 0.0, float("nan"), 5.0)]
    frame = spark.createDataFrame(rows, KIND)
    assert kept(D.nms(frame)) == [0, 1, 2] and D.kept_boxes(frame, crowd=1).count() == 3


def test_images_of_a_thousand_boxes_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(crowded, "suppress", None)
    rows = [(k % 2, k, "D00", k / 4000, float(k % 40 * 10), float(k // 40 * 10), float(k % 40 * 10 + 10), float(k // 40 * 10 + 10)) for k in range(4000)]
    assert D.kept_boxes(spark.createDataFrame(rows, KIND)).count() == 4000


def test_areas_of_images_over_many_batches(spark):
    """Images that reach over Arrow batches, small and large ones, with and without an area, in one table; boxes aren't spread to rows."""
    rng = np.random.default_rng(3)
    rows, masks = [], {}
    for image, n in ((1, 700), (2, 3), (3, 1), (4, 900), (5, 2), (None, 2)):
        masks[image] = np.zeros((40, 70), bool)
        for k, (x, y, w, h) in enumerate(zip(*rng.uniform(-5, 60, (2, n)), *rng.uniform(0, 4, (2, n)), strict=True)):
            x1, y1, x2, y2 = (round(float(v)) for v in (x, y, x + w, y + h))
            masks[image][max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] |= image is not None
            rows.append((image, k, "D00", 0.5, float(x), float(y), float(x + w), float(y + h)))
    rows.append((6, 0, "D00", 0.5, None, 0.0, 9.0, 9.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        ratios = D.area_ratios(spark.createDataFrame(rows, KIND), 70, 40)
        assert "Generate" not in ratios._jdf.queryExecution().executedPlan().toString()
        got = {r["image_id"]: r["ratio"] for r in ratios.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx({k: m.mean() for k, m in masks.items()} | {6: got[6]})
