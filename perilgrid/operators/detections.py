"""Object detections: confidence, greedy suppression, areas, severity, and the decoding of a model's output.

Suppression looks at images whole, many at once in arrays, each box after those before it; images with too many boxes for one row are
suppressed in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from perilgrid.functions import fixed
from perilgrid.functions.columns import class_weight, letterbox, severity
from perilgrid.operators import crowded
from perilgrid.sources.frozen import Frozen

#: Bytes of an Arrow batch at most.
BATCH = 8 << 20
BOX = "struct<det_id:bigint,class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>"


def confident(detections: DataFrame, least: float = fixed.CONFIDENCE) -> DataFrame:
    return detections.filter(F.col("confidence") >= least)


SIDES = ("x1", "y1", "x2", "y2")


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all stretches from a start up to its end, and for each which stretch it belongs to."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) + (starts - np.cumsum(sizes) + sizes)[which], which


def greedy(sides: dict[str, np.ndarray], offsets: np.ndarray, iou: float, equal: bool) -> np.ndarray:
    """Which boxes are kept, of images whose boxes lie side by side between offsets, sorted by rank: a box goes if it overlaps one kept
    before by more than ``iou``, or by as much where ``equal``. The boxes of one rank of all images are looked at together. Boxes
    without an area, and those with a coordinate that is missing or not finite, clash with none."""
    x1, y1, x2, y2 = (sides[c] for c in SIDES)
    with np.errstate(invalid="ignore"):
        sound = np.isfinite(x1) & np.isfinite(y1) & np.isfinite(x2) & np.isfinite(y2) & (x2 > x1) & (y2 > y1)
        area = (x2 - x1) * (y2 - y1)
    kept = np.ones(len(x1), bool)
    large_first = np.argsort(offsets[:-1] - offsets[1:], kind="stable")
    starts, ends = offsets[:-1][large_first], offsets[1:][large_first]
    sizes = ends - starts
    for rank in range(int(sizes[0]) - 1 if len(sizes) else 0):
        n = np.searchsorted(-sizes, -rank, side="left")  # images with boxes from this rank on
        top = starts[:n] + rank
        asks = np.flatnonzero(kept[top] & sound[top])
        other, which = _spread(top[asks] + 1, ends[asks])  # no more than all boxes at hand
        open_ = kept[other] & sound[other]
        other, own = other[open_], top[asks][which[open_]]
        w = np.maximum(0.0, np.minimum(x2[own], x2[other]) - np.maximum(x1[own], x1[other]))
        both = w * np.maximum(0.0, np.minimum(y2[own], y2[other]) - np.maximum(y1[own], y1[other]))
        share = both / (area[own] + area[other] - both)
        kept[other[share >= iou if equal else share > iou]] = False
    return kept


def _suppressed(grouped: DataFrame, iou: float, equal: bool) -> DataFrame:
    """image_id, n_in and kept from (image_id, boxes), arrays of boxes sorted by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = batch.column("boxes")
            flat, offsets = boxes.flatten(), np.concatenate([[0], np.cumsum(boxes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            sides = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in SIDES}
            kept = greedy(sides, offsets, iou, equal)
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(kept)), type=boxes.type)
            yield pa.record_batch([batch.column("image_id"), pa.array(np.diff(offsets), pa.int32()), lists], names=["image_id", "n_in", "kept"])

    grouped.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    kinds = grouped.schema
    out = StructType([kinds["image_id"], StructField("n_in", IntegerType()), StructField("kept", kinds["boxes"].dataType)])
    return grouped.mapInArrow(run, out)


def _boxes(*rank: Column) -> Column:
    """An image's boxes, sorted by rank."""
    names = ("det_id", "class_name", "confidence", "x1", "y1", "x2", "y2")
    sort = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), F.struct(*names).alias("box"))
    return F.transform(F.sort_array(F.collect_list(sort)), lambda s: s.box)


def nms(detections: DataFrame, iou: float = fixed.NMS_IOU) -> DataFrame:
    """image_id and kept, an array of boxes: most confident first, the smaller det_id first among equals; a box is dropped if
    it overlaps a kept one by more than the threshold."""
    grouped = detections.groupBy("image_id").agg(_boxes(-F.col("confidence"), F.col("det_id")).alias("boxes"))
    return _suppressed(grouped, iou, False)


def suppress_boxes(detections: DataFrame, iou: float = fixed.SUPPRESS_IOU) -> DataFrame:
    """The same for privacy boxes: largest first, and a box stays only if it overlaps all kept ones by less."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    grouped = detections.groupBy("image_id").agg(_boxes(-area, F.col("det_id")).alias("boxes"))
    return _suppressed(grouped, iou, True)


def kept_rows(suppressed: DataFrame) -> DataFrame:
    return suppressed.select("image_id", F.inline("kept"))


#: Boxes of an image up to which it is suppressed as one row, of a megabyte or so: larger ones go in rounds, which write
#: all boxes left to disk in each of them.
CROWD = 16_384


def kept_boxes(detections: DataFrame, iou: float = fixed.NMS_IOU, crowd: int = CROWD) -> DataFrame:
    """Rows of the boxes that ``nms`` keeps, for images of any number of boxes: those with more than ``crowd`` are suppressed in
    rounds over a grid, the others as ``nms`` does. Images with a null id are one image."""
    sizes = detections.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("image_id")
    sizes = Frozen(detections.sparkSession, "crowds")(sizes, "large")
    if sizes.isEmpty():
        return kept_rows(nms(detections, iou))
    same = detections["image_id"].eqNullSafe(sizes["image_id"])
    few = kept_rows(nms(detections.join(sizes, same, "left_anti"), iou))
    many = crowded.suppress(detections.join(sizes, same, "left_semi"), [-F.col("confidence"), F.col("det_id")], iou)
    return few.unionByName(many)


#: Pixels of images that are drawn together.
CELLS = 1 << 18


def _drawn(image: np.ndarray, n: int, boxes: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Which pixels of n images boxes cover: corners are marked, and sums along both axes fill the boxes."""
    x1, y1, x2, y2 = boxes
    marks = np.zeros((n, height + 1, width + 1), np.int32)
    for y, x, sign in ((y1, x1, 1), (y1, x2, -1), (y2, x1, -1), (y2, x2, 1)):
        np.add.at(marks.reshape(-1), (image * (height + 1) + y) * (width + 1) + x, sign)
    return (marks.cumsum(1, dtype=np.int32).cumsum(2, dtype=np.int32) > 0)[:, :height, :width]


def area_ratios(detections: DataFrame, width: int, height: int) -> DataFrame:
    """image_id and ratio, the share of the image that boxes cover, overlaps counted once.

    Edges are rounded half to even and clipped. Boxes are sorted by image and drawn as they stream, many small images together; a task
    holds the pixels of one image, or of ``CELLS``, whatever the number of boxes."""
    if width <= 0 or height <= 0:
        return detections.select("image_id").distinct().withColumn("ratio", F.lit(0.0))
    edge = {
        "x1": F.greatest(F.lit(0), F.rint("x1").cast("int")),
        "y1": F.greatest(F.lit(0), F.rint("y1").cast("int")),
        "x2": F.least(F.lit(width), F.rint("x2").cast("int")),
        "y2": F.least(F.lit(height), F.rint("y2").cast("int")),
    }
    clipped = detections.withColumns(edge).select("image_id", *edge)
    covers = F.coalesce(F.expr("x2 > x1 and y2 > y1"), F.lit(False))
    clipped = clipped.select("image_id", *(F.when(covers, F.col(c)).otherwise(0).alias(c) for c in edge)).repartition("image_id").sortWithinPartitions("image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mask = None, None  # the image that the next batch may go on with, and its pixels

        def out(ids: pa.Array, pixels: list[int]) -> pa.RecordBatch:
            return pa.record_batch([ids, pa.array(pixels, pa.int64())], names=["image_id", "pixels"])

        for batch in batches:
            ids = batch.column("image_id")
            if not len(ids):
                continue
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            ends, pixels = np.append(starts[1:], len(ids)), []
            image = np.repeat(np.arange(len(starts)), ends - starts)
            boxes = [batch.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")]
            if last is not None and last[0].as_py() != ids[0].as_py():
                yield out(last, [int(mask.sum())])
                mask = None
            step = max(1, CELLS // (width * height))
            for first in range(0, len(starts), step):
                n = min(step, len(starts) - first)
                part = slice(starts[first], ends[first + n - 1])
                drawn = _drawn(image[part] - first, n, [b[part] for b in boxes], width, height)
                if not first and mask is not None:
                    drawn[0] |= mask
                pixels += drawn.sum((1, 2)).tolist()
            last, mask = ids.slice(len(ids) - 1), drawn[-1].copy()
            yield out(ids.take(pa.array(starts[:-1])), pixels[:-1])
        if last is not None:
            yield out(last, [int(mask.sum())])

    detections.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    covered = clipped.mapInArrow(run, StructType([clipped.schema["image_id"], StructField("pixels", LongType())]))
    pixels = F.when(F.col("image_id").isNotNull(), F.col("pixels")).otherwise(0)
    return covered.select("image_id", (pixels / F.lit(float(width * height))).alias("ratio"))


def severities(detections: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """image_id and severity, from the detections of each image and its area ratio."""
    peak = F.max(class_weight(F.col("class_name")) * F.col("confidence"))
    by_image = detections.groupBy("image_id").agg(peak.alias("peak"), F.count("*").alias("n"))
    by_image = by_image.withColumn("ratio", F.lit(None).cast("double")) if ratios is None else by_image.join(ratios, "image_id", "left")
    return by_image.select("image_id", severity(F.col("peak"), F.col("n"), F.col("ratio")).alias("severity"))


def top_detections(detections: DataFrame) -> DataFrame:
    """The most confident detection of each image, the first of equals."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "det_id", "class_name")).alias("best")
    return detections.groupBy("image_id").agg(best, F.count("*").alias("n")).select(
        "image_id", F.col("best.class_name").alias("top_class"), (-F.col("best.c")).alias("top_confidence"), F.col("n").alias("n_detections")
    )


def unletterbox(boxes: DataFrame) -> DataFrame:
    """Boxes from centre and size in a padded square (cx, cy, w, h, scale, pad_x, pad_y, width, height) to corners in the
    image, clipped to it."""

    def corner(centre: str, size: str, sign: int, pad: str, whole: str) -> Column:
        value = (F.col(centre) + sign * F.col(size) / 2 - F.col(pad)) / F.col("scale")
        return F.greatest(F.lit(0.0), F.least(F.col(whole) - 1.0, value))

    return boxes.withColumns(
        {
            "x1": corner("cx", "w", -1, "pad_x", "width"),
            "y1": corner("cy", "h", -1, "pad_y", "height"),
            "x2": corner("cx", "w", 1, "pad_x", "width"),
            "y2": corner("cy", "h", 1, "pad_y", "height"),
        }
    )


DECODED = "image_id bigint, det_id bigint, class_id int, class_name string, confidence double, cx double, cy double, w double, h double"


def decode_output(outputs: DataFrame, classes: list[str] | None = None, least: float = fixed.CONFIDENCE) -> DataFrame:
    """Rows of detections from a detector's raw outputs (image_id, shape array<int>, values array<float>): the smaller axis
    holds four box numbers and a score for each class. Suppression follows by ``unletterbox`` and ``nms``."""
    classes = fixed.CLASSES if classes is None else classes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {c: [] for c in ("image_id", "det_id", "class_id", "confidence", "cx", "cy", "w", "h")}
            for image, shape, values in zip(batch["image_id"], batch["shape"], batch["values"], strict=True):
                a = np.squeeze(np.asarray(values, np.float32).reshape(shape))
                if a.ndim != 2:
                    continue
                a = a if a.shape[0] < a.shape[1] else a.T
                if a.shape[0] <= 4:
                    continue
                which, score = a[4:].argmax(0), a[4:].max(0)
                good = np.flatnonzero(score >= least)
                for c, v in zip(found, (np.full(len(good), image), good, which[good], score[good], *a[:4, good]), strict=True):
                    found[c].append(v)
            if not found["image_id"]:
                continue
            table = {c: np.concatenate(v) for c, v in found.items()}
            table["class_name"] = [classes[c] if c < len(classes) else str(c) for c in table["class_id"].tolist()]
            yield pd.DataFrame(table)[["image_id", "det_id", "class_id", "class_name", "confidence", "cx", "cy", "w", "h"]].astype(
                {"class_id": "int32"} | {c: float for c in ("confidence", "cx", "cy", "w", "h")}
            )

    return outputs.select("image_id", "shape", "values").mapInPandas(run, DECODED)


def detect(outputs: DataFrame, sizes: DataFrame, classes: list[str] | None = None, least: float = fixed.CONFIDENCE, iou: float = fixed.NMS_IOU) -> DataFrame:
    """The boxes that a detector's raw outputs (image_id, shape, values) come to: decoded, taken out of the padded square into
    images of ``sizes`` (image_id, width, height), and suppressed. Outputs without a size, or sizes without an output, give no
    rows."""
    box = letterbox(F.col("width").cast("double"), F.col("height").cast("double"))
    fitted = sizes.select("image_id", "width", "height", box.alias("fit")).select("image_id", "width", "height", "fit.scale", "fit.pad_x", "fit.pad_y")
    return kept_rows(nms(unletterbox(decode_output(outputs, classes, least).join(fitted, "image_id")), iou))
