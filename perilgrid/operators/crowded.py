"""Suppression for crowded images: rounds over a grid, with the same result as the fold over an image's sorted boxes.

Boxes that clash overlap by a share ``iou`` of their union, so their widths differ by a factor of ``1 / iou`` at most, and so do
their heights; their centres lie within half the sum of the widths, less ``iou`` of the larger one. A box therefore has one
cell, of its classes of width and height and of the place of its centre in a grid as fine as those classes, and whatever clashes
with it lies in a bounded number of cells. In each round the first box of every cell asks the cells around it: it is kept if no box
before it clashes with it, and then all boxes that clash with it go. The first box of an image is always kept, so rounds end; a
round looks at each cell's first box against its neighbourhood, never at all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions.columns import overlap
from perilgrid.sources.frozen import Frozen

BOX = ("det_id", "class_name", "confidence", "x1", "y1", "x2", "y2")
SIDES = ("x1", "y1", "x2", "y2")
#: A box's cell; the image's id lies in a struct, so that a null one joins too.
KEY = ("image", "cw", "ch", "cx", "cy")
#: Cells across a box of its class's largest size; finer ones have more first boxes in a round, and far more cells around each.
FINE = 1


def _scale(iou: float) -> float:
    """Sizes of a class span this factor; a little more than boxes that clash can differ by, for rounding."""
    return 1.001 / iou


def _cells(rows: DataFrame, iou: float) -> DataFrame:
    """Adds a box's own cell."""
    base = _scale(iou)
    size = {"cw": F.col("x2") - F.col("x1"), "ch": F.col("y2") - F.col("y1")}
    rows = rows.withColumns({c: F.floor(F.log(base, s)).cast("int") for c, s in size.items()})
    cell = lambda c: F.pow(F.lit(base), F.col(c) + 1) / FINE
    centre = {"cx": ("x1", "x2", "cw"), "cy": ("y1", "y2", "ch")}
    return rows.withColumns({n: F.floor((F.col(a) + F.col(b)) / 2 / cell(c)) for n, (a, b, c) in centre.items()})


def _around(rows: DataFrame, iou: float) -> DataFrame:
    """A row for every cell that may hold a box which clashes; the box's own columns start with ``a_``."""
    base = _scale(iou)
    rows = rows.select(*KEY, *(F.col(c).alias(f"a_{c}") for c in ("uid", "rank", *SIDES)))

    def axis(rows: DataFrame, kind: str, place: str, low: str, high: str) -> DataFrame:
        size, centre = F.col(f"a_{high}") - F.col(f"a_{low}"), (F.col(f"a_{high}") + F.col(f"a_{low}")) / 2
        rows = rows.withColumn(kind, F.explode(F.sequence(F.col(kind) - 1, F.col(kind) + 1)))
        widest = F.pow(F.lit(base), F.col(kind) + 1)
        reach = ((size + F.least(widest, size * base)) / 2 - size * iou) * (1 + 1e-9)
        first, last = (F.floor((centre + sign * reach) * FINE / widest) for sign in (-1, 1))
        return rows.withColumn(place, F.explode(F.sequence(first, last)))

    # Spark's estimate of a size doesn't count generated rows, so a broadcast of these must be ruled out.
    return axis(axis(rows, "cw", "cx", "x1", "x2"), "ch", "cy", "y1", "y2").hint("merge")


def suppress(detections: DataFrame, first: list[Column], iou: float, equal: bool = False) -> DataFrame:
    """Rows of the boxes kept (image_id and ``BOX``), taken in order of ``first`` and then of their columns.

    A box goes if it overlaps a kept one by more than ``iou``, or by as much where ``equal``. Boxes without an area, and those with a
    null, NaN or infinite coordinate, clash with none and stay; of repeated rows with an area one stays."""
    if not 0 < iou < 1:
        raise ValueError("the share of overlap must lie between 0 and 1")
    spark, frozen = detections.sparkSession, Frozen(detections.sparkSession, "crowded")
    finite = F.lit(True)
    for c in SIDES:
        finite = finite & (F.abs(F.col(c)) < math.inf)  # NaN is larger than any number
    sound = F.coalesce(finite & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    rank = F.struct(*(c.alias(f"r{i}") for i, c in enumerate(first)), F.struct(*BOX).alias("box"))
    rows = detections.select("image_id", *BOX, rank.alias("rank"), sound.alias("sound"))
    free = rows.filter("NOT sound").select("image_id", *BOX)
    left = frozen(_cells(rows.filter("sound").select(F.struct("image_id").alias("image"), "rank", *BOX), iou).withColumn("uid", F.monotonically_increasing_id()), "left-0")
    kinds = left.schema
    clash = overlap(*(F.struct(*(F.col(f"{p}{c}").alias(c) for c in SIDES)) for p in ("a_", "")))
    clash = clash >= iou if equal else clash > iou

    n = 0
    while not left.isEmpty():
        top = left.groupBy(*KEY).agg(F.min(F.struct("rank", "uid", *BOX)).alias("top")).select(*KEY, "top.*")
        asking = frozen(top, f"asking-{n}")
        blocked = left.join(_around(asking, iou), list(KEY)).filter((F.col("rank") < F.col("a_rank")) & clash)
        kept = frozen(asking.join(blocked.select(F.col("a_uid").alias("uid")).distinct(), "uid", "left_anti"), f"kept-{n}")
        gone = left.join(_around(kept, iou), list(KEY)).filter(clash).select("uid").distinct()
        fewer = frozen(left.join(gone, "uid", "left_anti").select(*kinds.names), f"left-{n + 1}")
        frozen.drop(f"left-{n}", f"asking-{n}")
        left, n = fewer, n + 1
    if not n:
        return free
    kept = spark.read.schema(kept.schema).parquet(f"{frozen.root}/kept-*")
    return kept.select("image.image_id", *BOX).unionByName(free)
