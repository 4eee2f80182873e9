"""Images: binary files, places from their metadata, mosaics, and a detector that is honest about being absent."""

from __future__ import annotations

import ast
import os
import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.functions import fixed


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _tags(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    n = struct.unpack_from(order + "H", data, at)[0]
    return {
        tag: (kind, count, data[at + 10 + 12 * i : at + 14 + 12 * i])
        for i in range(n)
        for tag, kind, count in [struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)]
    }


def gps_of(content: bytes) -> tuple[float, float] | None:
    """Latitude and longitude from a JPEG's EXIF block; None without one, or if it is damaged or out of range."""
    try:
        at = content.index(b"Exif\0\0") + 6
        data = content[at:]
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        main = _tags(data, struct.unpack_from(order + "I", data, 4)[0], order)
        gps = _tags(data, struct.unpack(order + "I", main[0x8825][2])[0], order)

        def degrees(tag: int) -> float:
            place = struct.unpack(order + "I", gps[tag][2])[0]
            parts = struct.unpack_from(order + "6I", data, place)
            d, m, s = (a / b for a, b in zip(parts[::2], parts[1::2], strict=True))
            return d + m / 60 + s / 3600

        def letter(tag: int, default: str) -> str:
            return gps[tag][2][:1].decode().upper() if tag in gps else default

        lat = degrees(2) * (-1 if letter(1, "N") == "S" else 1)
        lon = degrees(4) * (-1 if letter(3, "E") == "W" else 1)
        return (lat, lon) if -90 <= lat <= 90 and -180 <= lon <= 180 else None
    except (ValueError, KeyError, IndexError, struct.error, ZeroDivisionError):
        return None


def places(images: DataFrame) -> DataFrame:
    """(path, lat, lon); nulls where an image tells no place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [gps_of(bytes(c)) or (None, None) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "lat": [g[0] for g in got], "lon": [g[1] for g in got]}).astype({"lat": float, "lon": float})

    return images.select("path", "content").mapInPandas(run, "path string, lat double, lon double")


def mosaic(image: np.ndarray, x: int, y: int, w: int, h: int, blocks: int = 10) -> np.ndarray:
    """A copy with a region averaged into blocks; the region is clipped to the image, and nothing else changes."""
    out = image.copy()
    height, width = image.shape[:2]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
    if x1 <= x0 or y1 <= y0:
        return out
    if max(y1 - y0, x1 - x0) <= blocks:  # a block is one pixel
        return out
    rows = np.minimum(np.arange(y1 - y0) * min(blocks, y1 - y0) // (y1 - y0), blocks - 1)
    columns = np.minimum(np.arange(x1 - x0) * min(blocks, x1 - x0) // (x1 - x0), blocks - 1)
    region = out[y0:y1, x0:x1]
    for r in np.unique(rows):
        for c in np.unique(columns):
            cut = np.ix_(rows == r, columns == c)
            region[cut] = region[cut].reshape(-1, *image.shape[2:]).mean(0).round().astype(image.dtype)
    return out


def anonymize(image: np.ndarray, faces: list[tuple[int, int, int, int]] | None) -> tuple[np.ndarray | None, dict[str, str]]:
    """The image with faces covered, and what was done. Without a face detector (None) there is no image to pass on, and the
    state says so; plates are never claimed to be covered."""
    if faces is None:
        return None, {"face_status": "unavailable", "plate_status": "not performed"}
    for box in faces:
        image = mosaic(image, *box)
    return image.copy(), {"face_status": "performed", "plate_status": "not performed"}


def cover_faces(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, shape, pixels) with the boxes (image_id, x, y, w, h) of each image covered. Pixels are raw bytes in rows; an
    image without boxes stays as it is.

    Boxes grow with images, so they are merged with them: Spark judges by the size of compressed files what it broadcasts, and the driver
    would hold the boxes of all images."""
    wanted = boxes.groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes")).hint("merge")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shape, pixels, some in zip(b["shape"], b["pixels"], b["boxes"], strict=True):
                image = np.frombuffer(pixels, np.uint8).reshape([int(k) for k in shape])
                for box in some if some is not None else ():
                    image = mosaic(image, *(int(box[k]) for k in ("x", "y", "w", "h")))
                out.append(image.tobytes())
            yield pd.DataFrame({"image_id": b["image_id"], "shape": b["shape"], "pixels": out})

    joined = images.join(wanted, "image_id", "left").select("image_id", "shape", "pixels", "boxes")
    return joined.mapInPandas(run, "image_id bigint, shape array<int>, pixels binary")


def write_images(covered: DataFrame, path: str, originals: DataFrame | None = None) -> None:
    """Writes covered images; originals only where they are given, which a setting must allow."""
    covered.write.mode("append").parquet(f"{path}/covered")
    if originals is not None:
        originals.write.mode("append").parquet(f"{path}/original")


def find_model(folder: str, environ: Mapping[str, str] | None = None) -> str | None:
    """A model file: the one that MODEL_PATH names, else best.onnx, else best.pt; other kinds don't count."""
    named = (environ if environ is not None else os.environ).get("MODEL_PATH", "").strip()
    for path in ([named] if named else []) + [os.path.join(folder, n) for n in ("best.onnx", "best.pt")]:
        if path.endswith((".onnx", ".pt")) and os.path.isfile(path):
            return path
    return None


def class_names(metadata: Mapping[str, str], fallback: list[str] | None = None) -> list[str]:
    """Class names that a model carries, a list or a table by number; else the fallback."""
    fallback = fixed.CLASSES if fallback is None else fallback
    try:
        known = ast.literal_eval(metadata["names"])
    except (KeyError, ValueError, SyntaxError):
        return fallback
    if isinstance(known, dict):
        return [str(known[k]) for k in sorted(known, key=int)]
    return [str(x) for x in known] if isinstance(known, list) else fallback


_sessions: dict[str, object] = {}


def detect(tensors: DataFrame, model: str | None) -> DataFrame:
    """Raw outputs (image_id, shape, values) of an ONNX model for tensors (image_id, shape, values); null shape and values
    where the model isn't there: a detection is never made up. A session is opened once in each Python worker."""
    schema = "image_id bigint, shape array<int>, values array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = None
        if model and os.path.isfile(model):
            import onnxruntime

            session = _sessions.setdefault(model, onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]))
        for b in batches:
            rows = []
            for image, shape, values in zip(b["image_id"], b["shape"], b["values"], strict=True):
                if session is None:
                    rows.append((image, None, None))
                    continue
                x = np.asarray(values, np.float32).reshape([int(k) for k in shape])
                y = session.run(None, {session.get_inputs()[0].name: x})[0]
                rows.append((image, list(y.shape), y.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "shape", "values"])

    return tensors.select("image_id", "shape", "values").mapInPandas(run, schema)
