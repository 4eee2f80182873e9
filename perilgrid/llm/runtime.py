"""What the training-data operators share: shipping of the package and Arrow helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from perilgrid.sources.frozen import Frozen, shared_dir

__all__ = ["BLANKS", "Frozen", "shared_dir", "ship", "slices", "texts_of"]

#: Blanks that separate words; ``bytes.split()`` splits at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes of an Arrow batch between the JVM and Python, so that long texts don't add up to large batches.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, whatever the folder they start in, and bounds Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_perilgrid_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="perilgrid-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := f"{folder}/perilgrid.zip", "w") as z:
        for at, _, names in os.walk(f"{top}/perilgrid"):
            for x in sorted(names):
                if x.endswith(".py"):
                    z.write(f"{at}/{x}", os.path.relpath(f"{at}/{x}", top))
    sc.addPyFile(path)
    sc._perilgrid_shipped = True


def texts_of(column: pa.Array) -> list[bytes]:
    """A text column's values as UTF-8 bytes; null gives an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches, text: str = "text", most: int = 2 << 20):
    """Cuts Arrow batches into runs of rows with about ``most`` bytes of text, one row at least, so that a batch with very
    long texts takes no more memory than its longest text asks for."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
