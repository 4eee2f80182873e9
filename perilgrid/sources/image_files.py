"""A Spark sink for images as files: ``df.write.format("image_files")``, named by their content, with commit and abort.

Each attempt of a task writes to folders of its own below a hidden folder of the job, of ``FILES`` images at most. The commit removes what attempts left
that Spark doesn't count (they failed, or were speculative) and makes the job visible by renaming its folder once; an abort removes
it. So readers see all images of a write or none, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _place(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


#: Files of a folder at most.
FILES = 4096
#: Tasks that read images at most, and bytes of a batch that they pass on.
TASKS, BATCH = 2000, 8 << 20


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of an attempt that succeeded, and what it wrote; further folders are named after it."""

    folder: str
    files: int
    size: int


class ImageWriter(DataSourceWriter):
    def __init__(self, path: str, column: str, suffix: str):
        self.path, self.column, self.suffix, self.job = path.rstrip("/"), column, suffix, uuid.uuid4().hex

    @property
    def hidden(self) -> str:
        return f"{self.path}/.job-{self.job}"

    def write(self, iterator: Iterator) -> Attempt:
        system, root = _place(self.hidden)
        folder, files, size = uuid.uuid4().hex, 0, 0
        for row in iterator:
            content = row[self.column]
            if content is None:
                continue
            if files % FILES == 0:
                here = f"{root}/{folder}-{files // FILES}" if files else f"{root}/{folder}"
                system.create_dir(here, recursive=True)
            data = bytes(content)
            with system.open_output_stream(f"{here}/{hashlib.sha256(data).hexdigest()}{self.suffix}") as out:
                out.write(data)
            files, size = files + 1, size + len(data)
        return Attempt(folder, files, size)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        good = {m.folder for m in messages if m is not None and m.files}
        system, root = _place(self.hidden)
        for entry in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if entry.base_name.split("-")[0] not in good:
                system.delete_dir(entry.path)
        if good:
            system.move(root, _place(f"{self.path}/job-{self.job}")[1])

    def abort(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        system, root = _place(self.hidden)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class ImageFiles(DataSource):
    """Options: ``path``, ``column`` (of the bytes; ``content``), ``suffix`` (``.png``). Writes append; null content gives no file."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        column = self.options.get("column", "content")
        if overwrite:
            raise ValueError("images are only appended")
        if column not in schema.fieldNames():
            raise ValueError(f"no column {column}")
        return ImageWriter(self.options["path"], column, self.options.get("suffix", ".png"))


def save(images: DataFrame, path: str, suffix: str = ".png") -> DataFrame:
    """Writes images (image_id, content) and gives (image_id, name), the names of their files; null content has no name.

    Equal images are one file: they are reduced by name before they are dealt out, so that a picture that a third of all rows hold is
    no hot key. Content that isn't the same each time it is computed must be frozen before."""
    spark = images.sparkSession
    register(spark)
    named = images.select("image_id", "content", F.sha2("content", 256).alias("name"))
    once = named.filter("content IS NOT NULL").groupBy("name").agg(F.any_value("content").alias("content"))
    once.select("content").write.format("image_files").mode("append").option("path", path).option("suffix", suffix).save()
    return named.select("image_id", F.concat("name", F.lit(suffix)).alias("name"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the images saved in a folder. The driver lists the folders of attempts only, a name for every ``FILES`` images;
    tasks list and read the files in them."""
    from pyarrow import fs

    def below(system, root: str) -> list:
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith((".", "_"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _place(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                names, content, size = [], [], 0
                for f in system.get_file_info(fs.FileSelector(folder)):
                    if f.type != fs.FileType.File or f.base_name.startswith((".", "_")):
                        continue
                    with system.open_input_stream(f.path) as data:
                        content.append(data.read())
                    names.append(f.base_name)
                    size += len(content[-1])
                    if size > BATCH:
                        yield pa.record_batch([pa.array(names, pa.string()), pa.array(content, pa.binary())], names=["name", "content"])
                        names, content, size = [], [], 0
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(content, pa.binary())], names=["name", "content"])

    system, root = _place(path.rstrip("/"))
    folders = [(f.path,) for job in below(system, root) for f in below(system, job.path)]
    listed = spark.createDataFrame(folders, "folder string").repartition(max(1, min(len(folders), TASKS)))
    return listed.mapInArrow(run, "name string, content binary")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageFiles)
