"""A Spark data source of forecasts: ``spark.read.format("forecast")``, one partition for each grid point and slot.

Executors ask the service, or a folder of answers; what went wrong is a row with its reason, so that one failing point never
fails the job. Answers are parsed afterwards by expressions of the JVM (``weather.forecasts``).
"""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed value: the forecast service.
SERVICE = "https://apis.data.go.kr/1360000/VilageFcstInfoService_2.0/getVilageFcst"
#: Columns of a request, then the answer's text or the reason why there is none.
COLUMNS = "base_date string, base_time string, nx int, ny int, payload string, reason string"


def ask(key: str, base_date: str, base_time: str, nx: int, ny: int, timeout: float) -> str:
    """The service's answer to one request."""
    query = {"serviceKey": key, "pageNo": 1, "numOfRows": 300, "dataType": "JSON", "base_date": base_date, "base_time": base_time, "nx": nx, "ny": ny}
    with urllib.request.urlopen(f"{SERVICE}?{urllib.parse.urlencode(query)}", timeout=timeout) as answer:
        return answer.read().decode()


def numbers(text: str) -> list[int]:
    """Grid numbers from a text such as ``55-58,60``; a range that runs backwards is an error."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        if b < a:
            raise ValueError(f"a range runs backwards: {part}")
        out.update(range(a, b + 1))
    return sorted(out)


@dataclass
class Request(InputPartition):
    base_date: str
    base_time: str
    nx: int
    ny: int


class ForecastReader(DataSourceReader):
    """Partitions of one request each; a repeated slot or point is asked for once."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.key = options.get("path"), options.get("key")
        self.timeout, self.tries = float(options.get("timeout", 8.0)), int(options.get("tries", 1))
        slots = [s.split("T") for s in dict.fromkeys(filter(None, (s.strip() for s in options.get("slots", "").split(","))))]
        if any(len(s) != 2 for s in slots):
            raise ValueError("slots are written as date, T and time, separated by commas")
        xs, ys = numbers(options.get("nx", "60")), numbers(options.get("ny", "121"))
        self.requests = [Request(date, at, x, y) for date, at in slots for x in xs for y in ys]

    def partitions(self) -> list[Request]:
        return self.requests

    def read(self, request: Request | None) -> Iterator[tuple]:
        if request is None:  # Spark reads once where there are no partitions
            return
        where = (request.base_date, request.base_time, request.nx, request.ny)
        yield (*where, *self._answer(where))

    def _answer(self, where: tuple[str, str, int, int]) -> tuple[str | None, str | None]:
        if self.folder:
            return self._stored(where)
        if not self.key:
            return None, "no service key"
        for left in reversed(range(max(1, self.tries))):
            try:
                return ask(self.key, *where, self.timeout), None
            except Exception as error:
                if not left:
                    return None, f"the request failed: {error}"
                time.sleep(min(1.0, self.timeout))
        raise AssertionError

    def _stored(self, where: tuple[str, str, int, int]) -> tuple[str | None, str | None]:
        """The answer in a folder that is partitioned by the columns of a request; its files are joined in order of their names."""
        from pyarrow import fs

        try:
            system, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
            place = "/".join([root.rstrip("/"), *(f"{name}={value}" for name, value in zip(("base_date", "base_time", "nx", "ny"), where, strict=True))])
            files = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
            names = sorted(f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
            if not names:
                return None, "no answer is stored"
            texts = []
            for name in names:
                with system.open_input_stream(name) as stream:
                    texts.append(stream.read().decode())
            return "".join(texts), None
        except Exception as error:
            return None, f"the request failed: {error}"


class ForecastSource(DataSource):
    """Options: ``slots`` (``20240501T0200,...``), ``nx`` and ``ny`` (``55-58,60``), ``key``, ``timeout``, ``tries``; or ``path``, a
    folder of stored answers. No slots give no rows."""

    @classmethod
    def name(cls) -> str:
        return "forecast"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ForecastReader:
        return ForecastReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ForecastSource)
