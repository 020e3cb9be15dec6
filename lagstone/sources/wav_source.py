"""Windows of WAV files as a data source: heads and tails, of which only those that the filters leave are read.

    register(spark)
    spark.read.format("wav_windows").option("path", folder).option("window", 300).option("rate", 8000).load().where("part = 'tail'")

Filters on path, part, begin and seconds are pushed into the source: it decides by a file's header alone whether to decode.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lagstone.sources import decode
from lagstone.sources.files import arrow_path

SCHEMA = "path string, part string, begin double, seconds double, rate int, samples array<float>"
_TESTS = {EqualTo: operator.eq, In: lambda x, among: x in among, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_ARROW = pa.schema([("path", pa.string()), ("part", pa.string()), ("begin", pa.float64()), ("seconds", pa.float64()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32()))])


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.window, self.rate, self.files = options["path"], float(options.get("window", 300)), int(options.get("rate", 8000)), int(options.get("files", 16))
        self.pushed: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        """Keeps what the header of a file answers; the others are Spark's."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", "part", "begin", "seconds"):
                self.pushed.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def _left(self, **known) -> bool:
        """Whether a window is left by the filters on what is known of it."""
        return all(test(known[name], value) for name, test, value in self.pushed if name in known)

    def partitions(self) -> list[Files]:
        """A task for every few files that the filters on paths leave."""
        found, at = arrow_path(self.folder)
        names = sorted(x.base_name for x in found.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type == fs.FileType.File and x.extension.lower() == "wav")
        paths = [p for p in (f"{self.folder.rstrip('/')}/{n}" for n in names) if self._left(path=p)]
        return [Files(paths[k : k + self.files]) for k in range(0, len(paths), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            try:
                seconds = decode.duration(path)
            except Exception:  # noqa: BLE001  no recording
                continue
            if seconds is None:
                continue
            for part, begin in (("head", 0.0), ("tail", max(0.0, seconds - self.window))):
                if self._left(part=part, begin=begin, seconds=seconds):
                    x = decode.load(path, self.rate, self.window, begin)
                    if x is not None:
                        samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part]), pa.array([begin]), pa.array([seconds]), pa.array([self.rate], pa.int32()), samples], schema=_ARROW)


class WavWindows(DataSource):
    """Options: path (a folder), window (seconds, 300), rate (samples a second, 8000), files (of a task, 16).  Files that are no WAV are left out."""

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindowReader:
        return WindowReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavWindows)
