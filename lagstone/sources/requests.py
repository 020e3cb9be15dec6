"""Requests, event lines and history, read as tables or checked on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.sources.files import exists, names, path_kind

MODES = ("movie", "series", "batch", "single")


@dataclass
class SyncRequest:
    """A run's parameters; ``check`` raises ValueError for what can't run."""

    mode: str
    video_folder: str | None = None
    audio_folder: str | None = None
    audio_file: str | None = None
    video_files: list[str] = field(default_factory=list)
    segment_duration: float = 300.0
    match_pattern: str | None = None

    def check(self) -> SyncRequest:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.segment_duration <= 0:
            raise ValueError("the segment must be longer than 0 s")
        if self.mode in ("movie", "batch", "single") and not self.audio_file:
            raise ValueError("an audio file is needed")
        if self.mode == "movie" and not (self.video_folder or self.video_files):
            raise ValueError("a video folder or video files are needed")
        if self.mode == "batch" and not self.video_folder:
            raise ValueError("a folder is needed")
        if self.mode == "series" and not (self.video_folder and self.audio_folder):
            raise ValueError("a video folder and an audio folder are needed")
        if self.mode == "single" and len(self.video_files) != 1:
            raise ValueError("one video file is needed")
        return self


    def check_paths(self, spark: SparkSession) -> SyncRequest:
        """As ``check``, and folders must be folders and files files."""
        self.check()
        wanted = [(self.video_folder, "folder"), (self.audio_folder, "folder"), (self.audio_file, "file"), *((x, "file") for x in self.video_files)]
        for path, kind in wanted:
            if path and path_kind(spark, path) != kind:
                raise ValueError(f"{path} is not a {kind}")
        return self


def parse_request(line: str) -> SyncRequest:
    """From one JSON document; blank or invalid ones raise ValueError."""
    if not line.strip():
        raise ValueError("the request is empty")
    found = json.loads(line)
    if not isinstance(found, dict) or "mode" not in found:
        raise ValueError("the request has no mode")
    known = {k: v for k, v in found.items() if k in SyncRequest.__dataclass_fields__ and v is not None}
    return SyncRequest(**known).check()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines; blank lines are skipped, and a line that is no event has only ``_corrupt_record``."""
    return spark.read.schema(schemas.EVENTS + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Event lines of a run or of all runs below ``path``, with ``line``, by which they sort as they were written: by the number of the batch, by file
    (files of a batch are named in order) and by the place in it.  Lines that are no events keep their place.
    """
    found = spark.read.schema(schemas.EVENTS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    # without patterns, as it is done for each line; a path that names no batch gives its scheme, which is no number
    batch = F.expr("coalesce(try_cast(substring_index(substring_index(input_file_name(), '/batch=', -1), '/', 1) AS BIGINT), 0)")
    line = F.struct(batch.alias("batch"), F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("at"))
    return found.withColumn("line", line)


def history_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the lists that are complete, in order; the last one counts."""
    found = (re.fullmatch(r"version=(\d+)", x) for x in names(spark, path))
    return sorted(int(m[1]) for m in found if m and exists(spark, f"{path}/{m[0]}/_SUCCESS"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The kept runs, or none."""
    found = history_versions(spark, path)
    if not found:
        return spark.createDataFrame([], schemas.HISTORY)
    return spark.read.schema(schemas.HISTORY).parquet(f"{path}/version={found[-1]}")
