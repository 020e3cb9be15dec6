"""The pair processor: head and tail offsets of recordings, with the ladder of reasons to stop early."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.functions import grades, text
from lagstone.operators import correlate
from lagstone.sources import decode
from lagstone.sources.files import arrow_path
from lagstone.sources.scratch import scratch_path

# Fixed value: the analysis rate; more than a second at it is needed.
RATE = 8000


def _name(path: str) -> str:
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def _delay(p: np.ndarray, s: np.ndarray, rate: int) -> tuple[float, bool] | None:
    n = min(len(p), len(s))
    if n <= rate:
        return None
    p, s = p[:n], s[:n]
    return correlate.lag(p, s) / rate * 1000, bool(min(p.std(), s.std()) <= correlate.FLAT)


def process(primary: str, secondary: str, segment: float, *, rate: int = RATE, exact: bool = False, load: Callable = decode.load, duration: Callable = decode.duration) -> dict:
    """One pair's result.  Never raises: an error is text, beside whatever was found before it.

    ``degenerate`` marks flat signals, whose delay says nothing.  The error texts are fixed values.
    """
    out = {"start_delay_ms": None, "end_delay_ms": None, "error": None, "degenerate": None}
    pair = (("primary", primary), ("secondary", secondary))
    try:
        heads = []
        for side, path in pair:
            x = load(path, rate, segment)
            if x is None:
                return out | {"error": f"Failed to load start of {side}: {_name(path)}"}
            heads.append(x)
        found = _delay(*heads, rate)
        if found is None:
            return out | {"error": "Insufficient audio at start for analysis."}
        out["start_delay_ms"], out["degenerate"] = found
        lengths = [duration(path) for _, path in pair]
        if None in lengths:
            return out | {"error": "Could not get duration for end analysis."}
        tails, offsets = [], [max(0.0, d - segment) for d in lengths]
        for (side, path), offset in zip(pair, offsets, strict=True):
            x = load(path, rate, segment, offset)
            if x is None:
                return out | {"error": f"Failed to load end of {side}: {_name(path)}"}
            tails.append(x)
        found = _delay(*tails, rate)
        if found is None:
            return out | {"error": "Insufficient audio at end for analysis."}
        between = offsets[0] - offsets[1] if exact else lengths[0] - lengths[1]
        out["end_delay_ms"] = found[0] + between * 1000
    except Exception as e:  # noqa: BLE001  one bad pair must not stop the others
        out["error"] = str(e)
    return out


class Windows:
    """Decoded windows: those of the last secondary stay, since many primaries may share it; a primary's are for its pair only.

    Of a secondary that ``staged`` names (a table of ``stage_secondary``) none is decoded at all.
    """

    def __init__(self, load: Callable = decode.load, duration: Callable = decode.duration, staged: str | None = None, decoded: Accumulator | None = None):
        self.decode, self.length, self.secondary, self.kept, self.decoded = load, duration, None, {}, decoded
        self.staged, self.shared = staged, None

    def _shared(self) -> tuple[str, float | None, dict]:
        """Path, duration and windows of the staged secondary; a task reads them once."""
        if self.shared is None:
            files, at = arrow_path(self.staged)
            rows = pq.read_table(at, filesystem=files).to_pylist()
            self.shared = rows[0]["path"], rows[0]["seconds"], {r["begin"]: None if r["samples"] is None else np.frombuffer(r["samples"], np.float32) for r in rows}
        return self.shared

    def of(self, secondary: str) -> Callable:
        """A loader for a pair with this secondary."""
        if secondary != self.secondary:
            self.secondary, self.kept = secondary, {}

        def load(path: str, rate: int, duration: float | None = None, offset: float = 0.0):
            if path != secondary:
                return self.decode(path, rate, duration, offset)
            if self.staged is not None and self._shared()[0] == path and offset in self.shared[2]:
                return self.shared[2][offset]
            key = (rate, duration, offset)
            if key not in self.kept:
                self.kept[key] = self.decode(path, rate, duration, offset)
                if self.decoded is not None:
                    self.decoded.add(1)
            return self.kept[key]

        return load

    def duration(self, path: str) -> float | None:
        return self._shared()[1] if self.staged is not None and self._shared()[0] == path else self.length(path)


def stage_secondary(spark: SparkSession, path: str, *, segment: float, rate: int = RATE, decoded: Accumulator | None = None) -> str:
    """Decode the head and the tail of a recording that many pairs share, once and on an executor, into a table in the shared folder; returns its path.

    Its two rows, of ``segment`` seconds each at most, are all that a task reads of it.  A window that can't be decoded is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                try:
                    seconds = decode.duration(p)
                except Exception:  # noqa: BLE001  as if it were unknown
                    seconds = None
                for begin in sorted({0.0, max(0.0, seconds - segment)} if seconds is not None else {0.0}):
                    x = decode.load(p, rate, segment, begin)
                    if decoded is not None:
                        decoded.add(1)
                    yield pd.DataFrame({"path": [p], "seconds": pd.array([seconds], "Float64"), "begin": [begin], "samples": [None if x is None else x.astype(np.float32).tobytes()]})

    out = scratch_path(spark, "secondary")
    one = spark.createDataFrame([(path,)], "path string").coalesce(1)
    one.mapInPandas(run, "path string, seconds double, begin double, samples binary").coalesce(1).write.parquet(out)
    return out


def process_pairs(pairs: DataFrame, *, segment: float = 300.0, rate: int = RATE, exact: bool = False, tasks: int | None = None, done: Accumulator | None = None, staged: str | None = None, decoded: Accumulator | None = None) -> DataFrame:
    """Results of all pairs, with the time of completion.  Only paths travel; a task decodes what it works on.

    Pairs are dealt round robin, so a secondary that all primaries share is no one task's work; within a task the pairs of a secondary
    follow each other, and its windows are decoded once.  With ``staged``, the table of ``stage_secondary``, that one's are not decoded again at all.
    ``done`` counts finished pairs, for a driver that shows progress, ``decoded`` the windows of secondaries that were decoded (a repeated task counts
    again).
    """
    tasks = tasks or pairs.sparkSession.sparkContext.defaultParallelism * 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(staged=staged, decoded=decoded)
        for frame in frames:
            rows = []
            for p, s in zip(frame.primary_path, frame.secondary_path, strict=True):
                began = time.perf_counter()
                got = process(p, s, segment, rate=rate, exact=exact, load=windows.of(s), duration=windows.duration)
                rows.append((p, s, got["start_delay_ms"], got["end_delay_ms"], got["error"], int((time.perf_counter() - began) * 1000), got["degenerate"], pd.Timestamp.now(tz="UTC")))
                if done is not None:
                    done.add(1)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.RESULTS.split(", ")]).astype({"start_delay_ms": "float64", "end_delay_ms": "float64", "degenerate": "object"})

    dealt = pairs.select("primary_path", "secondary_path").repartition(tasks).sortWithinPartitions("secondary_path", "primary_path")
    return dealt.mapInPandas(run, schemas.RESULTS)


def graded(results: DataFrame) -> DataFrame:
    """Results with names, confidence and the outlier flag."""
    return results.withColumns(
        {
            "primary_name": text.basename("primary_path"),
            "secondary_name": text.basename("secondary_path"),
            "confidence": grades.confidence("start_delay_ms", "end_delay_ms"),
            "is_outlier": grades.outlier("start_delay_ms", "end_delay_ms"),
        }
    )


def report(results: DataFrame) -> DataFrame:
    """The six text columns of the console table, in order of the primary path."""
    bad = grades.has_error("error") | F.col("start_delay_ms").isNull()
    return results.orderBy("primary_path").select(
        text.basename("primary_path").alias("primary"),
        text.basename("secondary_path").alias("secondary"),
        F.when(bad, "-").otherwise(text.format_delay_cli("start_delay_ms")).alias("start_delay"),
        F.when(bad, "-").otherwise(text.format_delay_cli("end_delay_ms")).alias("end_delay"),
        grades.confidence_cli("start_delay_ms", "end_delay_ms", "error").alias("confidence"),
        grades.status_cli("start_delay_ms", "error").alias("status"),
    )
