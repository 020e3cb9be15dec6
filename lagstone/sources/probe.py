"""What a prober says about recordings: run on executors where it is installed, and else what their headers say."""

from __future__ import annotations

import json as js
import shutil
import struct
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.sources import decode
from lagstone.sources.files import arrow_path


def parse_probes(rows: DataFrame, *, json: str = "json", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """has_audio, has_video and duration of each document; a document that can't be read has neither and no duration."""
    x = F.from_json(json, schemas.PROBE)

    def any_of(kind: str):
        return F.coalesce(F.exists("x.streams", lambda s: s.codec_type == kind), F.lit(False))

    return rows.select(*keep, x.alias("x")).select(*keep, any_of("audio").alias("has_audio"), any_of("video").alias("has_video"), F.expr("try_cast(x.format.duration AS DOUBLE)").alias("duration"))


def _boxes(raw, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Names, begins and ends of the boxes from here on."""
    at = raw.tell()
    while at + 8 <= end:
        raw.seek(at)
        size, name = struct.unpack(">I4s", raw.read(8))
        begin = at + 8
        if size == 1:
            size, begin = struct.unpack(">Q", raw.read(8))[0], at + 16
        last = min(end, at + size) if size else end
        if last <= at:
            return
        yield name, begin, last
        at = last


def _mp4(raw) -> dict:
    kinds, seconds = [], None

    def walk(begin: int, end: int) -> None:
        nonlocal seconds
        raw.seek(begin)
        for name, first, last in _boxes(raw, end):
            if name in (b"moov", b"trak", b"mdia"):
                walk(first, last)
            elif name in (b"mvhd", b"hdlr"):
                raw.seek(first)
                body = raw.read(min(last - first, 40))
                if name == b"hdlr":
                    kinds.append({b"soun": "audio", b"vide": "video"}.get(body[8:12], "data"))
                else:
                    scale, ticks = struct.unpack_from(">IQ", body, 20) if body[0] else struct.unpack_from(">II", body, 12)
                    seconds = ticks / scale if scale else None

    walk(0, raw.size())
    return {"streams": [{"codec_type": k} for k in kinds], "format": {"duration": None if seconds is None else f"{seconds:.6f}"}}


def _flac(raw) -> dict:
    raw.seek(18)
    packed = int.from_bytes(raw.read(8))  # 20 bits of the rate, 8 of the kind, 36 of the number of samples
    rate, n = packed >> 44, packed & ((1 << 36) - 1)
    return {"streams": [{"codec_type": "audio"}], "format": {"duration": f"{n / rate:.6f}" if rate and n else None}}


def header_json(path: str) -> str:
    """What the header of a WAV, FLAC or MP4 file says, in the prober's form; other files raise ValueError."""
    files, at = arrow_path(path)
    with files.open_input_file(at) as raw:
        head = raw.read(12)
        if head[:4] == b"fLaC":
            found = _flac(raw)
        elif head[4:8] == b"ftyp":
            found = _mp4(raw)
        else:
            raw.seek(0)
            found = {"streams": [{"codec_type": "audio"}], "format": {"duration": f"{decode.Wav(raw).seconds:.6f}"}}
    return js.dumps(found)


def _probed(path: str) -> str | None:
    """The prober's JSON, or the header's where it is not installed; none of what neither can read."""
    try:
        tool = shutil.which("ffprobe")
        if tool is None:
            return header_json(path)
        # The options that make the prober give streams and duration as JSON.
        run = subprocess.run([tool, "-v", "error", "-show_entries", "format=duration", "-show_streams", "-of", "json", path], capture_output=True, check=False, text=True)
    except Exception:  # noqa: BLE001  a file that can't be read is a row, not an error
        return None
    return run.stdout if run.returncode == 0 else None


def probe_files(files: DataFrame, *, path: str = "path") -> DataFrame:
    """path, has_audio, has_video and duration of every file, probed on the executors; one that can't be probed has neither and no duration."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "json": [None if p is None else _probed(p) for p in frame["path"]]})

    return parse_probes(files.select(F.col(path).alias("path")).mapInPandas(run, "path string, json string"))


def with_probes(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Every file with its probe; without one, as one that failed."""
    joined = files.join(probes, "path", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_audio", "has_video")})


def latest(probes: DataFrame, *, key: str = "path", at: str = "ts") -> DataFrame:
    """One row per key: the latest."""
    others = [c for c in probes.columns if c != key]
    best = probes.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in others))
