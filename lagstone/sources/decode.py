"""Decoding of a window of a recording, and its duration, on executors.

WAV (integers of 8 to 32 bits, floats of 32 and 64) is read through any file system that Arrow opens, and only the window asked for.  Other formats go
to decoders that were added to ``DECODERS``, and to an external decoder where one is installed.  A failure is None, never an exception, as the pair processor turns it into a row.
"""

from __future__ import annotations

import math
import shutil
import struct
import subprocess
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from lagstone.sources.files import VIDEO_EXTENSIONS, arrow_path


def _open(path: str):
    files, at = arrow_path(path)
    return files.open_input_file(at)


def _extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def to_float(frames: bytes, width: int, channels: int) -> np.ndarray:
    """PCM of 1 to 4 bytes to mono floats; channels are averaged."""
    if width == 1:
        x = (np.frombuffer(frames, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(frames, "<i2").astype(np.float32) / 32768
    elif width == 3:
        b = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) ^ 0x800000) - 0x800000).astype(np.float32) / 8388608
    else:
        x = np.frombuffer(frames, "<i4").astype(np.float32) / 2147483648
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


#: Zero crossings of the resampling filter on each side, its window's shape, and outputs of a phase that are made at a time.
ZEROS, SHAPE, STEP = 16, 8.0, 4096


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold, as one row of weights for each of ``up`` phases; each row sums to 1."""
    wide = max(up, down)
    half = ZEROS * wide
    reach = half // up + 1
    place = np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up
    weights = np.where(np.abs(place) <= half, np.sinc(place / wide) * np.i0(SHAPE * np.sqrt(np.maximum(0, 1 - (place / half) ** 2))), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """To another rate by a polyphase filter: what the lower rate can't hold is damped, and memory beyond input and output is that of ``STEP`` outputs."""
    if rate == target or not len(x):
        return x
    n = max(1, round(len(x) * target / rate))
    up, down = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    phases = _phases(up, down)
    width = phases.shape[1]
    reach = width // 2
    padded = np.concatenate([np.zeros(reach, np.float32), x, np.zeros(reach + down, np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    # outputs ``up`` apart have one phase, and their inputs begin ``down`` apart
    for first in range(min(up, n)):
        many, begin, weights = -(-(n - first) // up), first * down // up, phases[first * down % up]
        for k in range(0, many, STEP):
            some = min(STEP, many - k)
            at = begin + k * down
            out[first + k * up : first + (k + some) * up : up] = seen[at : at + some * down : down][:some] @ weights
    return out


class Wav:
    """The header of a WAV file that is open, and any window of its frames."""

    # The tags of integer and float samples, and of the longer header that names one of them.
    INTEGER, FLOAT, LONGER = 1, 3, 0xFFFE

    def __init__(self, raw):
        self.raw, size = raw, raw.size()
        head = raw.read(12)
        if head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
            raise ValueError("no WAV file")
        self.tag = None
        while True:
            name, length = struct.unpack("<4sI", raw.read(8))
            if name == b"data":
                break
            body = raw.read(length + length % 2)
            if name == b"fmt ":
                self.tag, self.channels, self.rate, _, self.align = struct.unpack_from("<HHIIH", body)
                self.tag = struct.unpack_from("<H", body, 24)[0] if self.tag == self.LONGER else self.tag
        self.width = self.align // self.channels  # of fewer bits, the upper ones hold the sample
        if (self.tag, self.width) not in {*((self.INTEGER, w) for w in (1, 2, 3, 4)), (self.FLOAT, 4), (self.FLOAT, 8)} or not self.rate:
            raise ValueError("samples of another kind")
        self.begin = raw.tell()
        # a file that is still written, or too long for its header, has what is there
        self.frames = min(length, size - self.begin) // self.align

    @property
    def seconds(self) -> float:
        return self.frames / self.rate

    def read(self, first: int, frames: int) -> np.ndarray:
        """Mono floats."""
        first = min(first, self.frames)
        self.raw.seek(self.begin + first * self.align)
        data = self.raw.read(min(frames, self.frames - first) * self.align)
        if self.tag == self.INTEGER:
            return to_float(data, self.width, self.channels)
        x = np.frombuffer(data, f"<f{self.width}").astype(np.float32)
        return x.reshape(-1, self.channels).mean(axis=1) if self.channels > 1 else x


def _wav(path: str, rate: int, duration: float | None, offset: float) -> np.ndarray:
    with _open(path) as raw:
        f = Wav(raw)
        return resample(f.read(int(offset * f.rate), int(duration * f.rate) if duration else f.frames), f.rate, rate)


#: Further decoders (path, rate, duration or None, offset) -> mono floats or None, for formats that the standard library lacks.
DECODERS: list[Callable[[str, int, float | None, float], np.ndarray | None]] = []


def _external(path: str, rate: int, duration: float | None, offset: float) -> tuple[np.ndarray | None, str]:
    """What an installed decoder gives, and what it says."""
    tool = shutil.which("ffmpeg")
    if tool is None:
        return None, ""
    # The options that make the decoder give mono samples of 16 bits.
    window = [*(["-ss", str(offset)] if offset else []), *(["-t", str(duration)] if duration else [])]
    run = subprocess.run([tool, "-v", "error", *window, "-i", path, "-vn", "-ac", "1", "-ar", str(rate), "-f", "s16le", "-"], capture_output=True, check=False)
    found = np.frombuffer(run.stdout, "<i2").astype(np.float32) / 32768 if run.returncode == 0 and run.stdout else None
    return found, run.stderr.decode("utf-8", "replace")


def _direct(path: str, rate: int, duration: float | None, offset: float) -> np.ndarray | None:
    for decoder in (_wav, *DECODERS):
        try:
            x = decoder(path, rate, duration, offset)
        except Exception:  # noqa: BLE001  the next decoder's turn
            continue
        if x is not None:
            return x
    return None


def load(path: str, rate: int, duration: float | None = None, offset: float = 0.0) -> np.ndarray | None:
    """Mono floats at ``rate``: directly, then by the external decoder; of video containers by that first, and directly only if it misses a video stream."""
    video = _extension(path) in VIDEO_EXTENSIONS
    x = None if video else _direct(path, rate, duration, offset)
    if x is not None:
        return x
    try:
        x, said = _external(path, rate, duration, offset)
    except Exception:  # noqa: BLE001  as if it were not installed
        return None
    return _direct(path, rate, duration, offset) if x is None and "video stream" in said.lower() else x


def _printed(tool: str, *args: str) -> str:
    found = shutil.which(tool)
    return subprocess.run([found, *args], capture_output=True, check=False, text=True).stdout.strip() if found else ""


def _header(path: str) -> float:
    with _open(path) as raw:
        return Wav(raw).seconds


def _decoded(path: str) -> float | None:
    rate = 8000
    x = _direct(path, rate, None, 0.0) if DECODERS else None
    return None if x is None else len(x) / rate


def duration(path: str) -> float | None:
    """Seconds, by the first way that tells them: the header, an installed prober of tracks (milliseconds), one of formats, and the decoded samples."""
    ways = (
        lambda: _header(path),
        lambda: float(_printed("mediainfo", "--Output=General;%Duration%", path)) / 1000,
        lambda: float(_printed("ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", path)),
        lambda: _decoded(path),
    )
    for way in ways:
        try:
            found = way()
        except Exception:  # noqa: BLE001  the next way's turn
            continue
        if found:
            return found
    return None
