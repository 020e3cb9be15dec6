"""Operator 5: media columns.

Bytes are stored as 8-bit mono WAV by the ``wave`` module and read back by it.  The samples that were read are framed, windowed and
transformed (short-time Fourier transform); the strongest peak of each frequency band of a frame that rises over the clip's mean is a
landmark, and each landmark is paired with the next few.  A fingerprint packs the two frequencies and the time between them; its
time code is the frame of the first.  They are stored as arrays of longs, time code in the upper half, in order.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

RATE = 8000
FRAME = 256
HOP = 128
#: Upper bin of each band, in which the strongest peak of a frame is taken.
BANDS = (8, 16, 32, 64, 128)
#: Landmarks that follow the anchor and are paired with it.
FAN = 3
#: Frames transformed at a time, which bounds the memory for very long clips.
BLOCK = 2048


def write_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[bytes, int]:
    """The frames as bytes, and the rate."""
    with wave.open(io.BytesIO(media), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("only 8-bit mono clips are stored")
        return f.readframes(f.getnframes()), f.getframerate()


def spectrum(samples: np.ndarray, frame: int = FRAME, hop: int = HOP) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform, in blocks of frames; the clip's end is filled with silence."""
    window = np.hanning(frame)
    n = 1 + max(0, -(-(len(samples) - frame) // hop))
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        part = samples[at * hop : (at + m - 1) * hop + frame].astype(np.float64) - 128.0
        part = np.pad(part, (0, (m - 1) * hop + frame - len(part)))
        yield np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, frame)[::hop] * window, axis=1))


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Spectral-peak pairs as longs: frame of the first peak << 32 | its bin << 20 | bin of the second << 8 | frames between."""
    times, bins, low = [], [], 1
    at = 0
    for block in spectrum(samples):
        block = np.round(block, 3)
        mean = block[:, 1:].mean(axis=1)
        found = []
        for low, high in zip((1, *BANDS), BANDS, strict=False):
            best = block[:, low:high].argmax(axis=1) + low
            rows = np.flatnonzero(block[np.arange(len(block)), best] > mean)
            found.append(np.stack([rows + at, best[rows]]))
        t, b = np.concatenate(found, axis=1)
        order = np.lexsort((b, t))
        times.append(t[order])
        bins.append(b[order])
        at += len(block)
    t, b = np.concatenate(times), np.concatenate(bins)
    out = []
    for k in range(1, FAN + 1):
        if len(t) > k:
            gap = np.minimum(t[k:] - t[:-k], 255)
            out.append((t[:-k] << 32) | (b[:-k] << 20) | (b[k:] << 8) | gap)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, *, keep_media: bool = True) -> DataFrame:
    """Store every whole text's UTF-8 bytes, filled with bytes 0 to a positive multiple of 64, as a WAV clip, and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of what was read back), media_bytes, media_sha256, feature
    (number of fingerprints and the first 32 hex digits of the SHA-256 of their array) and, with ``keep_media``, media binary and
    fingerprints array<long>.  One narrow pass.  A null text counts as empty (64 bytes 0); repeated rows give repeated results, equal
    texts equal values; other columns are ignored.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, fingerprints array<bigint>" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                media = write_wav(data + bytes(64 * max(1, -(-len(data) // 64)) - len(data)))
                payload, _ = read_wav(media)
                marks = fingerprints(np.frombuffer(payload, np.uint8))
                row = [len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()[:32]}"]
                rows.append(row + [media, marks] * keep_media)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "fingerprints"][: 8 + 2 * keep_media]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=False)] if rows else [pa.array([], t) for t in types[: len(names) - 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return source.mapInArrow(run, schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents' bytes as clips and fingerprint them."""
    return media_columns(common.table(spark, sf_dir, "documents"), keep_media=False)
