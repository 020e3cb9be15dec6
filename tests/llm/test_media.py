from __future__ import annotations

import hashlib
import zlib

import numpy as np

from lagstone.llm import media


def test_round_trip():
    for n in (64, 640, 64 * 999):
        data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.read_wav(media.write_wav(data)) == (data, media.RATE)


def test_peaks():
    t = np.arange(4096)
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 20 * t / media.FRAME)).astype(np.uint8)
    block = next(media.spectrum(tone))
    assert (block[:-1, 1:].argmax(axis=1) + 1 == 20).all()
    marks = media.fingerprints(tone)
    assert len(marks)
    assert (((marks >> 20) & 0xFFF) == 20).mean() > 0.5
    assert (np.diff(marks) >= 0).all()


def test_shift_moves_time_codes_only():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, 128 * 60, dtype=np.uint8)
    a = set(media.fingerprints(x).tolist())
    b = {v - (3 << 32) for v in media.fingerprints(np.concatenate([rng.integers(0, 256, 128 * 3, dtype=np.uint8), x])).tolist()}
    assert len(a & b) > 0.9 * len(a)


def test_blocks(monkeypatch):
    x = np.random.default_rng(3).integers(0, 256, 64 * 500, dtype=np.uint8)
    whole = media.fingerprints(x)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (media.fingerprints(x) == whole).all()


def test_documents(spark, make, odd_rows):
    got = media.media_columns(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by_text = {}
    for r in got:
        payload = media.read_wav(bytes(r.media))[0]
        assert (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) == (r.payload_bytes, r.payload_sha256, r.tail_crc32)
        assert len(payload) % 64 == 0
        assert len(payload) >= 64
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert by_text.setdefault(r.payload_sha256, r.feature) == r.feature
    want = sorted((r[1] or "").encode() for r in odd_rows)
    assert sorted(media.read_wav(bytes(r.media))[0][: r.n_bytes] for r in got) == want
    assert media.media_columns(make(odd_rows).limit(0)).count() == 0


def brute_fingerprints(samples):
    """Frames, transforms, landmarks and pairs, one after the other, straight from the definitions."""
    x = samples.astype(float) - 128
    landmarks, at = [], 0
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)])
    turns = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    while at == 0 or at * media.HOP + media.FRAME - media.HOP < len(x):
        frame = np.zeros(media.FRAME)
        part = x[at * media.HOP : at * media.HOP + media.FRAME]
        frame[: len(part)] = part
        size = np.round(np.abs(turns @ (frame * window)), 3)
        mean, low = size[1:].mean(), 1
        for high in media.BANDS:
            best = max(range(low, high), key=lambda k: (size[k], -k))
            if size[best] > mean:
                landmarks.append((at, best))
            low = high
        at += 1
    pairs = []
    for i, (t, f) in enumerate(landmarks):
        for u, g in landmarks[i + 1 : i + 1 + media.FAN]:
            pairs.append((t << 32) | (f << 20) | (g << 8) | min(u - t, 255))
    return sorted(pairs)


def test_fingerprints_against_brute_force():
    rng = np.random.default_rng(31)
    for n in (64, 128, 256, 320, 1000, 4096):
        x = rng.integers(0, 256, n, dtype=np.uint8)
        assert media.fingerprints(x).tolist() == brute_fingerprints(x)
    text = np.frombuffer(("some ordinary text, with words " * 40).encode(), np.uint8)
    assert media.fingerprints(text).tolist() == brute_fingerprints(text)
