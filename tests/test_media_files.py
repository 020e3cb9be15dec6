"""Decoding, resampling, probing and correlating recordings, and windows of them as a data source."""

from __future__ import annotations

import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.operators import correlate, pairs
from lagstone.sources import decode, probe, requests, sinks, wav_source


def wav_bytes(x, rate=8000, kind="i2", channels=1, extra=b"", extensible=False, length=None):
    data = np.ascontiguousarray(x, f"<{kind}").tobytes()
    width = np.dtype(kind).itemsize
    tag = 3 if kind[0] == "f" else 1
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * width * channels, width * channels, 8 * width)
    fmt += struct.pack("<HHIH14s", 22, 8 * width, 0, tag, b"\0" * 14) if extensible else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(data) if length is None else length) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def noise(n, seed=0):
    return np.random.default_rng(seed).uniform(-0.9, 0.9, n).astype(np.float32)


@pytest.mark.parametrize(("kind", "extensible", "extra"), [("f4", False, b""), ("f8", False, b""), ("f4", True, b"LIST\x03\0\0\0abc\0"), ("i2", True, b"fact\x04\0\0\0\0\0\0\0")])
def test_wav_kinds(tmp_path, kind, extensible, extra):
    x = noise(20_000)
    raw = (x * 32768).round() if kind == "i2" else x
    (tmp_path / "a.wav").write_bytes(wav_bytes(raw, kind=kind, extensible=extensible, extra=extra))
    assert decode.duration(str(tmp_path / "a.wav")) == 2.5
    assert np.allclose(decode.load(str(tmp_path / "a.wav"), 8000), x, atol=1e-4)
    assert np.allclose(decode.load(str(tmp_path / "a.wav"), 8000, 0.5, 1.25), x[10_000:14_000], atol=1e-4)
    assert len(decode.load(str(tmp_path / "a.wav"), 8000, 1.0, 9.0)) == 0


def test_wav_stereo_and_odd_files(tmp_path):
    x = noise(8000)
    (tmp_path / "s.wav").write_bytes(wav_bytes(np.stack([x, -x / 2], axis=1), kind="f4", channels=2))
    assert np.allclose(decode.load(str(tmp_path / "s.wav"), 8000), x / 4, atol=1e-6)
    (tmp_path / "open.wav").write_bytes(wav_bytes(x, kind="f4", length=0xFFFFFFFF))  # still written: the header has no length yet
    assert decode.duration(str(tmp_path / "open.wav")) == 1.0
    for name, data in {"a": wav_bytes(x, kind="f4").replace(b"WAVE", b"AVI "), "b": wav_bytes(x, kind="i2")[:30], "c": b"", "d": wav_bytes(x, kind="i2").replace(b"fmt \x10\0\0\0\x01", b"fmt \x10\0\0\0\x07"), "e": wav_bytes(x, kind="i2", channels=0)}.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
        assert decode.load(str(tmp_path / f"{name}.wav"), 8000) is None


@pytest.mark.parametrize(("rate", "target"), [(44_100, 8000), (48_000, 8000), (16_000, 8000), (8000, 16_000), (11_025, 8000)])
def test_resampling(rate, target):
    """A tone that both rates hold stays; one that the lower rate can't hold is gone."""
    t = np.arange(2 * rate) / rate
    y = decode.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32), rate, target)
    want = np.sin(2 * np.pi * 1000 * np.arange(2 * target) / target)
    assert len(y) == 2 * target
    assert np.abs(y - want)[200:-200].max() < 2e-3
    high = min(rate, target) / 2 * 1.15
    if high < rate / 2:
        assert np.abs(decode.resample(np.sin(2 * np.pi * high * t).astype(np.float32), rate, target))[200:-200].max() < 2e-3
    assert np.allclose(decode.resample(np.ones(5000, np.float32), rate, target)[200:-200], 1, atol=1e-5)
    assert len(decode.resample(np.ones(1, np.float32), rate, target)) == max(1, round(target / rate))


def test_resampling_keeps_the_lag():
    x = noise(48_000 * 3, 3)
    p, s = decode.resample(x[: 48_000 * 2], 48_000, 8000), decode.resample(x[4800 : 48_000 * 2 + 4800], 48_000, 8000)
    assert correlate.lag(p, s) == 800


def test_resampling_memory():
    """Ten minutes: beyond the input and the output, a few blocks."""
    x = np.zeros(44_100 * 120, np.float32)
    decode._phases(80, 441)
    tracemalloc.start()
    y = decode.resample(x, 44_100, 8000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes * 1.1 + y.nbytes + 30e6


@pytest.mark.parametrize("seed", range(12))
def test_blocks_give_the_lag_of_the_whole(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 700, 2)
    base = rng.normal(size=2000)
    p, s = base[300 : 300 + n], base[300 + seed * 9 : 300 + seed * 9 + m]
    for block in (1, 7, 64, 256):
        assert correlate.lag(p, s, 6, block=block) == correlate.lag(p, s, 6, block=10_000)
    for same in (np.zeros(50), np.full(50, 3.5)):
        assert correlate.lag(same, same, block=16) == correlate.lag(same, same, block=1000) == -49


def test_memory_of_long_windows():
    """600 s at 8 kHz: the transform of the whole takes over 500 MB beside the signals, blocks under 150."""
    x = noise(4_800_000 + 4000, 5)
    tracemalloc.start()
    assert correlate.lag(x[:-4000], x[4000:]) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_shared_secondary_is_decoded_once_a_run(spark, tmp_path):
    """Twelve primaries over four tasks: two windows are decoded in all, and the results are those without the table."""
    x = noise(24_000, 9)
    (tmp_path / "a.wav").write_bytes(wav_bytes(x[1000:21_000], kind="f4"))
    for k in range(12):
        (tmp_path / f"p{k}.wav").write_bytes(wav_bytes(x[1000 - 8 * k : 21_000 - 8 * k], kind="f4"))
    rows = spark.createDataFrame([(f"{tmp_path}/p{k}.wav", f"{tmp_path}/a.wav") for k in range(12)], schemas.PAIRS)
    in_tasks, once = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    columns = ["primary_path", "start_delay_ms", "end_delay_ms", "error"]
    want = sorted(map(tuple, pairs.process_pairs(rows, segment=1.5, tasks=4, decoded=in_tasks).select(columns).collect()))
    assert in_tasks.value == 8
    staged = pairs.stage_secondary(spark, f"{tmp_path}/a.wav", segment=1.5, decoded=once)
    in_tasks.value = 0
    assert sorted(map(tuple, pairs.process_pairs(rows, segment=1.5, tasks=4, staged=staged, decoded=in_tasks).select(columns).collect())) == want
    assert (once.value, in_tasks.value) == (2, 0)
    assert {r[1] for r in want} == {float(k) for k in range(12)}
    missing = pairs.stage_secondary(spark, f"{tmp_path}/none.wav", segment=1.5)
    gone = rows.withColumn("secondary_path", F.lit(f"{tmp_path}/none.wav"))
    assert {r.error for r in pairs.process_pairs(gone, segment=1.5, staged=missing).collect()} == {"Failed to load start of secondary: none.wav"}


def box(name, body):
    return struct.pack(">I4s", 8 + len(body), name) + body


def mp4(kinds, scale, ticks, version=0):
    head = bytes([version, 0, 0, 0])
    mvhd = head + (b"\0" * 16 + struct.pack(">IQ", scale, ticks) if version else b"\0" * 8 + struct.pack(">II", scale, ticks)) + b"\0" * 80
    traks = b"".join(box(b"trak", box(b"tkhd", b"\0" * 20) + box(b"mdia", box(b"hdlr", b"\0" * 8 + k + b"\0" * 12))) for k in kinds)
    return box(b"ftyp", b"isom" + b"\0" * 8) + struct.pack(">I4sQ", 1, b"mdat", 16 + 9) + b"x" * 9 + box(b"moov", box(b"mvhd", mvhd) + traks)


def test_probing_files(spark, tmp_path):
    flac = b"fLaC\x80\0\0\x22" + b"\0" * 10 + ((8000 << 44) | (1 << 41) | (15 << 36) | 20_000).to_bytes(8) + b"\0" * 16
    content = {
        "a.wav": wav_bytes(noise(4000)), "b.flac": flac, "c.mp4": mp4([b"vide", b"soun"], 1000, 12_500), "d.mov": mp4([b"vide"], 600, 900, version=1), "e.m4a": mp4([b"soun"], 0, 5), "f.mkv": b"\x1aE\xdf\xa3 other", "g.wav": b"", "h.mp4": mp4([b"vide"], 1, 1)[:20],
        "i.mp4": b"\0\0\0\x0cftypisom" + b"\0\0\0\0free",
    }
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(n, f"{tmp_path}/{n}") for n in [*content, "none.wav"]] + [("null", None)], "name string, path string")
    got = {r.path and r.path.rsplit("/", 1)[1]: (r.has_audio, r.has_video, r.duration) for r in probe.probe_files(files).collect()}
    assert got == {
        "a.wav": (True, False, 0.5), "b.flac": (True, False, 2.5), "c.mp4": (True, True, 12.5), "d.mov": (False, True, 1.5), "e.m4a": (True, False, None), "f.mkv": (False, False, None), "g.wav": (False, False, None), "h.mp4": (False, False, None), "i.mp4": (False, False, None),
        "none.wav": (False, False, None), None: (False, False, None),
    }
    assert probe.with_probes(files, probe.probe_files(files)).count() == 11


def test_wav_windows_source(spark, tmp_path, capfd):
    """Heads and tails; filters reach the source, which then opens only the files and decodes only the windows that are left."""
    x = noise(40_000)
    for k in range(1, 5):
        (tmp_path / f"w{k}.wav").write_bytes(wav_bytes(x[: 8000 * k], kind="f4"))
    (tmp_path / "no.wav").write_bytes(b"no recording")
    (tmp_path / "other.txt").write_bytes(b"")
    wav_source.register(spark)
    windows = spark.read.format("wav_windows").option("path", str(tmp_path)).option("window", 1.5).option("files", 2).load()
    rows = sorted((r.path[-6:-4], r.part, r.begin, r.seconds, len(r.samples)) for r in windows.collect())
    assert rows == sorted((f"w{k}", part, begin, float(k), min(12_000, 8000 * k)) for k in range(1, 5) for part, begin in (("head", 0.0), ("tail", max(0.0, k - 1.5))))
    one = windows.where((F.col("path") == f"{tmp_path}/w3.wav") & (F.col("part") == "tail"))
    assert np.allclose(one.first().samples, x[12_000:24_000])
    some = windows.where("part = 'tail' AND begin >= 1.5 AND seconds < 4 AND size(samples) > 3")
    assert [r.path[-6:] for r in some.collect()] == ["w3.wav"]
    some.explain("formatted")
    plan = capfd.readouterr().out
    assert "PushedFilters" in plan and "begin" in plan.split("PushedFilters")[1].split("\n")[0]


def test_source_opens_no_other_file(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, StringContains

    for k in range(4):
        (tmp_path / f"w{k}.wav").write_bytes(wav_bytes(noise(9000)))
    reader = wav_source.WindowReader({"path": str(tmp_path), "window": "1"})
    other = StringContains(("path",), "x")
    assert list(reader.pushFilters([EqualTo(("path",), f"{tmp_path}/w2.wav"), other, EqualTo(("part",), "head")])) == [other]
    parts = reader.partitions()
    assert [p.paths for p in parts] == [[f"{tmp_path}/w2.wav"]]
    loaded = []
    real = decode.load
    monkeypatch.setattr(decode, "load", lambda *a: loaded.append(a) or real(*a))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 1
    assert [a[3] for a in loaded] == [0.0]


def entry(spark, k):
    return spark.sql(f"SELECT '{k}' AS id, timestamp_seconds({k}) AS date, 'series' AS mode, array(named_struct('videoFile', 'v', 'audioFile', 'a', 'startDelay', 1.0D, 'endDelay', 2.0D, 'error', CAST(NULL AS STRING), 'elapsed_ms', 5L)) AS results, 1L AS fileCount")


@pytest.mark.parametrize("step", ["_write_version", "_drop_versions", "half written"])
def test_history_survives_a_stop(spark, tmp_path, monkeypatch, step):
    """Stopped before the new list is written, while it is, or before the old one is deleted: a whole list is read, and the next run goes on."""
    path = str(tmp_path / "history")
    for k in range(22):
        if k < 2 or k > 19:
            sinks.keep_history(spark, path, entry(spark, k))
        else:
            continue
    before = requests.read_history(spark, path).count()
    assert before == 4

    def stopped(*args):
        raise KeyboardInterrupt

    if step == "half written":
        now = requests.history_versions(spark, path)[-1]
        (tmp_path / "history" / f"version={now + 1}").mkdir()
        (tmp_path / "history" / f"version={now + 1}" / "part-0.parquet").write_bytes(b"half")
    else:
        with monkeypatch.context() as m:
            m.setattr(sinks, step, stopped)
            with pytest.raises(KeyboardInterrupt):
                sinks.keep_history(spark, path, entry(spark, 30))
    assert requests.read_history(spark, path).count() == (5 if step == "_drop_versions" else 4)
    sinks.keep_history(spark, path, entry(spark, 31))
    kept = requests.read_history(spark, path)
    assert kept.count() == (6 if step == "_drop_versions" else 5)
    assert "31" in {r.id for r in kept.collect()}
    sinks.keep_history(spark, path, entry(spark, 32), limit=2)
    assert sorted(r.id for r in requests.read_history(spark, path).collect()) == ["31", "32"]
    assert len(requests.history_versions(spark, path)) == 1
