from __future__ import annotations

import json
import time
from datetime import datetime

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.operators import pairs, summary
from lagstone.plans import api
from lagstone.sources import files, probe, requests, sinks
from lagstone.streaming import runs


def test_listing(spark, tmp_path):
    for n in ("b.MKV", "a.mp4", "note.txt", "c.wav"):
        (tmp_path / n).write_bytes(b"xy")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "d.mkv").write_bytes(b"x")
    folder = f"file://{tmp_path}"
    assert sorted(r.name for r in files.list_folder(spark, folder).collect()) == ["a.mp4", "b.MKV", "c.wav", "note.txt"]
    movies = files.list_movies(spark, folder)
    assert sorted((r.name, r.size, r.type) for r in movies.collect()) == [("a.mp4", 2, "video"), ("b.MKV", 2, "video")]
    assert sorted(r.name for r in files.list_batch(spark, folder).collect()) == ["a.mp4", "b.MKV", "c.wav"]
    assert [r.name for r in files.list_movies(spark, folder, ["/else/z.avi"]).collect()] == ["z.avi"]
    assert files.list_folder(spark, f"{folder}/missing").count() == 0
    assert files.first_file(files.list_folder(spark, folder)).first().name == "a.mp4"
    assert files.count_by_extension(movies).first().n == 2
    one, parent = files.single_file(spark, f"{tmp_path}/c.wav")
    assert (one.first().size, parent) == (2, str(tmp_path))
    both = files.drop_files(files.as_audio(movies), files.as_audio(one), mode="movie", kind="audio")
    assert [r.name for r in both.collect()] == ["a.mp4"]
    assert files.drop_files(movies, one, mode="series", kind="audio").count() == 3
    given = files.dropped_paths(spark, ["/d/z.wav", "/d/a.wav"])
    assert [r.name for r in files.drop_files(movies.limit(0), given, mode="movie", kind="audio").collect()] == ["z.wav"]
    assert [r.name for r in files.drop_files(one, given, mode="movie", kind="audio").collect()] == ["c.wav"]
    assert sorted(r.name for r in files.drop_files(one, given, mode="series", kind="audio").collect()) == ["a.wav", "c.wav", "z.wav"]


def test_entries(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for n in (".hidden.mkv", "_a.mkv", "b c%.mp4"):
        (tmp_path / n).write_bytes(b"")
    folder = f"file://{tmp_path}"
    assert sorted(map(tuple, files.list_entries(spark, folder).select("name", "type", "size").collect())) == [(".hidden.mkv", "video", 0), ("_a.mkv", "video", 0), ("b c%.mp4", "video", 0), ("below", "folder", None)]
    assert sorted(r.name for r in files.list_folder(spark, folder).collect()) == ["_a.mkv", "b c%.mp4"]
    assert sorted(r.name for r in files.list_folder(spark, str(tmp_path), hidden=True).collect()) == [".hidden.mkv", "_a.mkv", "b c%.mp4"]
    assert [files.path_kind(spark, str(tmp_path / n)) for n in ("below", "_a.mkv", "none")] == ["folder", "file", None]
    bad = requests.SyncRequest("batch", video_folder=str(tmp_path / "_a.mkv"), audio_file=str(tmp_path / "b c%.mp4"))
    with pytest.raises(ValueError, match="not a folder"):
        bad.check_paths(spark)
    assert requests.SyncRequest("batch", video_folder=folder, audio_file=str(tmp_path / "_a.mkv")).check_paths(spark).mode == "batch"


def test_run_output(spark, tmp_path):
    """A run's output under a path of its own, and that of a run without pairs."""
    for n in ("v", "a"):
        (tmp_path / n).mkdir()
    request = requests.SyncRequest("series", video_folder=str(tmp_path / "v"), audio_folder=str(tmp_path / "a"))
    started = datetime(2024, 5, 6, 7, 8, 9)
    path = api.run_to(spark, request, str(tmp_path / "out"), started=started)
    assert path.endswith("/out/series_20240506_070809")
    events = requests.read_events(spark, f"{path}/events").select("type", "message", "total", "results").collect()
    assert [tuple(r) for r in events] == [("log", "No matching file pairs found.", None, None), ("done", None, 0, [])]
    for n in ("v/s01e01.wav", "a/s01e01.wav", "v/s01e02.wav", "a/s01e02.wav"):
        (tmp_path / n).write_bytes(b"no recording")
    done = spark.sparkContext.accumulator(0)
    path = api.run_to(spark, request, str(tmp_path / "out"), done=done, verbose=True)
    assert done.value >= 2
    events = requests.read_events(spark, f"{path}/events").where("type IS NOT NULL").collect()
    assert [r.message for r in events[:3]] == ["Series mode: matched 2 file pairs.", f"Video folder: {tmp_path}/v", f"Audio folder: {tmp_path}/a"]
    assert [r.type for r in events[3:]] == ["file_start", "file_progress", "file_progress", "file_end", "progress", "result"] * 2 + ["done"]
    assert [(r.processed, r.total) for r in events if r.type == "progress"] == [(1, 2), (2, 2)]
    assert len(events[-1].results) == 2
    assert all(x.error.startswith("Failed to load start of primary") for x in events[-1].results)
    assert sinks.read_csv(spark, f"{path}/csv").count() == 2


def test_last_folder(spark, tmp_path):
    path = str(tmp_path / "folders")
    assert sinks.last_folder(spark, path, "video") is None
    for side, folder in (("video", "/x"), ("audio", "/y"), ("video", "/z")):
        sinks.remember_folder(spark, path, side, folder)
    assert [sinks.last_folder(spark, path, x) for x in ("video", "audio")] == ["/z", "/y"]


def test_a_shared_secondary_is_decoded_once():
    calls = []
    windows = pairs.Windows(lambda path, *rest: calls.append((path, rest)))
    for k in range(50):
        load = windows.of("/shared.wav")
        for path in (f"/p{k}.wav", "/shared.wav"):
            load(path, 8000, 300.0)
            load(path, 8000, 300.0, 12.5)
    assert sum(path == "/shared.wav" for path, _ in calls) == 2
    assert len(calls) == 102


def test_requests():
    r = requests.parse_request(json.dumps({"mode": "series", "video_folder": "/v", "audio_folder": "/a", "other": 1}))
    assert (r.mode, r.segment_duration) == ("series", 300.0)
    for bad in ("", "{", "[]", '{"mode": "x"}', '{"mode": "movie"}', '{"mode": "batch", "audio_file": "a"}', '{"mode": "series", "video_folder": "/v"}', '{"mode": "single", "audio_file": "a"}'):
        with pytest.raises(ValueError):  # noqa: PT011
            requests.parse_request(bad)


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"type":"file_progress","file":"a","percent":50}\n\nnot an event\n{"type":"file_progress","file":"b","percent":50}\n')
    got = requests.read_events(spark, str(tmp_path)).cache()
    assert got.where("type IS NOT NULL").count() == 2
    assert got.where("_corrupt_record IS NOT NULL").count() == 1
    assert [r.file for r in runs.current_progress(got, "a").collect()] == ["a"]


def test_probe(spark):
    docs = ['{"streams":[{"codec_type":"audio"}],"format":{"duration":"12.5"}}', '{"streams":[],"format":{"duration":"N/A"}}', "broken", None]
    got = probe.parse_probes(spark.createDataFrame(list(enumerate(docs)), "path int, json string")).orderBy("path").collect()
    assert [tuple(r)[1:] for r in got] == [(True, False, 12.5), (False, False, None), (False, False, None), (False, False, None)]
    seen = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "path string, ts int, has_audio boolean")
    latest = probe.latest(seen).withColumn("has_video", F.lit(True))
    shown = probe.with_probes(spark.createDataFrame([("a",), ("b",)], "path string"), latest).orderBy("path").collect()
    assert [(r.has_audio, r.has_video) for r in shown] == [(False, True), (False, False)]


def test_csv(spark, tmp_path):
    rows = [("/v/a \"x\", y.mkv", "/a/b.aac", 1.5, None, None, 3, None), ("/v/c.mkv", "/a/d.aac", None, None, "bad", None, None)]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], None, None) for r in rows], schemas.RESULTS)
    for layout in (sinks.CSV_SERIES, sinks.CSV_MOVIE, sinks.CSV_EXPORT):
        sinks.write_csv(df, str(tmp_path / str(layout[0]) / str(len(layout))), layout)
        got = sinks.read_csv(spark, str(tmp_path / str(layout[0]) / str(len(layout))), layout).collect()
        assert {r[0] for r in got} == {'a "x", y.mkv', "c.mkv"}
        assert {r[-1] for r in got} == {None, "bad"}


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    assert requests.read_history(spark, path).count() == 0
    for k in range(4):
        entry = spark.createDataFrame([(str(k), "series", 1)], "id string, mode string, fileCount bigint").selectExpr(
            "id", f"timestamp_seconds({k}) AS date", "mode", "array(named_struct('videoFile', 'v', 'audioFile', 'a', 'startDelay', 1.0D, 'endDelay', 2.0D, 'error', CAST(NULL AS STRING), 'elapsed_ms', 5L)) AS results", "fileCount"
        )
        sinks.keep_history(spark, path, entry, limit=3)
    kept = requests.read_history(spark, path)
    assert [r.id for r in sinks.newest(kept).collect()] == ["3", "2", "1"]
    assert sinks.flatten_history(kept).count() == 3
    assert {r.high for r in summary.high_per_run(kept).collect()} == {1}


def test_stream_equals_batch(spark, tmp_path):
    rows = [("/none/a.wav", "/none/b.wav"), ("/none/c.wav", "/none/d.wav")]
    df = spark.createDataFrame(rows, schemas.PAIRS)
    for k in range(2):
        df.limit(k + 1).write.mode("append").parquet(str(tmp_path / "in"))
        runs.stream_pairs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/results"))
    want = pairs.graded(pairs.process_pairs(df.unionAll(df.limit(1))))
    columns = ["primary_path", "error", "confidence"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    events = requests.read_events(spark, str(tmp_path / "out/events/*"))
    assert events.where("type = 'result'").count() == 3


def test_selection_and_progress(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert sorted(r.i for r in files.toggle(a, b, "i").collect()) == [1, 3]
    assert [r.i for r in files.remove_ids(a, b, "i").collect()] == [1]
    got = summary.progress(a.distinct(), order="i").orderBy("i").collect()
    assert [(r.processed, r.total, r.percent) for r in got] == [(1, 2, 50), (2, 2, 100)]
    assert [r.i for r in summary.last_lines(b, order="i", limit=1).collect()] == [3]


def test_cancel(spark):
    """A run under a job group is stopped by its name; other jobs go on."""
    ended = []

    def slow():
        spark.sparkContext.setJobGroup("a run", "slow", interruptOnCancel=True)
        try:
            spark.range(4).repartition(4).mapInPandas(lambda frames: (time.sleep(60) or f for f in frames), "id long").collect()
            ended.append("done")
        except Exception as e:  # noqa: BLE001
            ended.append(str(e))

    thread = InheritableThread(target=slow)
    thread.start()
    while not spark.sparkContext.statusTracker().getJobIdsForGroup("a run"):
        time.sleep(0.1)
    runs.cancel(spark, "a run")
    thread.join(50)
    assert len(ended) == 1
    assert "cancelled" in ended[0]
    assert spark.range(3).count() == 3


def test_progress_of_a_whole_table(spark):
    """Ties, several ranges and what was processed before."""
    rows = spark.range(1000).selectExpr("id", "id % 7 AS k")
    got = summary.progress(rows.repartition(5), order=["k", "id"], before=20).orderBy("processed").collect()
    assert [r.id for r in got] == sorted(range(1000), key=lambda i: (i % 7, i))
    assert [r.processed for r in got] == list(range(21, 1021))
    assert {r.total for r in got} == {1020}
    assert summary.progress(rows.limit(0), order="id").count() == 0
