"""Event lines of runs and streams, the state that a viewer makes of them, and cancelling."""

from __future__ import annotations

import random
import threading
import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.operators import pairs
from lagstone.sources import requests
from lagstone.streaming import consume, runs

REQUEST = requests.SyncRequest("series", video_folder="/v", audio_folder="/a")


def results_of(spark, n):
    return spark.range(n).selectExpr(
        "concat('/v/', lpad(id, 4, '0'), '.mkv') AS primary_path", "'/a/x.wav' AS secondary_path", "CAST(id AS DOUBLE) AS start_delay_ms", "CAST(id * 3 AS DOUBLE) AS end_delay_ms", "CAST(NULL AS STRING) AS error",
        "id AS elapsed_ms", "timestamp_seconds(id) AS completed_at",
    )


def pairs_of(spark, a, b):
    return spark.range(a, b).selectExpr("concat('/none/', lpad(id, 4, '0'), '.wav') AS primary_path", "'/none/a.wav' AS secondary_path")


def lines(events):
    return events.orderBy("line").collect()


@pytest.mark.parametrize(("n", "part", "sizes"), [(25, 10, [10, 10, 5]), (20, 10, [10, 10]), (1, 10, [1]), (0, 10, [0])])
def test_done_in_parts(spark, tmp_path, n, part, sizes):
    """The parts list all results in order, and together they replace what came before."""
    runs.write_in_order(runs.run_events(results_of(spark, n).repartition(3), REQUEST, part=part), str(tmp_path / "e"))
    events = requests.read_lines(spark, str(tmp_path / "e"))
    done = [r for r in lines(events) if r.type == "done"]
    assert [len(r.results) for r in done] == sizes
    assert [(r.part, r.parts, r.total) for r in done] == [(k + 1, len(sizes), n) for k in range(len(sizes))]
    assert [x.videoFile for r in done for x in r.results] == [f"{k:04d}.mkv" for k in range(n)]
    assert "step" not in (tmp_path / "e" / next(x.name for x in (tmp_path / "e").iterdir() if x.name.endswith(".json"))).read_text()
    found = consume.run_results(events).orderBy("line", "place").collect()
    assert [r.videoFile for r in found] == [f"{k:04d}.mkv" for k in range(n)]
    # a part that is missing: done has not come
    cut = events.where("type <> 'done' OR part > 1")
    assert consume.run_results(cut).count() == n


def test_stream_numbers_go_on(spark, tmp_path):
    """Two batches of three, in one start and in two, and a batch that is repeated: 1 to 6 of 6, each once."""
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    pairs_of(spark, 0, 3).coalesce(1).write.parquet(source)
    runs.stream_pairs(spark, source, out, marks, request=REQUEST, at_once=1).awaitTermination()
    first = lines(requests.read_lines(spark, f"{out}/events"))
    assert [(r.processed, r.total) for r in first if r.type == "progress"] == [(1, 3), (2, 3), (3, 3)]
    pairs_of(spark, 3, 6).coalesce(1).write.mode("append").parquet(source)
    pairs_of(spark, 6, 9).coalesce(1).write.mode("append").parquet(source)
    runs.stream_pairs(spark, source, out, marks, request=REQUEST, at_once=1).awaitTermination()
    runs.finish(spark, out, part=4)
    found = lines(requests.read_lines(spark, f"{out}/events"))
    assert [(r.processed, r.total) for r in found if r.type == "progress"] == [(k, 3) for k in (1, 2, 3)] + [(k, 9) for k in range(4, 10)]
    assert [r.type for r in found[:3]] == ["log"] * 3 and [r.type for r in found[-3:]] == ["done"] * 3
    assert found[0].message == "Series mode: matched 3 file pairs."
    assert [r.type for r in found[3:9]] == ["file_start", "file_progress", "file_progress", "file_end", "progress", "result"]
    # the last batch was not committed: it runs again, and nothing counts twice
    (tmp_path / "marks" / "commits" / "2").unlink()
    (tmp_path / "marks" / "commits" / ".2.crc").unlink(missing_ok=True)
    runs.stream_pairs(spark, source, out, marks, request=REQUEST, at_once=1).awaitTermination()
    again = lines(requests.read_lines(spark, f"{out}/events"))
    assert [r.processed for r in again if r.type == "progress"] == list(range(1, 10))
    assert sum(len(r.results) for r in again if r.type == "done") == 9
    # more drops, and closed again
    pairs_of(spark, 9, 10).coalesce(1).write.mode("append").parquet(source)
    runs.stream_pairs(spark, source, out, marks, request=REQUEST).awaitTermination()
    runs.finish(spark, out)
    assert consume.run_results(requests.read_lines(spark, f"{out}/events")).count() == 10
    assert consume.run_state(requests.read_lines(spark, f"{out}/events")).first().processed == 10


def test_stream_without_drops(spark, tmp_path):
    spark.createDataFrame([], schemas.PAIRS).write.parquet(str(tmp_path / "in"))
    runs.stream_pairs(spark, *(str(tmp_path / x) for x in ("in", "out", "marks"))).awaitTermination()
    runs.finish(spark, str(tmp_path / "out"))
    assert [(r.type, r.total, r.results) for r in lines(requests.read_lines(spark, str(tmp_path / "out/events")))] == [("done", 0, [])]


def replay(rows):
    """What a viewer does, line by line."""
    s = {"current_file": None, "file_percent": None, "processed": 0, "total": 0, "log": [], "results": []}
    guard, parts = None, {}
    for r in rows:
        kind = r["type"]
        if kind == "file_start":
            guard = s["current_file"] = r["file"]
            s["file_percent"] = 0
            s["log"].append(f"Starting: {r['file']}")
        elif kind == "file_progress" and r["file"] == guard:
            s["file_percent"] = r["percent"]
        elif kind == "file_end":
            s["log"].append(f"Finished: {r['file']} ({r['elapsed_ms'] / 1000:.1f}s)")
        elif kind == "progress":
            s["processed"], s["total"] = r["processed"], r["total"]
        elif kind == "result":
            s["results"].append(r["videoFile"])
        elif kind == "log":
            s["log"].append(r["message"])
        elif kind == "done":
            parts = {} if r["part"] == 1 else parts
            parts[r["part"]] = [x["videoFile"] for x in r["results"]]
            s["file_percent"], guard = 100, None
            if len(parts) == r["parts"]:
                s["results"] = [x for k in sorted(parts) for x in parts[k]]
    s["log"] = s["log"][-5:]
    return s


@pytest.mark.parametrize("seed", range(4))
def test_state_equals_replay(spark, seed):
    """Random lines of three runs: starts, late and early progress, results before and after done, parts that are missing."""
    r = random.Random(seed)
    rows = []
    for run in "abc":
        for k in range(r.randint(0, 60)):
            kind = r.choice(["file_start", "file_progress", "file_progress", "file_end", "progress", "result", "log", *["done"] * (r.random() < 0.4)])
            x = {"run": run, "line": float(k), "type": kind, "file": r.choice("xyz") if kind.startswith("file") else None, "percent": r.choice([0, 50, 100]), "processed": k, "total": 60, "elapsed_ms": 100 * k, "message": f"m{k}", "videoFile": f"v{k}"}
            if kind == "done":
                n = r.randint(1, 3)
                rows += [x | {"line": k + j / 10, "part": j + 1, "parts": n, "results": [{"videoFile": f"d{k}.{j}.{i}"} for i in range(2)]} for j in range(n - (r.random() < 0.3))]
            else:
                rows.append(x)
    fields = "run string, line double, " + schemas.EVENTS + ", _corrupt_record string"
    events = spark.createDataFrame(rows, fields)
    state = {x.run: x for x in consume.run_state(events, by=["run"]).collect()}
    results = consume.run_results(events, by=["run"]).orderBy("line", "place").collect()
    log = consume.run_log(events, by=["run"], limit=5).orderBy(F.col("back").desc()).collect()
    for run in {x["run"] for x in rows}:
        want = replay([x | {"results": x.get("results")} for x in sorted(rows, key=lambda x: x["line"]) if x["run"] == run])
        got = state[run]
        assert {k: got[k] for k in ("current_file", "file_percent", "processed", "total")} == {k: want[k] for k in ("current_file", "file_percent", "processed", "total")}
        assert [x.videoFile for x in results if x.run == run] == want["results"]
        assert [x.message for x in log if x.run == run] == want["log"]


def test_lines_keep_their_order(spark, tmp_path):
    """Batches by number, not by name; several files of a batch; a line that is no event."""
    for batch in (2, 10, -1):
        runs.write_in_order(spark.range(40).selectExpr("id AS number", "0 AS step", "'log' AS type", f"concat('{batch}:', id) AS message").repartition(4), str(tmp_path / f"e/batch={batch}"))
    (tmp_path / "e/batch=11").mkdir()
    (tmp_path / "e/batch=11/x.json").write_text('\n{"type":"log","message":"a"}\nbroken\n{"type":"log","message":"b"}\n')
    found = lines(requests.read_lines(spark, str(tmp_path / "e")))
    assert [r.message for r in found[:120]] == [f"{b}:{k}" for b in (-1, 2, 10) for k in range(40)]
    assert [r.message or r._corrupt_record for r in found[120:]] == ["a", "broken", "b"]
    log = consume.run_log(requests.read_lines(spark, str(tmp_path / "e")), limit=2).orderBy("back").collect()
    assert [r.message for r in log] == ["b", "Invalid bridge message: broken"]


@pytest.fixture
def slow_pairs(monkeypatch):
    """Pairs that take long from the sixth block on."""
    real = pairs.process_pairs

    def process_pairs(frame, **how):
        slow = F.pandas_udf(lambda x: (time.sleep(20), x)[1], "string")
        late = frame.where("primary_path >= '/none/0010'").limit(1).count() > 0
        return real(frame.withColumn("primary_path", slow("primary_path")) if late else frame, **how)

    monkeypatch.setattr(runs.pair_ops, "process_pairs", process_pairs)
    return lambda: monkeypatch.setattr(runs.pair_ops, "process_pairs", real)


def test_canceled_run_keeps_finished_blocks(spark, tmp_path, slow_pairs):
    """Half of a run is done when it is canceled: its results stay, it says that it was canceled, and it can go on later."""
    out, ended = str(tmp_path / "out"), []
    thread = InheritableThread(target=lambda: ended.append(runs.run_blocks(spark, pairs_of(spark, 0, 20), out, "half", request=REQUEST, block=2)))
    thread.start()
    while not (tmp_path / "out/events/batch=4/_SUCCESS").exists():
        time.sleep(0.2)
    time.sleep(2)
    other = []
    threading.Thread(target=lambda: other.append(spark.range(10).count())).start()
    runs.cancel(spark, "half")
    thread.join(50)
    assert ended == ["canceled"]
    events = requests.read_lines(spark, f"{out}/events")
    assert spark.read.parquet(f"{out}/results").count() == 10
    assert [r.primary_name for r in spark.read.parquet(f"{out}/results").orderBy("primary_path").collect()] == [f"{k:04d}.wav" for k in range(10)]
    state = consume.run_state(events).first()
    assert (state.processed, state.total, state.finished) == (10, 20, False)
    assert consume.run_results(events).count() == 10
    assert consume.run_log(events).where("back = 1").first().message == runs.CANCELED
    assert other == [10]
    slow_pairs()
    assert runs.run_blocks(spark, pairs_of(spark, 0, 20), out, "half", request=REQUEST, block=2) == "done"
    events = requests.read_lines(spark, f"{out}/events")
    assert [r.processed for r in lines(events) if r.type == "progress"] == list(range(1, 21))
    assert consume.run_results(events).count() == 20
    assert runs.CANCELED not in [r.message for r in lines(events)]


def test_failing_run_is_not_canceled(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        runs.run_blocks(spark, pairs_of(spark, 0, 2).withColumn("primary_path", F.expr("raise_error('nowhere')")), str(tmp_path / "out"), "bad")


def test_canceled_stream_keeps_batches(spark, tmp_path, slow_pairs):
    """Stopped in its second batch: the first one's results stay, and the next start does the second."""
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for a, b in ((0, 3), (10, 12)):
        pairs_of(spark, a, b).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # drops come in the order of their times
    query = runs.stream_pairs(spark, source, out, marks, at_once=1)
    while not (tmp_path / "out/events/batch=0/_SUCCESS").exists():
        time.sleep(0.2)
    time.sleep(3)
    runs.stop(spark, query, out)
    events = requests.read_lines(spark, f"{out}/events")
    assert consume.run_results(events).count() == 3
    assert [r.message for r in lines(events)][-1] == runs.CANCELED
    slow_pairs()
    runs.stream_pairs(spark, source, out, marks, at_once=1).awaitTermination()
    runs.finish(spark, out)
    events = requests.read_lines(spark, f"{out}/events")
    assert [(r.processed, r.total) for r in lines(events) if r.type == "progress"] == [(1, 5), (2, 5), (3, 5), (4, 5), (5, 5)]
    assert consume.run_state(events).first().finished
