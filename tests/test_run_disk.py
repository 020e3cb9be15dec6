"""What event lines and their consumers leave on disk: lines are compressed, results are shuffled and their events are not."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lagstone.operators import summary
from lagstone.plans import catalog
from lagstone.sources import requests
from lagstone.streaming import consume, runs
from tests.test_runs import REQUEST, results_of

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def on_disk(spark, kind):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(f.stat().st_size for p in folder.glob(f"{kind}-*") for f in p.rglob("*") if f.is_file())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines_of_runs(spark):
    """The lines of two runs, in the file sizes that Spark would have to guess a join from."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    yield catalog._lines_of_two_runs(spark, DATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_run_has_the_lines_of_its_events(spark, tmp_path):
    """Written in steps, compressed or not: line by line what run_events says."""
    results = results_of(spark, 25).repartition(3)
    runs.write_in_order(runs.run_events(results, REQUEST, part=10), str(tmp_path / "want"))
    want = [r for r in requests.read_lines(spark, str(tmp_path / "want")).orderBy("line").drop("line").collect()]
    for compression, end in (("uncompressed", ".json"), ("gzip", ".json.gz")):
        numbered = runs.numbered_results(results, str(tmp_path / f"ranges-{compression}"))
        runs.write_run(numbered, 25, REQUEST, str(tmp_path / compression), part=10, compression=compression)
        assert requests.read_lines(spark, str(tmp_path / compression)).orderBy("line").drop("line").collect() == want
        assert all(x.name.endswith(end) for b in (0, runs.LAST) for x in (tmp_path / compression / f"batch={b}").glob("part-*"))


def test_numbers_without_a_second_shuffle(spark):
    """The places of events come from their files."""
    rows = summary.progress(spark.range(1000).repartition(5), order="id")
    assert "Window" not in plan(rows)
    assert [(r.id, r.processed) for r in rows.orderBy("id").collect()] == [(k, k + 1) for k in range(1000)]


@here
def test_event_lines_take_little_disk(spark):
    """plain lines are over 500 bytes a result; compressed ones a tenth, and the numbered results go once the lines are there."""
    lines, ranges = on_disk(spark, "lines"), on_disk(spark, "ranges")
    catalog.event_lines(spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert on_disk(spark, "lines") - lines < 100 * n
    assert on_disk(spark, "ranges") == ranges


@here
def test_log_lines_take_little_disk(spark):
    """those of one run and a half."""
    before, ranges = on_disk(spark, "runs"), on_disk(spark, "ranges")
    assert catalog.consumed_log(spark, DATA).count() == 400
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert on_disk(spark, "runs") - before < 150 * n
    assert on_disk(spark, "ranges") == ranges


@here
def test_results_are_not_shuffled(lines_of_runs):
    """a row for each run meets the lines where they are."""
    found = consume.run_results(lines_of_runs, by=["run"])
    assert "BroadcastHashJoin" in plan(found)
    assert "SortMergeJoin" not in plan(found)
    assert "hashpartitioning" not in plan(found)


@here
def test_state_is_not_shuffled_by_file(lines_of_runs):
    """what is shuffled is a row for each run and task, not one for each file."""
    found = consume.run_state(lines_of_runs, by=["run"])
    assert "BroadcastHashJoin" in plan(found)
    assert not [x for x in plan(found).splitlines() if "hashpartitioning" in x and "file" in x]


def test_state_of_nulls_and_of_nothing(spark):
    """Runs and files without names are as others; no lines at all are one run that has not begun, or none."""
    fields = "run string, line long, type string, file string, percent int, processed long, total long"
    rows = [(None, 1, "file_start", None, None, None, None), (None, 2, "file_progress", None, 40, None, None), (None, 3, "file_progress", "x", 90, None, None), ("a", 1, "file_progress", "x", 70, None, None), ("a", 2, "file_start", "x", None, None, None)]
    events = spark.createDataFrame(rows, fields)
    got = {r.run: (r.current_file, r.file_percent, r.finished) for r in consume.run_state(events, by=["run"]).collect()}
    assert got == {None: (None, 40, False), "a": ("x", 0, False)}
    none = consume.run_state(events.where(F.lit(False)))
    assert [(r.current_file, r.file_percent, r.processed, r.total, r.percent, r.finished) for r in none.collect()] == [(None, None, 0, 0, 0, False)]
    assert consume.run_state(events.where(F.lit(False)), by=["run"]).count() == 0
