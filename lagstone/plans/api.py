"""Runs: single, batch, movie and series."""

from __future__ import annotations

import logging
from datetime import datetime, timezone

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession

from lagstone import schemas
from lagstone.operators import matching, pairs
from lagstone.sources import files, sinks
from lagstone.sources.requests import SyncRequest
from lagstone.streaming import runs


def plan_pairs(spark: SparkSession, request: SyncRequest) -> DataFrame:
    """The pairs that a request asks for."""
    r = request.check()
    if r.mode == "single":
        return spark.createDataFrame([(r.video_files[0], r.audio_file)], schemas.PAIRS)
    if r.mode == "batch":
        return matching.pair_with_one(files.list_batch(spark, r.video_folder), r.audio_file)
    if r.mode == "movie":
        return matching.pair_with_one(files.list_movies(spark, r.video_folder, r.video_files), r.audio_file)
    return matching.pair_files(files.list_folder(spark, r.video_folder), files.list_folder(spark, r.audio_folder, kind="audio"), r.match_pattern)


def run(spark: SparkSession, request: SyncRequest, *, exact: bool = False, done: Accumulator | None = None, verbose: bool = False) -> DataFrame:
    """Graded results of a request; the folders and the file of batch and series mode must be there.  No pairs, no rows.

    ``done`` counts finished pairs for the driver; ``verbose`` logs the request and the plan of its pairs.
    """
    if request.mode in ("batch", "series"):  # of single files the pair itself says what is missing
        request.check_paths(spark)
    found = plan_pairs(spark, request)
    if verbose:
        logging.getLogger(__name__).info("%s\n%s", request, found._jdf.queryExecution().simpleString())
    # one recording that all pairs share is decoded once for all tasks
    staged = pairs.stage_secondary(spark, request.audio_file, segment=request.segment_duration) if request.mode in ("batch", "movie") else None
    return pairs.graded(pairs.process_pairs(found, segment=request.segment_duration, exact=exact, done=done, staged=staged))


def run_to(spark: SparkSession, request: SyncRequest, folder: str, *, started: datetime | None = None, one_file: bool = False, **how) -> str:
    """Run a request once and keep all its output under a path of its own, which is returned: results, event lines and the CSV report, as one file
    only where that is asked for."""
    path = sinks.run_path(folder, request.mode, started or datetime.now(timezone.utc))
    run(spark, request, **how).write.parquet(f"{path}/results")
    results = spark.read.parquet(f"{path}/results")
    runs.write_in_order(runs.run_events(results, request), f"{path}/events")
    sinks.write_csv(results, f"{path}/csv", sinks.CSV_MOVIE if request.mode == "movie" else sinks.CSV_SERIES, one_file=one_file)
    return path
