"""The state of runs from their event lines: what a viewer shows after it has taken in every line in order.

``line`` orders the lines of a run.  Nothing is replayed line by line: what the last line of each kind says is found by aggregates that combine before
they shuffle, so neither a run nor a file of very many lines is one task's work.  ``by`` names the columns that tell runs apart; without it all lines
are one run's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagstone.functions import grades, text
from lagstone.sources.scratch import kept

_RESULT = ["videoFile", "audioFile", "startDelay", "endDelay", "error", "elapsed_ms"]


def _is(kind: str) -> Column:
    return F.col("type") == kind


def run_state(events: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """A row for each run: current_file, file_percent, processed, total, percent and finished.

    A start makes its file the current one, at 0 percent.  Progress counts only if it is the current file's: what comes late, of a file before it, or after
    the run was done, is left out.  done brings the file to 100 percent.
    """
    # one row a run first; only the progress of the file that is current by then is looked for, so no state of all files is shuffled
    latest = {
        "now": F.max(F.when(_is("file_start"), F.struct("line", "file"))), "progress": F.max(F.when(_is("progress"), F.struct("line", "processed", "total"))),
        "done": F.max(F.when(_is("done"), F.col("line"))),
    }
    runs = kept(events.groupBy(*by).agg(*(c.alias(n) for n, c in latest.items())), "state")
    current = runs.where("now IS NOT NULL").select(*(F.col(c).alias(f"__{c}") for c in by), F.col("now.line").alias("__started"), F.col("now.file").alias("__file"))
    same = [F.col("file").eqNullSafe(F.col("__file")), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]
    late = events.where(_is("file_progress")).select(*by, "line", "file", "percent").join(current, same).where("line > __started")
    seen = late.groupBy(*(f"__{c}" for c in by)).agg(F.max(F.struct("line", "percent")).alias("seen"))
    runs = runs.join(seen, F.lit(True) if not by else [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")
    over = F.coalesce(F.col("done") > F.col("now.line"), F.col("done").isNotNull())
    shown = F.when(over, 100).when(F.col("now").isNull(), F.lit(None)).when(F.col("seen").isNotNull(), F.col("seen.percent")).otherwise(0)
    processed, total = F.coalesce("progress.processed", F.lit(0)), F.coalesce("progress.total", F.lit(0))
    return runs.select(*by, F.col("now.file").alias("current_file"), shown.cast("int").alias("file_percent"), processed.alias("processed"), total.alias("total"), text.percent(processed, total).cast("int").alias("percent"), over.alias("finished"))


def run_results(events: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The results of each run, with their confidence and (line, place), by which they are ordered.

    Results come one by one; done, once all its parts are there, replaces all that came before it.
    """
    key = list(by) or ["__run"]
    events = events if by else events.withColumn("__run", F.lit(0))
    done = events.where(_is("done"))
    # a done opens with its first part; the last one that is whole counts
    opened = F.max(F.when(F.coalesce("part", F.lit(1)) == 1, F.col("line"))).over(Window.partitionBy(*key).orderBy("line"))
    parts = done.select(*key, "line", "part", "parts").withColumn("opened", opened).where("opened IS NOT NULL")
    whole = parts.groupBy(*key, "opened").agg(F.count_distinct(F.coalesce("part", F.lit(1))).alias("there"), F.coalesce(F.max("parts"), F.lit(1)).alias("parts"), F.max("line").alias("closed"))
    # a row a run, whose size is known once it is kept: the lines stay where they are unless there are very many runs
    whole = kept(whole.where("there >= parts").groupBy(*key).agg(F.max(F.struct("opened", "closed")).alias("x")).select(*key, "x.*"), "whole")
    counts = F.when(_is("done"), F.expr("line >= opened AND line <= closed")).otherwise(F.expr("closed IS NULL OR line > closed"))
    lists = F.when(_is("done"), F.col("results")).otherwise(F.array(F.struct(*_RESULT)))
    found = events.where(_is("done") | _is("result")).join(whole, key, "left").where(counts).select(*key, "line", F.posexplode(lists).alias("place", "r"))
    return found.select(*key, "line", F.col("place").cast("long").alias("place"), "r.*").select(*by, "line", "place", *_RESULT, grades.confidence("startDelay", "endDelay").alias("confidence"))


def run_log(events: DataFrame, *, by: Sequence[str] = (), limit: int = 200) -> DataFrame:
    """The last ``limit`` log lines of each run with back: 1 for the last one.  Starts and ends of files are lines, and so are lines that are no events."""
    # The wording of the lines.
    end = F.concat(F.lit("Finished: "), "what", F.lit(" ("), text.seconds_text("elapsed_ms"), F.lit("s)"))
    said = F.when(_is("log"), F.col("what")).when(_is("file_start"), F.concat(F.lit("Starting: "), "what")).when(_is("file_end"), end).otherwise(F.concat(F.lit("Invalid bridge message: "), "what"))
    what = F.when(_is("log"), F.col("message")).when(_is("file_start") | _is("file_end"), F.col("file")).when(F.col("type").isNull(), F.col("_corrupt_record"))
    lines = events.select(*by, "line", "type", what.alias("what"), "elapsed_ms").where("what IS NOT NULL")
    # a limited row number: each task keeps its last lines only, before any of them travel
    back = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("line").desc()))
    return lines.withColumn("back", back).where(F.col("back") <= limit).select(*by, "back", said.alias("message"))
