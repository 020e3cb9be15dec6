"""Results that arrive while files do: file drops to result rows and events, by Structured Streaming."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagstone import schemas
from lagstone.functions import text
from lagstone.operators import pairs as pair_ops
from lagstone.operators import summary
from lagstone.sources.files import exists
from lagstone.sources.requests import SyncRequest
from lagstone.sources.scratch import brief_shuffles

#: Results that one closing event lists.
PART = 10_000
#: Where the closing events of a stream stand: after those of every batch.
LAST = 2**63 - 1
# Fixed value: what a canceled run says.
CANCELED = "Sync canceled by user."
_ORDER = ["completed_at", "primary_path", "secondary_path"]
#: Tags that were canceled, for runs between two jobs.
_canceled: set[str] = set()


def events_of(results: DataFrame, *, batch: int = 0, before: int = 0, total: int | None = None) -> DataFrame:
    """The event rows of a batch of results, in order of completion: for each file_start, file_progress at 0, at 50 where the head was
    compared, and at 100, file_end, progress (processed, total, current) and result.

    ``before`` results have been processed by earlier batches; ``total`` are known of, where that is more than have been processed.
    """
    rows = summary.progress(results, order=_ORDER, before=before)
    return _steps(rows.withColumn("total", F.greatest("total", F.lit(total or 0).cast("long"))), batch)


def _steps(rows: DataFrame, batch: int) -> DataFrame:
    """The events of numbered results."""
    # names are cut before a result becomes seven rows
    rows = rows.withColumns({"name": text.basename("primary_path"), "other": text.basename("secondary_path")})
    name = F.col("name")
    kinds = [("file_start", None), ("file_progress", 0), ("file_progress", 50), ("file_progress", 100), ("file_end", None), ("progress", None), ("result", None)]
    steps = F.array(*(F.struct(F.lit(k).alias("type"), F.lit(p).cast("int").alias("percent"), F.lit(i).alias("step")) for i, (k, p) in enumerate(kinds)))
    rows = rows.drop("percent", "primary_path", "secondary_path").withColumn("e", F.explode(steps))
    rows = rows.where((F.coalesce("e.percent", F.lit(0)) != 50) | F.col("start_delay_ms").isNotNull())
    kind = F.col("e.type")

    def where(*kinds: str, value) -> Column:
        return F.when(kind.isin(*kinds), value)

    return rows.select(
        F.lit(batch).cast("long").alias("batch"), F.col("processed").alias("number"), F.col("e.step").alias("step"), kind.alias("type"), where("file_start", "file_progress", "file_end", value=name).alias("file"),
        F.col("e.percent").alias("percent"), where("progress", value=F.col("processed")).alias("processed"), where("progress", value=F.col("total")).alias("total"), where("progress", value=name).alias("current"),
        where("file_end", "result", value=F.col("elapsed_ms")).alias("elapsed_ms"), where("result", value=name).alias("videoFile"), where("result", value=F.col("other")).alias("audioFile"),
        where("result", value=F.col("start_delay_ms")).alias("startDelay"), where("result", value=F.col("end_delay_ms")).alias("endDelay"), where("result", value=F.col("error")).alias("error"),
    )


def messages(request: SyncRequest, total: int) -> list[str]:
    """What a run says before it starts."""
    # The wording of the lines.
    if request.mode == "series":
        if not total:
            return ["No matching file pairs found."]
        lines = [f"Series mode: matched {total} file pairs.", f"Video folder: {request.video_folder}", f"Audio folder: {request.audio_folder}"]
        return lines + [f"Match pattern: {request.match_pattern}"] * bool(request.match_pattern)
    name = (request.audio_file or "").replace("\\", "/").rsplit("/", 1)[-1]
    return [f"Movie mode: {total} video files queued.", f"Audio file: {name}"] if total else []


def _closing(numbered: DataFrame, total: int, part: int) -> DataFrame:
    """The done events of numbered results: each lists ``part`` of them at most, in order, and says which of how many parts it is."""
    names = ["videoFile", "audioFile", "startDelay", "endDelay", "error", "elapsed_ms"]
    cells = [text.basename("primary_path"), text.basename("secondary_path"), *map(F.col, ("start_delay_ms", "end_delay_ms", "error", "elapsed_ms"))]
    entry = F.struct("processed", F.struct(*(c.alias(n) for c, n in zip(cells, names, strict=True))).alias("result"))
    if total:
        # dealt by ranges of parts, so that they are made and put in order where their results are, and not shuffled as lists once more
        ranged = numbered.select(F.expr(f"(processed - 1) DIV {part}").alias("k"), entry.alias("entry")).repartitionByRange("k")
        listed = ranged.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("entry")), lambda x: x["result"]).alias("results")).sortWithinPartitions("k")
    else:
        listed = numbered.sparkSession.range(1).select(F.col("id").alias("k"), F.array().cast(schemas.RESULT_LIST).alias("results"))
    return listed.select(
        (F.lit(total + 1) + F.col("k")).cast("long").alias("number"), F.lit(0).alias("step"), F.lit("done").alias("type"), F.lit(total).cast("long").alias("total"),
        (F.col("k") + 1).cast("long").alias("part"), F.lit(max(1, -(-total // part))).cast("long").alias("parts"), "results",
    )


def run_events(results: DataFrame, request: SyncRequest, *, part: int = PART) -> DataFrame:
    """All event rows of a finished run: log lines, the events of its results, and done, which replaces what came before.

    done comes in numbered parts that list ``part`` results each, in order of completion, together all of them; an empty run has one, with an empty list.
    Rows are in the order of number and step.
    """
    spark = results.sparkSession
    numbered = summary.progress(results, order=_ORDER)
    total = numbered.count()
    said = spark.createDataFrame([(0, k, "log", m) for k, m in enumerate(messages(request, total))], "number long, step int, type string, message string")
    return said.unionByName(_steps(numbered, 0).drop("batch"), True).unionByName(_closing(numbered, total, part), True)


def write_in_order(events: DataFrame, path: str) -> None:
    """Event rows as lines, in their order: by file, and by line within a file.  What was there is replaced."""
    _write_lines(events.orderBy("number", "step"), path)


def _write_lines(events: DataFrame, path: str, compression: str = "uncompressed") -> None:
    """Event rows that are in order already."""
    with brief_shuffles(events.sparkSession):
        events.drop("number", "step", "batch").write.mode("overwrite").option("compression", compression).json(path)


def numbered_results(results: DataFrame, path: str) -> DataFrame:
    """The results of a run with processed and total, in order of completion, kept under ``path`` for what is written of them."""
    columns = ["primary_path", "secondary_path", "start_delay_ms", "end_delay_ms", "error", "elapsed_ms", "completed_at"]
    return summary.progress(results.select(columns), order=_ORDER, path=path).drop("completed_at", "percent")


def write_result_lines(numbered: DataFrame, path: str, *, compression: str = "uncompressed") -> None:
    """The events of numbered results, as ``run_events`` has them.  Results are put in order, not their events, which are seven times as many."""
    _write_lines(_steps(numbered.orderBy("processed"), 0), path, compression)


def write_run(numbered: DataFrame, total: int, request: SyncRequest, path: str, *, closed: bool = True, part: int = PART, compression: str = "uncompressed") -> None:
    """The lines of a run, as ``run_events`` has them, below ``path``: what it says first, the events of its results and, where it is ``closed``, done.

    They are written one after the other as batches, as those of a stream, so only one of their shuffles is on disk at a time.
    """
    _note(numbered.sparkSession, messages(request, total), f"{path}/batch=-1")
    write_result_lines(numbered, f"{path}/batch=0", compression=compression)
    if closed:
        _write_lines(_closing(numbered, total, part), f"{path}/batch={LAST}", compression)


def _note(spark: SparkSession, lines: list[str], path: str) -> None:
    rows = [(0, k, "log", m) for k, m in enumerate(lines)]
    write_in_order(spark.createDataFrame(rows, "number long, step int, type string, message string"), path)


def stream_pairs(spark: SparkSession, source: str, out: str, checkpoint: str, *, segment: float = 300.0, request: SyncRequest | None = None, at_once: int | None = None) -> StreamingQuery:
    """Process pairs from Parquet drops; each batch's results go to ``out``/results and its events to ``out``/events.

    A batch writes into folders of its own, which a repeated batch replaces: results stay exactly once.  With its results it commits how many
    have been processed up to it, so numbers go on from batch to batch, over restarts as well; the total is that of all present drops.  The
    first start says what the ``request`` is.  Stops when all present drops are done; ``finish`` then closes the run, or start it again
    for later drops.  ``at_once``: files of a batch.
    """
    drops = spark.readStream.schema(schemas.PAIRS)
    drops = (drops.option("maxFilesPerTrigger", at_once) if at_once else drops).parquet(source)
    total = spark.read.schema(schemas.PAIRS).parquet(source).count()
    if request is not None and not exists(spark, f"{out}/events/batch=-1"):
        _note(spark, messages(request, total), f"{out}/events/batch=-1")

    def handle(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        results = pair_ops.graded(pair_ops.process_pairs(batch, segment=segment))
        results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        done = own.read.parquet(f"{out}/results/batch={number}")
        before = _processed(own, out, number)
        own.createDataFrame([(before + done.count(),)], "processed long").coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")
        write_in_order(events_of(done, batch=number, before=before, total=total), f"{out}/events/batch={number}")

    return drops.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _processed(spark: SparkSession, out: str, batch: int) -> int:
    """Results of the batches before this one: the last total that one of them committed."""
    if not exists(spark, f"{out}/totals"):
        return 0
    return spark.read.schema("processed long, batch long").parquet(f"{out}/totals").where(F.col("batch") < batch).agg(F.max("processed")).first()[0] or 0


def finish(spark: SparkSession, out: str, *, part: int = PART) -> None:
    """Close a streamed run: done with the results of all its batches, in their order.  Closing it again, after more drops, replaces that."""
    if exists(spark, f"{out}/results"):
        results = spark.read.parquet(f"{out}/results")
        numbered = summary.progress(results, order=["batch", *_ORDER])
    else:
        numbered = spark.createDataFrame([], schemas.RESULTS + ", processed long")
    write_in_order(_closing(numbered, numbered.count(), part), f"{out}/events/batch={LAST}")


def stop(spark: SparkSession, query: StreamingQuery, out: str) -> None:
    """Cancel a streamed run: the batch that runs is given up, those before it stay with their results, and the run says that it was canceled."""
    query.stop()
    _note(spark, [CANCELED], f"{out}/events/batch={LAST}")


def run_blocks(spark: SparkSession, pairs: DataFrame, out: str, tag: str, *, request: SyncRequest | None = None, segment: float = 300.0, block: int = 10_000, **how) -> str:
    """Process pairs in blocks, each a job under ``tag`` whose results and events are committed when it ends; "done" or "canceled".

    ``cancel`` with the tag stops the block that runs, and no further one starts: the results of finished blocks stay, and the run says that it was
    canceled.  Called again with the same ``out``, it goes on with the blocks that are not there yet.
    """
    source = f"{out}/pairs"
    if not exists(spark, f"{source}/_SUCCESS"):
        place = summary.progress(pairs.select("primary_path", "secondary_path"), order=["primary_path", "secondary_path"])
        place.select("primary_path", "secondary_path", F.expr(f"(processed - 1) DIV {block}").alias("block")).write.mode("overwrite").partitionBy("block").parquet(source)
    planned = spark.read.schema(schemas.PAIRS + ", block long").parquet(source)
    total = planned.count()
    if request is not None:
        _note(spark, messages(request, total), f"{out}/events/batch=-1")
    context = spark.sparkContext
    context.addJobTag(tag)
    _canceled.discard(tag)
    try:
        for k in range(-(-total // block)):
            if tag in _canceled:  # between two blocks no job could be stopped
                raise InterruptedError("canceled")
            if exists(spark, f"{out}/events/batch={k}/_SUCCESS"):
                continue
            path = f"{out}/results/batch={k}"
            pair_ops.graded(pair_ops.process_pairs(planned.where(F.col("block") == k), segment=segment, **how)).write.mode("overwrite").parquet(path)
            write_in_order(events_of(spark.read.parquet(path), batch=k, before=k * block, total=total), f"{out}/events/batch={k}")
    except Exception as e:
        context.removeJobTag(tag)
        if "cancel" not in str(e).lower():
            raise
        _note(spark, [CANCELED], f"{out}/events/batch={LAST}")
        return "canceled"
    context.removeJobTag(tag)
    finish(spark, out)
    return "done"


def stream_table(spark: SparkSession, source: str, schema, transform, out: str, checkpoint: str) -> StreamingQuery:
    """Any narrow transformation of Parquet drops, appended to ``out``."""
    rows = transform(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current_progress(events: DataFrame, current: str) -> DataFrame:
    """Progress of the current file only; what comes late for others is left out."""
    return events.where((F.col("type") == "file_progress") & (F.col("file") == current))


def cancel(spark: SparkSession, tag: str, *, seconds: float = 1.0) -> None:
    """Stop the runs that were started under a job group or a tag of this name; what they have committed stays.

    A query is several jobs, and one may begin as another ends, so jobs are looked for again and again for some time.
    """
    _canceled.add(tag)
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        spark.sparkContext.cancelJobGroup(tag)
        spark.sparkContext.cancelJobsWithTag(tag)
        time.sleep(0.1)
