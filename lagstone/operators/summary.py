"""Counts, filters, progress and lists over results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagstone.functions import grades, text
from lagstone.sources.scratch import brief_shuffles, scratch_path


def result_counts(results: DataFrame) -> DataFrame:
    """high, medium, low, error and total in one row; errors are counted among the low ones too."""
    counts = [F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")]
    return results.agg(*counts, F.count_if(grades.has_error("error")).alias("error"), F.count(F.lit(1)).alias("total"))


def success_counts(results: DataFrame) -> DataFrame:
    bad = grades.has_error("error")
    return results.agg(F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed"))


def by_confidence(results: DataFrame, wanted: str = "all") -> DataFrame:
    return results if wanted == "all" else results.where(F.col("confidence") == wanted)


def any_low(results: DataFrame) -> DataFrame:
    """Whether any result deserves a warning: low, or a delay missing."""
    bad = (F.col("confidence") == "low") | F.col("start_delay_ms").isNull() | F.col("end_delay_ms").isNull()
    return results.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("warn"))


def total_size(files: DataFrame, *by: str, size: str = "size") -> DataFrame:
    return files.groupBy(*by).agg(F.sum(F.coalesce(size, F.lit(0))).alias("total_size"))


def unique_parent(files: DataFrame, *by: str, path: str = "path") -> DataFrame:
    """The parent folder that all files share, or all of each ``by``; null if there are several.

    The least and the greatest parent are compared, so no set of distinct folders is held.
    """
    parents = files.select(*by, text.parent_folder(path).alias("p"))
    return parents.groupBy(*by).agg(F.when(F.min("p") == F.max("p"), F.max("p")).alias("parent"))


def progress(events: DataFrame, *, order: str | Sequence[str], by: str | None = None, before: int = 0, path: str | None = None) -> DataFrame:
    """Adds processed, total and percent of each event, in order; with ``by`` the counts run within each of its values.

    Over a whole table the events are dealt to ranges of the order, sorted and written, a file for each range; the counts of the ranges, one number
    a task, say where each begins, and an event's place in its file the rest, so no task sees all events and they are shuffled once.  ``before`` have
    been processed already and count in both.  ``path``: where the ranges are written, for callers that remove them when they are done.
    """
    order = [order] if isinstance(order, str) else list(order)
    if by:
        part = Window.partitionBy(by)
        done, total = F.row_number().over(part.orderBy(*order)).cast("long"), F.count(F.lit(1)).over(part)
        return events.withColumns({"processed": done, "total": total}).withColumn("percent", text.percent("processed", "total"))
    spark = events.sparkSession
    path = path or scratch_path(spark, "ranges")
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    with brief_shuffles(spark):
        # a file for each range, however many rows it has: the place in the file is the place in the range
        ranged.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    starts, total = [], before
    for r, n in sorted(map(tuple, ranged.groupBy("__range").count().collect())):
        starts.append((r, total))
        total += n
    starts = spark.createDataFrame(starts, "__range int, __start long")
    out = ranged.withColumn("__place", F.col("_metadata.row_index") + 1).join(F.broadcast(starts), "__range")
    out = out.withColumns({"processed": F.col("__start") + F.col("__place"), "total": F.lit(total).cast("long")}).drop("__range", "__start", "__place")
    return out.withColumn("percent", text.percent("processed", "total"))


def eta_ms(elapsed_ms, processed, total) -> Column:
    """Time per item so far times the items left; null before the first."""
    e, p, t = (F.col(c) if isinstance(c, str) else c for c in (elapsed_ms, processed, total))
    return F.try_divide(e, p) * (t - p)


def last_lines(lines: DataFrame, *, order: str, limit: int = 200) -> DataFrame:
    """The last lines, in order."""
    return lines.orderBy(F.col(order).desc()).limit(limit).orderBy(order)


def high_per_run(history: DataFrame) -> DataFrame:
    """Results with high confidence of each run."""
    good = F.filter("results", lambda r: grades.confidence(r.startDelay, r.endDelay) == "high")
    return history.select("id", F.size(good).alias("high"))
