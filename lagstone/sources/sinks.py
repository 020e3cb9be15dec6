"""CSV, event-line and history sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.functions import text
from lagstone.sources.files import exists, remove
from lagstone.sources.requests import history_versions, read_history

# The columns of the three CSV layouts.
CSV_SERIES = ("Primary File", "Secondary File", "Start Delay (ms)", "End Delay (ms)", "Error")
CSV_MOVIE = ("Video File", "Audio File", "Start Delay (ms)", "End Delay (ms)", "Error")
CSV_EXPORT = ("Video", "Audio", "Start Delay (ms)", "End Delay (ms)", "Elapsed (ms)", "Error")


def csv_rows(results: DataFrame, layout: tuple[str, ...] = CSV_SERIES) -> DataFrame:
    """Results as text cells of a layout: base names, and empty cells for nulls."""
    cells = [text.basename("primary_path"), text.basename("secondary_path"), F.col("start_delay_ms"), F.col("end_delay_ms")]
    cells += [F.col("elapsed_ms")] * (len(layout) == 6) + [F.col("error")]
    return results.select(*(text.csv_cell(c).alias(n) for c, n in zip(cells, layout, strict=True)))


def write_csv(results: DataFrame, path: str, layout: tuple[str, ...] = CSV_SERIES, *, one_file: bool = False) -> None:
    """CSV files with headers, written in parallel; quotes in a cell are doubled.  ``one_file`` is for reports, which one task can write."""
    rows = csv_rows(results, layout)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def run_path(folder: str, mode: str, started: datetime) -> str:
    """The folder of one run's output: its mode and the second it started in."""
    return f"{folder.rstrip('/')}/{mode}_{started:%Y%m%d_%H%M%S}"


def export_history(history: DataFrame, path: str, *, one_file: bool = False) -> None:
    """The results of all kept runs as one CSV table."""
    rows = flatten_history(history).select(F.col("videoFile").alias("primary_path"), F.col("audioFile").alias("secondary_path"), F.col("startDelay").alias("start_delay_ms"), F.col("endDelay").alias("end_delay_ms"), "error", "elapsed_ms")
    write_csv(rows, path, CSV_EXPORT, one_file=one_file)


def remember_folder(spark: SparkSession, path: str, side: str, folder: str) -> None:
    """Keep the folder last used on a side; each side has a row of its own."""
    spark.createDataFrame([(side, folder)], "side string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/side={side}")


def last_folder(spark: SparkSession, path: str, side: str) -> str | None:
    at = f"{path}/side={side}"
    return spark.read.parquet(at).first().folder if exists(spark, at) else None


def read_csv(spark: SparkSession, path: str, layout: tuple[str, ...] = CSV_SERIES) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in layout)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    events.write.mode("append").json(path)


def keep_history(spark: SparkSession, path: str, entry: DataFrame, *, limit: int = 20) -> DataFrame:
    """Add a run and keep the newest ``limit``.

    Each list is a version with a number of its own.  It counts from when it is complete, and only then the older ones go, so a stop at any
    moment leaves a whole list.
    """
    now = history_versions(spark, path)
    rows = newest(read_history(spark, path).unionByName(entry), limit)
    _write_version(rows, f"{path}/version={now[-1] + 1 if now else 0}")
    _drop_versions(spark, path, now)
    return read_history(spark, path)


def _write_version(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def _drop_versions(spark: SparkSession, path: str, numbers: list[int]) -> None:
    for k in numbers:
        remove(spark, f"{path}/version={k}")


def newest(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.col("date").desc(), "id").limit(limit)


def flatten_history(history: DataFrame) -> DataFrame:
    """The results of all kept runs as rows."""
    return history.select("id", "date", "mode", F.inline("results"))
