"""Listings of recordings as tables: name, path, type and size; the content of the files is not read."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone import schemas
from lagstone.functions import text

# Extensions of batch mode in its order, and of movie mode.
BATCH_EXTENSIONS = ("wav", "mp3", "aac", "flac", "ogg", "m4a", "eac3", "ac3", "mp4", "mkv", "webm", "avi", "mov")
MOVIE_EXTENSIONS = ("mp4", "mkv", "webm", "avi", "mov")
#: Containers that the external decoder reads.
VIDEO_EXTENSIONS = (*MOVIE_EXTENSIONS, "eac3", "ac3")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a small folder; a missing one has none."""
    files, at = _at(spark, folder)
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def path_kind(spark: SparkSession, path: str) -> str | None:
    """file, folder, or None for what isn't there."""
    files, at = _at(spark, path)
    return None if not files.exists(at) else "folder" if files.getFileStatus(at).isDirectory() else "file"


def arrow_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; names are taken as they are, blanks and percent signs too."""
    found = re.match(r"(\w+)://([^/]+)(/.*)", path, re.DOTALL)
    if not found:
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    files, root = fs.FileSystem.from_uri(f"{found[1]}://{found[2]}/")
    return files, root.rstrip("/") + found[3]


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry of a folder: files, empty ones too, subfolders (type folder, no size) and hidden ones.  A missing folder has none.

    One task lists the folder; nothing goes through the driver.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = arrow_path(folder)
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        for k in range(0, len(found), 10_000):
            part = found[k : k + 10_000]
            kinds = ["folder" if x.type == fs.FileType.Directory else "video" for x in part]
            yield pd.DataFrame({"name": [x.base_name for x in part], "path": [f"{folder.rstrip('/')}/{x.base_name}" for x in part], "type": kinds, "size": pd.array([x.size for x in part], "Int64")})

    return spark.range(1, numPartitions=1).mapInPandas(run, schemas.FILES)


def list_folder(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None, *, kind: str = "video", hidden: bool = False) -> DataFrame:
    """Files of a folder, not of those below, without ``hidden`` ones whose names begin with a dot; with ``extensions`` those only, whatever
    their case.  A missing folder has no files."""
    found = list_entries(spark, folder).where("type <> 'folder'").withColumn("type", F.lit(kind))
    if not hidden:
        found = found.where(~F.col("name").startswith("."))
    return found.where(text.has_extension("name", extensions)) if extensions else found


def list_batch(spark: SparkSession, folder: str) -> DataFrame:
    return list_folder(spark, folder, BATCH_EXTENSIONS)


def list_movies(spark: SparkSession, folder: str | None = None, explicit: Sequence[str] | None = None) -> DataFrame:
    """Movie files; an explicit list, if there is one, replaces the scan."""
    if explicit:
        return from_paths(spark, explicit)
    return list_folder(spark, folder, MOVIE_EXTENSIONS) if folder else spark.createDataFrame([], schemas.FILES)


def from_paths(spark: SparkSession, paths: Sequence[str], *, kind: str = "video") -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.select(text.basename("path").alias("name"), "path", F.lit(kind).alias("type"), F.lit(None).cast("long").alias("size"))


def as_audio(files: DataFrame) -> DataFrame:
    return files.withColumn("type", F.lit("audio"))


def single_file(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """A one-row listing with the size, and the parent folder."""
    files = spark.read.format("binaryFile").load(path).select(text.basename("path").alias("name"), "path", F.lit("audio").alias("type"), F.col("length").alias("size"))
    return files, path.replace("\\", "/").rpartition("/")[0] or None


def dropped_paths(spark: SparkSession, paths: Sequence[str], *, kind: str = "audio") -> DataFrame:
    """Dropped files with ordinal: the order in which they were dropped."""
    rows = spark.createDataFrame(list(enumerate(paths)), "ordinal long, path string")
    return rows.select(text.basename("path").alias("name"), "path", F.lit(kind).alias("type"), F.lit(None).cast("long").alias("size"), "ordinal")


def drop_files(current: DataFrame, dropped: DataFrame, *, mode: str, kind: str) -> DataFrame:
    """Append dropped files; in movie mode the audio list keeps the first only: one that was there before, else the first that was dropped, by its
    ordinal where the dropped files have one, and by path."""
    order = F.col("ordinal") if "ordinal" in dropped.columns else F.lit(0).cast("long")
    dropped = dropped.withColumn("__at", order).drop("ordinal")
    if mode != "movie" or kind != "audio":
        return current.unionByName(dropped.drop("__at"))
    both = current.withColumns({"__late": F.lit(0), "__at": F.lit(0).cast("long")}).unionByName(dropped.withColumn("__late", F.lit(1)))
    return both.orderBy("__late", "__at", "path").limit(1).drop("__late", "__at")


def first_file(files: DataFrame) -> DataFrame:
    return files.orderBy("path").limit(1)


def count_by_extension(files: DataFrame, extensions: Sequence[str] = ("mp4", "mkv")) -> DataFrame:
    return files.where(text.has_extension("name", extensions)).agg(F.count(F.lit(1)).alias("n"))


def remove_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return rows.join(ids.select(on), on, "left_anti")


def toggle(selected: DataFrame, clicked: DataFrame, on: str) -> DataFrame:
    """Ids in one of the two sets but not in both."""
    a, b = selected.select(on).distinct().withColumn("a", F.lit(True)), clicked.select(on).distinct().withColumn("b", F.lit(True))
    return a.join(b, on, "full").where("a IS NULL OR b IS NULL").select(on)


def write_files(rows: DataFrame, folder: str, *, name: str = "name", content: str = "content") -> None:
    """A file for each row, with its name and bytes, written by the executors; a file of that name is replaced."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = arrow_path(folder)
        files.create_dir(at, recursive=True)
        for frame in frames:
            for n, data in zip(frame[name], frame[content], strict=True):
                with files.open_output_stream(f"{at}/{n}") as out:
                    out.write(data)
            yield frame[[name]]

    rows.select(F.col(name), F.col(content)).mapInPandas(run, f"{name} string").write.format("noop").mode("overwrite").save()
