"""Operator 6: materialisation in training order.

Texts are encoded and cut into sequences of a fixed number of ids.  Sequence k of input partition p has the index p * LOCAL + k, and
its slot is f(index), where f is a keyed permutation of 0 .. PARTITIONS * LOCAL - 1: a balanced Feistel network over the next even
number of bits, applied again while its result is too large (cycle-walking).  So every sequence has a global slot as soon as it is
encoded, without a count of all sequences first: ids travel once, and are never stored between.

Ranges of slots are shards, one file each with its records in the order of slots; all records have one length.  The slots in use
are spread evenly over a space far larger than their number, so a record's position in the training order is the number of records
in the shards before it, which follows from the sizes of the files, plus its place in its own.  A reader resumes at any position with one
look at the table of files and one seek.

A record: slot and doc_id (int64), flag for a doc_id (uint8), number of the sequence in its text and number of ids (int32), the ids
(uint16), filled with 0, and a line end.  Little-endian.  The files are written by Spark's text sink, so they can lie on any file system.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagstone.llm import bpe, common

#: Ids of a record, and records of a shard, about.
LENGTH, SHARD = 512, 16_384
#: Shards that one task writes or reads, about, and shards whose positions are summed up together.
SHARDS_A_TASK, MANIFEST_BLOCK = 8, 4_096
ROUNDS, KEY = 4, 20_240_229
#: The space of indices: input partitions, and sequences of each.
PARTITIONS, LOCAL = 10**6, 10**12
_HEAD = "<qqBii"


def _round(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & np.uint64(mask)


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of indices below ``n``."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1
    keys = [int.from_bytes(hashlib.blake2b(f"{key}|{r}".encode(), digest_size=8).digest(), "little") >> 1 for r in range(ROUNDS)]
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & np.uint64(mask)
        for k in keys:
            left, right = right, left ^ _round(right, k, mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def record_type(length: int) -> np.dtype:
    return np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("known", "u1"), ("seq", "<i4"), ("n", "<i4"), ("ids", "<u2", (length,)), ("end", "u1")])


def write_shards(docs: DataFrame, vocabulary: str, path: str, *, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> None:
    """Write the shards of all whole texts to ``path``.

    A null or empty text is one sequence without ids; repeated rows are separate sequences; a null doc_id is written as unknown; other
    columns are ignored; an empty table writes no shard.  The order is a function of the key and of the rows' order in the input's
    partitions.  The number of shards follows from the texts' bytes, at three a token.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    if len(bpe.load(vocabulary).automaton.labels) > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    shared = bpe.share(spark, vocabulary)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    about = source.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / (3 * length))))).first()[0] or 0
    files = max(1, -(-about // shard))
    space = PARTITIONS * LOCAL

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        if part >= PARTITIONS:
            raise ValueError("the input has too many partitions")
        step = 2 * length
        for batch in batches:
            heads, ids = [], []
            packed = shared.value.encode_all([t or "" for t in batch.column(1).to_pylist()], "H")
            for d, x in zip(batch.column(0).to_pylist(), packed, strict=True):
                for k in range(max(1, -(-len(x) // step))):
                    heads.append((d or 0, d is not None, k))
                    ids.append(x[step * k : step * (k + 1)])
            n = len(ids)
            slots = permute(np.arange(at, at + n) + part * LOCAL, space, key)
            at += n
            records = [struct.pack(_HEAD, s, d, known, k, len(x) // 2) + x for s, (d, known, k), x in zip(slots.tolist(), heads, ids, strict=True)]
            # both steps keep the order of slots, so shards are ranges of them
            shards = np.minimum((slots / space * files).astype(np.int64), files - 1)
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(slots), pa.array(records, pa.binary())], names=["shard", "slot", "record"])

    placed = source.mapInArrow(encode, "shard long, slot long, record binary")
    tasks = max(min(files, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-files // SHARDS_A_TASK))
    ranges = placed.repartitionById(tasks, (F.col("shard") * tasks / files).cast("int")).sortWithinPartitions("shard", "slot")
    # filled up here: only ids travel
    whole = F.expr(f"rpad(record, {record_type(length).itemsize - 1}, X'00')").cast("string").alias("value")
    ranges.select(whole, "shard").write.partitionBy("shard").text(path, lineSep="\n")


def manifest(spark: SparkSession, path: str, *, length: int = LENGTH) -> DataFrame:
    """shard long, first long (position of its first record), n long (records) and file string of each shard; the sizes of files tell.

    Positions are summed up in two steps, over blocks of shards and within each, so no task has the rows of all shards.
    """
    # the schema is given, so that a folder without shards is an empty table; sizes only: no content is read
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    rows = files.select(
        F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard"), F.expr(f"length div {record_type(length).itemsize}").alias("n"), F.col("path").alias("file")
    ).withColumn("block", F.expr(f"shard div {MANIFEST_BLOCK}"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n").alias("all")).select("block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(blocks, "block")
    return placed.select("shard", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first"), "n", "file")


def _open(name: str):
    files, at = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
    return files.open_input_file(unquote(at))


def read_from(shards: DataFrame, position: int, *, length: int = LENGTH, block: int = 1024) -> Iterator[np.ndarray]:
    """Blocks of records from ``position`` on, in training order: opens the shard that has it and seeks; then shard after shard.

    ``shards`` is the manifest; its rows come partition by partition as they are needed.
    """
    kind = record_type(length)
    for row in shards.where(F.col("first") + F.col("n") > position).orderBy("shard").toLocalIterator():
        with _open(row.file) as f:
            place = max(0, position - row.first)
            f.seek(place * kind.itemsize)
            while place < row.n:
                got = np.frombuffer(f.read(min(block, row.n - place) * kind.itemsize), kind)
                yield got
                place += len(got)


def read_shards(spark: SparkSession, path: str, *, length: int = LENGTH) -> DataFrame:
    """position, slot, shard, offset (of the record in its file), doc_id, seq, n_tokens and ids_sha256 of every record.

    Tasks get rows of the manifest and stream the files that these name, in blocks of records.
    """
    kind = record_type(length)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(name) as f:
                    for at in range(0, n, 4096):
                        got = np.frombuffer(f.read(min(4096, n - at) * kind.itemsize), kind)
                        place = np.arange(at, at + len(got))
                        hashes = [hashlib.sha256(x[:m].astype("<u4").tobytes()).hexdigest() for x, m in zip(got["ids"], got["n"].tolist(), strict=True)]
                        doc = pa.array(got["doc_id"].astype(np.int64), mask=got["known"] == 0)
                        columns = [pa.array(first + place), pa.array(got["slot"].astype(np.int64)), pa.array(np.full(len(got), shard)), pa.array(place * kind.itemsize), doc, pa.array(got["seq"].astype(np.int32)), pa.array(got["n"].astype(np.int64)), pa.array(hashes, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["position", "slot", "shard", "offset", "doc_id", "seq", "n_tokens", "ids_sha256"])

    # staged: a table of files, a row each; spread so that each task opens a few of them
    rows = common.stage(manifest(spark, path, length=length), "manifest")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARDS_A_TASK))
    spread = rows.select("shard", "first", "n", "file").repartition(tasks, "shard")
    return spread.mapInArrow(parse, "position long, slot long, shard long, offset long, doc_id long, seq int, n_tokens long, ids_sha256 string")


def op6_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents in training order, and read the shards back."""
    import public_tokenizers

    path = common.new_path(spark, "shards")
    write_shards(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_shards(spark, path)
