"""Operator 10: token counts from the pieces of distinct pre-tokens.

Pieces are counted once per distinct pre-token.  Documents carry frequencies of pre-tokens, never ids: they are joined to the counts
and summed.  The join is in two parts, together exact.  The most frequent pre-tokens, a fixed number of them, are broadcast, so a
pre-token that stands in every document is no hot key; all the others are joined by a shuffle on the pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import bpe, common

#: Pre-tokens whose counts are broadcast (about 2 MB at this bound).
FREQUENT = 60_000
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHER = 200_000


def _pieces(tokenizer: bpe.Tokenizer, text: str) -> list[str]:
    """Pre-tokens and special strings of a text."""
    if "<|" not in text and not any(x in text for x in tokenizer.special):
        return tokenizer.pieces(text)
    return [p for x, i in tokenizer.parts(text) for p in ([x] if i >= 0 else tokenizer.pieces(x))]


def token_counts(docs: DataFrame, path: str, *, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes long, n_tokens long and over_limit boolean (n_tokens > limit) of every whole text.

    A null text counts as empty (0 bytes, 0 tokens).  A null doc_id and repeated rows are kept: each input row gives one row.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = bpe.share(spark, path)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, found = shared.value, Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(found), list(found.values())
            for at in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.string()), pa.array(n[at : at + 20_000], pa.int64())], names=["piece", "n"])
            found.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(_pieces(tokenizer, text))
            if len(found) > GATHER:
                yield from out()
        yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = [1 if w in tokenizer.special else k for w, k in zip(words, tokenizer.count_pieces(words), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64())], names=["piece", "n", "length"])

    distinct = source.select("text").mapInArrow(gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    lengths = common.stage(distinct.mapInArrow(count, "piece string, n long, length long"), "piece-lengths")
    top = lengths.orderBy(F.col("n").desc(), "piece").limit(frequent).select("piece", "length").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, get = shared.value, known.value.get
        for batch in batches:
            n_bytes, sums, rest = [], [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len((text or "").encode()))
                total, others = 0, []
                for piece, times in Counter(_pieces(tokenizer, text or "")).items():
                    length = get(piece)
                    if length is None:
                        others.append({"piece": piece, "times": times})
                    else:
                        total += length * times
                sums.append(total)
                rest.append(others)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())])))], names=["doc_id", "n_bytes", "known", "rest"])

    parts = source.mapInArrow(split, "doc_id long, n_bytes long, known long, rest array<struct<piece:string,times:bigint>>").withColumn("row", F.monotonically_increasing_id())
    parts = common.stage(parts, "piece-frequencies")
    rare = (
        parts.select("row", F.explode("rest").alias("x"))
        .select("row", "x.piece", "x.times")
        .join(lengths.select("piece", "length"), "piece")
        .select("row", (F.col("times") * F.col("length")).alias("n"))
    )
    sums = parts.select("row", "doc_id", "n_bytes", F.col("known").alias("n")).unionByName(rare, allowMissingColumns=True)
    total = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the byte-level vocabulary."""
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
