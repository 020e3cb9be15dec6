"""Operator 2: shards from a hierarchical weighted hash tree.

A key descends from the root to a region, to a rack and to a shard.  At each level every child draws an exponential variate from a
hash of the key and the child, divided by the child's weight (the sum of the shards below it), and the least draw wins.  A child's
chance is its share of the weight, and a change of one weight moves keys only into or out of the subtree whose weight changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagstone.llm import common

#: Rows of a numbering bucket, and the most buckets: their offsets are broadcast, so 9 shards x 4096 rows of 24 bytes bound that table.
BUCKET_ROWS, BUCKETS = 4096, 4096


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int = 8) -> tuple[Shard, ...]:
    """The tree of ``shards`` (8 or more): two regions of two racks of two shards, and a region of its own for each further shard.

    So one more shard changes the weight of no subtree but its own, and takes rows only into itself.
    """
    if shards < 8:
        raise ValueError("the tree has 8 shards at least")
    return tuple(Shard(i // 4, i // 2, i) if i < 8 else Shard(i - 6, i - 4, i) for i in range(shards))


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    unit = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{level}{node}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return F.struct((-F.log(unit) / weight).alias("draw"), F.lit(node).alias("node"))


def _least(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*(_draw(key, level, k, w) for k, w in weights.items()))).getField("node")


def _choice(of: Column, cases: dict[int, Column]) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(of == k, v) if out is None else out.when(of == k, v)
    return out


def descend(docs: DataFrame, key: Column, tree: tuple[Shard, ...], into: str) -> DataFrame:
    """Add the columns ``{into}_region``, ``{into}_rack`` and ``into``, the shard.  Weights must be over 0."""
    if min(x.weight for x in tree) <= 0:
        raise ValueError("weights must be over 0")
    regions, racks, shards = {}, {}, {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0) + x.weight
        racks.setdefault(x.region, {})
        racks[x.region][x.rack] = racks[x.region].get(x.rack, 0) + x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight
    docs = docs.withColumn(f"{into}_region", _least(key, "region", regions))
    docs = docs.withColumn(f"{into}_rack", _choice(F.col(f"{into}_region"), {r: _least(key, "rack", w) for r, w in racks.items()}))
    return docs.withColumn(into, _choice(F.col(f"{into}_rack"), {r: _least(key, "shard", w) for r, w in shards.items()}))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put every document into a shard by its doc_id, and number the rows of each shard without gaps.

    Returns doc_id, size long, text_crc32 long, law ('key'), shard int, slot long, grown_shard int (with one more shard), region int and
    rack int.  The text is read once and not shuffled.  A null text has size 1 and check sum 0; a null doc_id is a key of its own;
    repeated rows fall into one shard and get slots of their own; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.col("text").cast("string")
    n = docs.count()
    buckets = min(1 + n // BUCKET_ROWS, BUCKETS)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # numbered in buckets; the text counts too, as very many rows can have one doc_id or none
    draw = F.md5(F.concat(key, F.lit("|slot|"), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(draw, 1, 12), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    rows = descend(rows, key, topology(shards), "shard")
    rows = common.stage(descend(rows, key, topology(shards + 1), "grown_shard"), "shards")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard", F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7."""
    return shard_documents(common.table(spark, sf_dir, "documents"))


def _choose_sql(key: str, tree: tuple[Shard, ...]) -> str:
    """The descent as a SQL expression: the least draw at each level."""

    def least(level: str, weights: dict[int, float]) -> str:
        if len(weights) == 1:
            return str(next(iter(weights)))
        draws = [f"{{'draw': -ln((CAST(('0x' || substr(md5({key} || '|{level}{k}'), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0) / {w:.1f}, 'node': {k}}}" for k, w in weights.items()]
        return f"list_min([{', '.join(draws)}]).node"

    regions, racks, shards = {}, {}, {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0) + x.weight
        racks.setdefault(x.region, {})
        racks[x.region][x.rack] = racks[x.region].get(x.rack, 0) + x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight
    by_rack = " ".join(f"WHEN {r} THEN {least('shard', w)}" for r, w in shards.items())
    by_region = " ".join(f"WHEN {r} THEN (CASE {least('rack', w)} {by_rack} END)" for r, w in racks.items())
    return f"CAST(CASE {least('region', regions)} {by_region} END AS INTEGER)"


OP2_SQL = rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
c AS (SELECT doc_id, k, n + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) AS text_crc32 FROM d, t),
s AS (SELECT *, CAST(('0x' || substr(md5(k || '|slot|' || text_crc32), 1, 12)) AS BIGINT) % (SELECT least(1 + count(*) // {BUCKET_ROWS}, {BUCKETS}) FROM documents) AS bucket, {_choose_sql("k", topology(8))} AS shard, {_choose_sql("k", topology(9))} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard, shard // 4 AS region, shard // 2 AS rack FROM s
"""
