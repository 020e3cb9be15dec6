from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lagstone.llm import sharding


def test_law(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = sharding.shard_documents(docs).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8))
    assert max(counts.values()) < 1.25 * min(counts.values())
    for r in got:
        assert r.grown_shard in (r.shard, 8)
        assert (r.region, r.rack) == (r.shard // 4, r.shard // 2)
        assert r.size == len(f"text {r.doc_id}") + 1
        assert r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
    assert 0.07 < sum(r.grown_shard == 8 for r in got) / 6000 < 0.15
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    # a document's shard is its own affair
    again = {r.doc_id: r.shard for r in sharding.shard_documents(docs.where("doc_id % 7 = 0")).collect()}
    assert all(again[r.doc_id] == r.shard for r in got if r.doc_id in again)


def test_every_growth_fills_the_new_shard_only(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"))
    key = F.col("doc_id").cast("string")
    for n in range(8, 12):
        both = sharding.descend(sharding.descend(docs, key, sharding.topology(n), "a"), key, sharding.topology(n + 1), "b")
        assert both.where("a <> b AND b <> " + str(n)).count() == 0


def test_weights(spark):
    tree = (sharding.Shard(0, 0, 0, 1.0), sharding.Shard(0, 0, 1, 3.0), sharding.Shard(1, 1, 2, 4.0))
    heavier = (sharding.Shard(0, 0, 0, 1.0), sharding.Shard(0, 0, 1, 3.0), sharding.Shard(1, 1, 2, 8.0))
    docs, key = spark.range(8000).select(F.col("id").alias("doc_id")), F.col("doc_id").cast("string")
    got = sharding.descend(sharding.descend(docs, key, tree, "a"), key, heavier, "b")
    counts = {r.a: r["count"] for r in got.groupBy("a").count().collect()}
    assert abs(counts[0] / 8000 - 1 / 8) < 0.02
    assert abs(counts[1] / 8000 - 3 / 8) < 0.03
    assert got.where("a <> b AND b <> 2").count() == 0
    with pytest.raises(ValueError, match="weights"):
        sharding.descend(docs, key, (sharding.Shard(0, 0, 0, 0.0),), "a")
    with pytest.raises(ValueError, match="8 shards"):
        sharding.topology(7)


def test_odd_rows(spark, make, odd_rows):
    got = sharding.shard_documents(make(odd_rows)).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(make(odd_rows).limit(0)).count() == 0
