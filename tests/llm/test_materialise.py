from __future__ import annotations

import hashlib
import struct
from pathlib import Path

import numpy as np
import pytest

from lagstone.llm import bpe, materialise

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_permutation(n):
    got = materialise.permute(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (materialise.permute(np.arange(n), n, key=1) != got).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1


def test_slots_of_a_large_space():
    """Indices of few partitions out of a huge space: distinct slots, spread evenly over its ranges."""
    space = materialise.PARTITIONS * materialise.LOCAL
    index = np.concatenate([np.arange(20_000) + p * materialise.LOCAL for p in (0, 1, 7, 999_999)])
    got = materialise.permute(index, space)
    assert len(set(got.tolist())) == len(index)
    assert ((got >= 0) & (got < space)).all()
    counts = np.bincount((got / space * 40).astype(int), minlength=40)
    assert abs(counts - 2000).max() < 250


def test_shards(spark, make, odd_rows, tmp_path):
    vocabulary, path = P.path("byte_bpe_50k.json"), str(tmp_path / "shards")
    rows = odd_rows + [(1000 + i, f"text number {i} " * (i % 9)) for i in range(60)]
    materialise.write_shards(make(rows).repartition(5), vocabulary, path, length=16, shard=50)
    got = materialise.read_shards(spark, path, length=16).orderBy("position").collect()
    own, want = bpe.load(vocabulary), []
    for doc, text, *_ in rows:
        ids = own.encode(text or "")
        for k in range(max(1, -(-len(ids) // 16))):
            part = ids[16 * k : 16 * k + 16]
            want.append((doc, k, len(part), hashlib.sha256(struct.pack(f"<{len(part)}I", *part)).hexdigest()))
    assert sorted(((r.doc_id, r.seq, r.n_tokens, r.ids_sha256) for r in got), key=repr) == sorted(want, key=repr)
    # positions without gaps, in the order of slots
    assert [r.position for r in got] == list(range(len(want)))
    assert [r.slot for r in got] == sorted({r.slot for r in got})
    # a reader resumes in the middle, in any shard, with one seek
    table = materialise.manifest(spark, path, length=16)
    shards = table.orderBy("shard").collect()
    assert len(shards) > 5
    for position in (0, len(got) // 2, shards[3].first, shards[3].first - 1, len(got) - 1, len(got)):
        read = [(int(x["slot"]), int(x["seq"]), int(x["n"])) for block in materialise.read_from(table, position, length=16, block=7) for x in block]
        assert read == [(r.slot, r.seq, r.n_tokens) for r in got[position:]]
    kind = materialise.record_type(16)
    r = got[len(got) // 2]
    file = Path({s.shard: s.file for s in shards}[r.shard].removeprefix("file:")).read_bytes()
    record = np.frombuffer(file[r.offset : r.offset + kind.itemsize], kind)[0]
    assert (record["slot"], record["seq"], record["n"]) == (r.slot, r.seq, r.n_tokens)
    assert len(file) % kind.itemsize == 0


def test_positions_over_blocks_of_shards(spark, make, tmp_path, monkeypatch):
    """Positions are the same whatever the number of shards that are summed up together."""
    path = str(tmp_path / "blocks")
    materialise.write_shards(make([(i, f"text number {i} " * 30) for i in range(80)]), P.path("byte_bpe_50k.json"), path, length=16, shard=20)
    want = materialise.manifest(spark, path, length=16).orderBy("shard").collect()
    monkeypatch.setattr(materialise, "MANIFEST_BLOCK", 3)
    got = materialise.manifest(spark, path, length=16).orderBy("shard").collect()
    assert got == want and len(got) > 9
    assert [r.first for r in got] == [sum(x.n for x in got[:i]) for i in range(len(got))]


def test_no_rows(spark, make, tmp_path):
    path = str(tmp_path / "none")
    materialise.write_shards(make([(1, "x")]).limit(0), P.path("byte_bpe_50k.json"), path)
    assert materialise.manifest(spark, path).collect() == []
    assert materialise.read_shards(spark, path).count() == 0
    assert list(materialise.read_from(materialise.manifest(spark, path), 0)) == []
