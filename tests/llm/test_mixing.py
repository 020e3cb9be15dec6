from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lagstone.llm import mixing

TOKENS = {"a": 900.0, "b": 90.0, "c": 10.0}


def test_limit():
    x = mixing.temperature(TOKENS, repeat_limit=2.0)
    reps = mixing.repetitions(TOKENS, mixing.weights(TOKENS, x), None)
    assert math.isclose(max(reps.values()), 2.0, rel_tol=1e-6)
    assert math.isclose(min(reps.values()), 1.0)
    assert math.isclose(x, 1 - math.log(2) / math.log(90), rel_tol=1e-6)
    assert mixing.temperature(TOKENS, repeat_limit=1000.0) == 0.0
    assert mixing.temperature({"a": 5.0}, repeat_limit=1.0) == 0.0
    with pytest.raises(ValueError, match="limit"):
        mixing.temperature(TOKENS, repeat_limit=2.0, budget=5000.0)


def test_entropy():
    for target in (0.5, 0.8, 1.0):
        x = mixing.temperature(TOKENS, repeat_limit=100.0, target_entropy=target)
        assert math.isclose(mixing.entropy(mixing.weights(TOKENS, x)), target, rel_tol=1e-6)
    assert mixing.temperature(TOKENS, repeat_limit=100.0, target_entropy=0.0) == 1.0


def test_documents(spark, make, odd_rows):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i % 10 else "small") for i in range(3000)] + odd_rows
    got = mixing.mix(make(rows), repeat_limit=1.7).collect()
    assert len(got) == len(rows)
    assert min(r.copies for r in got) >= 1
    for source in ("big", "small", "s0", None):
        part = [r for r in got if r.source == source]
        want = part[0].repetition * sum(r.n_words for r in part)
        assert abs(sum(r.copies * r.n_words for r in part) - want) <= max([0, *(r.n_words for r in part)]) * (1 + max(r.block for r in part))
    assert mixing.realise(mixing.mix(make(rows)), ["doc_id"]).count() == sum(r.copies for r in mixing.mix(make(rows)).collect())
    half = mixing.mix(make(rows[:3000]), budget=5000.0, repeat_limit=5.0).collect()
    assert abs(sum(r.copies * r.n_words for r in half) - 5000) < 100
    assert mixing.mix(make(rows).limit(0)).count() == 0


def test_very_many_sources(make, odd_rows):
    """Sources that are not collected get the same plan."""
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 40 if i % 3 else 0}") for i in range(2000)] + odd_rows
    for how in ({}, {"target_entropy": 2.5}, {"budget": 30000.0, "repeat_limit": 9.0}):
        want, got = (sorted(((r.doc_id, r.source, r.copies, r.block, r.place, round(r.repetition, 6)) for r in mixing.mix(make(rows), max_sources=n, **how).collect()), key=repr) for n in (10_000, 3))
        assert got == want
    with pytest.raises(ValueError, match="limit"):
        mixing.mix(make(rows), max_sources=3, budget=1e9).collect()


def test_tokens_and_places(make):
    rows = [(None if i % 2 else i, f"text {i}", "en", "s") for i in range(3000)]
    docs = make(rows).withColumn("tokens", F.length("text"))
    got = mixing.mix(docs, tokens="tokens").collect()
    assert all(r.n_words == len(r.text) for r in got)
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r.place)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in blocks.values())
    assert max(map(len, blocks.values())) < 1500


def test_plan_needs_no_python_workers(make):
    """The plan of the sources goes to Spark as an Arrow table, not as a list that Python workers pass on."""
    rows = [(i, "w " * (1 + i % 7), "en", ["a", "b", None][i % 3]) for i in range(60)]
    plan = mixing.mix(make(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation [__source" in plan and "LogicalRDD [__source" not in plan
