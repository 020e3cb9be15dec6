from __future__ import annotations

import os

from pyspark import InheritableThread

from lagstone.llm import common, jaccard, quality


def test_marks_are_those_of_a_thread(spark):
    """A table that another thread stages after a mark is not deleted with what this one has made."""
    mark, other = common.made(), []
    mine = common.stage(spark.range(5), "mine")
    kept = common.stage(spark.range(6), "kept")

    def beside():
        other.append(common.stage(spark.range(7), "other"))

    thread = InheritableThread(target=beside)
    thread.start()
    thread.join(60)
    path = common._paths[mine].removeprefix("file://")
    common.drop_since(mark, kept)
    assert (kept.count(), other[0].count()) == (6, 7)
    assert not os.path.exists(path)


def test_two_operators_in_one_session(spark, make):
    """Quality rules delete what they have made while the join beside them still reads its own tables."""
    docs = make([(i, f"w{i % 40} " * 60 + f"some text number {i} with words of its own {i * 7}") for i in range(120)])
    near = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    good = sorted(map(tuple, quality.quality(docs).collect()))
    found = {}
    threads = [InheritableThread(target=lambda k=k, f=f: found.update({k: sorted(map(tuple, f(docs).collect()))})) for k, f in (("near", jaccard.near_duplicates), ("good", quality.quality))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert found == {"near": near, "good": good}


def test_lean_tasks(spark):
    """Rows pass unchanged, and what a task has freed is not kept by its process."""
    docs = spark.range(1000)
    assert sorted(x.id for x in docs.mapInArrow(common.lean(lambda batches: batches), "id long").collect()) == list(range(1000))
    kept = [b"x" * 1000 for _ in range(200_000)]
    last = kept[-1]
    del kept
    common.give_back()
    with open("/proc/self/statm") as f:
        before = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    kept = [b"x" * 1000 for _ in range(200_000)]
    last = kept[-1]
    del kept
    common.give_back()
    with open("/proc/self/statm") as f:
        after = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    assert last and after - before < 50 << 20
