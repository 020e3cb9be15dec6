from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lagstone.llm import jaccard
from lagstone.llm.components import components


def sets_of(rows, words):
    out = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    return out


def brute(rows, words, similar):
    """n_shingles and the members' ids of each row's component, by all pairs."""
    sets, up = sets_of(rows, words), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= similar * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min((x for x in members[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


def near_copies(seed, n=30):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 6, 12, 40, 120, 300]))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((doc, " ".join(copy)))
            doc += 1
    return rows


@pytest.mark.parametrize(("seed", "words", "similar", "block"), [(1, 3, 90, 2048), (2, 3, 90, 2), (3, 5, 80, 2048), (4, 1, 80, 3)])
def test_against_all_pairs(make, seed, words, similar, block):
    rows = near_copies(seed)
    got = jaccard.near_duplicates(make(rows), words=words, similar=similar, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, words, similar)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for similar in (80, 90):
        for _ in range(2000):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            k = int(rng.integers(0, max(1, int(len(a) * 0.22)) + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[k // 2 :]], rng.integers(0, 2**63, k - k // 2, dtype=np.int64).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= similar * (len(a) + len(b) - both) and not np.array_equal(a, b):  # equal sets are one node
                assert len(np.intersect1d(jaccard.signatures(a, similar)[0], jaccard.signatures(b, similar)[0]))


@pytest.mark.parametrize(("seed", "similar"), [(1, 90), (2, 80)])
def test_small_sets(make, seed, similar):
    """Sets of 1 to 24 words that have words added, removed or replaced."""
    r, rows = random.Random(seed), []
    for n in range(1, 25):
        base = [f"x{n}y{k}" for k in range(n)]
        for _ in range(8):
            copy = [x for x in base if r.random() > 0.06] + [f"z{r.randrange(60)}" for _ in range(r.choice([0, 0, 1, 1, 2]))]
            rows.append((len(rows), " ".join(copy)))
    got = jaccard.near_duplicates(make(rows), words=1, similar=similar).collect()
    want = brute(rows, 1, similar)
    assert sorted(map(tuple, got), key=repr) == want
    assert len({x[2] for x in want}) < len(rows) - 20


def test_short_texts_are_not_compared(spark):
    """Distinct texts of a few words: rows of the groups grow with the texts, not with their square."""
    sizes = []
    for n in (2000, 4000):
        docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1 + id % 14), k -> concat('w', id * 17 + k % 5 * k))) AS text")
        batches = [b for b in docs.select("text").toArrow().to_batches()]
        found = [jaccard.signatures(jaccard.ngram_hashes(t), 90) for b in batches for t in b.column(0).to_pylist()]
        assert all(len(x) == 0 for (x, _), t in zip(found, (t for b in batches for t in b.column(0).to_pylist()), strict=True) if len(set(t.split())) <= 8)
        pairs, direct = jaccard._groups(spark.createDataFrame([(int(p), i, int(q)) for i, (x, y) in enumerate(found) for p, q in zip(x.view(np.int64), y, strict=True)], "part long, node long, quota int"), 100)
        sizes.append(pairs.count() + direct.count())
    assert max(sizes) < 200


def test_common_parts_can_be_left_out():
    """Whatever order of parts is taken for the most common, similar sets keep an equal part when each leaves out its quota."""
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        k = int(rng.integers(0, max(1, int(len(a) * 0.2)) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[k // 2 :]], rng.integers(0, 2**63, k - k // 2, dtype=np.int64).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):  # equal sets are one node
            continue
        salt, kept = rng.integers(0, 2**62), []
        for x in (a, b):
            parts, quotas = jaccard.signatures(x, 80)
            left = []
            for q in np.unique(quotas):
                mine = parts[quotas == q]
                left.append(mine[np.argsort(mine ^ np.uint64(salt))][max(0, int(q)) & 0xFFFFFF :])  # nodes that stand for themselves are all kept
            kept.append(np.concatenate(left))
        assert len(np.intersect1d(*kept))


def test_meet():
    rows = [(1, 5), (1, 6), (1, 6), (1, 7), (2, 5), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2), (4, 3), (5, 8), (5, 9)]
    want = {(0, 1, 2, 0), (0, 8, 9, 0), *((1, p, n, 10 * p + n) for p, n in rows if p in (1, 4))}
    for step in (1, 2, 3, 5, 20):
        batches = (pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([10 * r[0] + r[1] for r in part], pa.int32())], names=["part", "node", "quota"]) for part in (rows[i : i + step] for i in range(0, len(rows), step)))
        assert {tuple(x.values()) for b in jaccard._meet(batches, 2) for x in b.to_pylist()} == want
    assert not [x for b in jaccard._meet(iter([]), 2) for x in b.to_pylist()]


def test_many_null_ids(make):
    """Null doc_ids in great numbers: neither their count nor repeated rows multiply the work."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(2500)]
    near = [t.rsplit(" ", 1)[0] + " end" for t in texts]
    rows = [(None, t) for t in texts] + [(None, t) for t in near] + [(None, texts[0])] * 500
    got = jaccard.near_duplicates(make(rows), words=3, similar=90).collect()
    assert len(got) == len(rows)
    _, links = jaccard.ngram_links(make(rows), words=3, similar=90)
    assert links.distinct().count() == len(texts)


def test_one_part_of_very_many_sets(make):
    """A passage of 20,000 otherwise different texts: no group forms around it, and near copies among them are still found."""
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(20000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(12))
    rows = [(i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(20000)]
    rows += [(100_000 + i, rows[i][1].rsplit(" ", 1)[0] + " end") for i in range(0, 20000, 400)]
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(make(rows), words=3, similar=90, block=256).collect()}
    assert got == {i: i if i < 100_000 else i - 100_000 for i, _ in rows}


@pytest.mark.parametrize("table", [1, 3000, 1 << 25])
def test_trie(monkeypatch, table):
    monkeypatch.setattr(jaccard, "TABLE", table)
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.concatenate([rng.permutation(np.arange(1000, 1600))[:580].astype(np.uint64)])) for _ in range(20)]
    alike = [{i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))} for q in sets]
    for k in range(len(sets)):
        group = jaccard.Group(sets, 60)
        assert {i for p, i in group.links([k])} == alike[k] - {k}
    # all together: what is connected is that which is, by fewer links than members
    links = list(jaccard.Group(sets, 60).links(list(range(len(sets)))))
    assert all(i in alike[p] for p, i in links)
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for p, i in links:
        assert find(p) != find(i)
        up[find(p)] = find(i)
    assert all(find(k) == find(i) for k in range(len(sets)) for i in alike[k])


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(make, odd_rows):
    got = jaccard.near_duplicates(make(odd_rows)).collect()
    empty = [r for r in odd_rows if not (r[1] or "").split()]
    want = [x for x in brute(odd_rows, 3, 90) if x[1]] + [(r[0], 0, r[0]) for r in empty]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert jaccard.near_duplicates(make(odd_rows).limit(0)).count() == 0


def test_one_of_each_group(make, odd_rows):
    r = random.Random(14)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(60)]
    near = [t.rsplit(" ", 1)[0] + " end" for t in texts]
    rows = [(100 + i, t) for i, t in enumerate(near)] + [(None, t) for t in texts] + [(None, t.rsplit(" ", 1)[0] + " stop") for t in texts[:30]] + [(None, "alone " + " ".join(vocabulary[:50]))] * 3
    got = jaccard.one_of_each_group(make(rows), words=3, similar=90)
    assert got.columns == make(rows).columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted([(100 + i, t) for i, t in enumerate(near)] + [rows[-1]], key=repr)
    want = {(a, b) for a, b, *_ in odd_rows}
    got = [(x.doc_id, x.text) for x in jaccard.one_of_each_group(make(odd_rows), words=3, similar=90).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want - {(6, "twice the same row")}
