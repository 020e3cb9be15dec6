from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lagstone.llm import suffix_dedup


def brute(rows, length):
    """Result per row: rows in order of doc_id (null first), then as given."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        mask = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                mask[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((doc, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_hashes():
    data = np.frombuffer(b"abcabcabcx", np.uint8)
    h = suffix_dedup.Hashes(data)
    at = np.arange(4)
    assert h.of(at[:1], at[:1] + 3)[0] == h.of(at[3:], at[3:] + 3)[0]
    assert h.of(at[:1], at[:1] + 3)[0] != h.of(at[1:2], at[1:2] + 3)[0]


@pytest.mark.parametrize("seed", range(5))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    data, length, n = rng.integers(0, 2 + seed % 2, 4000).astype(np.uint8), 12, 900
    starts = rng.integers(0, 4000 - length, n)
    group = np.sort(rng.integers(0, 5, n))
    sorter = suffix_dedup.SuffixSort(data, length)
    order = sorter.order(starts, group)
    want = sorted(range(n), key=lambda i: (group[i], data[starts[i] : starts[i] + length].tobytes()))
    assert order.tolist() == want  # stable
    same = sorter.same_as_previous(starts[order], group[order])
    content = [(group[i], data[starts[i] : starts[i] + length].tobytes()) for i in want]
    assert same.tolist() == [i > 0 and content[i] == content[i - 1] for i in range(n)]


def test_minimisers():
    data = np.random.default_rng(1).integers(0, 4, 500).astype(np.uint8)
    got = suffix_dedup.minimisers(suffix_dedup.Hashes(data), 30, 8)
    assert len(got) == 471
    assert ((got >= np.arange(471)) & (got <= np.arange(471) + 22)).all()
    again = suffix_dedup.minimisers(suffix_dedup.Hashes(np.concatenate([data[100:], data[:100]])), 30, 8)
    assert (again[:300] == got[100:400] - 100).all()


def documents(seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcd é") for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.7 else "".join(r.choice("wxyz") for _ in range(r.randint(1, 20))) for _ in range(r.randint(0, 14)))) for i in range(60)]
    return rows + [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, "ab" * 300), (64, "a" * 200), (None, rows[5][1])]


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 1), (3, 3), (4, 0)])
def test_documents(make, seed, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT", 400)
    rows = documents(seed)
    got = suffix_dedup.dedup(make(rows).repartition(3), length=24, gram=8, hot=hot).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 24)


def test_long_texts_in_pieces(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    rows = documents(4)
    rows.append((100, "".join(t or "" for _, t in rows)))
    _, found, _ = suffix_dedup.covered(make(rows), length=24, gram=8)
    assert found.count()
    for _, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        places, *hashes = suffix_dedup.anchors(data, 24, 8)
        monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 19)
        whole = suffix_dedup.anchors(data, 24, 8)
        monkeypatch.setattr(suffix_dedup, "PIECE", 200)
        assert all((a == b).all() for a, b in zip((places, *hashes), whole, strict=True))
        if len(places):
            mask = suffix_dedup.removed_mask(data, places[::2].tolist(), [], 24, 8)
            monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 19)
            assert (suffix_dedup.removed_mask(data, places[::2].tolist(), [], 24, 8) == mask).all()
            monkeypatch.setattr(suffix_dedup, "PIECE", 200)


def test_odd_rows(make, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = suffix_dedup.dedup(make(odd_rows), keep_text=True, keep=["lang"]).collect()
    strip = [tuple(r)[:5] for r in got]
    assert sorted(strip, key=repr) == brute(rows, 100)
    assert suffix_dedup.dedup(make(odd_rows).limit(0)).count() == 0


def test_repeated_rows(make):
    text = "a sentence that is long enough to be of more than one hundred bytes, so that a second copy of it is removed as a whole"
    got = sorted(r.n_removed for r in suffix_dedup.dedup(make([(1, text), (1, text), (1, text), (2, text), (1, text + " x")])).collect())
    n = len(text)
    assert sum(got) in (4 * n, 3 * n + n)
    assert got.count(0) == 1


def test_many_rows_of_one_doc_id(make):
    """Null and repeated doc_ids in great numbers: as many near copies of texts that are long enough to repeat."""
    r = random.Random(9)
    texts = [" ".join(f"{r.randrange(10**6)}" for _ in range(20)) for _ in range(5000)]
    rows = [(None, t) for t in texts] + [(None, t + " x") for t in texts] + [(7, t + " y") for t in texts] + [(7, t) for t in texts[:2500]]
    got = suffix_dedup.dedup(make(rows).repartition(8)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(t.encode())
    total = sum(x.n_bytes - x.n_removed for x in got)
    whole = sum(map(size, texts))
    assert all(x.n_removed == 0 or x.n_removed >= 100 for x in got)
    # of each family one text stays whole, and of the others what follows the common part at most
    assert whole <= total <= whole + 4 * 2 * len(texts)
    assert all(x.n_bytes - x.n_removed <= 2 or x.doc_id is None for x in got)


def test_hash_collisions_are_seen(make, monkeypatch):
    """With a polynomial hash that makes all surroundings alike, the other hash and the bytes tell them apart."""
    monkeypatch.setattr(suffix_dedup.Hashes, "of", lambda self, begin, end: np.asarray(end - begin, np.uint64))
    data = np.frombuffer("".join(documents(5)[0][1] * 3 + "tail").encode(), np.uint8)
    p, g, a, check = suffix_dedup.anchors(data, 24, 8)
    inner = (p >= 16) & (p + 24 <= len(data))
    assert len(set(a[inner].tolist())) == 1
    assert len(set(check[inner].tolist())) == len({data[x - 16 : x + 24].tobytes() for x in p[inner].tolist()})
    rows = pa_batch([(1, 1, 5, 10, 0, 3), (1, 1, 5, 11, 0, 4), (1, 1, 6, 9, 0, 2), (2, 1, 5, 1, 1, 1)])
    assert [tuple(x.values()) for b in suffix_dedup._sift(iter([rows])) for x in b.to_pylist()] == [(1, 1, 10, 0, 3), (0, 1, 11, 0, 4), (1, 1, 9, 0, 2)]
    assert [tuple(x.values()) for b in suffix_dedup._sift(rows.slice(i, 1) for i in range(4)) for x in b.to_pylist()] == [(0, 1, 11, 0, 4), (1, 1, 10, 0, 3), (1, 1, 9, 0, 2)]


def pa_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["gram", "around", "check", "id", "h", "tp"])


def test_bytes_decide_in_the_sort(monkeypatch):
    """Suffixes that only a forced collision of hashes makes alike are not covered."""
    monkeypatch.setattr(suffix_dedup.Hashes, "of", lambda self, begin, end: np.zeros(len(begin), np.uint64))
    rows = [(1, 1, 0, 0, b"a" * 24, 0, 0, 1), (1, 2, 0, 0, b"b" * 24, 0, 0, 1), (1, 3, 0, 0, b"b" * 24, 0, 0, 1)]
    got, left = suffix_dedup.covered_windows(rows, 24)
    assert got == [(3, 0, 0, 0, 24)]
    assert [x[1] for x in left] == [1, 2]


def test_runs_of_a_large_bucket(make, monkeypatch):
    """One line that stands in many documents between other text: split buckets and runs of few rows give the same."""
    r = random.Random(11)
    line = "".join(r.choice("abcdefgh ") for _ in range(40))
    word = lambda: "".join(r.choice("rstuvwxyz") for _ in range(30))
    rows = [(i, word() + line + word()) for i in range(300)]
    want = brute(rows, 24)
    for hot, run in ((20_000, 300_000), (20_000, 500), (5, 500), (0, 100)):
        monkeypatch.setattr(suffix_dedup, "SORT", run)
        assert sorted(map(tuple, suffix_dedup.dedup(make(rows).repartition(6), length=24, gram=8, hot=hot).collect()), key=repr) == want


def test_rows_are_sorted_rather_than_each_suffix(monkeypatch):
    """A bucket is sorted once to each side of its anchor: the comparisons don't grow with the suffixes that a row holds."""
    compared = []
    extension = suffix_dedup.SuffixSort.extension
    monkeypatch.setattr(suffix_dedup.SuffixSort, "extension", lambda self, x, y: compared.append(len(x)) or extension(self, x, y))
    r = random.Random(3)
    sides = [bytes(r.choice(b"ab\0") for _ in range(16)) for _ in range(12)]
    sides += [x[: r.randrange(16)] + bytes(r.choice(b"ab\0") for _ in range(16)) for x in sides]
    rows = []
    for i in range(400):
        left, right = r.choice(sides)[:16][r.randrange(3) * 6 :], r.choice(sides)[:16][: 16 - r.randrange(3) * 5]
        n = len(left) + 8 + len(right)
        first = r.randrange(3)
        if n - 24 - first >= 0:
            rows.append((i // 150, i, 0, len(left), left + b"anchor__" + right, len(left), first, n - 24 - first + 1))
    got, left = suffix_dedup.covered_windows(rows, 24)
    seen, want, rest = set(), set(), []
    for row in rows:
        starts = range(row[6], row[6] + row[7])
        again = {s for s in starts if (row[0], row[5] - s, row[4][s : s + 24]) in seen}
        seen |= {(row[0], row[5] - s, row[4][s : s + 24]) for s in starts}
        want |= {(row[1], s) for s in again}
        rest += [row] * (len(again) < row[7])
    assert {(doc, s) for doc, _, _, a, b in got for s in range(a, b - 24 + 1)} == want
    assert left == rest
    suffixes = sum(row[7] for row in rows)
    assert sum(compared) < 8 * suffixes  # 17 times as many when each suffix was sorted


def test_short_texts_are_hashed_together(monkeypatch):
    made = []
    init = suffix_dedup.Hashes.__init__
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (*range(20, 60), 0, 299, 300, 301, 900, 24, 23, 1, 100, 25)]
    texts += [texts[5], b"a" * 200, b"ab" * 40]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    monkeypatch.setattr(suffix_dedup.Hashes, "__init__", lambda self, data: made.append(len(data)) or init(self, data))
    which, *got = suffix_dedup.anchors_of(texts, 24, 8)
    assert len(made) < len(texts) // 2
    want = [suffix_dedup.anchors(np.frombuffer(x, np.uint8), 24, 8) for x in texts]
    assert which.tolist() == [i for i, x in enumerate(want) for _ in x[0]]
    assert all(a.tolist() == np.concatenate(b).tolist() for a, b in zip(got, zip(*want, strict=True), strict=True))
    assert [len(x) for x in suffix_dedup.anchors_of([], 24, 8)] == [0] * 5
