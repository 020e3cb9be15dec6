from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lagstone.llm import decontaminate as dec


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in ids if x is not None}
        spans = [(k, next(e for e in range(k, len(w) + 1) if e not in hit)) for k in sorted(hit) if k - 1 not in hit]
        out.append((doc, len(w), len(hit), sorted(found), spans))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), [(s.begin, s.end) for s in r.spans]) for r in df.collect()), key=repr)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, row string, doc_id string")


def corpus(seed, n=80, pool=6, most=60):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice(["a", "B", "c", "é", "Σ", "7"][:pool]) + r.choice([" ", " ", ", ", "\n", "_"]) for _ in range(k))
    items = [(i, say(r.randint(0, 9))) for i in range(12)] + [(None, say(7)), (3, say(6)), (50, None), (51, ""), (52, " ._-")]
    rows = [(i, say(r.randint(0, most)) + r.choice(["", items[r.randrange(12)][1]]) + say(r.randint(0, 5))) for i in range(n)]
    return rows + rows[:5], items


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(1, 2 + seed, rng.integers(0, 60)) for _ in range(20)]
    docs += docs[:4]
    symbols = np.concatenate([np.append(d, 0) for d in docs])
    ends = np.flatnonzero(symbols == 0)
    apart = symbols * 1000
    apart[ends] = np.arange(len(ends))
    want = sorted(range(len(symbols)), key=lambda i: apart[i:].tolist())
    assert dec.suffix_order(symbols, ends).tolist() == want


@pytest.mark.parametrize(("seed", "kinds"), [(0, 1), (1, 3), (2, 40), (3, 300)])
def test_index_searches_and_locates(seed, kinds):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(1, kinds + 1, rng.integers(0, 80)) for _ in range(30)]
    symbols = np.concatenate([np.append(d, 0) for d in docs])
    index = dec.Index(*dec.Index.parts(symbols, np.flatnonzero(symbols == 0), kinds, 4))
    windows = np.full((60, 5), -1)
    lengths = rng.integers(1, 6, 60)
    for row, n in zip(windows, lengths, strict=True):
        at = rng.integers(0, len(symbols) - n)
        row[5 - n :] = symbols[at : at + n] if (symbols[at : at + n] > 0).all() else rng.integers(1, kinds + 1, n)
    which, low, high = index.search(windows, lengths)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
    for k, (row, n) in enumerate(zip(windows, lengths, strict=True)):
        want = [i for i in range(len(symbols) - n) if (symbols[i : i + n] == row[5 - n :]).all()]
        assert found.get(k, []) == want
    assert found


def test_bits():
    bits = np.random.default_rng(1).integers(0, 2, 1003).astype(bool)
    b = dec.Bits(dec.Bits.pack(bits))
    i = np.arange(1004)
    assert b.rank(i).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert (b.get(i[:-1]) == bits).all()


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"shard": 40, "sample": 3}), (3, {"block": 7}), (4, {"shard": 25, "block_bytes": 60, "sample": 1})])
def test_brute_force(make, spark, odd_rows, seed, limits):
    """Also where documents are cut over shards, and windows go in several blocks."""
    rows, items = corpus(seed)
    rows = [*odd_rows, *rows] if "shard" not in limits else [*[x for x in odd_rows if len(x[1] or "") < 1000], *rows]
    items = [*items, (60, "did not the cat sat"), (61, "日本語"), (62, "twice the same row")]
    want = brute(rows, items, 5)
    assert got(dec.decontaminate(make(rows), benchmark(spark, items), window=5, **limits)) == want
    assert any(x[2] for x in want) and any(len(x[3]) > 1 for x in want)


def test_long_document_is_cut(make, spark):
    """One document of many shards: windows at every cut are found."""
    text = " ".join(f"w{i}" for i in range(500))
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 5))) for i in range(0, 490, 7)]
    docs = make([(1, text), (2, "w1 w2")])
    indexes = dec.index_documents(docs, longest=5, shard=60)
    assert indexes.count() > 8
    assert max(sum(d["words"] for d in r.docs) for r in indexes.collect()) <= 60
    assert got(dec.decontaminate(docs, benchmark(spark, items), window=5, shard=60)) == brute([(1, text), (2, "w1 w2")], items, 5)


def test_index_is_searched_again(make, spark):
    """One table of indexes serves several benchmarks."""
    indexes = dec.index_documents(make([(1, "the cat sat on the mat"), (2, "a cat sat")]))
    for text, rows in [("cat sat", 2), ("sat on", 1), ("dog", 0)]:
        assert dec.search(indexes, dec.windows_of(benchmark(spark, [(1, text)]))).count() == rows


def test_shared_words_of_items(make, spark):
    """A window of very many items, and copies of one document."""
    items = [(i, "one two three four five six") for i in range(3000)]
    rows = [(i, "zero one two three four five six seven") for i in range(40)]
    found = dec.decontaminate(make(rows), benchmark(spark, items), window=5, block=1000).collect()
    assert {(r.n_hit, len(r["items"])) for r in found} == {(6, 3000)}


def test_empty(make, spark):
    none = make([(1, "x")]).where("doc_id < 0")
    assert got(dec.decontaminate(none, benchmark(spark, [(1, "a b c")]))) == []
    assert got(dec.decontaminate(make([(1, "a b c"), (None, None)]), benchmark(spark, []))) == [(1, 3, 0, [], []), (None, 0, 0, [], [])]
    assert got(dec.decontaminate(none, benchmark(spark, []))) == []
