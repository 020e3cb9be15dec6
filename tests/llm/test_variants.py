from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lagstone.llm import variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    words = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def brute(words):
    form, out = {}, []
    around = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), form[w] and words[form[w]]))
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcéÿZ") for _ in range(r.randint(6, 9))) for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(5, 40)):
            w = r.choice(base[: r.randint(1, 6)])
            k = r.randrange(len(w))
            words.append(r.choice([w, w, w, w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abéø") + w[k:], w[:k] + "Q" + w[k + 1 :]]))
        rows.append((i, r.choice([" ", "1", "×x ", "\n"]).join(words)))
    return rows


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize(("seed", "filters"), [(1, variants.FILTERS), (2, variants.FILTERS), (3, 100)])
def test_brute_force(make, odd_rows, seed, filters):
    """Also where the filters go in several rounds."""
    rows = [*odd_rows, *rows_of(seed)]
    want = brute(brute_counts(rows))
    assert got(variants.spelling_variants(make(rows), filters=filters)) == want
    assert any(x[1] for x in want)


def test_slices_bound_the_filters(make, spark):
    words = spark.createDataFrame([(f"abcdefg{chr(97 + i % 26)}{chr(97 + i // 26)}", 2) for i in range(600)], "word string, n long")
    vocabulary = variants.vocabulary_of(words)
    blocks, slices = variants._filters(vocabulary, 256)
    assert slices == 5 and sum(blocks.values()) * 64 <= 256 + 64
    # a filter has every word of its slice
    found = 0
    keys = variants._key(variants.word_hashes([w.word for w in words.collect()]), np.full(600, 9))
    for k in range(slices):
        filters = variants._filled(vocabulary, blocks, slices, k)
        own = keys[keys % np.uint64(slices) == np.uint64(k)]
        assert len(filters[9].maybe(own)) == len(own)
        found += len(own)
    assert found == 600


def test_filter_of_several_stretches(monkeypatch, spark):
    monkeypatch.setattr(variants, "_BLOCKS", 3)
    words = spark.createDataFrame([(f"abcdefg{chr(97 + i % 26)}{chr(97 + i // 26)}", 2) for i in range(600)], "word string, n long")
    vocabulary = variants.vocabulary_of(words)
    blocks, _ = variants._filters(vocabulary, 1 << 20)
    keys = variants._key(variants.word_hashes([w.word for w in words.collect()]), np.full(600, 9))
    want = variants.Filter(blocks[9])
    want.add(keys)
    assert blocks[9] > 6
    assert (variants._filled(vocabulary, blocks, 1, 0)[9].bits == want.bits).all()
    other = variants._key(np.arange(100_000, dtype=np.uint64), np.full(1, 9))
    assert len(want.maybe(other)) < 1000


@pytest.mark.parametrize("limit", [64, 1 << 17])
def test_edits_are_those_of_the_words(monkeypatch, limit):
    monkeypatch.setattr(variants, "EDITS", limit)
    words, alphabet = ["aabca", "zzzzz", "éabba"], np.array(sorted(map(ord, "abczé")), np.uint32)
    seen = set()
    for size, hashes, told in variants.edits(words, alphabet):
        hit = np.arange(len(hashes))
        for h, w, p, s in zip(hashes, *told(hit), strict=True):
            edit = words[w][:p] + (chr(s) if s else "") + words[w][p + 1 :]
            assert len(edit) == size and variants.word_hashes([edit])[0] == h
            assert (w, edit) not in seen
            seen.add((w, edit))
    for w, word in enumerate(words):
        want = {word[:i] + word[i + 1 :] for i in range(5)} | {word[:i] + c + word[i + 1 :] for i in range(5) for c in "abczé" if c > word[i]}
        assert {e for v, e in seen if v == w} == want


def test_long_words(make):
    """Words that are far longer than a piece of edits, and longer than the last filter's length."""
    r = random.Random(4)
    long = "".join(r.choice("abcde") for _ in range(3000))
    other = long[:1500] + ("b" if long[1500] == "a" else "a") + long[1501:]
    text = " ".join([long] * 20 + [other] * 2 + [long[:-1]] * 2 + ["x" * 70] * 2 + ["x" * 71] * 2 + ["x" * 69] * 2)
    assert got(variants.spelling_variants(make([(1, text)]))) == brute(brute_counts([(1, text)]))


def test_chains_of_forms(spark):
    rows = [("abcdefghij"[:7] + "k" * i, 10**i) for i in range(1, 9)]
    words = variants.vocabulary_of(spark.createDataFrame(rows, "word string, n long"))
    assert {x.root for x in variants.variants(words).collect()} == {rows[-1][0]}


def test_empty(make, spark):
    assert got(variants.spelling_variants(make([(1, "no long words"), (2, None)]))) == []
    assert got(variants.spelling_variants(make([(1, "x")]).where("doc_id < 0"))) == []
