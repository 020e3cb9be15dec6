from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter
from functools import lru_cache
from unittest.mock import MagicMock

import pyarrow as pa
import pytest

from lagstone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_features():
    r = random.Random(1)
    pool = ["a", "b", "c", " ", " ", "\n", "\t", "é", "#", "|", "ab", "\x0b", "\x1c", " ", "日", "🎉"]
    for _ in range(500):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 80)))
        assert quality.base_features(t) == brute_features(t), repr(t)


def brute_model(texts):
    """Modified Kneser-Ney over padded characters, straight from the formulas."""
    n = quality.ORDER
    counts = {n: Counter()}
    for t in texts:
        x = chr(quality.PAD) * (n - 1) + t
        counts[n].update(x[i : i + n] for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        of = Counter(min(v, 5) for v in c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else None
        discounts[k] = [max(0.05, min(j - (j + 1) * y * of[j + 1] / of[j] if y is not None and of[j] else 0.5 * j, 0.95 * j)) for j in (1, 2, 3)]

    contexts = {k: {} for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            total, mass = contexts[k].get(g[:-1], (0, 0.0))
            contexts[k][g[:-1]] = (total + v, mass + discounts[k][min(v, 3) - 1])

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, v = len(g), counts[len(g)][g]
        total, mass = contexts[k].get(g[:-1], (0, 0.0))
        if not total:
            return p(g[1:])
        return (v - (discounts[k][min(v, 3) - 1] if v else 0)) / total + mass / total * p(g[1:])

    return p, counts


@pytest.fixture
def corpus():
    r = random.Random(4)
    words = ["the", "reason", "singing", "onwards", "attic", "outside", "stones", "another", "morning", "river", "kitchen", "table"]
    return [" ".join(r.choice(words) for _ in range(80)) + "." for _ in range(40)]


def log_likelihoods(make, model, texts, **how):
    docs = make(list(enumerate(texts)))
    rows = quality.score(docs, quality.values(quality.count_ngrams(docs), model), ["doc_id"], **how).collect()
    return [-r.log_ppl * len(texts[r.doc_id]) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("frequent", [0, 300, 1 << 20])
def test_model(spark, make, corpus, frequent):
    docs = make([(i, t) for i, t in enumerate(corpus)])
    model = quality.fit(docs.select("text", "lang"))
    p, counts = brute_model(corpus)
    seen = sorted(set("".join(corpus)))
    assert abs(sum(p("the " + c) for c in seen) - 1) < 0.02
    tests = [corpus[0], corpus[3][:7], "the zebra", "e", "QQ"]
    got = log_likelihoods(make, model, tests, frequent=frequent)
    for t, x in zip(tests, got, strict=True):
        padded = chr(quality.PAD) * (quality.ORDER - 1) + t
        assert math.isclose(x, sum(math.log(p(padded[i : i + quality.ORDER])) for i in range(len(t))), rel_tol=1e-4), t


def test_values_of_the_corpus(make, corpus):
    docs = make([(i, t) for i, t in enumerate(corpus)])
    model = quality.fit(docs.select("text", "lang"))
    assert {tuple(r) for r in quality.values(quality.count_ngrams(docs), model).collect()} == {(r.lang, r.gram, r.n, round(math.log(r.p) * quality.SCALE)) for r in model.probability[quality.ORDER].collect()}


def test_long_texts_in_segments(monkeypatch, spark, make, corpus):
    model = quality.fit(make([(i, t) for i, t in enumerate(corpus)]).select("text", "lang"))
    whole = log_likelihoods(make, model, corpus[:3])
    monkeypatch.setattr(quality, "SEGMENT", 50)
    assert log_likelihoods(make, model, corpus[:3]) == whole


def test_the_bound_does_not_show(make, corpus, odd_rows):
    """No n-gram is left out: broadcast or joined, the verdicts are the same, and so they are with a reference of the same texts."""
    docs = make([(100 + i, t, "en" if i % 3 else "fr") for i, t in enumerate(corpus)] + odd_rows)
    want = sorted(map(tuple, quality.quality(docs).collect()), key=repr)
    for frequent in (0, 50, 1000):
        assert sorted(map(tuple, quality.quality(docs, frequent=frequent).collect()), key=repr) == want
    assert sorted(map(tuple, quality.quality(docs, reference=docs).collect()), key=repr) == want


def test_verdicts(spark, make, corpus, odd_rows):
    r = random.Random(6)  # a text that its own counts make likely, and yet not as likely as the others
    noise = ["".join(r.choice("qxzjvkw#€ß") for _ in range(12)) for _ in range(120)]
    rows = [(100 + i, t) for i, t in enumerate(corpus)] + [(1000, " ".join(noise)), (1001, " ".join(corpus)), (1002, "the same words " * 40)] + odd_rows
    got = {r.doc_id: r for r in quality.quality(make(rows)).collect()}
    assert all(got[100 + i].kept for i in range(len(corpus)))
    assert got[1000].base_failed is False
    assert got[1000].kept is False
    assert got[1000].log_ppl > got[1000].high
    assert got[1002].base_failed
    assert got[2].base_failed
    assert got[2].log_ppl is None
    assert got[2].kept is False
    for doc, text, *_ in rows:
        if doc is not None:
            assert tuple(got[doc])[1:6] == brute_features(text or "")
    assert quality.quality(make(rows)).count() == len(rows)
    assert quality.quality(make(rows).limit(0)).count() == 0


def test_bands_reject_symbols_and_menus(spark, make):
    r = random.Random(8)
    syllables = ["the", "rea", "son", "sing", "ing", "on", "wards", "at", "tic", "out", "side", "sto", "nes", "mor", "ri", "ver", "kit", "chen", "ta", "ble"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(400)]
    clean = [" ".join(r.choice(words) for _ in range(60 * 2 ** (i % 4) + r.randint(0, 40))) + "." for i in range(600)]
    symbols = [" ".join(r.choice(words) + r.choice(["&&&", "%%%", "***", "$$$", "###"]) for _ in range(300)) for _ in range(12)]
    menus = [" | ".join("".join(r.choices(syllables, k=3)).title() for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, t) for i, t in enumerate(symbols + menus)]
    got = {x.doc_id: x for x in quality.quality(make(rows)).collect()}
    assert not any(x.base_failed for x in got.values())
    assert sum(got[i].kept for i in range(600)) >= 594
    assert not any(x.kept for i, x in got.items() if i >= 1000)
    assert all(x.high - x.low < 0.5 for x in got.values())


def test_bands_of_equal_texts(spark, make, corpus):
    got = quality.quality(make([(i, corpus[0]) for i in range(5)])).collect()
    assert all(x.kept for x in got)


def middle(x):
    """The element in the middle, the lower of two; none of nothing."""
    return sorted(x)[(len(x) + 1) // 2 - 1] if x else None


def brute_kept(rows):
    """Whether each of (doc_id, text, lang) is kept: base rules, a model per language and bands, straight from the definitions."""
    models = {}
    for lang in {r[2] for r in rows}:
        p, _ = brute_model([r[1] or "" for r in rows if r[2] == lang])
        models[lang] = lru_cache(None)(lambda g, p=p: round(math.log(p(g)) * quality.SCALE))
    good = {}
    for i, (_, text, lang) in enumerate(rows):
        n, *_, repeats = brute_features(text or "")
        if n >= 50 and 100 * repeats <= 50 * n:
            padded = chr(quality.PAD) * (quality.ORDER - 1) + text
            good[i] = (lang, len(text).bit_length(), -sum(models[lang](padded[j : j + quality.ORDER]) for j in range(len(text))) / quality.SCALE / len(text))

    def sides(group):
        mid = middle([x for _, _, x in group])
        off = [(x - mid, k) for _, k, x in group]
        out = {"mid": mid, "n": len(group)}
        for name, sign in (("up", 1), ("down", -1)):
            out[name] = middle([sign * d for d, _ in off if sign * d > 0])
            out["scaled_" + name] = middle([sign * d * 2 ** (k / 2) for d, k in off if sign * d > 0])
        return out

    def width(own, whole, side, k):
        found = own[side] if own["n"] >= quality.CLASS_DOCS else None
        for x in (side, "down" if side == "up" else "up"):
            if found is None and whole[x] is not None:
                found = max(whole[x], whole["scaled_" + x] * 2 ** (-k / 2))
        return quality.LEAST if found is None else quality.BAND * found

    kept = []
    for i in range(len(rows)):
        if i in good:
            lang, k, x = good[i]
            own, whole = (sides([g for g in good.values() if g[0] == lang and size in (g[1], None)]) for size in (k, None))
            mid = own["mid"] if own["n"] >= quality.CLASS_DOCS else whole["mid"]
            kept.append(mid - width(own, whole, "down", k) <= x <= mid + width(own, whole, "up", k))
        else:
            kept.append(False)
    return kept


def test_verdicts_against_brute_force(make, corpus, odd_rows):
    r = random.Random(16)
    words = " ".join(corpus).split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([55, 70, 130]))), r.choice(["en", "fr"])) for i in range(160)]
    rows += [(500 + i, " ".join(r.choice(words) + "%%" * (i % 4) for _ in range(80)), "en") for i in range(12)] + [(600, "qzx vvk " * 30 + " ".join(words[:80]), "fr")]
    rows += [(None if x[0] is None else 1000 + x[0], x[1], x[2] if len(x) > 2 else "en") for x in odd_rows]
    want = brute_kept(rows)
    got = quality.quality(make(rows)).collect()
    assert sorted(((x.doc_id, x.kept) for x in got), key=repr) == sorted(((x[0], k) for x, k in zip(rows, want, strict=True)), key=repr)
    assert not all(k for x, k in zip(rows, want, strict=True) if len(brute_features(x[1] or "")) and brute_features(x[1] or "")[0] >= 50)


def test_memory_of_counting(spark):
    """Millions of n-grams, of which few are distinct, are counted in bounded memory."""
    docs = MagicMock()
    quality.count_ngrams(docs)
    run = docs.select.return_value.mapInArrow.call_args[0][0]
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijkl", k=150_000)) for _ in range(28)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 7]), pa.array(["en"] * 7)], names=["text", "lang"]) for k in range(0, 28, 7)]
    got = Counter()
    tracemalloc.start()
    try:
        for b in run(iter(batches)):
            got.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
            if tracemalloc.is_tracing():
                peak = tracemalloc.get_traced_memory()[1]
                tracemalloc.stop()
    finally:
        tracemalloc.stop()
    padded = [chr(quality.PAD) * (quality.ORDER - 1) + t for t in texts]
    assert got == Counter(t[i : i + quality.ORDER].encode() for t in padded for i in range(len(t) - quality.ORDER + 1))
    assert peak < 180 << 20
