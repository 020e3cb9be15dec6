from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lagstone.llm import toxicity


def brute_kernel(s, t):
    """All subsequences of three characters with spans up to five, weighted by the decay to the power of the span."""

    def features(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(i + 5, len(w))):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b.get(k, 0) for k, v in a.items()) / norm if norm else 0.0


def test_kernel():
    words = ["idiot", "id.iot", "i-d-i-o-t", "idiotic", "aaaa", "banana", "table", "it", "xyz", "lowei", "loweischaft"]
    plain = ["idiot", "idiot", "idiot", "idiotic", "aaaa", "banana", "table"]
    got = toxicity.kernel(plain, plain)
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert abs(got[i, j] - brute_kernel(a, b)) < 1e-5
    k = dict(zip(words, toxicity.kernel(words, ["idiot"])[:, 0], strict=True))
    assert k["idiot"] > 0.999
    assert min(k["id.iot"], k["i-d-i-o-t"], k["idiotic"]) > 2 * max(k["table"], k["banana"], 0.01)
    assert k["it"] == 0


def test_words():
    assert toxicity.words_of("You I D I O T now") == ["you", "i", "d", "i", "o", "t", "now", "idiot"]
    assert toxicity.words_of("") == []


@pytest.fixture
def labelled(make, spark):
    r = random.Random(3)
    syllables = ["the", "re", "ing", "on", "at", "ou", "st", "an", "ble", "nd"]
    bad = ["idiot", "worthless", "scum", "moron"]

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(r.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                b = r.choice(bad)
                k = r.randrange(1, len(b))
                words.insert(r.randrange(len(words)), b if i % 8 else b[:k] + r.choice(".*-") + b[k:])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 4 == 0)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out(labelled):
    docs, labels, truth = labelled
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_labels_of_the_held_out_fold_are_not_used(labelled, spark):
    docs, labels, truth = labelled
    lies = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in truth.items()], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, lies)
    assert (a.weights == b.weights).all()
    assert (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_odd_rows(labelled, make, odd_rows):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score(make(odd_rows), model).collect()
    assert len(got) == len(odd_rows)
    assert {r.predicted for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert toxicity.score(make(odd_rows).limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(make(odd_rows), nothing).collect()} == {0}
    long_word = "x" * 500 + "worthless" + "y" * 500
    assert toxicity.kernel([long_word], ["worthless"])[0, 0] > 0.02


def test_against_brute_force(monkeypatch):
    """The projection on landmarks, the machine and the margins, straight from the formulas."""
    r = random.Random(21)
    syllables = ["the", "re", "ing", "on", "at", "ou", "st", "an", "ble", "nd"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    bags = [(int(i % 3 == 0), [[word() for _ in range(8)] + [r.choice(["idiot", "idi-ot", "worthless", "scum"])] * (i % 3 == 0)]) for i in range(90)]
    seen = {}
    for name in ("_landmarks", "_svm"):
        def record(*args, f=getattr(toxicity, name), name=name):
            seen[name] = (args, f(*args))
            return seen[name][1]

        monkeypatch.setattr(toxicity, name, record)
    model = toxicity.train(bags)
    marks, ((z, y, cost), (w, bias)) = seen["_landmarks"][1], seen["_svm"]
    brute = lambda xs, ys: np.array([[brute_kernel(a, b) for b in ys] for a in xs])
    # Nystroem: inner products of projections are K K_mm^-1 K', with the small directions of K_mm left out
    values, vectors = np.linalg.eigh(brute(marks, marks) + 1e-6 * np.eye(len(marks)))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    tests = ["theing", "onatou", "bleand", "stanre", "idiot", "worthless", "scumon"]
    shown = brute(tests, marks) @ root
    words = seen["_landmarks"][0]
    assert len(words[0]) + 1 < len(y)
    # the machine: the gradient of half the squared norm plus the costs of squared hinge losses is zero
    f = z @ w + bias
    slack = np.maximum(0, 1 - y * f)
    assert np.abs(w - z.T @ (cost * y * slack)).max() < 1e-3
    assert abs(1e-3 * bias - (cost * y * slack).sum()) < 1e-3
    assert abs(np.linalg.norm(z, axis=1).max()) < 1.01
    # the margin of a word: its kernel with each landmark, projected, times the machine's weights
    assert np.allclose(model.margins(tests), shown @ _aligned(root, marks) @ w + bias, atol=2e-3)


def _aligned(root, marks):
    """From the projection of these formulas to the operator's, whose directions may be turned or mirrored."""
    k = toxicity.kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh((k + k.T) / 2 + 1e-6 * np.eye(len(marks)))
    own = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    return np.linalg.lstsq(k @ root, k @ own, rcond=None)[0]


def test_scores_are_of_the_highest_word(make):
    model = toxicity.train([(i % 2, [["the", "onatou", "idiot" if i % 2 else "bleand"]]) for i in range(40)])
    texts = ["the onatou", "an idiot there", "", "id.iot", None, "bleand " * 50]
    got = {x.doc_id: x for x in toxicity.score(make(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        margins = [model.margins([w])[0] for w in toxicity.words_of(t or "")]
        want = model.probability(np.array([max(margins, default=model.bias)]))[0]
        assert abs(got[i].score - want) < 1e-6
        assert got[i].predicted == int(want >= 0.5)


def test_the_sample_is_bounded(spark, make, monkeypatch):
    """Repeated doc_ids and very long texts don't reach the driver."""
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda bags: taken.append(bags))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], f"other {k}") for k in range(3000)] + [(ids[1], "same")] * 50 + [(ids[2], "long " * 100)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1)], "doc_id long, toxic int")
    toxicity.fit(make(rows), labels, chars=100)
    toxicity.fit(make(rows).repartition(7), labels, chars=100)
    assert len(taken[0]) == len(ids)
    assert taken[0] == taken[1]
