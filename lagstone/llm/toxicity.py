"""Operator 9: toxicity by a subsequence string-kernel machine with Nystroem landmarks.

The kernel of two words is the gap-weighted subsequence kernel: each subsequence of three characters counts with ``DECAY`` to the power
of the span that it takes in either word, spans up to five; it is normalised by the words' own kernels.  So a word with inserted
characters, or an insult's stem in a longer word, stays close to the insult.  A support vector machine in the space that a set of
landmark words spans (Nystroem) is trained on labelled sentences: a sentence scores as its highest word does, every sentence of a
clean document is negative, and of a toxic one at least the highest is positive.

The decision is linear in the kernels to the landmarks, and these in the subsequences, so it is one weight per subsequence: an array
of 2 ** 18 floats, which is broadcast.  Whole texts are scored; each distinct word of a batch is evaluated once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

DECAY = 0.7
#: Offsets of the second and third character of a subsequence.
GAPS = [(j, k) for k in range(2, 5) for j in range(1, k)]
#: Letters of a word evaluated at a time; longer ones are cut into overlapping pieces of this size.
WIDTH, STRIDE = 32, 24
LANDMARKS = 128
#: Bounds of the training sample: labelled documents of either class, taken in the order of a hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: Characters of a labelled document in the sample; all are scored, whatever their length.
CHARS = 50_000
FOLDS = 5
ROUNDS = 3

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
# Characters that commonly stand for letters.
_LOOKS = str.maketrans("013457@$", "oieastas")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, and the joined runs of three or more single characters (spaced-out words)."""
    words = text.lower().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    single = sizes == 1
    if len(words) > 2 and (single[2:] & single[1:-1] & single[:-2]).any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        words += ["".join(words[a:b]) for a, b in edges.reshape(-1, 2).tolist() if b - a > 2]
    return words


def _pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of each word's pieces (0: none), and the word of each piece."""
    rows, owner = [], []
    for i, w in enumerate(words):
        w = _EDGE.sub("", w)
        if not w.isalpha():
            w = w.translate(_LOOKS)
        for at in range(0, max(1, len(w) - (WIDTH - STRIDE)), STRIDE):
            rows.append(w[at : at + WIDTH])
            owner.append(i)
    data = np.frombuffer("".join(r.ljust(WIDTH, "\0") for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    low = np.where((data >= 97) & (data < 123), data - 96, np.where(data < 128, 27 + data % 5, 32 + data % 32))
    return np.where(data == 0, 0, low).astype(np.int32), np.array(owner, np.int64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (-1: none) and weights of the subsequences of each piece, scaled to length 1, and the word of each piece."""
    c, owner = _pieces(words)
    codes, weights = [], []
    for j, k in GAPS:
        a, b, d = c[:, : WIDTH - k], c[:, j : WIDTH - k + j], c[:, k:]
        codes.append(np.where(d > 0, (a << 12) | (b << 6) | d, -1))
        weights.append(np.full(a.shape, DECAY ** (k + 1), np.float32))
    codes, weights = np.concatenate(codes, axis=1), np.concatenate(weights, axis=1)
    order = np.argsort(codes, axis=1, kind="stable")
    codes, weights = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    weights[codes < 0] = 0
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    group = np.cumsum(first.ravel()) - 1
    sums = np.bincount(group, weights.ravel())
    norm = np.sqrt(np.add.reduceat(np.where(first.ravel(), sums[group] ** 2, 0), np.arange(0, codes.size, codes.shape[1]))) if len(codes) else np.zeros(0)
    return codes, (weights / np.maximum(norm, 1e-9)[:, None]).astype(np.float32), owner


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised subsequence kernel of each word (the highest of its pieces) with each landmark."""
    codes, weights, at = subsequences(landmarks)
    used = np.unique(codes[codes >= 0])
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (np.where(codes >= 0, np.searchsorted(used, codes), len(used)), at[:, None]), np.where(codes >= 0, weights, 0))
    dense[-1] = 0
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i in range(0, len(words), 512):
        codes, weights, owner = subsequences(words[i : i + 512])
        pos = np.minimum(np.searchsorted(used, codes), len(used) - 1)
        hit = used[pos] == codes
        rows, cols = np.nonzero(hit)
        part = np.zeros((len(codes), len(landmarks)), np.float32)
        np.add.at(part, rows, dense[pos[rows, cols]] * weights[rows, cols][:, None])
        np.maximum.at(out, i + owner, part)
    return out


class Model:
    """One weight per subsequence, the bias, and the two parameters that turn a margin into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf)
        for i in range(0, len(words), 2048):
            codes, weights, owner = subsequences(words[i : i + 2048])
            np.maximum.at(out, i + owner, (self.weights[np.maximum(codes, 0)] * weights).sum(axis=1))
        return np.maximum(out, 0 if not len(words) else out) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(margin) + self.shift, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-loss linear support vector machine, by Newton steps in the primal; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active]
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-3
        new = np.linalg.solve(ridge + (za * ca[:, None]).T @ za, (za * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _landmarks(positive: Counter, negative: list[str], n: int) -> list[str]:
    """Frequent positive words, each not too near those taken, and some negative ones."""
    words = [w for w, _ in positive.most_common(1500)]
    taken: list[str] = []
    if words:
        k = kernel(words, words)
        near = np.zeros(len(words))
        for i in range(len(words)):
            if near[i] < 0.8 and len(taken) < n * 3 // 4:
                taken.append(words[i])
                near = np.maximum(near, k[:, i])
    return taken + [w for w in negative if w not in positive][: n - len(taken)]


def train(bags: list[tuple[int, list[list[str]]]]) -> Model:
    """From (label, sentences) of documents, each sentence a list of words.

    Without examples of both classes the model gives every text a probability under one half.
    """
    bags = [(y, [s for s in x if s]) for y, x in bags]
    toxic, clean = [x for y, x in bags if y and x], [x for y, x in bags if not y and x]
    if not toxic or not clean:
        return Model(np.zeros(1 << 18), -1.0, 1.0, -1.0)
    grams: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y, group in ((0, clean), (1, toxic)):
        for doc in group:
            grams[y].update({w[i : i + 4] for s in doc for w in s for i in range(max(1, len(w) - 3))})
    odds = {g: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((grams[0][g] + 0.5) / (len(clean) + 1)) for g, n in grams[1].items() if n > 1}
    odds = {g: v * np.sqrt(grams[1][g]) for g, v in odds.items()}
    start = {w: max((odds.get(w[i : i + 4], -1.0) for i in range(max(1, len(w) - 3))), default=-1.0) for doc in toxic for s in doc for w in s}
    negatives = Counter(w for doc in clean for w in {w for s in doc for w in s})
    rng = np.random.default_rng(7)
    common_words = [w for w, _ in negatives.most_common(200)]
    pool = list(negatives)
    sample = [pool[i] for i in rng.permutation(len(pool))[:20_000]]
    hard: list[str] = []
    score = start
    model = None
    for _ in range(ROUNDS):
        # the highest sentence of each toxic document, and in it the highest word
        best = [max((max((score[w], w) for w in s) for s in doc)) for doc in toxic]
        floor = 0.0 if model is None else -0.5
        positive = Counter(w for v, w in best if v > floor)
        if not positive:
            break
        negative = list(dict.fromkeys(common_words + hard + sample))[:24_000]
        negative = [w for w in negative if w not in positive]
        marks = _landmarks(positive, common_words + hard, LANDMARKS)
        kmm = kernel(marks, marks).astype(np.float64)
        values, vectors = np.linalg.eigh((kmm + kmm.T) / 2 + 1e-6 * np.eye(len(marks)))
        root = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
        words = list(positive) + negative
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        size = np.array([positive[w] for w in positive] + [1.0] * len(negative), float)
        cost = np.where(y > 0, 4.0 * np.sqrt(size), 2.0)
        w, bias = _svm(kernel(words, marks) @ root, y, cost)
        beta = root @ w
        codes, weights, at = subsequences(marks)
        flat = np.zeros(1 << 18)
        np.add.at(flat, np.maximum(codes, 0), weights * beta[at][:, None])
        flat[0] = 0
        model = Model(flat, bias)
        every = list(start)
        score = dict(zip(every, model.margins(every).tolist(), strict=True))
        m = model.margins(pool)
        hard = [pool[i] for i in np.argsort(-m)[:4000]]
    if model is None:
        return Model(np.zeros(1 << 18), -1.0, 1.0, -1.0)
    by_word = dict(zip(pool, model.margins(pool).tolist(), strict=True)) | score
    x = np.array([max(by_word[w] for s in doc for w in s) for doc in toxic + clean])
    t = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    slope, shift = 3.0, 0.0
    for _ in range(50):  # logistic regression of the label on the margin
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((t - p) * x).sum() - 0.01 * slope, (t - p).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum() + 0.01, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope + np.clip(step[0], -2, 2), shift + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.weights, model.bias, float(slope), float(shift))


_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")


def fit(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, chars: int = CHARS) -> Model:
    """Train on labelled documents outside the held-out fold: at most ``toxic_rows`` and ``clean_rows`` of either class, of at most ``chars``
    characters each, so what reaches the driver is bounded.

    Of rows with one doc_id the one with the least hash of its text is taken, and if labels of one doc_id differ it counts as toxic; rows
    without doc_id or label are not.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(fold != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    short = source.where(F.col("doc_id").isNotNull() & (F.length("text") <= chars)).groupBy("doc_id").agg(F.min("th").alias("th"))
    known = known.join(short, "doc_id")
    picked = known.where("toxic = 1").orderBy("draw", "doc_id").limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy("draw", "doc_id").limit(clean_rows))
    picked = common.stage(picked.select("doc_id", "th", "toxic"), "labelled")

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # distinct words of each sentence are all that training uses
            out = [[list(dict.fromkeys(words_of(s))) for s in _SENTENCE.split(t or "") if s.strip()] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.list_(pa.string())))], names=["doc_id", "toxic", "sentences"])

    rows = source.join(F.broadcast(picked), ["doc_id", "th"]).select("doc_id", "toxic", "text").dropDuplicates(["doc_id"])
    got = rows.mapInArrow(sentences, "doc_id long, toxic int, sentences array<array<string>>").toArrow().sort_by("doc_id")
    return train(list(zip(got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out boolean, score double and predicted int of every whole text, in one narrow pass.

    A null or empty text has no word and gets the least score; a null doc_id counts as text 'null' for the fold; repeated rows get
    repeated scores; other columns are ignored and are no inputs.
    """
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, margins = shared.value, {}
        for b in batches:
            texts = [words_of(t or "") for t in b.column(1).to_pylist()]
            words = {w for x in texts for w in x}
            local = {w: v for w in words if (v := margins.get(w)) is not None}
            new = [w for w in words if w not in local]
            found = dict(zip(new, model.margins(new).tolist(), strict=True))
            if len(margins) + len(found) > 400_000:
                margins.clear()
            margins.update(found)
            local |= found
            top = np.array([max(map(local.__getitem__, x), default=model.bias) for x in texts])
            p = model.probability(top) if len(top) else top
            ids = b.column(0).to_pylist()
            held = [zlib.crc32(("null" if i is None else str(i)).encode()) % FOLDS == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a machine trained on the labels outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    common.prepare(spark)
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
