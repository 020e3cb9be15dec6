"""Operator 3: quality rules with n-gram perplexity.

A character 5-gram model with modified Kneser-Ney smoothing is counted by Spark over all documents, one per language: raw counts for
whole n-grams, counts of distinct left neighbours for shorter ones, three discounts for each order.  Probabilities are joined per
distinct n-gram, with back-off where a text brings n-grams that the model lacks.  To score texts, the log probabilities of the most
frequent n-grams, a fixed number of them, are stored as two arrays, sorted 64-bit hashes and values, and broadcast; all the others are
joined by a shuffle on the n-gram itself.  Together that is exact, no n-gram is left out however large the corpus, and values are
whole numbers (millionths of a nat), so neither the bound nor the order of sums shows in a result.

A document is rejected if its log perplexity lies outside the band of its language and length.  Short texts scatter far more than long
ones, so a length class is a power of two of characters.  A band reaches from the median up by a multiple of the median deviation of
those above it, and down by that of those below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

ORDER = 5
#: N-grams whose values are broadcast (24 MB at this bound).
FREQUENT = 1 << 21
#: Values are whole multiples of a nat over this.
SCALE = 1_000_000
#: The probability of a character in a language that the model lacks.
UNKNOWN = 2.0**-20
#: Characters worked on at a time.
SEGMENT = 1 << 19
#: Distinct n-grams that a task gathers before it passes them on, and how many more wait to be merged with them.
GATHER, WAITING = 1 << 20, 1 << 19
#: Stands before the first character of a text.
PAD = 2
#: Width of the band on either side, in median deviations of that side; in nats per character only where no text of the language deviates.
BAND, LEAST = 5.0, 0.25
#: Documents with which a length class has a band of its own; the language's, scaled to the length, is taken for smaller ones.
CLASS_DOCS = 50

_M = np.uint64(0x9E3779B97F4A7C15)
# White space between words, and the characters counted as symbols.
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    n = len(words)
    repeats = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        h = (h[:-2] * _M + h[1:-1]) * _M + h[2:]
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            found = np.isin(h, twice)
            marks = np.zeros(n + 1, np.int8)
            for k in range(3):
                marks[k : k + n - 2] |= found
            repeats = int(marks.sum())
    return n, len(text) - (len(data) - len(data.translate(None, SPACE))), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


def _seed(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang or "").encode() + b"\0" * (lang is None), digest_size=8).digest(), "little")


def _layout(texts: list[str], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array of code points, each after ORDER - 1 pads; where each begins; its language's seed."""
    parts, starts, at = [], [], 0
    pads = np.full(ORDER - 1, PAD, np.uint32)
    for t in texts:
        x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [pads, x]
        at += ORDER - 1
        starts.append(at)
        at += len(x)
    seeds = np.array([_seed(x) for x in langs], np.uint64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(starts, np.int64), seeds


def _segments(texts: list[str], langs: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points with ORDER - 1 before the first position, the n-gram's hash by position, each position's text, positions of text."""
    codes, starts, seeds = _layout(texts, langs)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + ORDER - 1)
    inside = np.ones(len(codes), bool)
    for k in range(1, ORDER):
        inside[starts - k] = False
    for at in range(0, len(codes), SEGMENT):
        begin, end = max(at - ORDER + 1, 0), min(at + SEGMENT, len(codes))
        c = np.concatenate([np.full(ORDER - 1 - (at - begin), PAD, np.uint32), codes[begin:end]])
        m = end - at
        x = c.astype(np.uint64)
        with np.errstate(over="ignore"):
            h, power = seeds[owner[at:end]], np.uint64(1)
            for n in range(ORDER):
                h = h + (x[ORDER - 1 - n : ORDER - 1 - n + m] + np.uint64(1)) * power
                power = power * _M
        yield c, h, owner[at:end], np.flatnonzero(inside[at:end])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array.  The list is emptied, so they don't stand beside it while it is worked on."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, gram (ORDER characters, pads included) and n over all whole texts; partial counts are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, str | None] = {}
        keys, counts, grams, seeds = [], [], [], []

        def merge() -> None:
            if len(keys) > 1:
                u, first, inv = np.unique(_joined(keys), return_index=True, return_inverse=True)
                keys[:], counts[:] = [u], [np.bincount(inv, _joined(counts), len(u)).astype(np.int64)]
                del inv
                grams[:] = [_joined(grams)[first]]
                seeds[:] = [_joined(seeds)[first]]

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                merge()
                for at in range(0, len(keys[0]), 50_000):
                    g = np.ascontiguousarray(grams[0][at : at + 50_000]).astype("<u4")
                    text = g.tobytes().decode("utf-32-le", "surrogatepass")
                    rows = [text[i : i + ORDER].encode("utf-8", "surrogatepass") for i in range(0, len(text), ORDER)]
                    langs = [names[s] for s in seeds[0][at : at + 50_000].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary()), pa.array(counts[0][at : at + 50_000], pa.int64())], names=["lang", "gram", "n"])
                keys.clear(), counts.clear(), grams.clear(), seeds.clear()

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            names.update({_seed(x): x for x in set(langs)})
            own = np.array([_seed(x) for x in langs], np.uint64)
            for c, h, owner, at in _segments(texts, langs):
                if len(at):
                    u, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    where = at[first]
                    keys.append(u)
                    counts.append(n)
                    grams.append(np.stack([c[where + k] for k in range(ORDER)], axis=1))
                    seeds.append(own[owner[where]])
            if sum(map(len, keys[1:])) > WAITING:
                merge()
                if len(keys[0]) > GATHER:
                    yield from out()
        yield from out()

    counted = docs.select("text", "lang").mapInArrow(common.lean(run), "lang string, gram binary, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", F.col("gram").cast("string").alias("gram"), "n")


def _smooth(grams: DataFrame, order: int, lower: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probabilities (lang, gram, n, p) of one order and weights (lang, context, n, gamma), from counts and the next lower order."""
    few = [F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    stats = grams.groupBy("lang").agg(*few)

    def discount(k: int) -> F.Column:
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.greatest(F.lit(0.05), F.least(F.coalesce(d, F.lit(0.5 * k)), F.lit(0.95 * k))).alias(f"d{k}")

    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    stats = stats.select("lang", discount(1), discount(2), discount(3))
    grams = grams.withColumn("context", F.substring("gram", 1, order - 1)).join(stats, grams.lang.eqNullSafe(stats.lang)).drop(stats.lang)
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = grams.withColumn("taken", taken)
    contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("mass"))
    contexts = contexts.select(F.col("lang").alias("clang"), F.col("context").alias("ccontext"), "total", (F.col("mass") / F.col("total")).alias("gamma"))
    low = lower.select(F.col("lang").alias("llang"), F.col("gram").alias("suffix"), F.col("p").alias("plow"))
    p = (
        grams.join(contexts, grams.lang.eqNullSafe(contexts.clang) & (grams.context == contexts.ccontext))
        .join(low, F.col("lang").eqNullSafe(F.col("llang")) & (F.substring("gram", 2, order - 1) == F.col("suffix")))
        .select("lang", "gram", "n", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("gamma") * F.col("plow")).alias("p"))
    )
    return p, contexts.select(F.col("clang").alias("lang"), F.col("ccontext").alias("gram"), F.col("total").alias("n"), F.col("gamma").alias("p"))


class Model(NamedTuple):
    """By order, ``probability``: lang, gram, n and p; by length of the context, ``weight``: lang, gram and the back-off weight p."""

    probability: dict[int, DataFrame]
    weight: dict[int, DataFrame]


def fit(docs: DataFrame) -> Model:
    """The model of all documents, as tables in the shared folder that grow with the corpus."""
    counts = {ORDER: common.stage(count_ngrams(docs), "ngrams")}
    for n in range(ORDER - 1, 0, -1):
        shorter = counts[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        counts[n] = common.stage(shorter, f"ngrams{n}")
    empty = counts[1].groupBy("lang").agg(F.count(F.lit(1)).alias("v")).select("lang", F.lit("").alias("gram"), F.lit(1).cast("long").alias("n"), (1.0 / (F.col("v") + 1)).alias("p"))
    model = Model({0: common.stage(empty, "p0")}, {})
    for n in range(1, ORDER + 1):
        p, weight = _smooth(counts[n], n, model.probability[n - 1])
        model.probability[n], model.weight[n - 1] = common.stage(p, f"p{n}"), weight
    return model


def values(grams: DataFrame, model: Model) -> DataFrame:
    """lang, gram, n and value (the log probability, int) of n-grams of the full order, by back-off where the model lacks one."""
    out = grams.select("lang", "gram", "n").withColumns({"p": F.lit(None).cast("double"), "w": F.lit(1.0)})

    def with_(table: DataFrame, first: int, length: int) -> DataFrame:
        table = table.select(F.col("lang").alias("of"), F.col("gram").alias("part"), F.col("p").alias("found"))
        return out.join(table, F.col("lang").eqNullSafe(F.col("of")) & (F.substring("gram", first, length) == F.col("part")), "left").drop("of", "part")

    for k in range(ORDER, -1, -1):
        out = with_(model.probability[k], ORDER - k + 1, k).withColumn("p", F.coalesce("p", F.col("w") * F.col("found"))).drop("found")
        if k:
            out = with_(model.weight[k - 1], ORDER - k + 1, k - 1).withColumn("w", F.col("w") * F.coalesce("found", F.lit(1.0))).drop("found")
    return out.select("lang", "gram", "n", _value(F.coalesce("p", F.lit(UNKNOWN))))


def _value(p: Column) -> Column:
    return F.round(F.log(p) * SCALE).cast("int").alias("value")


def _table(values_: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Sorted hashes and values of the most frequent n-grams, ``frequent`` of them at most, and a table with all the others, if there are any."""
    bucket = F.floor(F.log2("n") * 16).cast("int")  # 1,024 of them at most
    least, total = None, 0
    sizes = sorted(map(tuple, values_.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)
    for b, n in sizes:
        if total + n > frequent:
            break
        least, total = b, total + n

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, gram, value = b.columns
            seeds = {x: np.uint64(_seed(x)) for x in lang.unique().to_pylist()}
            h = np.array([seeds[x] for x in lang.to_pylist()], np.uint64)
            codes = np.frombuffer("".join(gram.to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(h), ORDER).astype(np.uint64)
            with np.errstate(over="ignore"):
                for k in range(ORDER):
                    h += (codes[:, ORDER - 1 - k] + np.uint64(1)) * np.uint64(pow(int(_M), k, 2**64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), value], names=["key", "value"])

    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), values_ if sizes else None
    got = values_.where(bucket >= least).select("lang", "gram", "value").mapInArrow(hashed, "key long, value int").toArrow()
    keys, found = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    del got  # each array goes as soon as the next one stands: the driver has little memory
    order = np.argsort(keys)
    keys = keys[order]
    found = found[order]
    del order
    twice = np.zeros(len(keys), bool)
    twice[1:] = keys[1:] == keys[:-1]
    twice[:-1] |= twice[1:]
    others = values_ if twice.any() else values_.where(bucket < least) if least > sizes[-1][0] else None
    if twice.any():
        keys, found = keys[~twice], found[~twice]
    return keys, found, others


def score(docs: DataFrame, values_: DataFrame, keep: list[str], *, frequent: int = FREQUENT) -> DataFrame:
    """The ``keep`` columns, the base features, log_ppl double (nats per character; null for empty texts) and __size, the length class.

    ``values_`` must have every n-gram of ``docs``.
    """
    keys, found, others = _table(values_, frequent)
    shared = docs.sparkSession.sparkContext.broadcast((keys, found))
    del keys, found
    common.give_back()
    schema = docs.select(*keep).schema
    features = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest_type = pa.list_(pa.struct([("gram", pa.string()), ("times", pa.int64())]))
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *(f"{x} long" for x in features), "__lang string", "__chars long", "__sum long", "__size int", "__rest array<struct<gram:string,times:bigint>>"]
    at = len(keep)

    def sums(texts: list[str], langs: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Of each text the sum of the values that are broadcast, and the other n-grams with their numbers."""
        keys, found = shared.value
        total, rest = np.zeros(len(texts), np.int64), [[] for _ in texts]
        for c, h, owner, inside in _segments(texts, langs):
            if not len(inside):
                continue
            u, inv = np.unique(h[inside], return_inverse=True)
            pos = np.minimum(np.searchsorted(keys, u), max(len(keys) - 1, 0))
            hit = keys[pos] == u if len(keys) else np.zeros(len(u), bool)
            value = np.where(hit, found[pos] if len(keys) else 0, 0)[inv]
            total += np.bincount(owner[inside], value, len(texts)).astype(np.int64)
            missing = np.flatnonzero(~hit[inv])
            if len(missing):
                _, first, n = np.unique(np.stack([owner[inside][missing], inv[missing]]), axis=1, return_index=True, return_counts=True)
                for i, times in zip(inside[missing[first]].tolist(), n.tolist(), strict=True):
                    rest[owner[i]].append({"gram": c[i : i + ORDER].tobytes().decode("utf-32-le", "surrogatepass"), "times": times})
        return total, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = np.array([base_features(t) for t in texts], np.int64).reshape(len(texts), 5)
            total, rest = sums(texts, batch.column(at + 1).to_pylist())
            columns = [*batch.columns[:at], *(pa.array(base[:, k]) for k in range(5)), batch.column(at + 1), pa.array(list(map(len, texts)), pa.int64()), pa.array(total), pa.array([len(t).bit_length() for t in texts], pa.int32()), pa.array(rest, rest_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *features, "__lang", "__chars", "__sum", "__size", "__rest"])

    rows = docs.select(*keep, F.col("text").alias("__text"), F.col("lang").alias("__lang")).mapInArrow(common.lean(run), ", ".join(fields))
    if others is not None:
        parts = common.stage(rows.withColumn("__row", F.monotonically_increasing_id()), "partly-scored")
        rare = parts.select("__row", "__lang", F.explode("__rest").alias("x")).select("__row", "__lang", "x.gram", "x.times")
        rare = rare.join(others.select(F.col("lang").alias("of"), F.col("gram").alias("part"), "value"), F.col("__lang").eqNullSafe(F.col("of")) & (F.col("gram") == F.col("part")))
        rare = rare.groupBy("__row").agg(F.sum(F.col("times") * F.col("value")).alias("__more"))
        rows = parts.join(rare, "__row", "left").withColumn("__sum", F.col("__sum") + F.coalesce("__more", F.lit(0)))
    log_ppl = (-F.col("__sum") / F.lit(float(SCALE)) / F.nullif(F.col("__chars"), F.lit(0))).alias("log_ppl")
    return rows.select(*keep, *features, log_ppl, "__size")


def _with_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """Left join on the language and the length class; the bands are broadcast only if they are few."""
    bands = F.broadcast(bands) if bands.count() <= 10_000 else bands
    return rows.join(bands, F.col("lang").eqNullSafe(F.col("__of")) & (F.col("__size") == F.col("__at")), "left").drop("__of", "__at")


def _bands(good: DataFrame, band: float, least: float) -> DataFrame:
    """__of, __at, low and high of every language and length class of texts with log_ppl; class -1 stands for all lengths of a language."""
    rows = good.select("lang", "log_ppl", F.col("__size").alias("__length"), F.explode(F.array("__size", F.lit(-1))).alias("__size"))
    middle = rows.groupBy(F.col("lang").alias("__of"), F.col("__size").alias("__at")).agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("mid"))
    off = F.col("log_ppl") - F.col("mid")
    scaled = off * F.pow(2.0, F.col("__length") / 2)  # deviations shrink with the root of the length
    sides = [F.percentile_approx(F.when(sign * off > 0, sign * x), 0.5, 10_000).alias(name) for sign, x, name in ((1, off, "up"), (-1, off, "down"), (1, scaled, "scaled_up"), (-1, scaled, "scaled_down"))]
    spread = common.stage(_with_bands(rows, common.stage(middle, "medians")).groupBy("lang", "__size", "mid").agg(F.count(F.lit(1)).alias("docs"), *sides), "spreads")
    whole = spread.where("__size = -1").select(F.col("lang").alias("__of"), *(F.col(c).alias(f"all_{c}") for c in ("mid", "up", "down", "scaled_up", "scaled_down")))
    spread = spread.where("__size >= 0").join(whole, F.col("lang").eqNullSafe(F.col("__of"))).drop("__of")
    own = F.col("docs") >= CLASS_DOCS

    def width(side: str) -> F.Column:
        other = "down" if side == "up" else "up"
        whole = [F.greatest(F.col(f"all_{x}"), F.col(f"all_scaled_{x}") * F.pow(2.0, -F.col("__size") / 2)) for x in (side, other)]
        return F.coalesce(band * F.coalesce(F.when(own, F.col(side)), *whole), F.lit(least))

    mid = F.when(own, F.col("mid")).otherwise(F.col("all_mid"))
    return spread.select(F.col("lang").alias("__of"), F.col("__size").alias("__at"), (mid - width("down")).alias("low"), (mid + width("up")).alias("high"))


def quality(docs: DataFrame, *, reference: DataFrame | None = None, keep: list[str] | None = None, band: float = BAND, least: float = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """Quality verdicts over all documents, by the model of all ``reference`` documents (those that are judged, if none are given).

    Returns the ``keep`` columns (doc_id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), log_ppl, low and high (double; the band of the language and the length class).  A null or empty text has no words, fails the base rules and has a
    null log_ppl; a null language is a language of its own; a band exists wherever a text of the class passes the base rules; repeated rows give
    repeated verdicts; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    common.prepare(docs.sparkSession)
    docs, reference = (x.withColumns({"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")}) if x is not None else None for x in (docs, reference))
    mark = common.made()
    model = fit(docs if reference is None else reference)
    # n-grams of the documents that were counted are all in the model
    known = model.probability[ORDER].select("lang", "gram", "n", _value(F.col("p"))) if reference is None else common.stage(values(count_ngrams(docs), model), "values")
    rows = score(docs, known, [*keep, *(c for c in ["lang"] if c not in keep)], frequent=frequent)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = common.stage(rows.withColumn("base_failed", failed), "perplexities")
    common.drop_since(mark, rows)
    mark = common.made()
    bands = common.stage(_bands(rows.where(~F.col("base_failed")), band, least), "bands")
    common.drop_since(mark, bands)
    out = _with_bands(rows, bands)
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("log_ppl").between(F.col("low"), F.col("high")))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"), "log_ppl", "low", "high")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands over all documents."""
    return quality(common.table(spark, sf_dir, "documents"))
