"""Lag of one signal against another by normalised cross-correlation.

Two forms of the same: in SQL, a join of samples (quadratic; for short signals), and an Arrow-batched function with FFTs.  A positive lag
says that the content stands later in the first signal, so the second has to be delayed by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed value: a signal whose deviation is not over this is only centred.
FLAT = 1e-8
#: Correlations are rounded to so many digits before they are compared, so that equal ones are ties.
DIGITS = 6
#: Samples that are transformed at once.
BLOCK = 1 << 18


def normalise(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x - x.mean()
    std = x.std()
    return x / std if std > FLAT else x


def correlation(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Full cross-correlation by FFT; entry k belongs to lag k - (len(s) - 1)."""
    n = len(p) + len(s) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(p, size) * np.fft.rfft(s[::-1], size), size)[:n]


def _normaliser(x: np.ndarray, block: int):
    """A function that gives block k of the normalised signal; sums are made block by block, so no copy of the signal is."""
    mean = float(x.mean(dtype=np.float64))
    std = math.sqrt(sum(float(((x[k : k + block] - mean) ** 2).sum(dtype=np.float64)) for k in range(0, len(x), block)) / len(x))
    scale = std if std > FLAT else 1.0
    return lambda k: (x[k * block : (k + 1) * block].astype(np.float64) - mean) / scale


def _partitioned_lag(p: np.ndarray, s: np.ndarray, block: int, digits: int | None = None) -> int:
    """The same lag as of the whole transform, by blocks: the spectra of blocks that are as far apart are multiplied and added, and one inverse
    transform gives their part of the lags around that distance.

    Besides the signals it holds a spectrum of each block (8 bytes a sample, single precision) and a few transforms of two blocks.
    """
    spectra = []
    for x in (p, s):
        part = _normaliser(x, block)
        spectra.append([np.fft.rfft(part(k), 2 * block).astype(np.complex64) for k in range(-(-len(x) // block))])
    first, second = spectra
    best, found, carried = -np.inf, 0, np.zeros(block)
    for d in range(1 - len(second), len(first) + 1):
        total = np.zeros(block + 1, np.complex128)
        for b in range(max(0, -d), min(len(second), len(first) - d)):
            total += first[b + d] * np.conj(second[b])
        c = np.fft.irfft(total, 2 * block)
        # lags from (d - 1) blocks on: the later half of the last distance and the earlier half of this one
        carried[1:] += c[block + 1 :]
        low, high = max(0, 1 - len(s) - (d - 1) * block), min(block, len(p) - (d - 1) * block)
        if low < high:
            some = carried[low:high] if digits is None else np.round(carried[low:high], digits)
            k = int(np.argmax(some))
            if some[k] > best:
                best, found = some[k], (d - 1) * block + low + k
        carried = c[:block].copy()
    return found


def lag(p: np.ndarray, s: np.ndarray, digits: int | None = None, block: int = BLOCK) -> int:
    """The lag of the highest correlation, the smallest of equals, in samples.  Signals of more than ``block`` samples are transformed in blocks."""
    if max(len(p), len(s)) > block:
        return _partitioned_lag(np.asarray(p), np.asarray(s), block, digits)
    c = correlation(normalise(p), normalise(s))
    return int(np.argmax(c if digits is None else np.round(c, digits))) - (len(s) - 1)


@F.pandas_udf(LongType())
def estimate_lag(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Arrow form over two array columns; null if either is null or empty."""
    for p, s in pairs:
        yield pd.Series([lag(a, b, DIGITS) if a is not None and b is not None and len(a) and len(b) else None for a, b in zip(p, s, strict=True)], dtype="Int64")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row; inside a lambda it would be once an element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mean(samples: Column, f=lambda x: x) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + f(x)) / F.size(samples).cast("double")


def _with_deviation(samples: Column, use) -> Column:
    """``use(mean, deviation)`` of an array of doubles; the deviation is the population's."""
    return _let(_mean(samples), lambda m: _let(F.sqrt(_mean(samples, lambda x: (x - m) * (x - m))), lambda d: use(m, d)))


def znormalise(samples: Column) -> Column:
    """An array column less its mean, over its deviation where that is not flat."""
    return _with_deviation(samples, lambda m, d: F.transform(samples, lambda x: F.when(d > FLAT, (x - m) / d).otherwise(x - m)))


def sample_rows(signals: DataFrame, id_col: str, samples: str) -> DataFrame:
    """id, i, z: the normalised samples as rows; the deviation is a window's, so no signal is joined to its own statistics."""
    rows = signals.select(F.col(id_col).alias("id"), F.posexplode(samples).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy("id")
    mean, std = F.avg("x").over(w), F.stddev_pop("x").over(w)
    return rows.select("id", F.col("i").cast("long").alias("i"), F.when(std > FLAT, (F.col("x") - mean) / std).otherwise(F.col("x") - mean).alias("z"))


def lags_sql(signals: DataFrame, pairs: DataFrame, *, id_col: str, samples: str) -> DataFrame:
    """SQL form: for pairs (p_id, s_id) the lag and the rounded peak.  Each pair costs the product of the lengths."""
    rows = sample_rows(signals, id_col, samples)
    p = rows.select(F.col("id").alias("p_id"), F.col("i").alias("pi"), F.col("z").alias("pz"))
    s = rows.select(F.col("id").alias("s_id"), F.col("i").alias("si"), F.col("z").alias("sz"))
    products = pairs.select("p_id", "s_id").join(p, "p_id").join(s, "s_id")
    sums = products.groupBy("p_id", "s_id", (F.col("pi") - F.col("si")).alias("lag")).agg(F.round(F.sum(F.col("pz") * F.col("sz")), DIGITS).alias("corr"))
    best = F.max(F.struct("corr", (-F.col("lag")).alias("neg"))).alias("best")
    return sums.groupBy("p_id", "s_id").agg(best).select("p_id", "s_id", (-F.col("best.neg")).alias("lag"), F.col("best.corr").alias("peak"))


def lags_arrow(signals: DataFrame, pairs: DataFrame, *, id_col: str, samples: str) -> DataFrame:
    """Arrow form of the same, without the peak."""
    p = signals.select(F.col(id_col).alias("p_id"), F.col(samples).cast("array<double>").alias("p"))
    s = signals.select(F.col(id_col).alias("s_id"), F.col(samples).cast("array<double>").alias("s"))
    return pairs.select("p_id", "s_id").join(p, "p_id").join(s, "s_id").select("p_id", "s_id", estimate_lag("p", "s").alias("lag"))


def degenerate(samples: Column) -> Column:
    """Whether a signal is flat, so that its lag says nothing."""
    return _with_deviation(samples, lambda m, d: d <= FLAT)


def lag_ms(lag_column, rate: float) -> Column:
    return (F.col(lag_column) if isinstance(lag_column, str) else lag_column) / F.lit(float(rate)) * 1000


def head(samples, segment: int) -> Column:
    return F.slice(samples, 1, segment)


def tail(samples, segment: int) -> Column:
    """The last ``segment`` samples, or all of a shorter signal."""
    x = F.col(samples) if isinstance(samples, str) else samples
    return F.slice(x, F.greatest(F.lit(0), F.size(x) - segment) + 1, F.lit(segment))


def common_length(a: Column, b: Column) -> Column:
    return F.least(F.size(a), F.size(b))


def tail_correction(raw, p_duration, s_duration, *, exact: bool = False, segment: float | None = None) -> Column:
    """The tail's delay in ms: the raw one plus the difference of durations (s).

    With ``exact`` plus the difference of the offsets at which the tails begin, which differs where a signal is shorter than ``segment``.
    """
    raw, p, s = (F.col(c) if isinstance(c, str) else c for c in (raw, p_duration, s_duration))
    if exact:
        p, s = F.greatest(F.lit(0.0), p - segment), F.greatest(F.lit(0.0), s - segment)
    return raw + (p - s) * 1000


def series_offsets(pairs: DataFrame, *, rate: float, segment: int, least: int, exact: bool = False) -> DataFrame:
    """Head and tail delays of pairs of sample arrays p and s: adds start_delay_ms, end_delay_ms and error.

    ``rate``: samples a second.  A head or tail needs more than ``least`` samples.  Only the slices travel to Python.
    """
    cut = {f"__{c}{k}": x for c in ("p", "s") for k, x in (("h", head(c, segment)), ("t", tail(c, segment)), ("n", F.size(c)))}
    return slice_offsets(pairs.withColumns(cut), rate=rate, segment=segment, least=least, exact=exact).drop(*cut)


def slice_offsets(pairs: DataFrame, *, rate: float, segment: int, least: int, exact: bool = False) -> DataFrame:
    """The same from heads (__ph, __sh), tails (__pt, __st) and lengths (__pn, __sn) of the signals, so that whole ones need not be brought together."""
    rows = pairs.withColumns({"__h": common_length(F.col("__ph"), F.col("__sh")), "__t": common_length(F.col("__pt"), F.col("__st"))})
    usable_head, usable_tail = F.col("__h") > least, F.col("__t") > least
    lags = {
        "__hl": estimate_lag(*(F.when(usable_head, F.slice(c, F.lit(1), F.col("__h"))) for c in ("__ph", "__sh"))),
        "__tl": estimate_lag(*(F.when(usable_head & usable_tail, F.slice(c, F.lit(1), F.col("__t"))) for c in ("__pt", "__st"))),
    }
    rows = rows.withColumns(lags)
    durations = [F.col(c) / F.lit(float(rate)) for c in ("__pn", "__sn")]
    end = tail_correction(lag_ms("__tl", rate), *durations, exact=exact, segment=segment / rate)
    error = F.when(~usable_head, "Insufficient audio at start for analysis.").when(~usable_tail, "Insufficient audio at end for analysis.")
    return rows.withColumns({"start_delay_ms": lag_ms("__hl", rate), "end_delay_ms": end, "error": error}).drop("__h", "__t", "__hl", "__tl")
