"""Operator 7: removal of repeated passages by a hash-compared suffix sort.

Two suffixes matter to each other only if their first 100 bytes agree, and then these bytes have the same minimiser: the k-gram
with the least hash.  So suffixes are dealt to buckets by their minimiser, and a bucket holds one row for all the suffixes of a document
that share an occurrence of it.  A row carries two hashes of its surroundings, all the bytes that those suffixes begin with: a
polynomial one, by which rows are put together, and one of another kind that verifies it.  Rows whose surroundings repeat earlier ones
are covered; buckets with one kind of surroundings are done.  What is left is sorted: prefix polynomial hashes of the surroundings
give the hash of any stretch, binary search over lengths the common extension of two suffixes, and a mergesort that compares by it puts
equal beginnings next to each other, where their bytes are compared.  Rows are sorted, not each of their suffixes: once by what follows
the minimiser's beginning, and once by what precedes it, read backwards.  Lengths that neighbours have in common then tell which suffixes
are equal, as these agree on both sides.  The earliest of equal suffixes stays, and the others are covered.

A bucket of more than ``HOT`` kinds of surroundings is split: each of its suffixes becomes a row, dealt by a hash of its 100 bytes, so
equal ones still meet in one sort.  A sort of more rows than a task should hold goes in runs, and what isn't covered is carried on.

Texts are known by doc_id and 87 bits of hashes, so neither null nor repeated doc_ids mix them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

LENGTH, GRAM = 100, 32
HOT = 20_000
#: Bytes of one piece of a long text that is hashed at a time, of short texts that are hashed together, and suffixes of one sort, about.
PIECE, BLOCK, SORT = 1 << 19, 1 << 16, 300_000

_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 2**64)
_U = np.uint64
_POS_BITS = 20
#: The bits of a place in a text; those above it are more bits of the text's hash.
_PLACE = (1 << 40) - 1
#: What a text is known by.
KEY = ["id", "h", "t"]
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    got = _tables.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, base, _U)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.cumprod(got, dtype=_U)
        _tables[base] = got
    return got


class Hashes:
    """Prefix polynomial hashes of a byte string: the hash of any stretch by one subtraction."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.inverse = _powers(_INV, self.n + 1)
        terms = np.add(data, 1, dtype=_U)
        terms *= _powers(_M, self.n + 1)[: self.n]
        self.prefix = np.zeros(self.n + 1, _U)
        np.cumsum(terms, out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[end] - self.prefix[begin]) * self.inverse[begin]

    def all_of(self, size: int) -> np.ndarray:
        """The hashes of all stretches of ``size`` bytes."""
        out = self.prefix[size:] - self.prefix[: self.n + 1 - size]
        out *= self.inverse[: len(out)]
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _least(hashes: Hashes, length: int, gram: int) -> np.ndarray:
    """For each stretch of ``length`` bytes its least k-gram: bits of a hash above the place."""
    n, width = hashes.n, length - gram + 1
    low = hashes.all_of(gram)
    low ^= low >> _U(32)
    low *= _U(0xD6E8FEB86659FD93)
    low &= ~_U((1 << _POS_BITS) - 1)
    low |= np.arange(len(low), dtype=_U)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return low[: n - length + 1]


def minimisers(hashes: Hashes, length: int, gram: int) -> np.ndarray:
    """For each stretch of ``length`` bytes the place of its least k-gram, the first of equals.  At most 2 ** 20 bytes."""
    if hashes.n < length:
        return np.zeros(0, np.int64)
    return (_least(hashes, length, gram) & _U((1 << _POS_BITS) - 1)).view(np.int64)


def _found(data: np.ndarray, length: int, gram: int, hashes: bool = False) -> Iterator[tuple]:
    """Pieces of a text: the first suffix, and the minimisers of this and the following ones; with the piece's hashes and beginning."""
    reach, n, step = length - gram, len(data), PIECE - 3 * length
    for start in range(0, n - length + 1, step):
        # the stretches that begin in [start, start + step), and the surroundings of their minimisers
        begin, end = max(0, start - reach), min(n, start + step + 2 * length)
        h = Hashes(data[begin:end])
        found = minimisers(h, length, gram)[start - begin : start - begin + step] + begin
        yield (start, found, h, begin) if hashes else (start, found)


def _keys(raw: bytes, h: Hashes, p: np.ndarray, left: np.ndarray, right: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the k-grams at ``p`` and both hashes of the bytes from ``left`` to ``right``."""
    digest = xxhash.xxh3_64_intdigest
    around = _mix(h.of(left, right) * _U(0xD6E8FEB86659FD93) + (p - left).astype(_U) * _U(65537) + (right - p).astype(_U))
    check = np.array([digest(raw[x:y]) for x, y in zip(left.tolist(), right.tolist(), strict=True)], _U)
    return _mix(h.of(p, p + gram)), around, check


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the minimisers of a text, the hashes of their k-grams and both hashes of their surroundings."""
    out = [(np.zeros(0, np.int64), *[np.zeros(0, _U)] * 3)]
    after = 0
    for _, found, h, begin in _found(data, length, gram, hashes=True):
        # minimisers of later suffixes are never earlier
        p = found[np.concatenate([[True], found[1:] != found[:-1]])]
        p = p[p >= after] - begin
        left, right = np.maximum(p - (length - gram), 0), np.minimum(p + length, h.n)
        out.append((p + begin, *_keys(data[begin : begin + h.n].tobytes(), h, p, left, right, gram)))
        after = int(found[-1]) + 1
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def anchors_of(texts: Sequence[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of each text, in order, after the text's number.  Short texts go together."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, _U)] * 3)]

    def together(which: list[int]) -> None:
        raw = b"".join(texts[i] for i in which)
        h = Hashes(np.frombuffer(raw, np.uint8))
        sizes = np.array([len(texts[i]) for i in which], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        low = _least(h, length, gram)
        turns = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        p = (low[turns] & _U((1 << _POS_BITS) - 1)).view(np.int64)
        # a minimiser counts if one of its stretches lies in a text; those of two texts are further apart than stretches that share one
        text = np.searchsorted(ends - length, turns)
        some = begins[text] < np.append(turns[1:], len(low))
        p, text = p[some], text[some]
        left, right = np.maximum(p - (length - gram), begins[text]), np.minimum(p + length, ends[text])
        out.append((np.array(which)[text], p - begins[text], *_keys(raw, h, p, left, right, gram)))

    block, size = [], 0
    for i, x in enumerate(texts):
        if block and size + len(x) > BLOCK:
            together(block)
            block, size = [], 0
        if len(x) > BLOCK:
            p, *keys = anchors(np.frombuffer(x, np.uint8), length, gram)
            out.append((np.full(len(p), i), p, *keys))
        elif len(x) >= length:
            block.append(i)
            size += len(x)
    if block:
        together(block)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class SuffixSort:
    """Mergesort of suffixes of one buffer, within groups, by their first ``length`` bytes; comparisons are by common extension."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length, self.hashes = data, length, Hashes(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The length of the common beginning of suffixes, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.hashes.of(x, x + mid) == self.hashes.of(y, y + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        e = self.extension(x, y)
        equal = e == self.length
        off = np.where(equal, 0, e)
        return np.where(equal, or_equal, self.data[x + off] < self.data[y + off])

    def order(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes; ``group`` must be sorted, and groups stay together."""
        n = len(starts)
        order = np.arange(n)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(edges, n))
        base, size = np.repeat(edges, sizes), np.repeat(sizes, sizes)
        local = np.arange(n) - base
        width = 1
        while n and width < size.max():
            act = np.flatnonzero(size > width)
            b, m, at = base[act], size[act], local[act]
            run = at // width
            low = np.minimum((run ^ 1) * width, m)
            first, high = low, np.minimum(low + width, m)
            mine = starts[order[b + at]]
            right = (run & 1).astype(bool)  # of equals, those of the left run come first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(starts[order[b[open_] + mid]], mine[open_], right[open_])
                low[open_[before]] = mid[before] + 1 if before.any() else low[open_[before]]
                high = high.copy()
                high[open_[~before]] = mid[~before]
            to = b + (run // 2) * 2 * width + (at - run * width) + (low - np.minimum((run ^ 1) * width, m))
            new = order.copy()
            new[to] = order[b + at]
            order = new
            width *= 2
        return order

    def common(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For sorted suffixes: how many bytes each has in common with the one before it, by the bytes; -1 for the first of a group."""
        out = np.full(len(starts), -1, np.int64)
        near = np.flatnonzero(group[1:] == group[:-1]) + 1
        span = np.arange(self.length)
        for i in range(0, len(near), 20_000):
            k = near[i : i + 20_000]
            other = self.data[starts[k][:, None] + span] != self.data[starts[k - 1][:, None] + span]
            out[k] = np.where(other.any(axis=1), other.argmax(axis=1), self.length)
        return out

    def same_as_previous(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For sorted suffixes: whether each begins as the one before it in its group does."""
        return self.common(starts, group) == self.length


def suffixes_of(data: np.ndarray, places: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted places of minimisers the first suffix whose minimiser it is, and the one after the last."""
    first, last = np.full(len(places), len(data)), np.zeros(len(places), np.int64)
    for start, found in _found(data, length, gram):
        low, high = np.searchsorted(places, [found[0], found[-1] + 1])  # minimisers of later suffixes are never earlier
        p = places[low:high]
        a, b = start + np.searchsorted(found, p, "left"), start + np.searchsorted(found, p, "right")
        some = b > a
        first[low:high][some] = np.minimum(first[low:high], a)[some]
        last[low:high][some] = np.maximum(last[low:high], b)[some]
    return first, last


def _classes(lines: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the lines of each group.  For each of ``sizes`` and each place of that order, the number of the class of lines that begin with the same
    so many bytes; and the lines' places."""
    n, width = lines.shape
    sorter, starts = SuffixSort(np.ascontiguousarray(lines).reshape(-1), width), np.arange(n) * width
    order = sorter.order(starts, group)
    common = sorter.common(starts[order], group[order])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.cumsum(common < sizes[:, None], axis=1, dtype=np.int32), place


def covered_windows(rows: list[tuple], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], list[tuple]]:
    """From (bucket, id, h, tp, surroundings, offset of the minimiser, first suffix and number of suffixes in the surroundings), in order:
    (id, h, t, begin, end) of what repeats an earlier row, and the rows that have suffixes left."""
    if not rows:
        return [], []
    count = len(rows)
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    many, marks = np.array([r[7] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64)
    sizes = np.array([len(r[4]) for r in rows], np.int64)
    row = np.repeat(np.arange(count), many)
    off = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.array([r[6] for r in rows], np.int64), many)
    ahead = marks[row] - off
    reach = int(ahead.max(initial=1))
    bucket = np.array([r[0] for r in rows], np.int64)
    bucket = np.cumsum(np.concatenate([[False], bucket[1:] != bucket[:-1]]))
    # a line for each row, its minimiser in one column: suffixes that begin ``ahead`` of it are equal if so many bytes to its left are and the rest to its right
    column = np.arange(len(data)) + np.repeat(reach - marks - (np.cumsum(sizes) - sizes), sizes)
    inside = (column >= 0) & (column < reach + length)
    lines = np.zeros((count, reach + length), np.uint8)
    lines[np.repeat(np.arange(count), sizes)[inside], column[inside]] = data[inside]
    after, of_after = _classes(lines[:, reach:], bucket, length - np.arange(reach + 1))
    before, of_before = _classes(lines[:, :reach][:, ::-1], bucket, np.arange(reach + 1))
    # of equal suffixes that of the first row stays
    alike = (ahead * (count + 1) + after[ahead, of_after[row]]) * (count + 1) + before[ahead, of_before[row]]
    order = np.argsort(alike, kind="stable")
    same = np.concatenate([[False], alike[order[1:]] == alike[order[:-1]]]) if len(order) else np.zeros(0, bool)
    hit = order[same]
    row, ahead = row[hit], ahead[hit]
    left = [r for r, n, k in zip(rows, many.tolist(), np.bincount(row, minlength=len(rows)).tolist(), strict=True) if k < n]
    if not len(row):
        return [], left
    keep = np.lexsort((-ahead, row))
    row, ahead = row[keep], ahead[keep]
    breaks = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (ahead[1:] != ahead[:-1] - 1)]))
    out = []
    for a, b in zip(breaks, [*breaks[1:], len(row)], strict=True):
        _, doc, h, tp, *_ = rows[row[a]]
        pos = tp & _PLACE
        out.append((doc, h, tp >> 40, int(pos - ahead[a]), int(pos - ahead[b - 1]) + length))
    return out, left


def _keyed(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What a text is known by (id, a 64-bit hash and 23 bits of another), the text, and the ``keep`` columns under other names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = F.xxhash64(F.lit("more"), text).bitwiseAND(F.lit((1 << 23) - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("id"), F.xxhash64(text).alias("h"), more.alias("t"), text.alias("text"), *(F.col(c).alias(f"__{c}") for c in keep))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, both hashes, id, h and tp.  Kind 0 repeats its surroundings; kind 1 is the first of one of several."""

    def out(kind: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in rows)], names=["kind", "gram", "id", "h", "tp"])

    last = first = None  # the previous row; the first row of its kind, until that is passed on
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        settled = rows[5] < 0
        if settled.any():
            yield out(np.zeros(settled.sum()), [rows[0][settled], rows[3][settled], rows[4][settled], ~rows[5][settled]])
            rows = [x[~settled] for x in rows]
        if not len(rows[0]):
            continue
        # the previous row is put before these, or at the start one of another bucket
        rows = [np.concatenate([[x], y]) for x, y in zip(last if last is not None else [~rows[0][0], *(x[0] for x in rows[1:])], rows, strict=True)]
        last = [x[-1] for x in rows]
        equal = [x[1:] == x[:-1] for x in rows]
        same = equal[0] & equal[1] & equal[2]
        again = same & equal[3] & equal[4] & equal[5]
        kind = np.full(len(same) + 1, -1)
        kind[1:][same & ~again] = 0
        turn = np.flatnonzero(equal[0] & ~same) + 1  # another kind of surroundings of one bucket begins
        kind[turn] = 1
        first_of = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(kind)), 0))
        before = first_of[turn - 1]
        kind[before[before > 0]] = 1
        if (before == 0).any() and first is not None:
            yield out(np.ones(1), [np.array([x]) for x in first])
            first = None
        now = int(first_of[-1])
        if now > 0:
            first = None if kind[now] == 1 else [rows[k][now] for k in (0, 3, 4, 5)]
        found = np.flatnonzero(kind[1:] >= 0) + 1
        yield out(kind[found], [rows[k][found] for k in (0, 3, 4, 5)])


def covered(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The keyed rows (id, h, t, text); what is covered (id, h, t, place of a minimiser or null, begin and end); the staged tables behind it."""
    spark = docs.sparkSession
    common.prepare(spark)
    base = _keyed(docs)
    reach = length - gram

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h, t = (c.to_numpy() for c in batch.columns[:3])
            turn = np.lexsort((t, h, d))
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            which, p, *keys = anchors_of([texts[i] for i in turn.tolist()], length, gram)
            which = turn[which]
            d, h, p = d[which], h[which], (t[which] << 40) | p
            # combined before the shuffle: what repeats earlier surroundings of this batch is settled; it is passed on under a key of its own
            order = np.argsort(keys[0] + keys[1] * _U(_M) + keys[2] * _U(_INV), kind="stable")
            g, a, c, d, h, p = (x[order] for x in (*(y.view(np.int64) for y in keys), d, h, p))
            equal = [x[1:] == x[:-1] for x in (g, a, c, d, h, p)]
            again = np.zeros(len(g), bool)
            again[1:] = equal[0] & equal[1] & equal[2] & ~(equal[3] & equal[4] & equal[5])
            g[again], a[again], c[again] = _mix((d[again] ^ h[again] ^ (p[again] << 1)).view(_U)).view(np.int64), 0, 0
            p[again] = ~p[again]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, a, c, d, h, p)], names=["gram", "around", "check", "id", "h", "tp"])

    rows = base.mapInArrow(find, "gram long, around long, check long, id long, h long, tp long")
    rows = rows.repartition("gram").sortWithinPartitions("gram", "around", "check", "id", "h", "tp")
    sifted = buckets = common.stage(rows.mapInArrow(_sift, "kind int, gram long, id long, h long, tp long"), "buckets")
    sifted = sifted.withColumn("t", F.shiftright("tp", 40)).withColumn("pos", F.col("tp").bitwiseAND(F.lit(_PLACE)))
    open_ = sifted.where("kind = 1")
    heavy = common.stage(open_.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(True).alias("hot")), "hot")
    any_hot = heavy.limit(1).count() > 0
    wanted = open_.join(heavy, "gram", "left") if any_hot else open_.withColumn("hot", F.lit(None).cast("boolean"))
    wanted = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    joined = base.join(wanted, KEY).select(*KEY, "text", "places")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of ordinary buckets with their surroundings; of heavy ones a row for each suffix.  Of equal suffixes in a batch the first only; the
        others are settled, with their beginnings."""
        names = ["gram", "id", "h", "tp", "around", "off", "first", "many", "begin"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            out, single = [], []
            for doc, h, t, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                places = sorted(places, key=lambda x: x["pos"])
                first, last = suffixes_of(np.frombuffer(data, np.uint8), np.array([x["pos"] for x in places], np.int64), length, gram)
                for x, a, b in zip(places, first.tolist(), last.tolist(), strict=True):
                    if x["hot"]:
                        single += [(data[s : s + length], doc, h, (t << 40) | s) for s in range(a, b)]
                    else:
                        left = max(0, x["pos"] - reach)
                        out.append((x["gram"], doc, h, (t << 40) | x["pos"], data[left : x["pos"] + length], x["pos"] - left, a - left, b - a, None))
            before = None
            for x, doc, h, tp in sorted(set(single)):  # repeated rows bring a suffix twice
                if x == before:
                    out.append((None, doc, h, tp, None, None, None, None, tp & _PLACE))
                else:
                    out.append((xxhash.xxh3_64_intdigest(x) - (1 << 63), doc, h, tp, x, 0, 0, 1, None))
                before = x
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, types, strict=True)], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, new, most = [], 0, max(1, SORT // reach)

        def close() -> tuple[pa.RecordBatch, list[tuple]]:
            got, left = covered_windows(group, length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * 5)], names=[*KEY, "begin", "end"]), left

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and new >= most:
                    windows, left = close()
                    yield windows
                    # in the same bucket, what isn't covered meets the rows to come
                    group, new = [x for x in left if x[0] == row[0]], 0
                if not group or row[:4] != group[-1][:4]:
                    group.append(row)
                    new += 1
        yield close()[0]

    cuts = common.stage(joined.mapInArrow(surroundings, "gram long, id long, h long, tp long, around binary, off int, first int, many int, begin long"), "surroundings")
    sorted_ = cuts.where("begin IS NULL").drop("begin").repartition("gram").sortWithinPartitions("gram", "id", "h", "tp")
    windows = common.stage(sorted_.mapInArrow(settle, "id long, h long, t long, begin long, end long"), "windows")
    ready = cuts.where("begin IS NOT NULL").select("id", "h", F.shiftright("tp", 40).alias("t"), "begin", (F.col("begin") + length).alias("end"))
    none = F.lit(None).cast("long")
    done = sifted.where("kind = 0").select(*KEY, "pos", none.alias("begin"), none.alias("end"))
    return base, done.unionByName(windows.unionByName(ready).select(*KEY, none.alias("pos"), "begin", "end")), [buckets, heavy, cuts, windows]


def removed_mask(data: np.ndarray, places: list[int], spans: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which bytes are covered: by the stretches whose minimiser is at ``places``, and by ``spans``."""
    n = len(data)
    change = np.zeros(n + 1, np.int32)
    if places:
        wanted = np.zeros(n, bool)
        wanted[places] = True
        for start, found in _found(data, length, gram):
            s = np.flatnonzero(wanted[found]) + start
            change[s] += 1
            change[s + length] -= 1
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep_text: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts earlier (smaller doc_id, or earlier in the document).

    Returns doc_id, n_bytes, n_removed, n_spans (long), kept_sha256 and, with ``keep_text``, text: what remains, read as UTF-8 with bytes
    that a cut left incomplete dropped, and the ``keep`` columns.  A null text counts as empty; a null doc_id comes before all others (and so
    does -2 ** 63, which counts as null); of rows with one doc_id the order is that of hashes of their texts, and of rows equal in both
    the first stays; texts under ``length`` bytes stay whole.  Other columns are ignored.
    """
    _, found, staged = covered(docs, length=length, gram=gram, hot=hot)
    base = _keyed(docs, keep)
    hidden = [f"__{c}" for c in keep]
    per_doc = found.groupBy(*KEY).agg(F.collect_list("pos").alias("places"), F.collect_list(F.when(F.col("begin").isNotNull(), F.struct("begin", "end"))).alias("spans"))
    joined = base.join(per_doc, KEY, "left").select(*KEY, "text", "places", "spans", *hidden)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.select(*hidden).schema) if hidden else ""
    fields = "id long, h long, t long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text + kinds

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, h, t, text, places, spans in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
                data = _bytes(text)
                mask = removed_mask(data, places or [], [(x["begin"], x["end"]) for x in spans or []], length, gram) if places or spans else np.zeros(len(data), bool)
                kept = data[~mask].tobytes()
                starts = int((mask[1:] & ~mask[:-1]).sum() + (mask[:1].sum()))
                row = [doc, h, t, len(data), int(mask.sum()), starts, hashlib.sha256(kept).hexdigest()]
                rows.append(row + [kept.decode("utf-8", "ignore")] * keep_text)
            types = [*[pa.int64()] * 6, pa.string(), *[pa.string()] * keep_text]
            names = [*KEY, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * keep_text]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[6:]], names=[*names, *hidden])

    out = common.stage(joined.mapInArrow(apply, fields).withColumn("__row", F.monotonically_increasing_id()), "deduplicated")
    common.drop(*staged)
    # rows equal in doc_id and text: all but one are copies
    twice = out.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.min("__row").alias("stays")).where("rows > 1").select(*KEY, "stays")
    doc = F.when(F.col("id") != common.NULL_ID, F.col("id")).alias("doc_id")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * keep_text]
    if twice.limit(1).count():
        out = out.join(common.stage(twice, "copies"), KEY, "left").withColumn("copy", (F.col("__row") != F.col("stays")) & (F.col("n_bytes") >= length))
        empty = hashlib.sha256(b"").hexdigest()
        for name, value in (("n_removed", F.col("n_bytes")), ("n_spans", F.lit(1).cast("long")), ("kept_sha256", F.lit(empty)), *[("text", F.lit(""))] * keep_text):
            out = out.withColumn(name, F.when(F.col("copy"), value).otherwise(F.col(name)))
    return out.select(doc, *columns, *(F.col(f"__{c}").alias(c) for c in keep))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return dedup(common.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100),
f AS (SELECT substr(h, 2 * s + 1, 200) AS w, count(*) AS k, min({'d': doc_id, 's': s}) AS first FROM p GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT p.doc_id, p.s FROM p JOIN f ON f.w = substr(p.h, 2 * p.s + 1, 200) WHERE {'d': p.doc_id, 's': p.s} > f.first),
r AS (SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -101) > 100 AS starts FROM c),
g AS (SELECT doc_id, s, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
x AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, b AS from_, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), -1) AS to_ FROM x UNION ALL SELECT doc_id, 0, min(a) FROM x GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (CASE WHEN to_ < 0 THEN n ELSE to_ END - from_)), '' ORDER BY from_) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
m AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
"""
