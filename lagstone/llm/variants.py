"""Operator 12: spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted first.  Two words are near if one inserted, deleted or replaced code point makes one of the other.  From each
word its deletions, and its replacements by symbols that come later in code-point order, are generated: that is every near pair once.
Edits are probed as hashes against blocked Bloom filters, one for each word length, which hold the hashes of the vocabulary; a hash is a
sum over positions, so that of an edit follows from the word's by two additions.  Only positives leave the task, as numbers.  They are
joined to the vocabulary by hash, and the words themselves are compared, which removes the filters' false positives and equal hashes.

Filters take ``BITS`` bits a word.  Where all of them would be larger than ``FILTERS``, the hashes are cut into slices, each probed in a
round of its own, so what is broadcast at a time is bounded at any size of vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST, OCCURRENCES, TIMES = 7, 2, 10
#: A run in so many is cut by one code point.
EVERY = 31
#: Bits of a filter for each word, bytes of all filters that are broadcast at once, hashes of a word in a block.
BITS, FILTERS, PROBES = 16, 64 << 20, 7
#: Words of this length and longer ones share one filter.
LONG = 64
#: Distinct words that a task gathers before it passes them on; edits that are hashed at a time.
GATHER, EDITS = 200_000, 1 << 17

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCKS = 1 << 10  # blocks of 64 bytes that one task fills


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _at(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a symbol at a place adds to a word's hash."""
    with np.errstate(over="ignore"):
        return _mix((symbols.astype(_U) + (places.astype(_U) << _U(21))) * _U(0x9E3779B97F4A7C15))


def _symbols(words: list[str]) -> np.ndarray:
    """Words of one length as a table of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words of one length."""
    table, total = _symbols(words), np.zeros(len(words), _U)
    step = max(1, EDITS // len(words))
    for k in range(0, table.shape[1], step):
        with np.errstate(over="ignore"):
            total += _at(table[:, k : k + step], np.arange(k, min(k + step, table.shape[1]))).sum(axis=1, dtype=_U)
    return total


def _key(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a filter is asked for: the hash mixed with the length."""
    with np.errstate(over="ignore"):
        return _mix(hashes + length.astype(_U) * _U(0xD6E8FEB86659FD93))


class Filter:
    """A blocked Bloom filter: a word's bits lie in one block of 512."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None):
        self.blocks, self.bits = blocks, np.zeros(8 * blocks, _U) if bits is None else bits

    @staticmethod
    def block(keys: np.ndarray, blocks: int) -> np.ndarray:
        return ((keys >> _U(32)) * _U(blocks)) >> _U(32)

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        return _mix(keys ^ _U(0xA24BAED4963EE407))

    def add(self, keys: np.ndarray, first: int = 0) -> None:
        """``first``: the block that ``bits`` begin with."""
        block, b = (self.block(keys, self.blocks) - _U(first)) << _U(3), self._bits(keys)
        for k in range(PROBES):
            x = b >> _U(9 * k)
            np.bitwise_or.at(self.bits, (block + ((x >> _U(6)) & _U(7))).astype(np.int64), _U(1) << (x & _U(63)))

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may have been added; none that has been is left out."""
        block, b, found = (self.block(keys, self.blocks) << _U(3)), self._bits(keys), None
        for k in range(PROBES):
            x = b >> _U(9 * k)
            hit = np.flatnonzero((self.bits[(block + ((x >> _U(6)) & _U(7))).astype(np.int64)] >> (x & _U(63))) & _U(1))
            block, b, found = block[hit], b[hit], hit if found is None else found[hit]
        return found


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, Callable]]:
    """Of words of one length, in pieces: the edits' length, their hashes, and a function that tells of some of them the words' numbers, the
    places and the symbols put there (0: deleted).

    Of the deletions in a row of equal symbols the first only; replacements by later symbols of ``alphabet`` (sorted) only.
    """
    table, whole = _symbols(words), word_hashes(words)
    n, length = table.shape
    step, wide = max(1, EDITS // (n * max(1, len(alphabet)))), max(1, EDITS // n)
    behind, moved, total = (np.zeros(n, _U) for _ in range(3))  # sums over places: before this one; from 1 up to this one, moved to the left; all of these
    for k in range(1, length, wide):
        at = np.arange(k, min(k + wide, length))
        with np.errstate(over="ignore"):
            total += _at(table[:, at], at - 1).sum(axis=1, dtype=_U)
    for k in range(0, length, step):
        at = np.arange(k, min(k + step, length))
        part = table[:, at]
        with np.errstate(over="ignore"):
            here = _at(part, at)
            left = np.where(at > 0, _at(part, np.maximum(at - 1, 0)), _U(0))
            before = behind[:, None] + np.cumsum(here, axis=1, dtype=_U) - here
            upto = moved[:, None] + np.cumsum(left, axis=1, dtype=_U)
            shorter = before + total[:, None] - upto
            behind, moved = behind + here.sum(axis=1, dtype=_U), upto[:, -1]
        first = np.ones(part.shape, bool)
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        if k:
            first[:, 0] = part[:, 0] != table[:, k - 1]
        cut = np.flatnonzero(first)
        yield length - 1, shorter.ravel()[cut], lambda hit, cut=cut, at=at: (cut[hit] // len(at), at[cut[hit] % len(at)], np.zeros(len(hit), np.uint32))
        if len(alphabet):
            put = np.flatnonzero(alphabet[None, None, :] > part[:, :, None])
            with np.errstate(over="ignore"):
                changed = ((whole[:, None] - here)[:, :, None] + _at(alphabet[None, :], at[:, None])[None]).ravel()[put]
            m = len(alphabet)
            yield length, changed, lambda hit, put=put, at=at, m=m: (put[hit] // (m * len(at)), at[put[hit] // m % len(at)], alphabet[put[hit] % m])


def word_counts(docs: DataFrame, *, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word and n of all runs of letters with ``least`` code points or more, lower-cased; a run in ``every`` lost one of them before.

    Which run of a document loses which code point follows from a check sum of doc_id and the run.
    """
    common.prepare(docs.sparkSession)
    source = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(found), list(found.values())
            for at in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.string()), pa.array(n[at : at + 20_000], pa.int64())], names=["word", "n"])
            found.clear()

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, begun = Counter(runs.findall(text.translate(_LOWER).decode())), zlib.crc32(f"{doc}:".encode())
                for run in [x for x in own if zlib.crc32(x.encode(), begun) % every == 0]:
                    k = zlib.crc32(run.encode(), begun) % len(run)
                    n = own.pop(run)
                    if len(run) > least:
                        found[run[:k] + run[k + 1 :]] += n
                found.update(own)
            if len(found) > GATHER:
                yield from out()
        yield from out()

    return source.mapInArrow(gather, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of the words of each length."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for length, group in groupby(order, key=lambda i: len(words[i])):
        yield length, np.fromiter(group, np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        lengths, hashes = np.zeros(len(words), np.int32), np.zeros(len(words), _U)
        for length, which in _by_length(words):
            lengths[which] = length
            hashes[which] = word_hashes([words[i] for i in which]) if length else 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array(hashes.view(np.int64))], names=["word", "n", "length", "hash"])


def vocabulary_of(counts: DataFrame) -> DataFrame:
    """word, n, length and hash of (word, n), staged."""
    common.prepare(counts.sparkSession)
    return common.stage(counts.select("word", "n").mapInArrow(_hashed, "word string, n long, length int, hash long"), "vocabulary")


def _filters(vocabulary: DataFrame, limit: int) -> tuple[dict[int, int], int]:
    """Blocks of each length's filter in one slice, and the number of slices."""
    shard = F.least("length", F.lit(LONG)).alias("shard")
    sizes = {r["shard"]: r["n"] for r in vocabulary.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length under LONG
    slices = max(1, -(-sum(sizes.values()) * BITS // (8 * limit)))
    return {s: -(-n * BITS // (512 * slices)) for s, n in sizes.items()}, slices


def _filled(vocabulary: DataFrame, blocks: dict[int, int], slices: int, chosen: int) -> dict[int, Filter]:
    """The filters of one slice: each task fills a stretch of blocks, and the stretches, which ``FILTERS`` bounds, are put together."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, h = (c.to_numpy() for c in batch.columns)
            key, shard = _key(h.view(_U), length), np.minimum(length, LONG)
            use = key % _U(slices) == _U(chosen)
            key, shard = key[use], shard[use]
            size = np.array([blocks[s] for s in shard.tolist()], np.int64).astype(_U)
            chunk = ((((key >> _U(32)) * size) >> _U(32)) // _U(_BLOCKS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(chunk), pa.array(key.view(np.int64))], names=["shard", "chunk", "key"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([part.bits.tobytes()], pa.binary())], names=["shard", "chunk", "bits"])
        for batch in batches:
            shard, chunk, key = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (chunk[1:] != chunk[:-1])])) if len(key) else []
            for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
                if at != (int(shard[a]), int(chunk[a])):
                    if at is not None:
                        yield done()
                    at = int(shard[a]), int(chunk[a])
                    part = Filter(blocks[at[0]], np.zeros(8 * min(_BLOCKS, blocks[at[0]] - at[1] * _BLOCKS), _U))
                part.add(key[a:b].view(_U), at[1] * _BLOCKS)
        if at is not None:
            yield done()

    rows = vocabulary.select("length", "hash").mapInArrow(places, "shard int, chunk int, key long").repartition("shard", "chunk").sortWithinPartitions("shard", "chunk")
    parts = rows.mapInArrow(fill, "shard int, chunk int, bits binary").toArrow().to_pylist()
    out = {s: Filter(n) for s, n in blocks.items()}
    for x in parts:
        bits = np.frombuffer(x["bits"], _U)
        first = 8 * x["chunk"] * _BLOCKS
        out[x["shard"]].bits[first : first + len(bits)] = bits
    return out


def near_pairs(vocabulary: DataFrame, *, filters: int = FILTERS) -> DataFrame:
    """Every near pair of words of a staged vocabulary once: a, a_n, b, b_n."""
    spark = vocabulary.sparkSession
    # the symbols of all words: a word's symbols are found once, and their number is that of the letters
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("s")).distinct().collect()
    alphabet = np.array(sorted(ord(r["s"]) for r in letters if r["s"]), np.uint32)
    blocks, slices = _filters(vocabulary, filters)
    rounds = []
    for chosen in range(slices):
        shared = spark.sparkContext.broadcast({s: (f.blocks, f.bits) for s, f in _filled(vocabulary, blocks, slices, chosen).items()})

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, chosen=chosen) -> Iterator[pa.RecordBatch]:
            known = {s: Filter(*x) for s, x in shared.value.items()}
            for batch in batches:
                words, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for length, which in _by_length(words):
                    # as many words at a time as make a piece of edits
                    many = max(1, EDITS // (length * max(1, len(alphabet))))
                    for k in range(0, len(which), many):
                        some = which[k : k + many]
                        for size, h, told in edits([words[i] for i in some], alphabet):
                            found = known.get(min(size, LONG))
                            if found is None:
                                continue
                            key = _key(h, np.array([size]))
                            if slices > 1:
                                use = np.flatnonzero(key % _U(slices) == _U(chosen))
                                hit = use[found.maybe(key[use])]
                            else:
                                hit = found.maybe(key)
                            if len(hit):
                                word, place, symbol = told(hit)
                                columns = [hashes[some[word]], np.full(len(hit), length, np.int32), h[hit].view(np.int64), np.full(len(hit), size, np.int32), place.astype(np.int32), symbol.astype(np.int32)]
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["from_hash", "from_length", "hash", "length", "place", "symbol"])

        positive = vocabulary.select("word", "hash").mapInArrow(probe, "from_hash long, from_length int, hash long, length int, place int, symbol int")
        if slices > 1:  # the filters of one slice go before the next ones come
            positive = common.stage(positive, "positives")
            shared.destroy()
        rounds.append(positive)
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    other = vocabulary.select("length", "hash", F.col("word").alias("b"), F.col("n").alias("b_n"))
    own = vocabulary.select(F.col("length").alias("from_length"), F.col("hash").alias("from_hash"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    symbol = F.when(F.col("symbol") > 0, F.decode(F.unhex(F.lpad(F.hex("symbol"), 8, "0")), "UTF-32")).otherwise("")
    edit = F.concat(F.expr("substring(a, 1, place)"), symbol, F.expr("substring(a, place + 2)"))
    return found.join(other, ["length", "hash"]).join(own, ["from_length", "from_hash"]).where(F.col("b") == edit).select("a", "a_n", "b", "b_n")


def variants(vocabulary: DataFrame, *, times: int = TIMES, filters: int = FILTERS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a staged vocabulary.

    form is the near word with the largest n, of equals the smallest, if that n is ``times`` the word's or more; root is what the forms lead to.
    """
    pairs = near_pairs(vocabulary, filters=filters)
    seen = "array(struct(a AS word, a_n AS n, struct(-b_n AS m, b AS w) AS x), struct(b AS word, b_n AS n, struct(-a_n AS m, a AS w) AS x))"
    near = pairs.select(F.explode(F.expr(seen)).alias("e")).select("e.*", F.lit(1).alias("one"))
    rows = vocabulary.select("word", "n", F.lit(0).alias("one")).unionByName(near, allowMissingColumns=True)
    best = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("one").alias("n_near"), F.min("x").alias("x"))
    has = -F.col("x.m") >= times * F.col("n")
    best = common.stage(best.select("word", "n", "n_near", F.when(has, F.col("x.w")).alias("form"), F.when(has, -F.col("x.m")).alias("form_n")), "forms")
    # n grows by ``times`` at each step, so doubling what has been followed ends after a few rounds
    ways, held = best.where("form IS NOT NULL").select("word", F.col("form").alias("root")), []
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = common.stage(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        common.drop(*held)
        ways, held = step.select("word", "root"), [step]
        if not step.where("moved").limit(1).count():
            break
    return best.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, least: int = LEAST, occurrences: int = OCCURRENCES, every: int = EVERY, times: int = TIMES, filters: int = FILTERS) -> DataFrame:
    """Words of all whole texts and their near words, as ``variants`` gives them.

    A null text has no words; a null doc_id counts as an empty one; repeated rows count again; other columns are ignored; without words that
    occur ``occurrences`` times there are no rows.
    """
    counts = word_counts(docs, least=least, every=every).where(F.col("n") >= occurrences)
    return variants(vocabulary_of(counts), times=times, filters=filters)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(common.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS h FROM o WHERE length(run) >= 7 GROUP BY doc_id, run),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) AS h FROM r, t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM c) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
x AS (SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM e a JOIN e b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM e a JOIN w ON w.word = a.p || a.s),
y AS (SELECT a, a_n, b, b_n FROM x UNION SELECT b, b_n, a, a_n FROM x),
f AS (SELECT a AS word, count(*) AS n_near, min({'m': -b_n, 'w': encode(b)}) AS best FROM y GROUP BY a),
g AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN decode(best.w) END AS form, CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n FROM w LEFT JOIN f USING (word)),
z AS (SELECT word, word AS root, 0 AS depth FROM g UNION ALL SELECT z.word, g.form, depth + 1 FROM z JOIN g ON g.word = z.root WHERE g.form IS NOT NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN (SELECT word, max_by(root, depth) AS root FROM z GROUP BY word) USING (word)
"""
