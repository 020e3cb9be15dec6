"""Operator 13: benchmark decontamination by FM-indexes of the training texts.

The words of the documents are dealt to shards of bounded size, and each shard gets an FM-index: its suffixes are sorted by prefix
doubling, the word before each suffix in that order (the Burrows-Wheeler transform) goes into a wavelet matrix, and of every suffix that
begins a document or stands at a multiple of ``SAMPLE`` words in one the position is kept.  The indexes are a table, written once, that
any benchmark can be searched in.

A benchmark's windows are searched backwards, word by word, all at once: each step maps the two ends of a window's range of suffixes by
ranks in the wavelet matrix, and a window whose range is empty drops out.  What is left is located: each suffix of the range goes
back word by word until a sampled one is met.  The spans that occurrences cover are merged, within a shard and then over those that a long
document was cut into; such cuts overlap, so no occurrence is lost.

Windows go to the tasks in blocks of bounded size, one pass over the indexes for each, so a benchmark of any size can be searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

#: Words of a window; of a shard, at most (positions and ranks take 20 bits each); distance of sampled suffixes.
WINDOW, SHARD, SAMPLE = 10, 1_000_000, 16
#: Windows and their bytes in a block, about.
BLOCK, BLOCK_BYTES = 200_000, 16 << 20

_U = np.uint64
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: A-Z to lower case, and what isn't part of a word to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if _WORD[b] else 32 for b in range(256))


def words_of(texts: Sequence[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased, as one array of bytes, and the number of words of each text."""
    data = np.frombuffer(b" ".join(x or b"" for x in texts).translate(_FOLD) + b" ", np.uint8)
    word = data != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    begins, ends = edges[word[edges]], edges[~word[edges]]
    if word[0]:
        begins = np.concatenate([[0], begins])
    offsets = np.concatenate([[0], np.cumsum(ends - begins)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[word])])
    texts_end = np.cumsum([len(x or b"") + 1 for x in texts])
    return words, np.diff(np.concatenate([[0], np.searchsorted(begins, texts_end)]))


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order.  ``ends`` are the places of separators, each smaller than any word and than the later ones."""
    n = len(symbols)
    counts = np.bincount(symbols)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    rank = first[symbols].astype(_U)  # the place where the suffixes of the same beginning begin
    rank[ends] = np.arange(len(ends), dtype=_U)
    order = np.empty(n, np.uint32)
    order[: len(ends)] = ends
    at = np.flatnonzero(symbols)  # suffixes that share their beginning with others, and the places they have
    slots = np.arange(len(ends), n)
    length, low = 1, _U((1 << 20) - 1)
    while len(at):
        keys = np.sort((rank[at] << _U(40)) | (rank[at + length] << _U(20)) | at.astype(_U))
        at = (keys & low).astype(np.int64)
        order[slots] = at
        keys >>= _U(20)
        new = np.ones(len(at) + 1, bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:-1])
        begins = np.flatnonzero(new[:-1])
        rank[at] = np.repeat(slots[begins], np.diff(np.append(begins, len(at)))).astype(_U)
        shared = ~(new[:-1] & new[1:])
        # a suffix and what follows it are in one document: those that reach its end are told apart by it
        at, slots = at[shared], slots[shared]
        length *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, packed: np.ndarray):
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(_U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, bitorder="little")

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(_U)) & _U(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))


class Index:
    """An FM-index over the symbols of a shard: 0 ends a document, k + 1 is the word k of its vocabulary."""

    def __init__(self, counts: np.ndarray, levels: list[np.ndarray], marks: np.ndarray, positions: np.ndarray):
        self.n = int(counts.sum())
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of each symbol the first suffix
        self.levels = [Bits(x) for x in levels]
        self.zeros = [self.n - int(x.rank(np.array([self.n]))[0]) for x in self.levels]
        self.marks, self.positions = Bits(marks), positions
        # where each symbol begins in the lowest level: symbols are there in the order of their reversed bits
        symbols, turned = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        for k in range(len(levels)):
            turned |= ((symbols >> k) & 1) << (len(levels) - 1 - k)
        order = np.argsort(turned)
        self.lowest = np.zeros(len(counts), np.int64)
        self.lowest[order] = np.concatenate([[0], np.cumsum(counts[order])])[:-1]

    @staticmethod
    def parts(symbols: np.ndarray, ends: np.ndarray, vocabulary: int, sample: int = SAMPLE) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """What the index of a shard is made of: counts of symbols, levels of the wavelet matrix, marks and positions of sampled suffixes."""
        order = suffix_order(symbols, ends)
        counts = np.bincount(symbols, minlength=vocabulary + 1)
        moved = symbols[order.astype(np.int64) - 1].astype(np.uint32)  # before the first word stands the last separator
        levels = []
        for k in range(max(1, int(vocabulary).bit_length()) - 1, -1, -1):
            one = (moved & np.uint32(1 << k)) != 0
            levels.append(Bits.pack(one))
            moved = np.concatenate([moved[~one], moved[one]])
        begins = np.concatenate([[0], ends[:-1] + 1])
        sampled = np.zeros(len(symbols), bool)
        sampled[begins] = True
        off = np.arange(len(symbols)) - np.repeat(begins, np.diff(np.append(begins, len(symbols))))
        sampled |= off % sample == 0
        marks = sampled[order]
        return counts, levels, Bits.pack(marks), order[marks]

    def _ranks(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the words before the first i suffixes."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (len(self.levels) - 1 - k)) & 1, zeros + ones, i - ones)
        return i - self.lowest[symbol]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur, and the first and last suffix (not included) that begins with each; rows of symbols end at the right."""
        which = np.arange(len(windows))
        last = windows[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for k in range(2, windows.shape[1] + 1):
            go = np.flatnonzero(lengths[which] >= k)
            symbol = windows[which[go], -k]
            both = self._ranks(np.concatenate([symbol, symbol]), np.concatenate([low[go], high[go]])) + np.tile(self.first[symbol], 2)
            low[go], high[go] = both[: len(go)], both[len(go) :]
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: back word by word to a sampled one."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            known = self.marks.get(rows)
            out[todo[known]] = self.positions[self.marks.rank(rows[known])] + steps
            todo, i = todo[~known], rows[~known]
            symbol = np.zeros(len(i), np.int64)
            for bits, zeros in zip(self.levels, self.zeros, strict=True):
                one, ones = bits.get(i), bits.rank(i)
                i = np.where(one, zeros + ones, i - ones)
                symbol = (symbol << 1) | one
            rows = self.first[symbol] + i - self.lowest[symbol]
            steps += 1
        return out


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans of each document, in order."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    # spans of later documents lie behind those of earlier ones, so that one running maximum serves all
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * far)
    new = np.ones(len(doc), bool)
    new[1:] = begin[1:] + doc[1:] * far > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], begin[at], reach[np.append(at[1:], len(doc)) - 1] - doc[at] * far


INDEX = "docs array<struct<row:bigint,doc_id:bigint,first:bigint,words:bigint,n_words:bigint>>, vocabulary binary, counts binary, levels array<binary>, marks binary, positions binary"
_DOCS = pa.list_(pa.struct([(x, pa.int64()) for x in ("row", "doc_id", "first", "words", "n_words")]))


def index_documents(docs: DataFrame, *, longest: int = WINDOW, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """The FM-indexes of all whole texts, staged: a row for each shard, with the documents in it.

    Windows of up to ``longest`` words can be searched: a document of more words than a shard is cut, and its parts share ``longest - 1`` words.
    """
    common.prepare(docs.sparkSession)
    if shard >= (1 << 20) - 1 or shard < 2 * longest:
        raise ValueError("a shard has two windows of words at least, and under 2 ** 20 - 1")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = [], [], 0  # documents and words of the shard so far

        def close() -> pa.RecordBatch:
            nonlocal held, parts, size
            words = pa.chunked_array(parts, pa.large_binary()).combine_chunks().dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            lengths = np.array([x["words"] for x in held], np.int64)
            ends = np.cumsum(lengths + 1) - 1
            symbols = np.zeros(int(lengths.sum()) + len(held), np.int64)
            is_word = np.ones(len(symbols), bool)
            is_word[ends] = False
            symbols[is_word] = words.indices.to_numpy().astype(np.int64) + 1
            counts, levels, marks, positions = Index.parts(symbols, ends, len(words.dictionary), sample)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("word", pa.large_binary())])) as writer:
                writer.write_batch(pa.record_batch([words.dictionary], names=["word"]))
            cells = [held, sink.getvalue().to_pybytes(), counts.astype("<u4").tobytes(), [x.tobytes() for x in levels], marks.tobytes(), positions.astype("<u4").tobytes()]
            held, parts, size = [], [], 0
            types = [_DOCS, pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=["docs", "vocabulary", "counts", "levels", "marks", "positions"])

        for batch in batches:
            rows, ids, texts = (c.to_pylist() for c in batch.columns)
            words, lengths = words_of(texts)
            at = 0
            for row, doc, n in zip(rows, ids, lengths.tolist(), strict=True):
                first = 0
                while True:
                    room = shard - size - len(held) - 1
                    if n - first > room and held and (n < shard // 2 or room < 2 * longest):
                        yield close()
                        continue
                    take = min(n - first, room)
                    held.append({"row": row, "doc_id": doc, "first": first, "words": take, "n_words": 0 if first else n})
                    parts.append(words.slice(at + first, take))
                    size += take
                    if first + take == n:
                        break
                    first += take - longest + 1
                at += n
        if held:
            yield close()

    return common.stage(source.mapInArrow(build, INDEX), "fm-index")


def windows_of(benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """window (words joined by blanks) and item (item_id as text), distinct: every ``window`` consecutive words of each item, or all of a shorter one."""
    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").translate(_FOLD).split()
                if words:
                    found = [b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    return source.mapInArrow(run, "window binary, item string").distinct()


def _table(windows: pa.Table) -> dict:
    """Of a block of windows: its words, the windows as rows of their numbers, and the items that each window stands in."""
    distinct = windows.column("window").combine_chunks().dictionary_encode()
    if isinstance(distinct, pa.ChunkedArray):
        distinct = distinct.combine_chunks()
    split = [w.split(b" ") for w in distinct.dictionary.to_pylist()]
    lengths = np.array([len(x) for x in split], np.int64)
    words = pa.array([y for x in split for y in x], pa.large_binary()).dictionary_encode()
    rows = np.full((len(split), int(lengths.max(initial=1))), -1, np.int64)
    rows[np.arange(rows.shape[1])[None, :] >= rows.shape[1] - lengths[:, None]] = words.indices.to_numpy()
    order = np.argsort(distinct.indices.to_numpy(), kind="stable")
    return {"words": words.dictionary, "rows": rows, "lengths": lengths, "items": np.array(windows.column("item").to_pylist(), object)[order], "edges": np.searchsorted(distinct.indices.to_numpy()[order], np.arange(len(split) + 1))}


def search(indexes: DataFrame, windows: DataFrame, *, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, spans (array of begin and end, in words) and items of every document part that windows occur in; a part may have several rows."""
    spark = indexes.sparkSession
    windows = common.stage(windows, "windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0))).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / block), math.ceil((size["bytes"] or 0) / block_bytes))
    fields = "row long, spans array<struct<begin:bigint,end:bigint>>, items array<string>"
    found = None
    for k in range(blocks):
        some = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k) if blocks > 1 else windows
        shared = spark.sparkContext.broadcast(_table(some.toArrow()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    got = _hits(batch.slice(i, 1), table)
                    if got is not None:
                        yield got

        hits = indexes.mapInArrow(run, fields)
        if blocks > 1:  # the windows of one block go before the next ones come
            hits = common.stage(hits, "hits")
            shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def _hits(shard: pa.RecordBatch, table: dict) -> pa.RecordBatch | None:
    """Merged spans and items of the documents of one shard."""
    docs, vocabulary, counts, levels, marks, positions = (c[0] for c in shard.columns)
    known = pa.ipc.open_stream(pa.py_buffer(vocabulary.as_py())).read_all().column(0).combine_chunks()
    symbols = pc.index_in(table["words"], value_set=known).fill_null(-1).to_numpy().astype(np.int64) + 1
    rows = np.where(table["rows"] >= 0, symbols[table["rows"]], -1) if len(table["words"]) else table["rows"]
    whole = np.flatnonzero((rows != 0).all(axis=1)) if len(rows) else np.zeros(0, np.int64)
    if not len(whole):
        return None
    index = Index(np.frombuffer(counts.as_py(), "<u4").astype(np.int64), [np.frombuffer(x.as_py(), np.uint8) for x in levels], np.frombuffer(marks.as_py(), np.uint8), np.frombuffer(positions.as_py(), "<u4").astype(np.int64))
    which, low, high = index.search(rows[whole], table["lengths"][whole])
    if not len(which):
        return None
    many = high - low
    place = index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()))
    window = np.repeat(whole[which], many)
    parts = docs.values
    lengths = parts.field("words").to_numpy()
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    part = np.searchsorted(begins, place, "right") - 1
    begin = place - begins[part]
    doc, a, b = _merged(part, begin, begin + table["lengths"][window])
    first = parts.field("first").to_numpy()
    seen = np.unique(np.stack([part, window], axis=1), axis=0)
    edges = np.searchsorted(seen[:, 0], np.unique(doc))
    items = [{x for w in some.tolist() for x in table["items"][table["edges"][w] : table["edges"][w + 1]] if x is not None} for some in np.split(seen[:, 1], edges[1:])]
    ids, at = np.unique(doc, return_index=True)
    spans = [[{"begin": int(x), "end": int(y)} for x, y in zip(p, q, strict=True)] for p, q in zip(np.split(a + first[doc], at[1:]), np.split(b + first[doc], at[1:]), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(parts.field("row").to_numpy()[ids]), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["row", "spans", "items"]
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard: int = SHARD, sample: int = SAMPLE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (array of begin and end, in words: what is to be removed), n_hit, items (sorted) of every document.

    A null text has no words, as an empty one; a null doc_id stays null; each input row gives one row, repeated ones as well; an item without
    words has no windows, and one whose item_id is null marks words but isn't listed; of repeated items one counts; an empty benchmark hits
    nothing; other columns are ignored.
    """
    indexes = index_documents(docs, longest=window, shard=shard, sample=sample)
    hits = search(indexes, windows_of(benchmark, window=window), block=block, block_bytes=block_bytes)
    rows = indexes.select(F.explode("docs").alias("d")).select("d.row", "d.doc_id", "d.n_words")
    both = rows.unionByName(hits, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    # parts of one document and blocks of windows may overlap
    union = F.expr("""aggregate(array_sort(spans), cast(array() AS array<struct<begin:bigint,end:bigint>>), (made, x) -> CASE
        WHEN size(made) = 0 OR element_at(made, -1).end < x.begin THEN concat(made, array(x))
        ELSE concat(slice(made, 1, size(made) - 1), array(named_struct('begin', element_at(made, -1).begin, 'end', greatest(element_at(made, -1).end, x.end)))) END)""")
    both = both.withColumn("spans", F.when(F.size("spans") > 1, union).otherwise(F.col("spans")))
    return both.select("doc_id", "n_words", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"]).alias("n_hit"), "items")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of the benchmark."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.k, p.s, i.item_id FROM p JOIN i USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
