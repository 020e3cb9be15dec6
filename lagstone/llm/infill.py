"""Operator 11: fill-in-middle transformation on seekable compressed frames.

A text is stored as independent zstandard frames of bounded size.  Each frame says how many units (a run of ASCII letters, or any other
code point), code points and bytes stand before it, so a place given in units is found by a search among these counts, and only the
frame that it lies in is decompressed.  Outputs are stored the same way.  Digests and rebuilt texts come from streams of frames in
order, so neither an output nor a rebuilt text is ever held whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

#: Bytes of text in a frame, about, and the compression level.
FRAME, LEVEL = 1 << 16, 1
#: Of 100 documents so many are rearranged, and of 100 rearranged ones so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

FRAMES = "array<struct<units:bigint,chars:bigint,bytes:bigint,data:binary>>"
_ARROW = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


def _starts(data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes after the byte ``before``: which begin a unit, and which begin a code point."""
    letter = _LETTER[data]
    lead = (data & 0xC0) != 0x80
    after = np.empty_like(letter)
    after[:1], after[1:] = _LETTER[before], letter[:-1]
    return lead & ~(letter & after), lead


class Frames:
    """A text as frames, with the counts of units, code points and bytes before each."""

    def __init__(self, frames: Sequence[dict], units: int, chars: int, size: int):
        self.frames, self.units, self.chars, self.size = frames, units, chars, size

    @classmethod
    def store(cls, chunks: Iterator[bytes], frame: int = FRAME) -> Frames:
        """Frames of the UTF-8 text that ``chunks`` make; none ends within a code point."""
        pack, found, last, units, chars, size, rest = zstandard.ZstdCompressor(level=LEVEL), [], 0, 0, 0, 0, b""

        def add(data: bytes) -> None:
            nonlocal last, units, chars, size
            unit, lead = _starts(np.frombuffer(data, np.uint8), last)
            found.append({"units": units, "chars": chars, "bytes": size, "data": pack.compress(data)})
            last, units, chars, size = data[-1], units + int(unit.sum()), chars + int(lead.sum()), size + len(data)

        for chunk in chunks:
            rest = rest + chunk if rest else chunk
            at = 0
            while len(rest) - at > frame:
                end = at + frame
                while rest[end] & 0xC0 == 0x80:
                    end -= 1
                add(rest[at:end])
                at = end
            rest = rest[at:]
        if rest:
            add(rest)
        return cls(found, units, chars, size)

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.frames[k]["data"])

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit; after the last one, those of the whole text."""
        if unit >= self.units:
            return self.size, self.chars
        # the last frame with fewer or as many units before it: one that begins within a long run has none of its own up to its end
        k = bisect_right(self.frames, unit, key=lambda f: f["units"]) - 1
        here, after = self.frames[k]["units"], self.frames[k + 1]["units"] if k + 1 < len(self.frames) else self.units
        begins, lead = _starts(np.frombuffer(self.frame(k), np.uint8), 0)
        begins = np.flatnonzero(begins)
        # where the frame begins within a run, its first letter begins no unit
        at = int(begins[unit - here + len(begins) - (after - here)])
        return self.frames[k]["bytes"] + at, self.frames[k]["chars"] + int(lead[:at].sum())

    def stream(self, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes from ``begin`` to ``end``, frame by frame."""
        end = self.size if end is None else end
        k = max(0, bisect_right(self.frames, begin, key=lambda f: f["bytes"]) - 1)
        while begin < end:
            first, data = self.frames[k]["bytes"], self.frame(k)
            yield data[begin - first : end - first]
            begin, k = first + len(data), k + 1

    def find(self, *marks: bytes) -> list[int]:
        """The first place of each mark, or -1; marks are of the same length."""
        places, tail, done = [-1] * len(marks), b"", 0
        for data in self.stream():
            data = tail + data
            for i, mark in enumerate(marks):
                if places[i] < 0:
                    at = data.find(mark)
                    places[i] = at + done - len(tail) if at >= 0 else -1
            done += len(data) - len(tail)
            tail = data[-len(marks[0]) + 1 :]
        return places


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits that belong to a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4)]


def arrange(text: Frames, doc_id: int | None, *, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, Iterator[bytes]]:
    """Form, code points of prefix and middle (None if plain), and the output as a stream."""
    h = draws(doc_id, seed)
    if not text.size or h[2] % 100 >= rate or max(text.find(PREFIX, SUFFIX, MIDDLE)) >= 0:
        return "plain", None, None, text.stream()
    (a, a_chars), (b, b_chars) = (text.cut(u) for u in sorted(x % (text.units + 1) for x in h[:2]))

    def psm() -> Iterator[bytes]:
        yield PREFIX
        yield from text.stream(0, a)
        yield SUFFIX
        yield from text.stream(b)
        yield MIDDLE
        yield from text.stream(a, b)

    def spm() -> Iterator[bytes]:
        yield SUFFIX
        yield from text.stream(b)
        yield PREFIX
        yield from text.stream(0, a)
        yield MIDDLE
        yield from text.stream(a, b)

    first = h[3] % 100 < suffix_first
    return "spm" if first else "psm", a_chars, b_chars - a_chars, spm() if first else psm()


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that ``output`` was made of, as a stream.

    A rearranged text has no marks of its own, and no mark can begin in a part and end in the mark behind it, so the first place of each counts.
    """
    if form == "plain":
        yield from output.stream()
        return
    p, s, m = output.find(PREFIX, SUFFIX, MIDDLE)
    prefix, suffix = ((p + 3, m), (s + 3, p)) if form == "spm" else ((p + 3, s), (s + 3, m))
    yield from output.stream(*prefix)
    yield from output.stream(m + 3)
    yield from output.stream(*suffix)


def _digest(chunks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for x in chunks:
        h.update(x)
    return h.hexdigest()


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)


def store(docs: DataFrame, *, frame: int = FRAME) -> DataFrame:
    """doc_id, n (units), n_chars, n_bytes (long) and frames of every whole text: a table that can be written and read at any place.

    A null text counts as empty and has no frames; a null doc_id stays null; each input row gives one row; other columns are ignored.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, x.units, x.chars, x.size, x.frames) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in [Frames.store(iter([text]), frame)]]
            yield _columns(rows, ["doc_id", "n", "n_chars", "n_bytes", "frames"], [*[pa.int64()] * 4, _ARROW])

    return source.mapInArrow(run, f"doc_id long, n long, n_chars long, n_bytes long, frames {FRAMES}")


def rearrange(stored: DataFrame, *, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, frame: int = FRAME) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output: the frames of each rearranged text, from a table that ``store`` made.

    The cuts and the form follow from a digest of ``seed`` and doc_id (of a null one: of no digits), so repeated rows are rearranged alike.  Empty texts
    and texts with a mark of their own stay plain; a plain row's numbers of code points are null.
    """
    common.prepare(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, *counts, frames in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                form, prefix, middle, chunks = arrange(Frames(frames, *counts), doc, seed=seed, rate=rate, suffix_first=suffix_first)
                output = Frames.store(chunks, frame)
                rows.append((doc, counts[0], form, prefix, middle, output.units, output.chars, output.size, output.frames))
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_units", "output_chars", "output_bytes", "output"]
            yield _columns(rows, names, [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, _ARROW])

    fields = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output_units long, output_chars long, output_bytes long, output {FRAMES}"
    return stored.select("doc_id", "n", "n_chars", "n_bytes", "frames").mapInArrow(run, fields)


def digests(rearranged: DataFrame, *, texts: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256, both from streams of the output's frames; with ``texts``
    also output and restored, as strings."""
    common.prepare(rearranged.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in range(4)]
            for form, *counts, frames in zip(*(batch.column(k).to_pylist() for k in (2, 5, 6, 7, 8)), strict=True):
                output = Frames(frames, *counts)
                found[0].append(_digest(output.stream()))
                found[1].append(_digest(restored(output, form)))
                if texts:
                    found[2].append(b"".join(output.stream()).decode())
                    found[3].append(b"".join(restored(output, form)).decode())
            names = ["output_sha256", "restored_sha256", "output", "restored"][: 4 if texts else 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x, pa.string()) for x in found[: len(names)])], names=[*rearranged_names, *names])

    rearranged_names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    fields = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string, restored string" * texts
    return rearranged.select(*rearranged_names, "output_units", "output_chars", "output_bytes", "output").mapInArrow(run, fields)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for filling in the middle.  One narrow pass: frames go from step to step, and nothing is shuffled."""
    return digests(rearrange(store(common.table(spark, sf_dir, "documents"))))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
