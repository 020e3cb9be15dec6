from __future__ import annotations

import hashlib
import random
import re

import pytest

from lagstone.llm import infill


def brute(doc_id, text, rate=90, first=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    if h[3] % 100 < first:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def text_of(r):
    pool = ["abc", "Z", " ", "\n", "é", "日", "🎉", "1", "<", "S", ">", "x" * r.randint(1, 40), "<S", "P>"]
    return "".join(r.choice(pool) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("seed", range(40))
def test_frames_find_any_unit(seed):
    """Cuts by counts and one frame each equal those in the whole text, also where a run of letters spans frames or a code point several bytes."""
    r = random.Random(seed)
    text = text_of(r)
    chunks = [text[i : i + 7].encode() for i in range(0, len(text), 7)]
    frames = infill.Frames.store(iter(chunks), r.choice([4, 5, 9, 30]))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert (frames.units, frames.chars, frames.size) == (len(units), len(text), len(text.encode()))
    assert all(len(frames.frame(k)) <= 30 for k in range(len(frames.frames)))
    for u in range(len(units) + 1):
        before = "".join(units[:u])
        assert frames.cut(u) == (len(before.encode()), len(before))
    data = text.encode()
    for _ in range(20):
        a, b = sorted(r.randint(0, len(data)) for _ in range(2))
        assert b"".join(frames.stream(a, b)) == data[a:b]
    assert frames.find(b"<S>", b"abc") == [data.find(b"<S>"), data.find(b"abc")]


def test_cut_decompresses_one_frame(monkeypatch):
    frames = infill.Frames.store(iter([b"ab 1 " * 1000]), 100)
    opened = []
    real = infill.Frames.frame
    monkeypatch.setattr(infill.Frames, "frame", lambda self, k: opened.append(k) or real(self, k))
    assert frames.cut(2002) == (5 * 500 + 3, 5 * 500 + 3)
    assert len(opened) == 1
    b"".join(frames.stream(210, 390))
    assert opened[1:] == [2, 3]


@pytest.mark.parametrize("frame", [8, 1 << 16])
def test_brute_force(make, odd_rows, frame):
    r = random.Random(5)
    rows = [*odd_rows, *((i, text_of(r)) for i in range(100, 300)), (400, "has a <M> of its own"), (401, "<<S>P>M><")]
    if frame < 100:
        rows = [(d, t) for d, t, *_ in rows if len(t or "") < 1000]
    stored = infill.store(make(rows), frame=frame)
    got = infill.digests(infill.rearrange(stored, frame=frame), texts=True).collect()
    want = [brute(row[0], row[1]) for row in rows]
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.restored) for x in got), key=repr) == sorted(want, key=repr)
    assert all(x.output_sha256 == hashlib.sha256(x.output.encode()).hexdigest() and x.restored_sha256 == hashlib.sha256(x.restored.encode()).hexdigest() for x in got)
    if frame > 100:
        assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_empty_table(make, spark):
    assert infill.digests(infill.rearrange(infill.store(make([(1, "x")]).where("doc_id < 0")))).collect() == []
