from __future__ import annotations

import hashlib
import math
import os
import random
import struct

import pytest
import tokenizers

import corpus_pipeline
from lagstone.llm import mixing, queries
from tests.llm.test_jaccard import sets_of
from tests.llm.test_quality import brute_kept

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, make, odd_rows):
    r = random.Random(2)
    words = ["the", "reason", "singing", "onwards", "attic", "outside", "stones", "another", "morning", "river", "kitchen", "table"]
    rows = [(100 + i, " ".join(r.choice(words) for _ in range(90)) + ".", "en", f"s{i % 3}") for i in range(40)]
    passage = " ".join(r.choice(words) for _ in range(60))
    near = rows[0][1].split()
    near[40] = "garden"
    planted = [(300, rows[0][1], "en", "s0"), (301, " ".join(near), "en", "s1"), *((310 + k, " ".join(r.choice(words) for _ in range(70)) + " " + passage, "en", "s2") for k in range(3))]
    docs, columns = make(rows + planted + odd_rows), corpus_pipeline.COLUMNS
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stage(stage(spark, docs, ""), "test")
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: {x.doc_id for x in got} for name, got in kept.items()}
    clean = {x[0] for x in rows}
    assert clean <= ids["quality rules"]
    assert not {2, 3, 4} & ids["quality rules"]
    assert {300, 301, *clean} & ids["n-gram Jaccard join"] == clean
    texts = {x.doc_id: x.text for x in kept["suffix-array dedup"]}
    assert passage in texts[310]
    assert passage not in texts[311]
    assert len(texts[312]) < len(planted[4][1]) - 200
    assert ids["mixing sources to target weights"] == ids["suffix-array dedup"]
    assert len(kept["BPE encoding and decoding"]) == len(kept["mixing sources to target weights"])
    assert all(len(x.ids) == 4 * x.n_tokens for x in kept["BPE encoding and decoding"])


def brute_pipeline(rows):
    """Rows (doc_id, text, lang, source) through all stages, each straight from its definition: (doc_id, source, ids) of what comes out."""
    rows = [x for x, kept in zip(rows, brute_kept([x[:3] for x in rows]), strict=True) if kept]
    # one of each group
    sets, up = sets_of(rows, 5), list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    first = {}
    for i, x in enumerate(rows):
        first.setdefault(find(i), []).append(x)
    rows = [min(group, key=lambda x: (x[0] is None, x[0] or 0)) for group in first.values()]
    # repeated passages
    seen, left = set(), []
    for doc, text, lang, source in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        data = text.encode()
        mask = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                mask[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        if not all(mask):
            left.append((doc, bytes(b for b, m in zip(data, mask, strict=True) if not m).decode("utf-8", "ignore"), lang, source))
    # the mixture
    words = {x: len([w for w in x[1].encode().split() if w]) for x in left}
    tokens = {}
    for x in left:
        tokens[x[3]] = tokens.get(x[3], 0) + words[x]
    most, least = max(tokens.values()), min(n for n in tokens.values() if n)
    exponent = max(0.0, 1 - math.log(2) / math.log(most / least)) if most > least else 0.0
    out = []
    for source in tokens:
        own = [x for x in left if x[3] == source]
        assert len(own) < mixing.BLOCK_DOCS  # one block
        rep = (tokens[source] / most) ** (exponent - 1)
        rest, before = (rep - math.floor(rep + 1e-9)) * tokens[source], 0
        key = lambda x: str(x[0]) if x[0] is not None else "null|" + hashlib.md5(x[1].encode()).hexdigest()
        for x in sorted(own, key=lambda x: hashlib.md5(f"{key(x)}|mix".encode()).hexdigest()):
            out += [x] * (math.floor(rep + 1e-9) + (rest > 1e-6 and before + words[x] / 2 <= rest))
            before += words[x]
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [(x[0], x[3], struct.pack(f"<{len(ids)}I", *ids)) for x in out for ids in [library.encode(x[1], add_special_tokens=False).ids]]


def test_against_brute_force(spark, make):
    r = random.Random(27)
    words = ["the", "reason", "singing", "onwards", "attic", "outside", "stones", "another", "morning", "river", "kitchen", "table", "façade", "日本語"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    rows = [(i, text(r.choice([60, 90, 140])), r.choice(["en", "fr"]), r.choice(["s0", "s0", "s0", "s1", "s2", None])) for i in range(150)]
    passage = text(45)
    rows += [(200 + i, text(60) + " " + passage + " " + text(30), "en", "s1") for i in range(8)]
    rows += [(300 + i, " ".join("moved" if j == 9 * i else w for j, w in enumerate(rows[5][1].split())), "en", "s2") for i in range(4)] + [(310, rows[7][1], "fr", "s0"), (None, rows[8][1], "en", "s0"), (None, text(80), "en", "s1")]
    rows += [(320 + i, text(20), "en", "s1") for i in range(5)] + [(330, "again and again " * 40, "en", "s0"), (331, None, "en", "s0"), (332, "", None, None), (333, " ".join(w + "%&$#" for w in text(70).split()), "en", "s0")]
    r.shuffle(rows)
    docs = make(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stage(stage(spark, docs, ""), "test")
    got = [(x.doc_id, x.source, bytes(x.ids)) for x in docs.collect()]
    want = brute_pipeline(rows)
    assert len(want) > 150
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    """run() gives what the stages give, and leaves no more tables than the last stage reads."""
    got = corpus_pipeline.run(spark, DATA)
    folder = corpus_pipeline.common.shared_dir(spark).removeprefix("file://")
    assert sorted(x.split("-")[0] for x in os.listdir(folder) if x.startswith("stage")) == ["stage3"]
    docs = corpus_pipeline.common.table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stage(stage(spark, docs, DATA), "test")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty(spark, make):
    docs = make([(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 13
