from __future__ import annotations

import gc
import hashlib
import random
import struct
import time
import weakref

import numpy as np
import pytest
from tokenizers import Tokenizer

from lagstone.llm import bpe, token_counts

P = pytest.importorskip("public_tokenizers")
POOL = [*"aaaaeettt hhe ioo\n\t '’sdréçßΣσİıǅ²½Ⅷ٣日本語🎉👍🏽́​\x1c\x85\xa0　_-=*!.,0123456789ABCDEÉ", "<|endoftext|>", "<|startoftext|>", "'ll", "'VE", "    ", "----------", "<|", "the ", "ing"]


def texts(n):
    r = random.Random(3)
    return ["".join(r.choice(POOL) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_as_the_library(name):
    own, lib = bpe.load(P.path(name)), Tokenizer.from_file(P.path(name))
    for t in texts(3000):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_many_words_together(name):
    """Words of a batch go through the tables together; the library says what each text gives, long words and special strings included."""
    own, lib = bpe.Tokenizer(open(P.path(name), encoding="utf-8").read()), Tokenizer.from_file(P.path(name))
    some = ["", "a", "ab" * 40, "x" * 63, "y" * 64, "", *texts(3000), "a", "日本" * 40]
    expected = [lib.encode(t, add_special_tokens=False).ids for t in some]
    for code, width in ("I", 4), ("H", 2), ("I", 4):
        got = own.encode_all(some, code)
        assert [list(struct.unpack(f"<{len(x) // width}{code}", x)) for x in got] == expected
    assert own.encode_all([]) == []
    pieces = sorted({p for t in some for p in own.pieces(t)})
    assert len(pieces) > bpe.FEW
    assert own.count_pieces(pieces) == [len(own.encode_piece(p)) for p in pieces]
    words, packed = own.pack_pieces(pieces, "I")
    assert sorted(words) == pieces
    assert packed == [struct.pack(f"<{len(x := own.encode_piece(w))}I", *x) for w in words]
    assert own.count_pieces([]) == []


def test_cut_as_the_pattern():
    """Texts that lie one after the other are cut as the pattern cuts each of them: contractions, gaps and kinds at every edge."""
    r, own = random.Random(7), bpe.load(P.path("byte_bpe_50k.json"))
    pool = ["'", "'s", "'re", "'l", "l", "'ll", "'ve", "'S", "t'", "d", " ", " ", "\n", "\xa0", "　", "a", "é", "日", "7", "²", "!", "-", "\x1c", "🎉", "ǅ"]
    for _ in range(3000):
        some = ["".join(r.choice(pool) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))]
        whole = "".join(some)
        begins = bpe.cut(np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, some)])).tolist()
        assert [whole[a:b] for a, b in zip(begins, [*begins[1:], len(whole)], strict=True)] == [p for t in some for p in own.any.findall(t)], some


def test_a_batch_is_cut_as_one_array(monkeypatch):
    """Byte-level texts don't go through the pattern one by one, but for those with special strings; each distinct piece is encoded once."""
    own = bpe.Tokenizer(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = [f"the word {k % 90} l'été 'tis " * 20 for k in range(300)] + ["x" * 5000, "a<|endoftext|>b", "\x00 \x00\x00"]
    searched, encoded, pieces = [], [], own.pieces
    monkeypatch.setattr(own, "pieces", lambda text: searched.append(text) or pieces(text))
    encode = getattr(own, "encode_bytes", None)
    monkeypatch.setattr(own, "encode_bytes", lambda data, offsets: encoded.append(len(offsets) - 1) or encode(data, offsets), raising=False)
    got = own.encode_all(some, "H")
    assert [list(struct.unpack(f"<{len(x) // 2}H", x)) for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in some]
    assert sorted(searched) == ["a", "b"]
    assert encoded == [len({p for t in some if "<|" not in t for p in pieces(t)})]


def test_long_words_beside_short_ones(monkeypatch):
    """Words far longer than the others of a batch go one by one, so that no batch takes a step of all for each symbol of one."""
    own, lib = bpe.Tokenizer(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r, longest = random.Random(2), []
    some = ["".join(r.choice("aethrsin") for _ in range(n)) for n in (20_000, 3_000, 700, 300, 299, *[150] * 70, *[9] * 200)]
    encode = bpe.Columns.encode
    monkeypatch.setattr(bpe.Columns, "encode", lambda self, codes, lengths: longest.append(int(lengths[0])) or encode(self, codes, lengths))
    got = own.encode_all(some)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in some]
    assert longest == [300]


def test_many_words_over_random_merges():
    """All words over three letters, some of them without a symbol of the vocabulary, together and one by one."""
    r = random.Random(5)
    for _ in range(60):
        labels, merges = list("abc"), []
        for _ in range(r.randint(0, 12)):
            a, b = r.randrange(len(labels)), r.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                labels.append(labels[a] + labels[b])
                merges.append((a, b, len(labels) - 1))
        try:
            automaton = bpe.Automaton(labels, merges)
        except ValueError:
            continue
        columns = bpe.Columns(automaton, "abcd")
        words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(300)}, key=lambda w: (-len(w), w))
        codes = np.array(["abcd".index(c) for w in words for c in w], np.uint8)
        tokens, counts = columns.encode(codes, np.array([len(w) for w in words]))
        assert [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])] == [automaton.encode_word(w) for w in words]
        with pytest.raises(ValueError):
            columns.encode(np.array([0, 3], np.uint8), np.array([2]))


def test_memory_of_a_tokenizer():
    """Its tables are small, and it goes when the last one who holds it lets go: a worker collects no cycles while a task runs."""
    own = bpe.Tokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    own.encode_all(texts(300))
    assert sum(x.nbytes for x in vars(own.columns).values()) < 40 << 20
    gc.disable()
    try:
        gone = weakref.ref(own)
        del own
        assert gone() is None
    finally:
        gc.enable()


def test_cache_keeps_two_generations():
    made = []
    cache = bpe.WordCache(lambda w: made.append(w) or w.upper(), lambda words: (words, [w.upper() for w in words]), limit=100)
    words = [f"w{k}" for k in range(250)]
    cache.learn(words[:100])
    assert [cache[w] for w in words[:100]] == [w.upper() for w in words[:100]] and not made
    cache.learn(words)
    assert [cache[w] for w in words] == [w.upper() for w in words]
    assert len(cache) <= 100 and len(cache.old) <= 100
    cache.learn(words[:3])
    assert cache["z" * 80] == "Z" * 80 and "z" * 80 not in cache


def test_gadgets_against_merging():
    """All words over three letters, with random merge lists, against merging in rank order."""
    r = random.Random(9)
    for _ in range(30):
        labels, merges = list("abc"), []
        for _ in range(r.randint(1, 12)):
            a, b = r.randrange(len(labels)), r.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                labels.append(labels[a] + labels[b])
                merges.append((a, b, len(labels) - 1))
        own = bpe.Automaton(labels, merges)
        for _ in range(150):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            ids = [labels.index(c) for c in word]
            for a, b, w in merges:
                out, i = [], 0
                while i < len(ids):
                    if ids[i : i + 2] == [a, b]:
                        out.append(w)
                        i += 2
                    else:
                        out.append(ids[i])
                        i += 1
                ids = out
            assert own.encode_word(word) == ids
            assert own.decode(ids) == word


def merged(ids, merges):
    for a, b, w in merges:
        out, i = [], 0
        while i < len(ids):
            if ids[i : i + 2] == [a, b]:
                out.append(w)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def test_transitions_against_merging():
    """The table has an arc from a token's state exactly where merging the two tokens' symbols gives the two tokens."""
    r = random.Random(11)
    lacking = 0
    for _ in range(40):
        labels, merges = list("abc"), []
        for _ in range(r.randint(1, 14)):
            a, b = r.randrange(len(labels)), r.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                labels.append(labels[a] + labels[b])
                merges.append((a, b, len(labels) - 1))
        own = bpe.Automaton(labels, merges)
        alive = [i for i, x in enumerate(labels) if merged([labels.index(c) for c in x], merges) == [i]]
        for a in alive:
            for b in alive:
                want = merged([labels.index(c) for c in labels[a] + labels[b]], merges) == [a, b]
                assert own.has_arc(a, b) == want, (labels, merges, a, b)
                lacking += not want
    assert lacking > 500


def test_long_word_takes_linear_time():
    """A word of many ambiguous places is read once: four times the length takes about four times as long."""
    own = bpe.load(P.path("byte_bpe_50k.json")).automaton
    times = []
    for n in (40_000, 160_000):
        word = "".join(random.Random(n).choice("aethrsin") for _ in range(n))
        begin = time.process_time()
        ids = own.encode_word(word)
        times.append(time.process_time() - begin)
        assert own.decode(ids) == word
    assert times[1] < 12 * times[0]


def test_improper_merges():
    with pytest.raises(ValueError, match="proper"):
        bpe.Automaton(["a", "b", "ab", "abb"], [(2, 1, 3), (0, 1, 2)])
    with pytest.raises(ValueError, match="symbols"):
        bpe.Automaton(["a", "b"], []).encode_word("ax")


def test_documents(spark, make, odd_rows):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.encode_documents(make(odd_rows), path).collect()
    assert len(got) == len(odd_rows)
    want = []
    for r in odd_rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r[0], len(ids), packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(make(odd_rows).limit(0), path).count() == 0


@pytest.mark.parametrize("frequent", [0, 5, 60_000])
def test_counts(spark, make, odd_rows, frequent):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts(40))]
    got = token_counts.token_counts(make(rows), path, limit=20, frequent=frequent).collect()
    want = []
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 20))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(make(rows).limit(0), path).count() == 0


def test_the_driver_keeps_no_tokenizer(spark, monkeypatch):
    """Once a vocabulary is shared no process holds its objects for later, and it is still compiled only once."""
    path, made = P.path("word_bpe_49k.json"), []
    load = bpe.load

    def watched(path):
        own = load(path)
        made.append(weakref.ref(own))
        return own

    first = load(path)
    kept = weakref.ref(first)
    want = first.encode_all(texts(300))
    del first
    assert kept() is None
    monkeypatch.setattr(bpe, "load", watched)
    monkeypatch.setattr(bpe.Tokenizer, "__init__", lambda self, spec: pytest.fail("compiled again"))
    shared = bpe.share(spark, path)
    assert [x() for x in made] == [None]
    assert spark.range(1).rdd.map(lambda _: shared.value.encode_all(texts(300)) == want).collect() == [True]


def test_a_kept_tokenizer_is_small():
    path = P.path("byte_bpe_50k.json")
    bpe.load(path)
    assert len(bpe._compiled[path]) < 12 << 20
