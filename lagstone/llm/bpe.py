"""Operator 1: BPE encoding and decoding by a tokenization automaton.

The merge list is compiled, one merge after the other, into a deterministic automaton over tokens.  At the start one state
accepts every sequence of base symbols.  The gadget for a merge ``(a, b) -> w`` looks at the transitions ``s -a-> q -b-> t``:
``a`` is redirected to a copy of ``q`` that lacks the arc ``b``, and an arc ``s -w-> t`` is added.  After the last merge the automaton
accepts exactly the sequences that BPE produces, so a word has one accepted tokenization, and so has every prefix.

All arcs with the same token lead to the same state.  While the gadgets are built, a state that a token leads to is kept as the arcs
that were cut from it and when; an arc that a later merge adds exists where the arc of its left half does.  From these the
transitions are written out once: tokens with the same row of arcs share a state, tokens with the same column share a letter, and
a bit of the table says whether a state has an arc for a letter.  The table's size follows from the vocabulary (some 20 MB for
50,000 merges).

Encoding reads a word once, from left to right.  A trie of the arc labels with links to the longest suffix tells which tokens end at a
place; the one among them whose arc leaves the state before it is the last token of that prefix.  Nothing is tried twice.  The words
that a batch of texts brings anew go through the tables together, a symbol of all of them at a time.  Where pre-tokens leave no
character out (byte-level pieces), all texts of a call are cut as one array of code points, Arrow numbers the distinct pieces, and these are
encoded together and gathered by their numbers.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import struct
import sys
import unicodedata
import weakref
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagstone.llm import common

#: Ends the last symbol of a word in vocabularies that mark word ends (a private-use character, never produced by byte symbols).
WORD_END = ""
#: Words remembered by a worker, in each of two generations; byte-level pieces only of texts with special strings.
CACHE_WORDS = 350_000
#: Words that go through the tables together, at most and at least (fewer are encoded one by one), and bytes of a word that is kept.
TOGETHER, FEW, KEPT = 16_384, 64, 64
#: Symbols whose steps are kept together.
BLOCK = 16

# White space as the tokenizers' regular expressions define it.
SPACE = r"\t-\r \x85\xa0  -     　"
# The two published pre-tokenization patterns, for any text and for ASCII text.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_PATTERN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^\sa-zA-Z0-9]+"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
BYTE_PATTERN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+(?!\S)|\s+"


@lru_cache(1)
def byte_symbols() -> str:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    shown = set(printable)
    return "".join(chr(b) if b in shown else chr(next(others)) for b in range(256))


#: What a code point is to the pre-tokenization patterns.
OTHER, LETTER, NUMBER, GAP = range(4)


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point, as the patterns' classes have it."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (GAP, f"[{SPACE}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def cut(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of ``BYTE_PATTERN`` begin; ``first`` has the places where a text begins, and the end.

    Runs of a kind are pieces.  The last gap of a run belongs to what follows it if it is a blank, else it is a piece.  An apostrophe
    that begins a piece takes the letters of its contraction with it.
    """
    n = len(codes)
    kind = kinds()[codes]
    gap = kind == GAP
    starts = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    last = gap[:-1] & ~gap[1:]
    starts[:-1] |= last
    starts[1:] &= ~(last & (codes[:-1] == 32))
    # nothing goes from one text to the next
    edges = first[(first > 0) & (first < n)]
    alone = edges[gap[edges - 1]] - 1
    starts[alone] = (alone == 0) | ~gap[alone - 1]
    starts[first[first < n]] = True
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        left = first[np.searchsorted(first, marks, "right")] - marks  # code points of its text from the mark on
        after = codes[np.minimum(marks[:, None] + (1, 2), n - 1)]
        one = np.isin(after[:, 0], [ord(c) for c in "stmd"]) & (left > 1)
        two = np.isin(after[:, 0] * 256 + after[:, 1], [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & (after[:, 1] < 256) & (left > 2)
        width = np.where(starts[marks], 2 * one + 3 * two, 0)
        taken = width > 0
        starts[marks[taken] + 1] = False
        ends = (marks + width)[taken]
        starts[ends[ends < n]] = True
    return np.flatnonzero(starts)


class _Gadgets:
    """The gadgets of the merges so far: which arc each cut, and of which halves a token is made.

    The state after a token began as that of its right half, as it was when the token was made, and so on inwards; an arc exists
    where that of its left half did when it was made.  So a cut holds for a pair of tokens if it was made between those times.
    """

    def __init__(self, n: int):
        self.n = n
        self.created, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        self.cut: dict[int, int] = {}  # arc (a, b), as a * n + b -> the rank of the merge that removed it
        self.after: dict[int, list[int]] = {}  # a -> the ranks of its cuts
        self.before: dict[int, list[int]] = {}  # b -> the ranks of its cuts
        self.dead: set[int] = set()
        self.used: set[int] = set()  # tokens of the halves so far, which no later merge may make

    def add(self, rank: int, a: int, b: int, w: int) -> None:
        self.used.update((a, b))
        if self.created[w] or w in self.used:
            raise ValueError(f"merge {rank} is not a proper one")
        alive = a not in self.dead and b not in self.dead and self._has_arc(a, b)
        self.created[w], self.left[w], self.right[w] = rank, a, b
        if alive:
            self.cut[a * self.n + b] = rank
            self.after.setdefault(a, []).append(rank)
            self.before.setdefault(b, []).append(rank)
        else:
            self.dead.add(w)

    def _has_arc(self, last: int, x: int) -> bool:
        created, left, cut, n = self.created, self.left, self.cut, self.n
        before = 1 << 60
        while last >= 0:
            since, y, until = created[last], x, 1 << 60
            while y >= 0:
                rank = cut.get(last * n + y)
                if rank is not None and since < rank < before and created[y] < rank <= until:
                    return False
                until, y = created[y], left[y]
            before, last = since, self.right[last]
        return True

    def cuts_after(self, last: int) -> frozenset[int]:
        """The cuts that the state after ``last`` has."""
        out, before = [], 1 << 60
        while last >= 0:
            since = self.created[last]
            out += [rank for rank in self.after.get(last, ()) if since < rank < before]
            before, last = since, self.right[last]
        return frozenset(out)

    def cuts_before(self, x: int) -> frozenset[int]:
        """The cuts that take the arc ``x`` away."""
        out, until = [], 1 << 60
        while x >= 0:
            since = self.created[x]
            out += [rank for rank in self.before.get(x, ()) if since < rank <= until]
            until, x = since, self.left[x]
        return frozenset(out)


class Automaton:
    """The deterministic automaton of a merge list.

    ``labels[i]`` is what decoding emits for token ``i`` and ``arcs[i]`` what encoding reads (the labels, if not given); ``merges`` holds
    ``(left, right, result)`` ids in rank order.  Every merge must make a token of its own from tokens that exist by then, else ValueError.
    """

    def __init__(self, labels: Sequence[str], merges: Iterable[tuple[int, int, int]], arcs: Sequence[str] | None = None):
        self.labels = list(labels)
        gadgets = _Gadgets(len(self.labels))
        for rank, merge in enumerate(merges, 1):
            gadgets.add(rank, *merge)
        self._transitions(gadgets)
        self._trie(list(arcs if arcs is not None else labels), gadgets.dead)

    def _transitions(self, gadgets: _Gadgets) -> None:
        """Write out the table: ``table`` has a bit for each state and letter, a token's state begins at bit ``state[token]``."""
        states, letters = {}, {}
        self.state, self.letter = [0] * gadgets.n, [0] * gadgets.n
        for x in range(gadgets.n):
            if x not in gadgets.dead:
                self.state[x] = states.setdefault(gadgets.cuts_after(x), len(states))
                self.letter[x] = letters.setdefault(gadgets.cuts_before(x), len(letters))
        lacking: dict[int, list[int]] = {}
        for cuts, k in letters.items():
            for rank in cuts:
                lacking.setdefault(rank, []).append(k)
        columns = {rank: np.array(x) for rank, x in lacking.items()}
        width = -(-max(1, len(letters)) // 8) * 8
        rows = []
        for cuts in states:
            row = np.ones(width, bool)
            for rank in cuts:
                if rank in columns:
                    row[columns[rank]] = False
            rows.append(np.packbits(row, bitorder="little").tobytes())
        self.table = b"".join(rows)
        self.state = [k * width for k in self.state]

    def _trie(self, arcs: list[str], dead: set[int]) -> None:
        """The trie of the arc labels: ``step`` by node and symbol, ``link`` to the longest suffix, ``ending``: the tokens that end there."""
        self.step: list[dict[str, int]] = [{}]
        whole, nodes = [-1], []
        for token, label in enumerate(arcs):
            if token in dead or not label:
                continue
            at = 0
            for depth, c in enumerate(label, 1):
                after = self.step[at].setdefault(c, len(self.step))
                if after == len(self.step):
                    nodes.append((depth, after, at, c))
                    self.step.append({})
                    whole.append(-1)
                at = after
            whole[at] = token
        self.link = [0] * len(self.step)
        # of each token: its number, length, letter and state; longest first
        self.ending: list[tuple[tuple[int, int, int, int], ...]] = [()] * len(self.step)
        none: dict[str, int] = {}
        for depth, node, parent, c in sorted(nodes):
            if depth > 1:
                at = self.link[parent]
                while at and c not in self.step[at]:
                    at = self.link[at]
                self.link[node] = self.step[at].get(c, 0)
            x, self.ending[node] = whole[node], self.ending[self.link[node]]
            if x >= 0:
                self.ending[node] = ((x, depth, self.letter[x], self.state[x]), *self.ending[node])
        self.step = [x or none for x in self.step]

    def has_arc(self, last: int, x: int) -> bool:
        """Whether the state that ``last`` leads to has an arc ``x``."""
        at = self.state[last] + self.letter[x]
        return bool(self.table[at >> 3] >> (at & 7) & 1)

    def encode_word(self, word: str) -> list[int]:
        """The one accepted token sequence that spells ``word``; ValueError if its symbols aren't all in the vocabulary."""
        step, link, ending, table = self.step, self.link, self.ending, self.table
        last, states = [], []  # of each prefix: the token that ends its sequence and its length; the state after it, -1 where there is none
        at = 0
        for end, c in enumerate(word):
            after = step[at].get(c)
            while after is None:
                if not at:
                    raise ValueError("the word has symbols that the vocabulary lacks")
                at = link[at]
                after = step[at].get(c)
            at = after
            for x, width, letter, state in ending[at]:
                if width > end:
                    break
                before = states[end - width]
                if before >= 0:
                    k = before + letter
                    if table[k >> 3] >> (k & 7) & 1:
                        break
            else:
                x = width = state = -1
            last.append((x, width))
            states.append(state)
        out, end = [], len(word) - 1
        while end >= 0:
            x, width = last[end]
            if x < 0:
                raise ValueError("the word has symbols that the vocabulary lacks")
            out.append(x)
            end -= width
        out.reverse()
        return out

    def decode(self, ids: Iterable[int], joint: str = "") -> str:
        """The arc labels, in order."""
        return joint.join(map(self.labels.__getitem__, ids))


class Columns:
    """An automaton's tables as arrays, by which many words take a step at a time.

    ``alphabet[i]`` is the symbol that code ``i`` stands for.  A node's row is that of its link with the node's own arcs, and a node without arcs
    shares its link's row.  Rows are lists of blocks of 16 symbols, and a block without own arcs is the link's: ``step`` has the distinct blocks,
    ``block`` those of each row, so a symbol is two look-ups in tables that grow with the arcs.
    """

    def __init__(self, automaton: Automaton, alphabet: str):
        codes = {c: i for i, c in enumerate(alphabet)}
        n = len(automaton.step)
        self.row, self.depth = np.zeros(n, np.int32), np.zeros(n, np.int32)
        wide = -(-len(alphabet) // BLOCK)
        self.block = np.zeros((sum(map(bool, automaton.step)) + 1, wide), np.int32)
        blocks = [array("i", bytes(4 * BLOCK))]
        self.ends = np.zeros(n, np.int32)  # the longest suffix that is a token, and after that the next shorter one; 0 for none
        self.shorter = np.zeros(n, np.int32)
        self.token = np.full(n, -1, np.int32)
        rows, level = 0, [0]
        while level:
            deeper = []
            for node in level:
                link, arcs = automaton.link[node], automaton.step[node]
                ending = automaton.ending[node]
                whole = bool(ending) and ending[0][1] == self.depth[node]
                self.token[node] = ending[0][0] if whole else -1
                self.shorter[node] = self.ends[link] if node else 0
                self.ends[node] = node if whole else self.shorter[node]
                if not arcs:
                    self.row[node] = self.row[link]
                    continue
                if node:
                    rows += 1
                    self.block[rows] = self.block[self.row[link]]
                    self.row[node] = rows
                own = set()
                for c, after in arcs.items():
                    self.depth[after] = self.depth[node] + 1
                    deeper.append(after)
                    if c in codes:
                        k = codes[c] // BLOCK
                        if k not in own:
                            own.add(k)
                            blocks.append(blocks[self.block[rows, k]][:])
                            self.block[rows, k] = len(blocks) - 1
                        blocks[self.block[rows, k]][codes[c] % BLOCK] = after
            level = deeper
        self.step = np.frombuffer(b"".join(blocks), np.int32).reshape(-1, BLOCK)
        self.letter, self.state = np.array(automaton.letter, np.int64), np.array(automaton.state, np.int64)
        self.table = np.frombuffer(automaton.table, np.uint8)

    def encode(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words, one after the other, and how many each has; words come longest first, their codes one after the other."""
        n, longest = len(lengths), int(lengths[0])
        symbols = np.zeros((n, longest), np.uint8)
        symbols[np.arange(longest) < lengths[:, None]] = codes
        symbols = np.ascontiguousarray(symbols.T)
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # how many words have a symbol at each place
        last = np.zeros((longest, n), np.int32)  # the node of the token that ends each prefix
        states = np.full((longest + 1) * n, -1, np.int64)
        states[:n] = -2  # the first state, which has all arcs
        at = np.zeros(n, np.int32)
        for end, m in enumerate(alive.tolist()):
            c = symbols[end, :m]
            at = self.step[self.block[self.row[at[:m]], c // BLOCK], c % BLOCK]
            if not at.all():
                raise ValueError("the word has symbols that the vocabulary lacks")
            word, node = np.arange(m), self.ends[at]
            while True:
                found = node > 0
                if not found.all():
                    word, node = word[found], node[found]
                if not len(word):
                    break
                x = self.token[node]
                before = states[(end + 1 - self.depth[node]) * n + word]
                bit = np.maximum(before, 0) + self.letter[x]
                fits = (before == -2) | ((before >= 0) & (self.table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0))
                done = word[fits]
                last[end, done] = node[fits]
                states[(end + 1) * n + done] = self.state[x[fits]]
                word, node = word[~fits], self.shorter[node[~fits]]
        counts = np.zeros(n, np.int64)
        word, left, found = np.arange(n), lengths.astype(np.int64), []
        while len(word):
            node = last[left - 1, word]
            if not node.all():
                raise ValueError("the word has symbols that the vocabulary lacks")
            found.append((word, self.token[node]))
            counts[word] += 1
            left = left - self.depth[node]
            word, left = word[left > 0], left[left > 0]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int32)
        for k, (word, x) in enumerate(found, 1):
            out[ends[word] - k] = x
        return out, counts


class WordCache(dict):
    """Word -> value, two generations, so memory is bounded and frequent words stay.

    ``make`` gives the value of a word, ``make_all`` those of many words.
    """

    def __init__(self, make, make_all=None, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.make_all, self.limit, self.old = make, make_all, limit, {}

    def _keep(self, word, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) < KEPT:
            self._keep(word, value)
        return value

    def learn(self, words: Iterable[str]) -> None:
        """Make the values that ``words`` lack together; long words are left to be made when they are asked for."""
        old = self.old
        lacking = [w for w in set(words).difference(self) if w not in old and len(w) < KEPT]
        if len(lacking) < FEW:
            return
        for at in range(0, len(lacking), TOGETHER):
            part = lacking[at : at + TOGETHER]
            for word, value in zip(*self.make_all(part), strict=True):
                self._keep(word, value)


class Tokenizer:
    """A byte-level BPE vocabulary of a ``.json`` file, encoded by the automaton.

    Understands the two layouts of such files: words with an end mark (normalised to NFC and lower case, white space dropped)
    and plain byte-level pieces.  Anything else raises ValueError.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("this kind of vocabulary is not supported")
        self.words = bool(suffix)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != (["NFC", "Replace", "Lowercase"] if self.words else []) or (not self.words and spec.get("normalizer")) or any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("this normalisation is not supported")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for x, i in vocab.items():
            labels[i] = x
        arcs = [x[: -len(suffix)] + WORD_END if suffix and x.endswith(suffix) and x != suffix else x for x in labels]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b if not suffix or not a.endswith(suffix) else a[: -len(suffix)] + b]) for a, b in pairs]
        self.automaton = Automaton(labels, merges, arcs)
        for x, i in self.special.items():
            self.automaton.labels[i] = x
        self.decoder = (spec.get("decoder") or {}).get("type")
        self._ready()

    def _ready(self) -> None:
        symbols = byte_symbols()
        self.bytes_to_symbols = {i: c for i, c in enumerate(symbols)}
        self.symbols_to_bytes = {c: i for i, c in enumerate(symbols)}
        self.any = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.ascii = re.compile(WORD_PATTERN_ASCII if self.words else BYTE_PATTERN_ASCII, re.ASCII)
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.columns = None
        # no strong reference back: a worker gives a tokenizer up when its next task begins, and only a task's end collects cycles
        own = weakref.proxy(self)
        self.packed = {
            code: WordCache(lambda w, code=code: struct.pack(f"<{len(x := own.encode_piece(w))}{code}", *x), lambda words, code=code: own.pack_pieces(words, code))
            for code in "IH"
        }

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("words", "special", "automaton", "decoder")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if text.isascii():
            return self.ascii.findall(text.lower() if self.words else text)
        if self.words:
            text = unicodedata.normalize("NFC", text)
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return self.any.findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of ordinary text (id -1) and special tokens, in order."""
        at = 0
        for m in self.split_special.finditer(text):
            yield text[at : m.start()], -1
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], -1

    def encode_piece(self, piece: str) -> list[int]:
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes_to_symbols)
        return self.automaton.encode_word(word + WORD_END if self.words else word)

    def _columns(self) -> Columns:
        if self.columns is None:
            symbols = byte_symbols()
            # byte 255 is in no UTF-8 text, so its place is free for the mark of a word's end
            self.columns = Columns(self.automaton, symbols[:255] + WORD_END if self.words else symbols)
        return self.columns

    def encode_pieces(self, pieces: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The order in which the pieces (none of them empty) are taken, their tokens in that order, and how many each has."""
        words = [w.encode("utf-8", "surrogatepass") for w in pieces]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + self.words
        order = np.argsort(-lengths, kind="stable").tolist()
        end = b"\xff" * self.words
        codes = np.frombuffer(end.join([words[k] for k in order]) + end, np.uint8)
        return order, *self._columns().encode(codes, lengths[order])

    def pack_pieces(self, pieces: list[str], code: str) -> tuple[list[str], list[bytes]]:
        """The pieces in some order, and the packed ids of each."""
        order, tokens, counts = self.encode_pieces(pieces)
        width = struct.calcsize(f"<{code}")
        packed = tokens.astype(f"<u{width}").tobytes()
        ends = (np.cumsum(counts) * width).tolist()
        return [pieces[k] for k in order], [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """How many ids each piece has."""
        out = [0] * len(pieces)
        short = [k for k, w in enumerate(pieces) if 0 < len(w) < KEPT]
        for k, w in enumerate(pieces):
            if len(w) >= KEPT:
                out[k] = len(self.encode_piece(w))
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            order, _, counts = self.encode_pieces([pieces[k] for k in part])
            for k, n in zip(order, counts.tolist(), strict=True):
                out[part[k]] = n
        return out

    def encode_all(self, texts: Sequence[str], code: str = "I") -> list[bytes]:
        """``encode_packed`` of each text; what words they bring anew is encoded together."""
        if not self.words:
            return self._encode_cut(texts, code)
        cache, split = self.packed[code], []
        for text in texts:
            plain = "<|" not in text and not any(x in text for x in self.special)
            split.append(self.pieces(text) if plain else None)
        cache.learn(chain.from_iterable(x for x in split if x is not None))
        get = cache.__getitem__
        return [b"".join(map(get, x)) if x is not None else self.encode_packed(text, code) for text, x in zip(texts, split, strict=True)]

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode_pieces`` of the pieces that lie in ``data`` between one offset and the next, as UTF-8."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        ends = np.cumsum(lengths)
        codes = data[np.arange(ends[-1]) + np.repeat(offsets[:-1][order] - ends + lengths, lengths)]
        tokens, counts, at = [], [], 0
        while at < len(order):
            longest, together = int(lengths[at]), lengths[at : at + FEW]
            # a word that is far longer than those after it, or very long, goes alone: each symbol of it would be a step for it only
            if len(together) < FEW or longest > 2 * together[-1] or longest * FEW > TOGETHER * KEPT:
                upto = at + 1
                word = codes[ends[at] - longest : ends[at]].tobytes().decode("latin-1").translate(self.bytes_to_symbols)
                x = np.array(self.automaton.encode_word(word), np.int32)
                n = [len(x)]
            else:
                upto = min(len(order), at + min(TOGETHER, TOGETHER * KEPT // longest))
                x, n = self._columns().encode(codes[ends[at] - longest : ends[upto - 1]], lengths[at:upto])
            tokens.append(x)
            counts.append(n)
            at = upto
        return order, np.concatenate(tokens), np.concatenate(counts)

    def _encode_cut(self, texts: Sequence[str], code: str) -> list[bytes]:
        """``encode_all`` where pieces leave nothing out: the pieces of all texts are numbered, each distinct one encoded, and ids gathered."""
        plain = [k for k, text in enumerate(texts) if text and "<|" not in text and not any(x in text for x in self.special)]
        whole = "".join([texts[k] for k in plain])
        try:
            data = np.frombuffer(whole.encode(), np.uint8)
        except UnicodeEncodeError:  # lone surrogates, which Arrow has no strings for
            plain, whole = [], ""
        out = {}
        if whole:
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            first = np.cumsum([0, *(len(texts[k]) for k in plain)])
            begins = cut(codes, first)
            widths = (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF) + np.uint8(1)
            offsets = np.append(0, np.cumsum(np.add.reduceat(widths, begins, dtype=np.int64)))
            pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
            _, offsets, distinct = pieces.dictionary.buffers()
            n, width = len(pieces.dictionary), struct.calcsize(f"<{code}")
            order, tokens, counts = self.encode_bytes(np.frombuffer(distinct, np.uint8), np.frombuffer(offsets, np.int64)[: n + 1])
            ends = np.append(0, np.cumsum(counts)) * width
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(tokens.astype(f"<u{width}"))])
            rank = np.empty(n, np.int32)
            rank[order] = np.arange(n)
            _, offsets, packed = ids.take(pa.array(rank[pieces.indices.to_numpy()])).buffers()
            ends = np.frombuffer(offsets, np.int64)[np.searchsorted(begins, first)].tolist()
            packed = memoryview(packed)
            out = {k: bytes(packed[a:b]) for k, a, b in zip(plain, ends, ends[1:], strict=False)}
        return [out[k] if k in out else self.encode_packed(text, code) for k, text in enumerate(texts)]

    def encode_packed(self, text: str, code: str = "I") -> bytes:
        """The ids of a text as little-endian unsigned integers of 32 bits, or with code H of 16 bits."""
        get = self.packed[code].__getitem__
        if "<|" not in text and not any(x in text for x in self.special):
            return b"".join(map(get, self.pieces(text)))
        return b"".join(struct.pack(f"<{code}", i) if i >= 0 else b"".join(map(get, self.pieces(x))) for x, i in self.parts(text))

    def encode(self, text: str) -> list[int]:
        ids = self.encode_packed(text)
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: Sequence[int]) -> str:
        """Emit the arc labels: joined by a blank where the file has no decoder, else mapped back to bytes."""
        if self.decoder is None:
            return self.automaton.decode(ids, " ")
        out = bytearray()
        for i in ids:
            x = self.automaton.labels[i]
            codes = [self.symbols_to_bytes.get(c) for c in x]
            out += x.encode() if None in codes else bytes(codes)
        return out.decode("utf-8", "replace")


#: By path, the compressed pickle of what this process has compiled: some MB, where the objects take 60.
_compiled: dict[str, bytes] = {}


def load(path: str) -> Tokenizer:
    """The vocabulary at ``path``; a process compiles each once, and gives it up with its last user."""
    if path in _compiled:
        return pickle.loads(zlib.decompress(_compiled[path]))
    with open(path, encoding="utf-8") as f:
        tokenizer = Tokenizer(f.read())
    _compiled[path] = zlib.compress(pickle.dumps(tokenizer, pickle.HIGHEST_PROTOCOL), 1)
    return tokenizer


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary at ``path`` for all tasks; the driver, which encodes nothing, keeps neither its objects nor the memory they took."""
    shared = spark.sparkContext.broadcast(load(path))
    common.give_back()
    return shared


def encode_documents(docs: DataFrame, path: str, *, keep_ids: bool = True, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode and decode every whole text of ``docs`` with the vocabulary at ``path``.

    Returns the ``keep`` columns, n_tokens long, ids binary (little-endian unsigned 32-bit; only with ``keep_ids``), ids_sha256 and
    decoded_sha256.  One narrow pass, no shuffle; the automaton, whose size the vocabulary bounds, is broadcast.  A null text
    counts as empty: no tokens, the digests of empty strings.  Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = share(spark, path)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    n = len(keep)
    schema = docs.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_tokens long", *["ids binary"] * keep_ids, "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        for batch in batches:
            counts, ids, hashes, decoded = [], [], [], []
            for packed in tokenizer.encode_all([text or "" for text in batch.column(n).to_pylist()]):
                counts.append(len(packed) // 4)
                if keep_ids:
                    ids.append(packed)
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(tokenizer.decode(struct.unpack(f"<{len(packed) // 4}I", packed)).encode()).hexdigest())
            columns = [pa.array(counts, pa.int64()), *[pa.array(ids, pa.binary())] * keep_ids, pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = [*keep, "n_tokens", *["ids"] * keep_ids, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=names)

    return source.mapInArrow(common.lean(run), out)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the word vocabulary."""
    import public_tokenizers

    return encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
