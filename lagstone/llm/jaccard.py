"""Operator 8: n-gram Jaccard join over prefix trees.

Each distinct n-gram set is a node, ordered by one global order, that of the n-grams' hashes.  The range of hashes is cut into so many
parts that two sets that are similar enough differ in fewer of them, so several parts are the same in both; nodes that have a part in
common form a group around the least of them, the centre.  In a group the ordered sets are stored in a path-compressed trie; a probe
traverses it once, sharing the overlap of common beginnings, and a subtree is left as soon as the remaining lengths can't reach the
overlap that its shortest set needs.  Probes are the centre and all that it isn't linked to; pairs already connected in the group are
passed by, so no group is expanded into pairs.

The number of parts follows from the sizes: sets are dealt to classes of size, and a set takes part in the next class too if a set
of that can be similar to it.  There are more parts than differences, by two quotas.  A set leaves out its smallest parts up to the one quota:
they are what unrelated texts have in common.  It leaves out the parts that most sets have up to the other: so a passage of very many
texts makes no group.  Similar sets have more equal parts than both quotas, and each leaves out a beginning of the same order, so one
equal part stays in both.  Short sets have no parts: those that differ by one n-gram are joined by what they have without it.

Groups that are large by sets or n-grams are dealt over several tasks, each with the centre; what isn't linked to the centre then
meets the other blocks in a second round.  Only node ids travel until then; a text is fetched once for its node.  Links are joined to
components by star rounds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagstone.llm import common
from lagstone.llm.components import components

WORDS, SIMILAR = 3, 90
#: Nodes and n-grams of one block of a group, about.
BLOCK, BLOCK_NGRAMS = 2048, 1 << 21
#: Ratio of the bounds of a class of sizes.
RATIO = 1.25
#: Tokens of a trie edge that are compared before the bound is looked at again, at most 255.
STEP = 128
#: Bytes of the table of the probes that traverse a trie together.
TABLE = 1 << 25

_M = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams; with fewer words, one for the whole sequence."""
    data = text.encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))
    n = min(words, len(data))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * _M
            out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(hashes: np.ndarray) -> int | None:
    """A 64-bit hash of the set, by which it is known; none of an empty set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None


#: In place of a quota: the part is the node itself, or a node that has one n-gram less.
OWN, WITHOUT = -2, -1
#: The largest size in each class.
_LARGEST = sorted({int(RATIO**k) for k in range(1, 130)})


def signatures(hashes: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of a set in each of its classes, without the smallest; with each the class and its quota of common parts, as one number.

    In a class whose sets have ``top`` n-grams at most, similar ones differ in ``off`` n-grams at most, and so in no more parts.  Where ``off`` is
    0 only equal sets are similar, and these are one node: there are no parts.  Where it is 1, one set has all of the other and one n-gram more: in
    place of parts there are the set itself and what it is without each of its n-grams, as nodes, marked by ``OWN`` and ``WITHOUT``.
    """
    n, out, quotas = len(hashes), [], []
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(29)), dtype=np.uint64)])
    c = bisect_left(_LARGEST, n)
    while True:
        off = (100 - similar) * 2 * _LARGEST[c] // (100 + similar)
        if off < 2:
            if off and 100 * n >= similar * (n + 1) and not any(q[0] == OWN for q in quotas):  # a set with one n-gram more is similar
                out.append(np.array([node_of(hashes)], np.int64).view(np.uint64))
                quotas.append(np.array([OWN], np.int32))
            if off and 100 * (n - 1) >= similar * n and not any(q[0] == WITHOUT for q in quotas):
                out.append(np.array([node_of(np.delete(hashes, k)) for k in range(n)], np.int64).view(np.uint64))
                quotas.append(np.full(n, WITHOUT, np.int32))
            if 100 * n < similar * (_LARGEST[c] + 1):
                break
            c += 1
            continue
        small, common_ = 2 + off * 3 // 20, 1 + off // 20
        parts = off + 1 + small + common_
        edges = np.searchsorted(hashes >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
        edges[-1] = n
        size = np.diff(edges)
        # whole levels of size are left out, so that another set leaves out the same parts of those that are equal
        use = np.flatnonzero(size >= np.searchsorted(np.cumsum(np.bincount(size)), small, "right"))
        with np.errstate(over="ignore"):
            x = (sums[edges[use + 1]] - sums[edges[use]] + np.uint64(c * 1_000_003 + 1)) * _M + use.astype(np.uint64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(27)))
        quotas.append(np.full(len(use), (c << 24) | common_, np.int32))
        if 100 * n < similar * (_LARGEST[c] + 1):
            break
        c += 1
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, np.int32), *quotas])


class _Node:
    """A path of tokens from depth ``start`` to ``end`` of the sets below; ``here``: those that end with it, ``only``: the one below, if it is one."""

    __slots__ = ("children", "end", "first", "here", "least", "most", "only", "start")

    def __init__(self, start: int, end: int, first: int, least: int, most: int, only: int | None):
        self.start, self.end, self.first, self.least, self.most, self.only = start, end, first, least, most, only
        self.children: list[_Node] = []
        self.here: list[int] = []


class Trie:
    """A path-compressed prefix tree of ordered sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, [len(x) for x in sets]
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self._node(order, 0)
        self.root.end = 0
        work = [(self.root, order)]
        while work:
            node, members = work.pop()
            node.here = [i for i in members if self.sizes[i] == node.end]
            rest = [i for i in members if self.sizes[i] > node.end]
            at = 0
            while at < len(rest):
                token, to = sets[rest[at]][node.end], at + 1
                while to < len(rest) and sets[rest[to]][node.end] == token:
                    to += 1
                child = self._node(rest[at:to], node.end)
                node.children.append(child)
                work.append((child, rest[at:to]))
                at = to

    def _node(self, members: list[int], start: int) -> _Node:
        a, b = self.sets[members[0]], self.sets[members[-1]]
        n = min(len(a), len(b))
        off = np.flatnonzero(a[start:n] != b[start:n])
        sizes = [self.sizes[i] for i in members]
        return _Node(start, start + int(off[0]) if len(off) else n, members[0], min(sizes), max(sizes), members[0] if len(members) == 1 else None)


class Group:
    """The sets of a group in a trie, and which of them are known to be connected."""

    def __init__(self, sets: list[np.ndarray], similar: int):
        self.similar, self.sizes = similar, np.array([len(x) for x in sets], np.int64)
        tokens, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        self.tokens, self.sets = len(tokens), np.split(ranks, np.cumsum(self.sizes)[:-1])
        self.trie = Trie(self.sets)
        self.part = np.arange(len(sets))  # equal for sets that are connected

    def links(self, probes: list[int]) -> Iterator[tuple[int, int]]:
        """Links from ``probes`` to similar members; what is connected already is passed by, and of each connected part one link is given.

        Many probes traverse the trie together: a table says which of them have a token, so an edge is compared with all at once.
        """
        at = 0
        while at < len(probes):
            width, total = 0, 0
            while at + width < len(probes) and (not width or (total + self.sizes[probes[at + width]]) * (width + 1) <= TABLE):
                total += int(self.sizes[probes[at + width]])
                width += 1
            yield from self._traverse(np.array(probes[at : at + width]))
            at += width

    def _traverse(self, probes: np.ndarray) -> Iterator[tuple[int, int]]:
        used = np.unique(np.concatenate([self.sets[p] for p in probes]))
        row = np.full(self.tokens, len(used))
        row[used] = np.arange(len(used))
        table = np.zeros((len(used) + 1, len(probes)), np.uint8)
        for k, p in enumerate(probes):
            table[row[self.sets[p]], k] = 1
        similar, trie, part, sizes = self.similar, self.trie, self.part, self.sizes[probes]
        stack = [(trie.root, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            node, alive, overlap = stack.pop()
            n = sizes[alive]
            keep = 100 * np.minimum(n, node.most) >= similar * np.maximum(n, node.least)
            if node.only is not None:
                keep &= part[probes[alive]] != part[node.only]
            alive, overlap, n = alive[keep], overlap[keep], n[keep]
            source = trie.sets[node.first]
            for begin in range(node.start, node.end, STEP):
                if not len(alive):
                    break
                rows = table[row[source[begin : min(begin + STEP, node.end)]]]
                overlap = overlap + (rows if len(alive) == len(probes) else rows[:, alive]).sum(axis=0, dtype=np.uint8)
                # no more is common than the rest of the longest set below, nor than the probe has
                most = np.minimum(overlap + node.most - begin - len(rows), n)
                keep = most * (100 + similar) >= similar * (n + node.least)
                if not keep.all():
                    alive, overlap, n = alive[keep], overlap[keep], n[keep]
            if not len(alive):
                continue
            for i in node.here:
                found = probes[alive[100 * overlap >= similar * (n + self.sizes[i] - overlap)]]
                found = found[part[found] != part[i]]
                if len(found):
                    parts, first = np.unique(part[found], return_index=True)
                    yield from ((int(p), i) for p in found[first])
                    part[np.isin(part, parts)] = part[i]
            stack += [(c, alive, overlap) for c in node.children]


def _link_blocks(rows: DataFrame, words: int, similar: int) -> DataFrame:
    """From (center, block, node, text, role), sorted by center, block, role: links a, b, and with b null what the centre isn't linked to.

    Roles: 0 the centre, 1 a probe from another block, 2 a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close(key, group) -> None:
            sets = Group([ngram_hashes(t, words) for _, _, t in group], similar)
            nodes, roles = [n for n, _, _ in group], [r for _, r, _ in group]
            foreign = [i for i, r in enumerate(roles) if r == 1]
            first = [i for i, r in enumerate(roles) if r == 0] if not foreign else foreign
            links = list(sets.links(first))
            if not foreign:
                near = {i for link in links for i in link}
                rest = [i for i in range(len(nodes)) if i not in near and roles[i] != 0]
                out.extend((key[0], key[1], nodes[i], None) for i in rest)
                links += sets.links(rest) if len(nodes) > 2 else []
            out.extend((key[0], key[1], nodes[i], nodes[j]) for i, j in links)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["center", "block", "a", "b"])

        key, group = None, []
        for batch in batches:
            for center, block, node, text, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (center, block) != key:
                    if len(group) > 1:
                        close(key, group)
                    key, group = (center, block), []
                if not group or group[-1][:2] != (node, role):  # repeated rows bring a text twice
                    group.append((node, role, text))
            if len(out) > 1000:
                yield flush()
        if len(group) > 1:
            close(key, group)
        yield flush()

    rows = rows.repartition("center", "block").sortWithinPartitions("center", "block", "role", "node")
    return rows.select("center", "block", "node", "text", "role").mapInArrow(run, "center long, block int, a long, b long")


def _meet(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by part, quota and node: the first node of each part with every other (kind 0); of parts of over ``block`` nodes instead the
    part with each node and its quota (kind 1); the nodes that are another one with one n-gram more, with that (kind 2)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray, quota: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(quota)], names=["kind", "a", "b", "quota"])

    def pairs(part: np.ndarray, node: np.ndarray, large: np.ndarray, starts: np.ndarray, sizes: np.ndarray, quota: np.ndarray) -> Iterator[pa.RecordBatch]:
        big, center = np.repeat(large, sizes), np.repeat(node[starts], sizes)
        if big.any():
            yield out(1, part[big], node[big], quota[big])
        some = ~big & (center != node)
        got = np.unique(np.stack([center[some], node[some]], axis=1), axis=0)
        yield out(0, got[:, 0], got[:, 1], np.zeros(len(got), np.int32))

    held = None  # rows of the last part, which may go on, while it isn't large
    hot = None  # the last part, if it is
    own = None  # the last node that stands for itself
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        direct = rows[2] < 0
        if direct.any():
            part, node, quota = (x[direct] for x in rows)
            rows = [x[~direct] for x in rows]
            at = np.maximum.accumulate(np.where(quota == OWN, np.arange(len(part)), -1))
            before = np.where(at >= 0, part[at], part[0] if part[0] == own else ~part)
            found = (quota == WITHOUT) & (before == part)
            yield out(2, part[found], node[found], np.zeros(found.sum(), np.int32))
            own = part[at[-1]] if at[-1] >= 0 else own
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        part, node, quota = (x[new] for x in rows)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sizes = np.diff(np.append(starts, len(part)))
        large = sizes > block
        large[0] |= part[0] == hot
        held, hot = None, part[-1] if large[-1] else None
        if hot is None:
            held, starts, sizes, large = [x[starts[-1] :] for x in (part, node, quota)], starts[:-1], sizes[:-1], large[:-1]
            part, node, quota = (x[: len(x) - len(held[0])] for x in (part, node, quota))
        if len(part):
            yield from pairs(part, node, large, starts, sizes, quota)
    if held is not None:
        yield from pairs(*held[:2], np.zeros(1, bool), np.zeros(1, np.int64), np.array([len(held[0])]), held[2])


def _groups(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """center and node from the parts of nodes (part, node, quota), and the links a, b that are known without their sets.

    Of parts of over ``block`` nodes each node leaves out its most common ones up to its quota; only rows of such parts travel again.
    """
    rows = rows.repartition("part").sortWithinPartitions("part", "quota", "node")
    found = common.stage(rows.mapInArrow(lambda batches: _meet(batches, block), "kind int, a long, b long, quota int").distinct(), "groups")
    pairs = found.where("kind = 0").select(F.col("a").alias("center"), F.col("b").alias("node"))
    large = found.where("kind = 1").select(F.col("a").alias("part"), F.col("b").alias("node"), "quota")
    direct = found.where("kind = 2").select("a", "b")
    if not large.limit(1).count():
        return pairs, direct
    large = large.join(large.groupBy("part").agg(F.count(F.lit(1)).alias("nodes")), "part")
    order = Window.partitionBy("node", "quota").orderBy(F.col("nodes").desc(), "part")
    large = large.withColumn("rank", F.row_number().over(order)).where(F.col("rank") > F.col("quota").bitwiseAND(F.lit((1 << 24) - 1))).select("part", "node")
    large = common.stage(large, "large-parts")
    large_pairs = large.join(large.groupBy("part").agg(F.min("node").alias("center")), "part").where("node != center").select("center", "node")
    direct = common.stage(direct, "direct-links")
    out = common.stage(pairs.unionByName(large_pairs).distinct(), "regrouped")
    common.drop(found, large)
    return out, direct


def ngram_links(docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The sets (doc_id, th, n_shingles, node) and links (a, b) that connect all pairs of nodes similar enough; both are staged.

    th is ``xxhash64`` of the text.
    """
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_hashes(t or "", words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(map(node_of, sets), pa.int64())], names=["doc_id", "th", "n_shingles", "node"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of each set that the task hasn't seen before."""
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, quotas = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for t in batch.column(0).to_pylist():
                h = ngram_hashes(t or "", words)
                node = node_of(h)
                if node is None or node in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                x, q = signatures(h, similar)
                keys.append(x)
                quotas.append(q)
                nodes.append(np.full(len(x), node))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(quotas))], names=["part", "node", "quota"])

    known = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # texts are hashed twice: kept between, the parts would take more room than the texts
    sets = common.stage(known.mapInArrow(describe, "doc_id long, th long, n_shingles long, node long"), "ngram-sets")
    pairs, direct = _groups(docs.select("text").mapInArrow(parts, "part long, node long, quota int"), block)
    # one text for each node that is in a group, with the size of its set
    wanted = pairs.select("node").unionAll(pairs.select(F.col("center").alias("node"))).distinct()
    key = F.struct(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("id"), "th")
    wanted = sets.join(wanted, "node").groupBy("node", "n_shingles").agg(F.min(key).alias("key"))
    wanted = common.stage(wanted.select("node", "n_shingles", "key.id", "key.th"), "wanted")
    texts = known.withColumn("id", F.coalesce("doc_id", F.lit(common.NULL_ID))).join(wanted.hint("merge"), ["id", "th"]).groupBy("id", "th").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    texts = common.stage(texts.select("node", "text"), "texts")
    sizes = pairs.join(wanted.select("node", "n_shingles"), "node").groupBy("center").agg(F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / BLOCK_NGRAMS).cast("int").alias("last"))
    sizes = common.stage(sizes, "group-sizes")
    members = pairs.join(sizes, "center").select("center", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int").alias("block"), "node", F.lit(2).alias("role"))
    centers = sizes.select("center", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.col("center").alias("node"), F.lit(0).alias("role"))
    found = common.stage(_link_blocks(members.unionByName(centers).join(texts, "node"), words, similar), "links")
    links = found.where("b IS NOT NULL").select("a", "b")
    # second round, for groups of several blocks: what the centre isn't linked to meets the other blocks
    large = sizes.where("last > 0")
    if large.limit(1).count():
        rest = found.where("b IS NULL").select("center", F.col("block").alias("own"), F.col("a").alias("node")).join(large, "center")
        probes = rest.select("center", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), "own", "node").where("block != own").select("center", "block", "node", F.lit(1).alias("role"))
        met = probes.select("center", "block").distinct()
        more = _link_blocks(members.join(met, ["center", "block"], "left_semi").unionByName(probes).join(texts, "node"), words, similar)
        links = links.unionByName(common.stage(more.where("b IS NOT NULL").select("a", "b"), "links"))
    links = common.stage(links.unionByName(direct), "all-links")
    common.drop(wanted, texts, sizes, found)
    return sets, links


def near_duplicates(docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Texts with white space only, and null ones, have no n-grams and stand alone; so does a text whose set no other set reaches; equal
    sets are linked.  A null doc_id is kept and counts as the smallest id only among null ids (-2 ** 63 may stand for null where a
    text is fetched, which changes no result); repeated rows fall into one component; other columns are ignored.
    """
    sets, links = ngram_links(docs, words=words, similar=similar, block=block)
    least = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    parts = components(links)
    least = least.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    ids = common.stage(least.groupBy("part").agg(F.min("first").alias("component_id")).join(least.select("part", "node"), "part").select("node", "component_id"), "classes")
    common.drop(links)
    return sets.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, *, words: int = WORDS, similar: int = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Of the rows of ``docs`` that links connect, the one with the smallest doc_id; all columns are kept.

    A null doc_id comes after all others, and of rows with one doc_id the one with the least hash of its text stays.  A text without words,
    empty or null, stands alone.  Rows equal in doc_id and text are one document, and one of them stays.
    """
    sets, links = ngram_links(docs.select("doc_id", "text"), words=words, similar=similar, block=block)
    key = [F.col("doc_id").isNull().alias("__none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id")]
    rows = sets.select(*key, F.col("th").alias("__th"), "node")
    parts = components(links)
    grouped = rows.where("node IS NOT NULL").join(parts, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min(F.struct("__none", "__id", "__th")).alias("first"))
    stay = common.stage(grouped.select("first.*").unionByName(rows.where("node IS NULL").select("__none", "__id", "__th").distinct()), "first-of-groups")
    common.drop(sets, links)
    keyed = docs.select("*", *key, F.xxhash64(F.col("text").cast("string")).alias("__th"))
    names = ["__none", "__id", "__th"]
    return keyed.join(stay, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose word-triple sets are 90 percent alike."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 3 THEN w[i:i + 2] ELSE w END, ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.b, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY 1) m USING (doc_id)
"""
