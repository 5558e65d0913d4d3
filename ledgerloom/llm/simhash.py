"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: words and 4-word shingles (any length is a parameter), XXH64 of each shingle, majority of
every bit.  Pairs of fingerprints within ``distance`` bits are found as follows.

1. Equal fingerprints are one node (their smallest id speaks for them), so copies never meet in pairs.
2. Correlated bits, as a bounded sample of nodes shows them, are put in the same one of m parts.
3. If part i may differ in t_i bits and sum(t_i) = distance - m + 1, then every pair within ``distance``
   is within t_i in some part i (t_i = -1: the part is not probed).  Dynamic programming picks m and the
   unequal thresholds with the least estimated cost: candidates (pairs of the sample within t in that
   part, scaled to all nodes) plus probes (values within t of one value).
4. Nodes are posted under (part, value) and, where t_i > 0, probe all values within t_i.  Groups are dealt
   by (part, value); inside a task whole groups are compared by xor and popcount in tiles, a group over
   ``TILE`` rows is first split again by pigeonhole on all 64 bits, so no group's pairs are ever held or
   sent: a task sends a spanning forest of the links that it has verified.
5. Components: large-star / small-star rounds over the forest's edges, each round cut by a checkpoint.

The sample only steers cost.  Links found do not depend on it: the principle holds for every split.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and link like any
other; texts of fewer words than a shingle are one shingle; rows that repeat an id give one row each;
a null id is a member but never names a component unless no other id is there; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, least_reachable, partitions, release

BITS, TILE, SAMPLE = 64, 2048, 1000
#: Words of a feature, and bits that may differ, of the SimHash that finds near copies: single words hang unrelated texts together
FEATURE, NEAR = 2, 4
PROBE_COST = 200.0  # measured: about 2 us for a posted row, 10 ns for a candidate


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes."""
    tokens = (text or b"").lower().split()  # bytes: A-Z only, split at 0x09-0x0D and 0x20
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1:].tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 4096):
        part = h[at:at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a (signed) long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- partitions and thresholds -------------------------------------------------------------------

def _groups(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of equal size; each grows by the bit that correlates most with it."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((BITS, BITS))
    free, out = set(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, out))) // (m - i)
        first = max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def plan(sample: np.ndarray, nodes: int, distance: int, probe_cost: float = PROBE_COST) -> list[tuple[list[int], int]]:
    """[(bits of the part, threshold)] with the least estimated cost; sample: uint64 fingerprints."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(min(2, distance + 1), distance + 2):
        groups, costs = _groups(bits, m), []
        for g in groups:
            code = _take(sample, g)
            apart = np.zeros(BITS + 1, dtype=np.int64)  # pairs by differing bits within the part
            for i in range(0, len(code), 250):
                apart += np.bincount(np.bitwise_count(code[i:i + 250, None] ^ code[None]).ravel(), minlength=BITS + 1)
            apart[0] -= len(code)
            near = np.cumsum(apart)[:distance + 1] // 2
            costs.append([0.0] + [max(near[t], pairs / 2.0 ** len(g) * sum(math.comb(len(g), i) for i in range(t + 1))) / pairs * nodes
                                  + probe_cost * sum(math.comb(len(g), i) for i in range(t + 1)) for t in range(distance + 1)])
        need = distance - m + 1
        table = {0: (0.0, [])}  # key: sum of (t + 1)
        for c in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, ts) in table.items():
                for t in range(-1, distance + 1):
                    k = total + t + 1
                    if k <= need + m and (k not in step or cost + c[t + 1] < step[k][0]):
                        step[k] = (cost + c[t + 1], [*ts, t])
            table = step
        cost, ts = table[need + m]
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, ts)))
    assert best is not None
    return best[1]


def _take(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _masks(width: int, t: int) -> list[int]:
    if t <= 0:
        return []
    return [1 << i for i in range(width)] + [m | 1 << i for m in (_masks(width, t - 1) if t > 1 else []) for i in range(m.bit_length(), width)]


# -- verified links ------------------------------------------------------------------------------

class Forest:
    """Union-find over the ids one task meets; smaller ids are roots."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = a = up.get(b, b)
        return a

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        low = [(a, self.root(a)) for a in list(self.up)]
        return [a for a, r in low if a != r], [r for a, r in low if a != r]


class Group:
    """Rows of one (part, value): ``base`` marks the nodes' own rows, the others are their probes."""

    def __init__(self, fp: np.ndarray, own: np.ndarray, base: np.ndarray, distance: int) -> None:
        self.fp, self.own, self.base, self.distance = fp, own, base, distance

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.distance

    def tiles(self, rows: np.ndarray, forest: Forest) -> None:
        """Every own row against every row, in tiles; a tile's links meet in its least rows."""
        ours, all_ = rows[self.base[rows]], rows
        for p in range(0, len(ours), TILE):
            x = ours[p:p + TILE]
            for q in range(0, len(all_), TILE):
                y = all_[q:q + TILE]
                a, b = np.nonzero(np.bitwise_count(self.fp[x, None] ^ self.fp[None, y]) <= self.distance)
                a, b = x[a], y[b]
                other = self.own[a] < self.own[b] if self.base.all() else self.own[a] != self.own[b]
                a, b = a[other], b[other]
                if len(a):
                    ids, index = np.unique(np.concatenate([self.own[a], self.own[b]]), return_inverse=True)
                    low = least_reachable(len(ids), index[:len(a)], index[len(a):])
                    for u, v in zip(ids.tolist(), ids[low].tolist()):
                        if u != v:
                            forest.link(u, v)

    def split(self, rows: np.ndarray, forest: Forest, level: int = 0) -> None:
        """Large groups under a small distance split by pigeonhole on other cuts of the 64 bits."""
        if len(rows) <= 8 * TILE or level > 3 or self.distance > 5:
            self.tiles(rows, forest)
            return
        turn = 7 * level + 3
        turned = (self.fp[rows] << np.uint64(turn)) | (self.fp[rows] >> np.uint64(BITS - turn))
        edges = [BITS * i // (self.distance + 1) for i in range(self.distance + 2)]
        for lo, hi in zip(edges, edges[1:]):
            part = (turned >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            order = np.argsort(part, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(g) > 1:
                    self.split(rows[g], forest, level + 1)


def _verify(part: np.ndarray, val: np.ndarray, rows: Group, forest: Forest) -> None:
    """Rows sorted by (part, val): small groups by shifted comparison, large ones by tiles."""
    new = np.flatnonzero((np.diff(part) != 0) | (np.diff(val) != 0)) + 1
    starts = np.concatenate(([0], new))
    sizes = np.diff(np.concatenate((starts, [len(part)])))
    group = np.repeat(np.arange(len(starts)), sizes)
    for s, n in zip(starts[sizes > 128].tolist(), sizes[sizes > 128].tolist()):
        rows.split(np.arange(s, s + n), forest)
    small = np.flatnonzero(sizes[group] <= 128)
    g = group[small]
    for d in range(1, 128):
        i = np.flatnonzero(g[:-d] == g[d:])
        if not len(i):
            break
        i, j = small[i], small[i + d]
        use = (rows.base[i] | rows.base[j]) & (rows.own[i] != rows.own[j])
        i, j = i[use], j[use]
        hit = rows.near(i, j)
        for x, y in zip(rows.own[i[hit]].tolist(), rows.own[j[hit]].tolist()):
            forest.link(x, y)


def links(nodes: DataFrame, distance: int = 4, count: int | None = None) -> DataFrame:
    """nodes: fp, node (one row a distinct fp).  Edges (node, root) whose components are those of all pairs within distance."""
    n = nodes.count() if count is None else count
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(SAMPLE).select("fp").collect()], dtype=np.int64)
    parts = plan(sample.view(np.uint64), n, distance, PROBE_COST)
    names = ["part", "val", "fp", "node", "base"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (group, t) in enumerate(parts):
                if t < 0:
                    continue
                v = _take(fp.view(np.uint64), group)
                for mask in [0, *_masks(len(group), t)]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array((v ^ np.uint64(mask)).view(np.int64)), pa.array(fp), b.column("node"), pa.array(np.full(len(fp), mask == 0))], names=names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = Forest(), None

        def settle(e: int) -> None:
            group = Group(kept[2][:e].view(np.uint64), kept[3][:e], kept[4][:e], distance)
            _verify(kept[0][:e], kept[1][:e], group, forest)

        for b in batches:
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            if len(kept[0]) < 100_000 and len(kept[0]) < 2 * len(now[0]):
                continue
            last = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1]))
            if len(last):  # the last group may go on in the next batch
                settle(last[-1] + 1)
                kept = [x[last[-1] + 1:] for x in kept]
        if kept is not None and len(kept[0]):
            settle(len(kept[0]))
        a, r = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(r, pa.int64())], names=["a", "b"])

    width = partitions(nodes.sparkSession)
    posted = nodes.select("fp", "node").mapInArrow(post, "part int, val long, fp long, node long, base boolean")
    return posted.repartition(width, "part", "val").sortWithinPartitions("part", "val").mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b  ->  (node, component): the smallest node reachable.  Nodes without edges are
    not listed.  Large-star and small-star rounds until a round changes nothing."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a")
        edges = cut(small.select("a", F.col("m").alias("b")).union(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row a document."""
    fps = cut(fingerprints(docs, id_col, text_col, words))
    # a fingerprint is its own node, so one that only rows without an id have links and bridges like any other
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(nodes.select("fp", F.col("fp").alias("node")), distance))
    member = cut(nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = member.join(named, "component").select("fp", "component_id")
    return fps.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- shingle similarity ----------------------------------------------------------------------------

def text_hash(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text.cast("binary"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: documents linked whose sets of shingles have a Jaccard similarity of ``similarity`` or more."""
    return similar_rows(docs, words, similarity, id_col, text_col).select("doc_id", "component_id")


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``similar_groups`` with t, the hash of each row's text: rows that repeat an id with other texts may be in other groups.

    First the texts of each group that SimHash links meet and are compared exactly.  This finds most near copies, but not all:
    texts of a similarity of 0.8 may differ in many more bits than ``NEAR``.  So all rows then go through the prefix filter of ``jaccard``,
    which loses none; its blocks that the first step has joined to one component are settled, the others are compared."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("t", text_hash(F.col("text")))
    own = cut(jaccard.nodes(rows, words, partial(fingerprint, words=FEATURE)).drop("odd"))
    # one document a node
    one = cut(own.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("d"), F.max("n").alias("n"), F.min("fp").alias("fp")))
    sure = _simhash_links(rows, one, words, similarity)
    common = jaccard.common_shingles(rows, own.count(), words)
    edges = cut(jaccard.neighbours(rows, words, similarity, common))
    release(docs.sparkSession)
    hung = components(edges).withColumnRenamed("component", "block")
    blocks = hung.union(hung.select("block", "block").distinct())  # components do not list their least node
    held = cut(one.join(blocks, "node").join(sure, "node", "left").withColumn("component", F.coalesce("component", "node")))
    open_ = cut(held.groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
                .select("block", ((F.col("k") > jaccard.BLOCK_NODES) | (F.col("s") > jaccard.BLOCK_SHINGLES)).alias("large")))
    settled = held.join(open_, "block", "left_anti").select("node", "component")
    texts = _texts(rows, held.join(open_, "block").select("block", "d", "large"))
    if not open_.where("large").limit(1).count():
        comp = cut(jaccard.within_blocks(texts, words, similarity))
    else:  # read several times: stored, so that all texts move once; still dealt by document, as a block may hold very many
        texts = cut(texts)
        release(docs.sparkSession)
        comp = cut(jaccard.within_blocks(texts.where("not large"), words, similarity))
        comp = comp.unionByName(_large_groups(texts.where("large").drop("large"), words, similarity, common))
    named = cut(own.join(comp.unionByName(settled), "node", "left").select("doc_id", "t", F.coalesce("component", "node").alias("c")))
    return named.join(named.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "t", "component_id")


def _texts(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows' columns with block and what else ``of`` has beside d (doc_id, t), its document."""
    of = of.select(F.col("d.doc_id").alias("__d"), F.col("d.t").alias("__t"), *[c for c in of.columns if c != "d"])
    return rows.join(of, rows.doc_id.eqNullSafe(F.col("__d")) & (rows.t == F.col("__t"))).drop("__d", "__t")


def _simhash_links(rows: DataFrame, one: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, component under the links of that similarity or more inside of each group that SimHash makes; exact.  A group too large for
    one task is left to the prefix filter.  one: node, d, n, fp."""
    fps = cut(one.select("fp", F.col("fp").alias("node")).distinct())
    comp = components(links(fps, NEAR)).withColumnRenamed("node", "fp").withColumnRenamed("component", "block")
    named = cut(one.join(comp, "fp", "left").withColumn("block", F.coalesce("block", "fp")))
    fit = (named.groupBy("block").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where((F.col("k") > 1) & (F.col("k") <= jaccard.BLOCK_NODES) & (F.col("s") <= jaccard.BLOCK_SHINGLES))
           .select("block"))
    return cut(jaccard.within_blocks(_texts(rows, named.join(fit, "block").select("block", "d")), words, similarity))


def _large_groups(rows: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, component of documents (doc_id, text, t) too many to meet in one task."""
    own = cut(jaccard.nodes(rows, words))
    first = cut(jaccard.candidates(rows, words, similarity, common))
    release(rows.sparkSession)

    def linked(pairs: DataFrame, edges: DataFrame | None) -> DataFrame:
        """edges and the links among pairs that join different components of them."""
        sure = pairs.where("sure").select("a", "b")
        edges = sure if edges is None else edges.union(sure)
        if not pairs.where("not sure").limit(1).count():
            return cut(edges)
        open_ = cut(jaccard.across(pairs.where("not sure"), components(edges)))
        edges = cut(edges.union(jaccard.verified(rows, own, cut(jaccard.best(open_)), words, similarity)))
        open_ = cut(jaccard.across(open_, components(edges)))
        return cut(edges.union(jaccard.verified(rows, own, open_.select("a", "b"), words, similarity)))

    edges = linked(cut(jaccard.possible(first.where("n is null").select("a", "b"), own, similarity)), None)
    comp = components(edges)
    posts = first.where("n is not null")
    if posts.limit(1).count():
        comp = components(linked(cut(jaccard.across_groups(posts, own, comp, similarity)), edges))
    return comp
