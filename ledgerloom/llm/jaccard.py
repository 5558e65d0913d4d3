"""Pairs of documents whose sets of word shingles have a Jaccard similarity of t or more, without loss.

Two sets with J >= t share at least ceil(t n) of the n shingles of either, so under any common order of shingles
each has one of the shared ones among its first n - ceil(t n) + 1 (prefix filter).  Sets are posted under the
shingles of this prefix, rarest first as a bounded sample counts them; the sample only steers cost.

1. Tasks turn texts into sets of 64-bit shingle hashes; equal sets are one node, named by a 64-bit digest.
2. Postings by shingle (no text) first make blocks: pairs posted under one shingle whose sizes and places leave room for
   J >= t hang together, in stars for each shingle, and the components of these stars are closed under links.  A family of near
   copies is one block, however many shingles it shares.  Each block's texts meet once, in one task, which counts the shingles that
   its sets share and sends each node's component, so neither pairs nor candidates are ever sent.
   Blocks of more than ``BLOCK_NODES`` nodes or ``BLOCK_SHINGLES`` shingles go on as follows instead.
3. Postings (shingle, node, size, place in the order; no text) are dealt by shingle as packed columns.  A pair that
   shares a shingle is a candidate if, were it the first that they share, sizes and places leave room for J >= t;
   this holds at the first one that they do share, so no pair is lost.
4. Distinct candidates meet the nodes' parity bitmaps, two to four bits a shingle: bins of the hashes that hold an odd
   number in one set and an even one in the other.  They are never more than the shingles that the sets do not share,
   so pairs with too many go; pairs with so few that more unshared shingles than J >= t allows would miss them by
   ``SIGMAS`` standard deviations are links (an error of about 1e-12 a pair, as for equal 64-bit digests).
   Pairs in between, close to t, are decided on the sets themselves, and only if these links leave their ends in
   different components: first each node's most promising pair, then the others.
5. Groups of more than ``SMALL`` nodes first give each node's neighbours by size and a chain of hubs.  Once these are
   joined to components, the postings of groups that span several components are dealt with their bitmaps over pairs of
   tiles, about ``TILE`` nodes each, and all pairs whose ends lie in different components are looked at: pairs inside one
   cannot change the result.  Of pairs that the bitmaps decide only a forest leaves the task.  No links or components
   reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_reachable, partitions

BLOCK_NODES, BLOCK_SHINGLES = 8192, 4_000_000
SMALL, BINS, WIDEST, SIGMAS, SAMPLE, COMMON, HOT, TILE, FLUSH = 64, 256, 256, 7.0, 10_000, 3, 200_000, 4096, 1_000_000
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Ascending hashes of each text's distinct shingles; a text of fewer words than a shingle is one shingle."""
    docs = [(t or b"").lower().split() for t in texts]
    tokens = [w for d in docs for w in d]
    own = {w: xxhash.xxh64_intdigest(w, 7) for w in set(tokens)}
    h = np.fromiter(map(own.__getitem__, tokens), dtype=U64, count=len(tokens))
    n = max(0, len(h) - words + 1)
    x = h[:n]
    for k in range(1, words):
        x = _mix(x) + h[k:k + n]
    x = _mix(x)
    out, at = [], 0
    for d in docs:
        if len(d) < words:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(d), 7)] if d else [], dtype=U64))
        else:
            out.append(np.unique(x[at:at + len(d) - words + 1]))
        at += len(d)
    return out


def digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 11) - (1 << 63)


def parities(s: np.ndarray) -> bytes:
    """A bit for each bin of the hashes: whether it holds an odd number.  Bins: a power of two, at least ``BINS`` and twice
    the set's size; halves laid over each other give the bits of half as many bins."""
    bins = max(BINS, 1 << (2 * len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits(np.bincount((s & U64(bins - 1)).astype(np.int64), minlength=bins) & 1).tobytes()


def bins_apart(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of bitmaps, over the bins of the smaller one: bits that differ, and the number of bins."""
    nx, ny = (np.fromiter(map(len, c), dtype=np.int64, count=len(c)) for c in (x, y))
    least, apart = np.minimum(nx, ny), np.zeros(len(x), dtype=np.int64)
    kinds = nx << 32 | ny
    for kind in np.unique(kinds).tolist():
        i = np.flatnonzero(kinds == kind)
        both = []
        for c, n in ((x, kind >> 32), (y, kind & 0xFFFFFFFF)):
            bits = np.frombuffer(b"".join([c[k] for k in i.tolist()]), dtype="<u8").reshape(len(i), -1)
            both.append(np.bitwise_xor.reduce(bits.reshape(len(i), n // int(least[i[0]]), -1), axis=1))
        apart[i] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return apart, least * 8


def odd_bins(unshared: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the bins that so many hashes leave odd."""
    m = bins.astype(np.float64)
    p, q = (1 - 2 / m) ** unshared, (1 - 4 / m) ** unshared
    return m * (1 - p) / 2, np.sqrt(np.maximum(m * (1 - p * p) + m * (m - 1) * (q - p * p), 0)) / 2


def _sets(column: pa.Array, words: int) -> Iterator[list[np.ndarray]]:
    """The sets of some rows at a time, about 4 MB of text."""
    held, texts = 0, []
    for t in column:
        texts.append(t.as_py())
        held += len(texts[-1] or b"")
        if held > 4_000_000:
            yield shingle_sets(texts, words)
            held, texts = 0, []
    if texts:
        yield shingle_sets(texts, words)


def nodes(docs: DataFrame, words: int, mark: Callable[[bytes | None], int] | None = None) -> DataFrame:
    """docs: doc_id, text (binary), t (the text's hash).  doc_id, t, node, n, odd: rows of equal sets have one node; its size and
    parities.  With ``mark`` also fp, the 64 bits that it gives for each text, as a (signed) long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(digest(s), len(s), parities(s)) for sets in _sets(b.column(2), words) for s in sets]
            columns = [b.column(0), b.column(1), *(pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))]
            if mark is not None:
                columns.append(pa.array(np.array([mark(t.as_py()) for t in b.column(2)], dtype=U64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "node", "n", "odd", "fp"][:len(columns)])

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, node long, n long, odd binary" + (", fp long" if mark else ""))


def common_shingles(docs: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of shingles that a sample of documents often holds, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in _sets(b.column(0), words):
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    every = max(1, rows // SAMPLE)
    held = (docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long, c long")
            .groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "h").limit(HOT).toPandas())
    h, c = held.h.to_numpy(dtype=np.int64).view(U64), held.c.to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order, enough to meet every set of that similarity."""
    n = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
    h, c = common
    if not len(h):
        return s[:n]
    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
    return s[np.argsort(np.where(h[at] == s, c[at], 0), kind="stable")][:n]


POST = (("h", "<u8"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4"))


class _Pairs:
    """Distinct candidates of one task, sent on when many are held."""

    def __init__(self, n: np.ndarray, at: np.ndarray, node: np.ndarray, similarity: float) -> None:
        self.n, self.at, self.node, self.t, self.held, self.size = n, at, node, similarity, [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, p, q = self.n[i], self.n[j], self.at[i], self.at[j]
        # at the first shingle that a pair shares, all that it shares lies from here on in both sets; a pair is only taken there
        ok = np.minimum(x - p, y - q) * (1 + self.t) >= self.t * (x + y) - 1e-6
        a, b = self.node[i[ok]], self.node[j[ok]]
        self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        self.size += len(a)
        if self.size > FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(self.held) if self.held else np.zeros((0, 2), dtype=np.int64)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        x = x[np.concatenate(([True], (np.diff(x, axis=0) != 0).any(axis=1)))] if len(x) else x
        self.held, self.size = [], 0
        for k in range(0, len(x), 100_000):
            yield _rows(x[k:k + 100_000, 0], x[k:k + 100_000, 1])


PAIRS = "a long, b long, n long, at long"


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (n, at))], names=["a", "b", "n", "at"])


def _postings(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Shingle, node, size and place of one bucket's postings, by shingle and size, and where each shingle starts and ends."""
    cols: dict[str, list[np.ndarray]] = {c: [] for c, _ in POST}
    for b in blobs:
        k, at = int(np.frombuffer(b, "<i8", 1)[0]), 8
        for c, kind in POST:
            cols[c].append(np.frombuffer(b, kind, k, at))
            at += cols[c][-1].nbytes
    h, node = np.concatenate(cols["h"]), np.concatenate(cols["node"])
    n, at = (np.concatenate(cols[c]).astype(np.int64) for c in ("n", "at"))
    order = np.lexsort((node, n, h))
    order = order[np.concatenate(([True], (np.diff(h[order]) != 0) | (np.diff(node[order]) != 0)))]
    h, node, n, at = h[order], node[order], n[order], at[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(h)) + 1))
    return h, node, n, at, starts, np.diff(np.concatenate((starts, [len(h)])))


def _neighbours(blobs: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) of one bucket: the nodes of each shingle that hang together by pairs whose sizes and places leave
    room, in a star.  What a shingle gives depends on its own nodes only, so one set of nodes gives the same edges by every shingle
    that it shares, however many buckets these are dealt over."""
    h, node, n, at, starts, sizes = _postings(blobs)
    # room for J >= t with m shingles at the first shared one, for m up to here; so a pair has room if each size lies in the other's reach
    reach = (n - at) * (1 + similarity) / similarity - n + 1e-6
    use = reach >= np.repeat(n[starts], sizes)
    h, node, n, reach = h[use], node[use], n[use], reach[use]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.concatenate((starts, [len(h)])))
    group, low, held = np.repeat(np.arange(len(starts)), sizes), np.arange(len(h)), []
    small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= SMALL))
    for d in range(1, SMALL):
        small = small[small + d < starts[group[small]] + sizes[group[small]]]
        if not len(small):
            break
        i = small[(n[small + d] <= reach[small]) & (n[small] <= reach[small + d])]
        i = i[low[i] != low[i + d]]
        held.append((i, i + d))
        if sum(len(x) for x, _ in held) > FLUSH:
            low, held = _hung(low, held), []
    for g in np.flatnonzero(sizes > SMALL).tolist():
        rows = np.arange(starts[g], starts[g] + sizes[g])
        name = _near_sizes(n[rows], reach[rows], similarity)
        held.append((rows, rows[name]))
    low = _hung(low, held)
    least = np.full(len(h), np.iinfo(np.int64).max)
    np.minimum.at(least, low, node)
    edges = np.stack((node, least[low]), axis=1)
    edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
    return edges[:, 0], edges[:, 1]


def _hung(low: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's component, by links so far and new ones."""
    a, b = (np.concatenate([np.arange(len(low)) if k == 0 else low, *(x[k] for x in held)]) for k in (0, 1))
    return least_reachable(len(low), a, b)


def _near_sizes(n: np.ndarray, reach: np.ndarray, similarity: float) -> np.ndarray:
    """For each node of a large group, sizes ascending, the row that names its component; beyond ``TILE`` nodes in order of size,
    which hangs together what has room and more."""
    name = np.arange(len(n))
    if len(n) > TILE:
        return np.maximum.accumulate(np.where(np.concatenate(([True], n[:-1] < similarity * n[1:] - 1e-9)), name, 0))
    upto = np.searchsorted(n, reach, side="right")
    for i, j in enumerate(upto.tolist()):
        near = name[i + 1:j][reach[i + 1:j] >= n[i]]
        if (near != name[i]).any():
            joined = np.unique(np.append(near, name[i]))
            name[np.isin(name, joined)] = joined[0]
    return name


def _components(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of some distinct sets the row that names its component under links of that similarity or more; exact."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    n = size[order]
    flat, held = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True, return_counts=True)[1:]
    use = held[flat] > 1  # what one set holds alone is shared with none
    row, flat = np.repeat(np.arange(len(n)), n)[use], (np.cumsum(held > 1) - 1)[flat[use]]
    ends = np.cumsum(np.bincount(row, minlength=len(n)))
    starts, name, wide = np.concatenate(([0], ends[:-1])), np.arange(len(n)), -(-int((held > 1).sum()) // 64)
    dense = wide * len(n) <= len(flat)  # bits cost less than looking up each shingle
    bits = np.zeros((len(n), wide if dense else 0), dtype="<u8")
    if dense:
        np.bitwise_or.at(bits, (row, flat >> 6), U64(1) << (flat & 63).astype(U64))
    mark, at = np.zeros(wide * 64, dtype=np.int32), np.concatenate((flat, [0]))
    upto = np.searchsorted(n, n / similarity + 1e-6, side="right")
    for i, j in enumerate(upto.tolist()):  # against the larger sets, up to the size that leaves room
        if j <= i + 1 or starts[i] == ends[i]:
            continue
        if dense:
            both = np.bitwise_count(bits[i + 1:j] & bits[i]).sum(axis=1, dtype=np.int64)
        else:
            mark[flat[starts[i]:ends[i]]] = 1
            both = np.add.reduceat(mark[at[ends[i]:ends[j - 1] + 1]], starts[i + 1:j] - ends[i])
            both = np.where(starts[i + 1:j] < ends[i + 1:j], both, 0)
            both[-1] -= mark[at[ends[j - 1]]] if starts[j - 1] < ends[j - 1] else 0
            mark[flat[starts[i]:ends[i]]] = 0
        near = i + 1 + np.flatnonzero(both >= similarity * (n[i] + n[i + 1:j] - both) - 1e-9)
        if (name[near] != name[i]).any():
            joined = np.unique(np.append(name[near], name[i]))
            name[np.isin(name, joined)] = joined[0]
    out = np.empty(len(n), dtype=np.int64)
    out[order] = order[name]
    return out


def _compare(blobs: list[bytes], similarity: float, most: int) -> Iterator[pa.RecordBatch]:
    """Candidates of one bucket; of groups of more than ``most`` nodes a connected few, and their postings."""
    h, node, n, at, starts, sizes = _postings(blobs)
    pairs = _Pairs(n, at, node, similarity)
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= most))
    for d in range(1, most):
        i = np.flatnonzero(group[small[:-d]] == group[small[d:]])
        if not len(i):
            break
        yield from pairs.add(small[i], small[i + d])
    for g in np.flatnonzero(sizes > most).tolist():
        rows = np.arange(starts[g], starts[g] + sizes[g])
        hubs = rows[np.arange(len(rows)) // most * most]
        for i, j in ((rows[1:], rows[:-1]), (rows[2:], rows[:-2]), (rows[rows != hubs], hubs[rows != hubs]), (rows[most::most], rows[:-most:most])):
            yield from pairs.add(i, j)
        # a posting only matters if its place leaves room for the smallest partner there can be
        least = np.maximum(n[rows[0]], np.ceil(similarity * n[rows] - 1e-9))
        rows = rows[(n[rows] - at[rows]) * (1 + similarity) >= similarity * (n[rows] + least) - 1e-6]
        if len(rows) > 1:
            yield _rows(node[rows], h[rows].view(np.int64), n[rows], at[rows])
    yield from pairs.flush()


def _posted(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """bucket, posts: the postings of prefixes, packed and dealt by shingle."""
    sc = docs.sparkSession.sparkContext
    width = partitions(docs.sparkSession)
    shared = sc.broadcast(common)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in _sets(b.column(0), words):
                seen, cols = set(), ([], [], [], [])
                for s in sets:
                    own = digest(s)
                    if own in seen or not len(s):
                        continue
                    seen.add(own)
                    p = prefix(s, shared.value, similarity)
                    for c, v in zip(cols, (p, np.full(len(p), own, np.int64), np.full(len(p), len(s), np.uint32), np.arange(len(p), dtype=np.uint32))):
                        c.append(v)
                if not cols[0]:
                    continue
                whole = [np.concatenate(c) for c in cols]
                where = (_mix(whole[0]) % U64(width)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.diff(where[order])) + 1
                keys, blobs = [], []
                for g in np.split(order, cuts):
                    keys.append(int(where[g[0]]))
                    blobs.append(len(g).to_bytes(8, "little") + b"".join(c[g].astype(kind).tobytes() for c, (_, kind) in zip(whole, POST)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "posts"])

    return docs.select("text").mapInArrow(post, "bucket int, posts binary").repartitionById(width, "bucket")


def candidates(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """a, b (nodes, a < b) of pairs that may reach the similarity; rows with n and at are postings (node, shingle) of
    large groups."""
    small = SMALL

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if blobs:
            yield from _compare(blobs, similarity, small)

    return _posted(docs, words, similarity, common).mapInArrow(compare, PAIRS).distinct()


def neighbours(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """a, b: edges whose components are the blocks."""
    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _neighbours(blobs, similarity)], names=["a", "b"])

    return _posted(docs, words, similarity, common).mapInArrow(hang, "a long, b long").distinct()


def within_blocks(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """block, text  ->  node, component.  A task holds one block at a time."""
    def settle(held: list[bytes]) -> pa.RecordBatch:
        sets: dict[int, np.ndarray] = {}
        for some in _sets(held, words):
            sets.update((digest(s), s) for s in some)
        nodes = np.array(list(sets), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[_components(list(sets.values()), similarity)])], names=["node", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                if held and name != block:
                    yield settle(held)
                    held = []
                block = name
                held.append(text)
        if held:
            yield settle(held)

    width = partitions(texts.sparkSession)
    return texts.select("block", "text").repartition(width, "block").sortWithinPartitions("block").mapInArrow(run, "node long, component long")


def across_groups(posts: DataFrame, own: DataFrame, comp: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes in different components that a shingle of a large group makes candidates, as ``possible`` leaves them:
    pairs that parities decide come as a forest of sure links, those close to the similarity one by one.
    posts: a (node), b (shingle), n, at."""
    tile = TILE
    named = cut(posts.join(comp.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a")))
    spans = (named.groupBy("b").agg(F.count("*").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("b", F.ceil(F.col("k") / tile).cast("int").alias("tiles")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = [np.bitwise_xor.reduce(np.frombuffer(x, "<u8").reshape(-1, widest // 8), axis=0).tobytes() if len(x) > widest else x for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(odd, pa.binary())], names=["a", "odd"])

    widest, mine = WIDEST, F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int")
    some = named.join(spans, "b")
    maps = own.select(F.col("node").alias("a"), "odd").join(some.select("a"), "a", "left_semi").dropDuplicates(["a"]).mapInArrow(fold, "a long, odd binary")
    dealt = (some.join(maps, "a").withColumn("own", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "n", "at", "component", "odd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # one pair of tiles at a time
            keys = [b.column(c).to_numpy() for c in ("b", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
            ends = [*cuts.tolist(), b.num_rows]
            if held and b.num_rows and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in ("b", "i", "j")):
                yield from _tiles(pa.Table.from_batches(held), similarity)
                held = []
            for lo, hi in zip([0, *ends[:-1]], ends):
                held.append(b.slice(lo, hi - lo))
                if hi < b.num_rows:
                    yield from _tiles(pa.Table.from_batches(held), similarity)
                    held = []
        if held:
            yield from _tiles(pa.Table.from_batches(held), similarity)

    width = partitions(posts.sparkSession)
    return dealt.repartition(width, "b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(run, CHECKED).distinct()


CHECKED = "a long, b long, apart double, sure boolean"


def _close(x: np.ndarray, y: np.ndarray, ordered: bool, odd: list[bytes], n: np.ndarray, at: np.ndarray, name: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, row, bins apart, bins) of pairs of rows x and y that sizes, places and parities leave."""
    size = np.fromiter(map(len, odd), dtype=np.int64, count=len(odd))
    for a in np.unique(size[x]).tolist():
        for b in np.unique(size[y]).tolist():
            if not 1 <= max(a, b) // min(a, b) <= 2:  # sizes too far apart for the similarity
                continue
            i, j, least = x[size[x] == a], y[size[y] == b], min(a, b)
            left, right = (np.bitwise_xor.reduce(np.frombuffer(b"".join([odd[k] for k in r.tolist()]), dtype="<u8").reshape(len(r), w // least, -1), axis=1) for r, w in ((i, a), (j, b)))
            for s in range(0, len(i), 64):
                u = i[s:s + 64, None]
                apart = np.bitwise_count(left[s:s + 64, None] ^ right[None]).sum(axis=2, dtype=np.int64)
                p, q, m, k = at[u], at[j][None], n[u], n[j][None]
                ok = (apart <= (1 - t) / (1 + t) * (m + k) + 1e-9) & (name[u] != name[j][None]) & (np.minimum(m - p, k - q) * (1 + t) >= t * (m + k) - 1e-6)
                if ordered:
                    ok &= u < j[None]
                r, c = np.nonzero(ok)
                yield i[s + r], j[c], apart[r, c], np.full(len(r), least * 8)


def _tiles(rows: pa.Table, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of two tiles of one shingle's nodes."""
    i, j, own, node, n, at, name = (rows.column(c).to_numpy() for c in ("i", "j", "own", "a", "n", "at", "component"))
    every = np.arange(len(node))
    x, y = (every, every) if i[0] == j[0] else (every[own == i[0]], every[own == j[0]])
    got = list(_close(x, y, bool(i[0] == j[0]), rows.column("odd").to_pylist(), n, at, name, similarity))
    if not got:
        return
    u, v, apart, bins = (np.concatenate(c) for c in zip(*got))
    mean, sd = odd_bins(np.floor((1 - similarity) / (1 + similarity) * (n[u] + n[v]) + 1e-9) + 1, bins)
    sure = apart < mean - SIGMAS * sd
    _, first, group = np.unique(name, return_index=True, return_inverse=True)
    low = least_reachable(len(first), group[u[sure]], group[v[sure]])
    hung = np.flatnonzero(low != np.arange(len(low)))
    rest = np.flatnonzero(~sure & (low[group[u]] != low[group[v]]))
    a, b = np.concatenate((node[first[hung]], node[u[rest]])), np.concatenate((node[first[low[hung]]], node[v[rest]]))
    far = np.concatenate((np.zeros(len(hung)), apart[rest] / np.maximum(n[u[rest]] + n[v[rest]], 1)))
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far), pa.array(np.arange(len(a)) < len(hung))], names=["a", "b", "apart", "sure"])


def possible(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parities leave room for the similarity, their bins apart for each shingle, and
    whether they are sure to have it; own: node, n, odd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart, bins = bins_apart(b.column("x").to_pylist(), b.column("y").to_pylist())
            n = b.column("n").to_numpy(zero_copy_only=False)
            most = np.floor((1 - similarity) / (1 + similarity) * n + 1e-9)
            mean, sd = odd_bins(most + 1, bins)
            ok = apart <= most
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(ok)) for c in ("a", "b")), pa.array((apart / np.maximum(n, 1))[ok]), pa.array((apart < mean - SIGMAS * sd)[ok])],
                                             names=["a", "b", "apart", "sure"])

    one = own.select("node", "n", "odd").dropDuplicates(["node"])
    a, b = (one.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("odd").alias(o)) for c, o in (("a", "x"), ("b", "y")))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y").mapInArrow(run, CHECKED)


def best(pairs: DataFrame) -> DataFrame:
    """For each node its pair with the fewest bins apart."""
    both = pairs.select("a", "b", "apart").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    near = both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m"))
    return near.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    x, y = comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "apart")


def verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have exactly that similarity or more; own: doc_id, node.  Only the texts of
    one document a node go on; Spark broadcasts the documents' ids where they are few enough for it."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = cut(own.where("doc_id is not null").join(ends, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    lost = own.where("doc_id is null").join(ends.join(some, "node", "left_anti"), "node", "left_semi").limit(1).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in _sets(b.column(0), words):
                own = {digest(s): s for s in sets}
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([s.view(np.int64) for s in own.values()], pa.list_(pa.int64()))], names=["node", "shingles"])

    held = docs.join(some.select("doc_id"), "doc_id", "left_semi").select("text")
    if lost:  # nodes that only rows without an id have
        held = held.union(docs.where("doc_id is null").select("text"))
    found = held.mapInArrow(run, "node long, shingles array<long>").join(ends, "node", "left_semi").dropDuplicates(["node"])
    a, b = found.select(F.col("node").alias("a"), F.col("shingles").alias("x")), found.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - F.lit(1e-9)).select("a", "b")
