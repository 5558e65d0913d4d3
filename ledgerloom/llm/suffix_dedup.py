"""Removal of repeated byte strings across documents by a distributed, sampled suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id;
strings are judged on the input.  Sorting every suffix of a corpus would ship ``length`` bytes for each
byte.  Instead every string of ``length`` bytes elects one of its ``gram``-byte substrings, the one with the
least hash (the first of equals), as its anchor: equal strings elect the same one at the same place, and
neighbouring strings nearly always share one, so about one position in ``(length - gram) / 2`` is an
anchor.  An anchor speaks for the run of strings that elected it.

1. Each task elects the anchors of its documents in chunks and settles equal runs within the chunk: all but those
   of the smallest id repeat something earlier, and of a document's own equal runs the first speaks for the others
   (texts that repeat a word thousands of times).
2. What is left (anchor hash, four hashes of parts of the run about it, place: some 21 bytes a run, no text) is
   dealt by anchor hash.  A string that two runs share covers one of these four parts as a whole, so runs that agree
   with no other document on any of them are done with.
3. The other runs' bytes are dealt by anchor hash, and their suffixes are sorted by mergesort: first whole runs,
   then, of runs that differ, the strings in them.  Two suffixes are compared by binary search for their common
   extension on prefix hashes and one byte after it; neighbours that hash alike are compared byte by byte, and a
   collision sends them to classes by plain bytes.  In each class of equal strings, all but the smallest id repeat.
4. Repeated starts meet their document again, which is cut.

Steps 1 and 3 decide by the same suffix order and byte comparison; hashes alone only rule runs out.

Anchors that many documents of a bounded sample share (``SAMPLE`` rows; it only steers cost) are hot: within a chunk
their runs are also settled string by string, so of a line that a third of all documents share one copy a chunk goes
on, and their records are dealt by anchor and part instead of anchor alone.
Texts over ``CHUNK`` bytes are cut into pieces that overlap by ``length - 1`` bytes, so each string is in one piece.

Defined results: null text counts as empty; texts shorter than ``length`` stay whole; rows that repeat an
id are judged as one document (they never remove each other) and give one row each; a null id counts as
larger than any other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, release

BASE, CHUNK, SLICE, LAST = 0x9E3779B97F4A7C15, 1_500_000, 2_000_000, (1 << 63) - 1
SAMPLE, HOT_SHARE, HOT_LEAST = 4_000, 0.02, 16
SIDE_BITS = 12
U64 = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, back):
        p = np.full(n + 1, base, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


class Hashes:
    """Prefix polynomial hashes modulo 2**64 of a byte array; the hash of any substring in constant time."""

    def __init__(self, raw: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        n = len(raw)
        up, down = powers if powers is not None and len(powers[0]) > n else _powers(n)
        self.down = down
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((raw.astype(U64) + U64(1)) * up[:n], out=self.sums[1:], dtype=U64)

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _runs(raw: np.ndarray, hashes: Hashes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings inside documents (fewer than 2**24 bytes): (anchor, first start, last start, anchor hash)."""
    n = max(0, len(raw) - gram + 1)
    at = np.arange(n, dtype=np.int64)
    grams = _mix((hashes.sums[gram:] - hashes.sums[:n]) * hashes.down[:n])
    low = (grams & ~U64((1 << 24) - 1)) | at.astype(U64)
    width = length - gram + 1
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    starts = np.concatenate(([0], ends[:-1]))
    room = ends - starts - length + 1
    keep = room > 0
    spans, first = room[keep], starts[keep]
    s = np.repeat(first - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
    anchor = (low[s] & U64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1)) if len(s) else np.zeros(0, dtype=np.int64)
    a, lo = anchor[new], s[new]
    hi = s[np.concatenate((new[1:], [len(s)])) - 1] if len(s) else lo
    return a, lo, hi, grams[a] >> U64(24)


def _sides(missing: int) -> list[tuple[int, int]]:
    """(bytes before, bytes after an anchor): a common string holds the anchor and ``missing`` more bytes, so
    it agrees on one of these four."""
    p1, p2, p3 = (-(-missing * i // 4) for i in (1, 2, 3))
    return [(0, missing - p1 + 1), (p1, missing - p2 + 1), (p2, missing - p3 + 1), (p3, 0)]


def _side_hashes(hashes: Hashes, at: np.ndarray, left: np.ndarray, span: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side: the runs that reach over it, and the hash of its bytes.  at: anchor positions."""
    out = []
    after = length + span - left - gram
    for x, y in _sides(length - gram):
        i = np.flatnonzero((left >= x) & (after >= y))
        out.append((i, _mix(hashes(at[i] - x, gram + x + y))))
    return out


# -- suffix sort ----------------------------------------------------------------------------------

def common_extension(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most ``most``: binary search on hashes."""
    out = np.array(np.broadcast_to(most, a.shape), dtype=np.int64)
    part = np.flatnonzero(hashes(a, out) != hashes(b, out))
    a, b = a[part], b[part]
    lo, hi = np.zeros(len(a), dtype=np.int64), out[part] - 1
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = hashes(a, mid) == hashes(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    out[part] = lo
    return out


def sort_suffixes(raw: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Order of the suffixes by (group, first ``most`` bytes): mergesort in every group at once.  At each
    level a suffix finds its place in the neighbouring run by binary search; equals keep their order."""
    most = np.broadcast_to(most, starts.shape)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[group[order]]
    size = sizes[group[order]]
    slot = np.arange(len(order))
    run = 1
    while run < (sizes.max() if len(sizes) else 0):
        p = slot - first
        own = p // run
        sib = (own ^ 1) * run
        act = np.flatnonzero(sib < size)
        lo = (first + sib)[act]
        end = first[act] + np.minimum(sib[act] + run, size[act])
        base, hi = lo.copy(), end
        me, right, reach = starts[order[act]], (own[act] & 1).astype(bool), most[order[act]]
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            other = starts[order[mid]]
            n = common_extension(hashes, me[live], other, reach[live])
            x, y = raw[np.minimum(other + n, len(raw) - 1)], raw[np.minimum(me[live] + n, len(raw) - 1)]
            before = np.where(n == reach[live], right[live], x < y)  # the other stands before me
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        place = slot.copy()
        place[act] = first[act] + (own[act] >> 1) * 2 * run + (p[act] - own[act] * run) + (lo - base)
        out = np.empty_like(order)
        out[place] = order
        order = out
        run *= 2
    return order


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether the n (8 or more) bytes at a equal those at b, for all pairs; eight bytes at a time."""
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    for i in range(0, len(a), 200_000):
        x, y, m = a[i:i + 200_000], b[i:i + 200_000], n[i:i + 200_000]
        for at in range(0, int(m.max()), 8):
            k = np.flatnonzero(m > at) if at else slice(None)
            p = np.minimum(at, m[k] - 8)
            if not (words[x[k] + p] == words[y[k] + p]).all():
                return False
    return True


def equal_strings(raw: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A class for each suffix: equal where group and the first ``most`` bytes (one number a group) are."""
    order = sort_suffixes(raw, hashes, starts, group, most)
    at = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    a, b, n = starts[order[at + 1]], starts[order[at]], most[order[at]]
    same = hashes(a, n) == hashes(b, n)
    alike = np.zeros(len(order) - 1, dtype=bool)
    alike[at[same]] = True
    if not same.any() or _same_bytes(raw, a[same], b[same], n[same]):  # collision verification
        cls = np.empty(len(order), dtype=np.int64)
        cls[order] = np.concatenate(([0], np.cumsum(~alike)))
        return cls
    names: dict[tuple[int, bytes], int] = {}
    return np.array([names.setdefault((g, raw[s:s + n].tobytes()), len(names)) for g, s, n in zip(group.tolist(), starts.tolist(), most.tolist())], dtype=np.int64)


def _partners(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a key also stands in another document."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    order = np.argsort(key)
    k, d = key[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    out = np.empty(len(key), dtype=bool)
    out[order] = np.repeat(np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new), np.diff(np.append(new, len(k))))
    return out


def _later(cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    least = np.full(cls.max() + 1, LAST, dtype=np.int64)
    np.minimum.at(least, cls, doc)
    return doc > least[cls]


def _whole_runs(raw: np.ndarray, hashes: Hashes, h: np.ndarray, base: np.ndarray, left: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """Class of each run that equals another one (place, length and bytes), -1 for the others."""
    cls = np.full(len(h), -1, dtype=np.int64)
    size = span + length
    place = h << U64(16) | left.astype(U64) << U64(8) | span.astype(U64)
    content = _mix(hashes(base, size)) ^ _mix(place)
    order = np.argsort(content)
    twin = content[order][1:] == content[order][:-1]
    many = np.sort(order[np.concatenate(([False], twin)) | np.concatenate((twin, [False]))]) if len(h) else order
    if len(many):
        _, group = np.unique(place[many], return_inverse=True)
        cls[many] = equal_strings(raw, hashes, base[many], group, size[many])
    return cls


def _shared_strings(raw: np.ndarray, hashes: Hashes, h: np.ndarray, doc: np.ndarray, base: np.ndarray, left: np.ndarray, span: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, string in it) of strings that runs of a smaller id with the same anchor also hold."""
    none = np.zeros(0, dtype=np.int64)
    sides = np.zeros(len(h), dtype=np.uint8)
    for k, (i, v) in enumerate(_side_hashes(hashes, base + left, left, span, length, gram)):
        i = i[_partners(v ^ _mix(h[i]), doc[i])]
        sides[i] |= 1 << k
    run = np.flatnonzero(sides)
    if not len(run):
        return none, none
    count = span[run].astype(np.int64) + 1
    which = np.repeat(run, count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    offset = left[which] - inner  # from the string's start to its anchor
    # a string with so many bytes before its anchor can only be shared on that side
    side = np.searchsorted([x for x, _ in _sides(length - gram)[1:]], offset, side="right").astype(np.uint8)
    keep = np.flatnonzero(sides[which] >> side & 1)
    which, inner, offset = which[keep], inner[keep], offset[keep]
    place = h[which] << U64(16) | offset.astype(U64)
    keep = np.flatnonzero(_partners(_mix(hashes(base[which] + inner, length)) ^ _mix(place), doc[which]))
    if not len(keep):
        return none, none
    which, inner, place = which[keep], inner[keep], place[keep]
    _, group = np.unique(place, return_inverse=True)
    cls = equal_strings(raw, hashes, base[which] + inner, group, np.full(len(which), length, dtype=np.int64))
    later = _later(cls, doc[which])
    return which[later], inner[later]


def repeated_strings(raw: np.ndarray, h: np.ndarray, doc: np.ndarray, base: np.ndarray, left: np.ndarray, span: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last string) of runs of strings that a smaller id also holds."""
    hashes = Hashes(raw)
    cls = _whole_runs(raw, hashes, h, base, left, span, length)
    part = np.flatnonzero(cls >= 0)
    whole = part[_later(cls[part], doc[part])] if len(part) else part
    rest = np.ones(len(h), dtype=bool)
    rest[whole] = False
    rest = np.flatnonzero(rest)
    run, inner = _shared_strings(raw, hashes, h[rest], doc[rest], base[rest], left[rest], span[rest], length, gram)
    return np.concatenate((whole, rest[run])), np.concatenate((np.zeros(len(whole), dtype=np.int64), inner)), np.concatenate((span[whole], inner))


# -- packed columns ---------------------------------------------------------------------------------

NARROW = {"five": 5, "six": 6}


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width])


def _squeeze(data: bytes) -> bytes:
    """zstd at its fastest level, after the size."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unsqueeze(blob: bytes) -> bytes:
    return pa.Codec("zstd", 1).decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


class Columns:
    """Columns one after the other in one blob: (name, kind); "five" and "six" keep so many bytes.  Documents (id, key) are held once
    a blob, rows point into them."""

    def __init__(self, *fields: tuple[str, str]) -> None:
        self.fields = fields

    def pack(self, doc: np.ndarray, key: np.ndarray, **cols: np.ndarray) -> bytes:
        order = np.lexsort((key, doc))
        new = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(key[order]) != 0)))
        index = np.empty(len(doc), dtype="<u4")
        index[order] = np.cumsum(new) - 1
        own = order[new]
        parts = [np.array([len(doc), len(own)], dtype="<i8"), doc[own].astype("<i8"), key[own].astype("<i8"), index]
        return _squeeze(b"".join(x.tobytes() for x in (*parts, *(_narrow(cols[n], NARROW[kind]) if kind in NARROW else cols[n].astype(kind) for n, kind in self.fields))))

    def read(self, blobs: list[bytes]) -> dict[str, np.ndarray]:
        got: dict[str, list[np.ndarray]] = {n: [] for n in ("doc", "key", *(f for f, _ in self.fields))}
        for blob in map(_unsqueeze, blobs):
            n, d = np.frombuffer(blob, "<i8", 2).tolist()
            own, at = np.frombuffer(blob, "<i8", 2 * d, 16).reshape(2, d), 16 + 16 * d
            index, at = np.frombuffer(blob, "<u4", n, at), at + 4 * n
            got["doc"].append(own[0][index])
            got["key"].append(own[1][index])
            for name, kind in self.fields:
                if kind in NARROW:
                    width, wide = NARROW[kind], np.zeros((n, 8), dtype=np.uint8)
                    wide[:, :width] = np.frombuffer(blob, np.uint8, width * n, at).reshape(n, width)
                    got[name].append(wide.view("<u8").ravel())
                    at += width * n
                else:
                    got[name].append(np.frombuffer(blob, kind, n, at))
                    at += got[name][-1].nbytes
        kinds = dict(self.fields) | {"doc": "<i8", "key": "<i8"}
        return {n: np.concatenate(x) if x else np.zeros(0, dtype="<u8" if kinds[n] in NARROW else kinds[n]) for n, x in got.items()}


RECORDS = Columns(("h", "five"), ("sides", "six"), ("a", "<u4"), ("left", "u1"), ("span", "u1"))
STARTS = Columns(("lo", "<u4"), ("hi", "<u4"))
COPIES = Columns(("lo", "<u4"), ("hi", "<u4"), ("shift", "<u4"))
ASKS = Columns(("h", "five"), ("a", "<u4"), ("left", "u1"), ("span", "u1"))
KINDS = {"records": RECORDS, "starts": STARTS, "copies": COPIES, "asks": ASKS}


def _deal(kind: str, to: np.ndarray, doc: np.ndarray, key: np.ndarray, **cols: np.ndarray) -> Iterator[tuple[int, str, bytes]]:
    """(partition, kind, blob) for every partition that rows go to."""
    order = np.argsort(to, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(g):
            yield int(to[g[0]]), kind, KINDS[kind].pack(doc[g], key[g], **{n: x[g] for n, x in cols.items()})


# -- tasks ------------------------------------------------------------------------------------------

def _chunk(texts: list[bytes], ids: np.ndarray, keys: np.ndarray, offsets: np.ndarray, length: int, gram: int, buckets: int, hot: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, str, bytes]]:
    """(partition, kind, blob) of one chunk of texts.  A text may be a piece of its document that starts at its
    offset there; all places that leave are places in the document."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    hashes = Hashes(raw, powers)
    a, lo, hi, h = _runs(raw, hashes, ends, length, gram)
    if not len(a):
        return
    piece = np.searchsorted(ends, a, side="right")
    begin = (np.concatenate(([0], ends[:-1])) - offsets)[piece]
    doc, key, left, span = ids[piece], keys[piece], a - lo, hi - lo
    home = (key % buckets).astype(np.int64)
    cls = _whole_runs(raw, hashes, h, lo, left, span, length)
    part = np.flatnonzero(cls >= 0)
    later, first = np.zeros(len(a), dtype=bool), np.arange(len(a))
    if len(part):
        later[part] = _later(cls[part], doc[part])
        # a document's own equal runs share their fate: the first one speaks for them
        order = part[np.lexsort((lo[part] - begin[part], key[part], doc[part], cls[part]))]
        twin = np.concatenate(([False], (np.diff(cls[order]) == 0) & (np.diff(doc[order]) == 0) & (np.diff(key[order]) == 0)))
        first[order] = order[np.maximum.accumulate(np.where(twin, 0, np.arange(len(order))))]
    again = (first != np.arange(len(a))) & ~later
    i = np.flatnonzero(later)
    yield from _deal("starts", home[i], doc[i], key[i], lo=lo[i] - begin[i], hi=hi[i] - begin[i])
    i = np.flatnonzero(again)
    at, to = lo[first[i]] - begin[first[i]], lo[i] - begin[i]
    yield from _deal("copies", home[i], doc[i], key[i], lo=at, hi=at + span[i], shift=to - at)
    live = ~later & ~again
    warm = np.zeros(len(a), dtype=bool)
    if len(hot):
        warm = live & (hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
        i = np.flatnonzero(warm)
        run, inner = _shared_strings(raw, hashes, h[i], doc[i], lo[i], left[i], span[i], length, gram)
        at = lo[i[run]] - begin[i[run]] + inner
        yield from _deal("starts", home[i[run]], doc[i[run]], key[i[run]], lo=at, hi=at)
        # what is left of these runs: from their first to their last string that is not settled
        count = span[i] + 1
        which, before = np.repeat(np.arange(len(i)), count), np.cumsum(count) - count
        open_ = np.ones(len(which), dtype=bool)
        open_[before[run] + inner] = False
        which, place = which[open_], (np.arange(len(open_)) - np.repeat(before, count))[open_]
        low, high = np.full(len(i), LAST), np.full(len(i), -1)
        np.minimum.at(low, which, place)
        np.maximum.at(high, which, place)
        live[i[high < 0]] = warm[i[high < 0]] = False
        i, low, high = i[high >= 0], low[high >= 0], high[high >= 0]
        lo[i], left[i], span[i] = lo[i] + low, left[i] - low, high - low
    sides = np.zeros((4, len(a)), dtype=U64)
    for k, (i, v) in enumerate(_side_hashes(hashes, a, left, span, length, gram)):
        sides[k, i] = v % U64((1 << SIDE_BITS) - 1) + U64(1)
    i = np.flatnonzero(live & ~warm)
    fixed = lambda i: {"h": h[i], "a": a[i] - begin[i], "left": left[i], "span": span[i]}
    yield from _deal("records", (h[i] % U64(buckets)).astype(np.int64), doc[i], key[i], **fixed(i), sides=_packed(sides[:, i]))
    for k in range(4):  # of hot anchors, each side goes its own way
        i = np.flatnonzero(warm & (sides[k] > 0))
        to = (_mix(h[i] << U64(SIDE_BITS) | sides[k, i]) + U64(k)) % U64(buckets)
        yield from _deal("records", to.astype(np.int64), doc[i], key[i], **fixed(i), sides=sides[k, i] << U64(k * SIDE_BITS))


def _packed(sides: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce([s << U64(k * SIDE_BITS) for k, s in enumerate(sides)])


def _settle(blobs: list[bytes], buckets: int) -> Iterator[tuple[int, str, bytes]]:
    """The runs of one partition's records that agree with another document's run of their anchor on a side."""
    t = RECORDS.read(blobs)
    h, doc = t["h"], t["doc"]
    some = np.flatnonzero(_partners(h, doc))
    ask = np.zeros(len(h), dtype=bool)
    for k in range(4):
        side = t["sides"][some] >> U64(k * SIDE_BITS) & U64((1 << SIDE_BITS) - 1)
        i = some[side > 0]
        ask[i] |= _partners(h[i] << U64(SIDE_BITS) | side[side > 0], doc[i])
    i = np.flatnonzero(ask)
    yield from _deal("asks", t["key"][i] % buckets, doc[i], t["key"][i], **{n: t[n][i] for n in ("h", "a", "left", "span")})


ROW = np.dtype([("h", "<u8"), ("a", "<u4"), ("left", "u1"), ("span", "u1")])
RUNS = Columns(("h", "five"), ("a", "<u4"), ("left", "u1"), ("span", "u1"))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column, without a copy."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, dtype=np.int64)
    return off, np.frombuffer(data, np.uint8) if data else np.zeros(0, dtype=np.uint8)


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _fine(m: dict[str, np.ndarray], raw: np.ndarray, length: int, gram: int, buckets: int) -> Iterator[tuple[int, str, bytes]]:
    """Repeated starts among runs (in the order of their bytes in raw); whole anchors, about ``SLICE`` bytes at a time."""
    size = m["span"].astype(np.int64) + length
    base = np.cumsum(size) - size
    order = np.argsort(m["h"], kind="stable")
    ends = np.append(np.flatnonzero(np.diff(m["h"][order])) + 1, len(order))
    total = np.cumsum(size[order])[ends - 1]
    at = done = 0
    while at < len(order):
        last = max(int(np.searchsorted(total, done + SLICE, side="right")) - 1, int(np.searchsorted(ends, at, side="right")))
        i = order[at:ends[last]]
        own = _gather(raw, base[i], size[i])
        doc, left, span = m["doc"][i], m["left"][i].astype(np.int64), m["span"][i].astype(np.int64)
        run, low, high = repeated_strings(own, m["h"][i], doc, np.cumsum(size[i]) - size[i], left, span, length, gram)
        start = m["a"][i][run].astype(np.int64) - left[run]
        key = m["key"][i][run]
        yield from _deal("starts", key % buckets, doc[run], key, lo=start + low, hi=start + high)
        at, done = int(ends[last]), int(total[last])


def _emit(rows: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8_000_000:
            yield pa.RecordBatch.from_pydict(dict(zip(("p", "kind", "blob"), map(list, zip(*held)))), schema=DEALT_TYPES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(("p", "kind", "blob"), map(list, zip(*held)))), schema=DEALT_TYPES)


DEALT, DEALT_TYPES = "p int, kind string, blob binary", pa.schema([("p", pa.int32()), ("kind", pa.string()), ("blob", pa.binary())])
BY_DOC = "doc long, key long, starts binary, copies binary, asks binary"


def _of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of this partition: its repeated starts (joined where they touch), copies and asks."""
    blobs: dict[str, list[bytes]] = {"starts": [], "copies": [], "asks": []}
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
            blobs[kind].append(blob)
    t = {kind: KINDS[kind].read(x) for kind, x in blobs.items()}
    doc, key = (np.concatenate([x[c] for x in t.values()]) for c in ("doc", "key"))
    if not len(doc):
        return
    order = np.lexsort((key, doc))
    new = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(key[order]) != 0)))
    row = np.empty(len(doc), dtype=np.int64)
    row[order] = np.cumsum(new) - 1
    own, n = order[new], int(new.sum())
    cols, done = [pa.array(doc[own]), pa.array(key[own])], 0
    for kind, x in t.items():
        r = row[done:done + len(x["doc"])]
        done += len(r)
        if kind == "starts":
            lo, hi = r << 33 | x["lo"].astype(np.int64), r << 33 | x["hi"].astype(np.int64)
            o = np.argsort(lo)
            lo, hi, r = lo[o], hi[o], r[o]
            first = np.flatnonzero(np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1))) if len(lo) else o
            mask = (1 << 33) - 1
            data = np.stack([lo[first] & mask, (np.maximum.reduceat(hi, first) if len(lo) else hi) & mask], axis=1).astype("<u4")
            r = r[first]
        elif kind == "copies":
            o = np.lexsort((x["lo"], r))
            data, r = np.stack([x[c][o] for c in ("lo", "hi", "shift")], axis=1).astype("<u4"), r[o]
        else:
            o = np.lexsort((x["span"], x["left"], x["a"], r))
            same = [np.diff(c[o].astype(np.int64)) == 0 for c in (r, x["a"], x["left"], x["span"])]
            o = o[np.concatenate(([True], ~np.logical_and.reduce(same)))] if len(o) else o
            data, r = np.zeros(len(o), dtype=ROW), r[o]
            for c in ROW.names:
                data[c] = x[c][o]
        width = data.nbytes // max(1, len(data))
        offsets = np.searchsorted(r, np.arange(n + 1)) * width
        cols.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary()))
    whole = pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in BY_DOC.split(", ")])
    for i in range(0, n, 5000):
        yield whole.slice(i, 5000)


def hot_anchors(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Ascending hashes of anchors that many of a sample's documents hold: at most ``1 / HOT_SHARE`` times the anchors of
    an average document."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.zeros(0, dtype=U64)]
            for text in b.column(0):
                t = text.as_py()
                for at in range(0, len(t) - length + 1, CHUNK):
                    raw = np.frombuffer(t[at:at + CHUNK + length - 1], dtype=np.uint8)
                    own.append(np.unique(_runs(raw, Hashes(raw), np.array([len(raw)]), length, gram)[3]))
            h, c = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(np.where(np.arange(len(h)) == 0, b.num_rows, 0))], names=["h", "c", "n"])

    counts = cut(docs.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long, c long, n long"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(HOT_LEAST, HOT_SHARE * n)).select("h").toPandas()
    return np.sort(held.h.to_numpy(dtype=np.int64)).astype(U64)


def repeated_starts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc, key, starts, copies: runs of starts (pairs of 32-bit numbers) of strings seen in a smaller id, and the
    document's own copies of its runs; at most two rows a document.  docs: doc, key, text (binary)."""
    spark = docs.sparkSession
    buckets, chunk, hot = partitions(spark), CHUNK, hot_anchors(docs, length, gram)

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(chunk + length + 1)

        def rows() -> Iterator[tuple]:
            texts, ids, keys, offsets, held = [], [], [], [], 0
            done = lambda: _chunk(texts, *(np.array(x, dtype=np.int64) for x in (ids, keys, offsets)), length, gram, buckets, hot, powers)
            for b in batches:
                for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    whole = text.as_py()
                    for at in range(0, len(whole) - length + 1, chunk):
                        text = whole[at:at + chunk + length - 1]
                        if held and held + len(text) > chunk:
                            yield from done()
                            texts, ids, keys, offsets, held = [], [], [], [], 0
                        texts.append(text)
                        ids.append(doc)
                        keys.append(key)
                        offsets.append(at)
                        held += len(text)
            if texts:
                yield from done()
        yield from _emit(rows())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            blobs = []
            for b in batches:
                for p, kind, blob in zip(*(b.column(c).to_pylist() for c in ("p", "kind", "blob"))):
                    if kind == "records":
                        blobs.append(blob)
                    else:
                        yield p, kind, blob
            yield from _settle(blobs, buckets)
        yield from _emit(rows())

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key = (b.column(c).to_numpy() for c in ("doc", "key"))
            off, raw = _binary(b.column("text"))
            at, data = _binary(b.column("asks"))
            q = np.frombuffer(data[at[0]:at[-1]].tobytes(), dtype=ROW)
            which = np.repeat(np.arange(b.num_rows), np.diff(at) // ROW.itemsize)
            base = off[which] + q["a"] - q["left"]
            size = q["span"].astype(np.int64) + length
            to = (q["h"] % U64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ps, blobs, parts = [], [], []
            for g in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                if len(g):
                    ps.append(int(to[g[0]]))
                    blobs.append(RUNS.pack(doc[which[g]], key[which[g]], **{c: q[c][g] for c in ROW.names}))
                    parts.append(_squeeze(_gather(raw, base[g], size[g]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(blobs, pa.binary()), pa.array(parts, pa.binary())], names=["p", "blob", "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, parts = [], []
        for b in batches:
            blobs += b.column("blob").to_pylist()
            parts += b.column("part").to_pylist()
        if blobs:
            yield from _emit(_fine(RUNS.read(blobs), np.frombuffer(b"".join(map(_unsqueeze, parts)), dtype=np.uint8), length, gram, buckets))

    dealt = lambda df: df.repartitionById(buckets, "p")
    found = cut(dealt(dealt(docs.mapInArrow(elect, DEALT)).mapInArrow(settle, DEALT)).mapInArrow(_of_documents, BY_DOC))
    release(spark)
    asks = found.where("length(asks) > 0").select("doc", "key", "asks")
    runs = dealt(docs.join(asks.hint("shuffle_hash"), ["doc", "key"]).mapInArrow(fetch, "p int, blob binary, part binary"))
    fine = dealt(runs.mapInArrow(compare, DEALT)).mapInArrow(_of_documents, BY_DOC)
    return found.where("length(starts) > 0 or length(copies) > 0").select("doc", "key", "starts", "copies").union(fine.select("doc", "key", "starts", "copies"))


def _with_copies(s: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Repeated starts (first, last) and those that copies (first, last, shift) of their runs add."""
    s = s[np.argsort(s[:, 0], kind="stable")]
    new = np.concatenate(([True], s[1:, 0] > np.maximum.accumulate(s[:, 1])[:-1] + 1))
    s = np.stack([s[new, 0], np.maximum.reduceat(s[:, 1], np.flatnonzero(new))], axis=1)
    if not len(copies):
        return s
    i, j = np.searchsorted(s[:, 1], copies[:, 0]), np.searchsorted(s[:, 0], copies[:, 1], side="right")
    n = np.maximum(j - i, 0)
    which = np.repeat(np.arange(len(copies)), n)
    run = np.repeat(i, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    c = copies[which]
    added = np.stack([np.maximum(s[run, 0], c[:, 0]) + c[:, 2], np.minimum(s[run, 1], c[:, 1]) + c[:, 2]], axis=1)
    return np.concatenate([s, added])


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes)."""
    if not 4 <= gram <= length <= 255 or length < 8:
        raise ValueError("4 <= gram <= length, 8 <= length <= 255")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))
    starts = repeated_starts(rows, length, gram).groupBy("doc", "key").agg(F.collect_list("starts").alias("starts"), F.collect_list("copies").alias("copies"))
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    if not with_text:
        names, kinds, schema = names[:5], kinds[:5], schema.rpartition(",")[0]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t, found, copies in zip(b.column("doc").to_pylist(), b.column("text"), b.column("starts").to_pylist(), b.column("copies").to_pylist()):
                t = t.as_py()
                kept, spans = t, 0
                if found and any(found):
                    s, c = (np.frombuffer(b"".join(x), "<u4").reshape(-1, k).astype(np.int64) for x, k in ((found, 2), (copies, 3)))
                    s = _with_copies(s, c)
                    s = s[np.argsort(s[:, 0], kind="stable")]
                    lo, hi = s[:, 0], np.maximum.accumulate(s[:, 1] + length)
                    new = np.concatenate(([True], lo[1:] > hi[:-1]))
                    begin, end = lo[new].tolist(), hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hi) - 1]))].tolist()
                    kept = b"".join(t[x:y] for x, y in zip([0, *end], [*begin, len(t)]))
                    spans = len(begin)
                rows.append((None if doc == LAST else doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return rows.join(starts.hint("shuffle_hash"), ["doc", "key"], "left").select("doc", "text", "starts", "copies").mapInArrow(finish, schema)
