"""Phrase collocations: n-grams enumerated from an FM-index per shard, summed across shards.

1. Tasks turn their documents, language by language, into shards: a sequence of word ids in which 0 ends a piece, and the
   shard's words.  Shards are cut where pieces end, so no phrase is lost.  They are written to the shared folder.
2. A shard's ``Index`` holds the Burrows-Wheeler transforms of the sequence and of its reverse, sorted as deep as phrases are
   long.  Intervals of rows stand for phrases; one step extends all intervals of a length at once: to the right in the
   reverse index, to the left in the forward one, each step keeping both in line.  A phrase's count is its interval's
   size; the phrases that extend it to the left or right are its extensions.
3. Most phrases are rare, so their words do not travel.  Shards send 40 bits of a phrase's hash and its count, dealt by other
   bits of the hash; sums below the least count rule a phrase out for good (equal bits only add up, so nothing is lost), and
   each shard gets back one bit for each phrase that it sent.  What is left is spelt out and summed by its words.
4. Joins on the parts of a phrase give the scores.  Everything that sums or compares is exact; products are decimals.

The number of buckets follows the counted words, so a task's memory does not grow with the corpus.

Defined results: null texts count as empty and a null language as ``und`` (with rows that name it so); null or repeated ids
do not matter; words are what spaces and tabs leave, other characters (control characters too) are letters like any; a piece
without end is one shard whatever its length; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

#: Words after which a shard is full, bytes after which a text is cut at the next end of a piece, phrases a bucket holds
SHARD, SLICE, BUCKET = 750_000, 4_000_000, 1_500_000
SPLIT = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(SPLIT + b"\t" + bytes(range(65, 91)), b"\n" * len(SPLIT) + b" " + bytes(range(97, 123)))
TOKEN = re.compile(rb"\n|[^ \n]+")
U64 = np.uint64
SHARDS = "shard long, lang string, n long, ids binary, vocabulary binary"


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = text.find(b"\n", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Shard:
    """Word ids of one language in a task."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count(1).__next__)
        self.ids[b"\n"] = 0
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, tokens: list[bytes]) -> None:
        own = np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.uint32, count=len(tokens))
        self.held += [np.zeros(1, dtype=np.uint32), own]
        self.n += int(np.count_nonzero(own))

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate([*self.held, np.zeros(1, dtype=np.uint32)])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        blobs = squeeze(ids.tobytes()), squeeze(b"\n".join(list(self.ids)[1:]))
        return pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, "n": self.n, "ids": blobs[0], "vocabulary": blobs[1]}],
                                          schema=pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()),
                                                            ("ids", pa.binary()), ("vocabulary", pa.binary())]))


def shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """shard, lang, n (words), ids, vocabulary: one row a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        names = count(TaskContext.get().partitionId() << 32)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for part in _slices((text.as_py() or b"").translate(FOLD)):
                    shard = open_.setdefault(lang, _Shard())
                    shard.add(TOKEN.findall(part))
                    if shard.n >= SHARD:
                        yield open_.pop(lang).row(next(names), lang)
        for lang, shard in open_.items():
            if shard.n:
                yield shard.row(next(names), lang)

    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SHARDS)


def _sorted_rows(t: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """Places of a sequence by the ``depth`` symbols from there on."""
    if symbols ** depth >= 1 << 63:
        return np.lexsort([np.concatenate((t[k:], np.zeros(min(k, len(t)), dtype=t.dtype))) for k in range(depth)][::-1])
    key = t.copy()
    for k in range(1, depth):
        key *= symbols
        key[:-k] += t[k:]
    return np.argsort(key)


class _Half:
    """One direction of the index: rows sorted by depth, the symbol before each row, and where that symbol's row is."""

    def __init__(self, t: np.ndarray, depth: int, symbols: int) -> None:
        self.symbols, self.at = symbols, _sorted_rows(t, depth, symbols)
        self.bwt = np.where(self.at > 0, t[self.at - 1], 0)
        order = np.argsort(self.bwt * len(t) + np.arange(len(t)))
        self.back = np.empty(len(t), dtype=np.int64)
        self.back[order] = np.arange(len(t))

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions of disjoint intervals: which one, its symbol, rows, first row here, and rows of smaller symbols
        in the interval (the shift of the other direction's interval).  Ends of pieces extend nothing."""
        which = np.repeat(np.arange(len(low)), size)
        first = np.cumsum(size) - size
        rows = np.arange(len(which)) - first[which] + low[which]
        key = which * self.symbols + self.bwt[rows]
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        n = np.diff(np.concatenate((start, [len(key)])))
        of, symbol = key[start] // self.symbols, key[start] % self.symbols
        begin = np.minimum.reduceat(self.back[rows[order]], start) if len(start) else start
        real = symbol > 0
        return of[real], symbol[real], n[real], begin[real], (start - first[of])[real]


class Index:
    """A bidirectional FM-index of one shard."""

    def __init__(self, t: np.ndarray, symbols: int, depth: int) -> None:
        self.t, self.depth, self.symbols = t, depth, symbols
        self.ahead, self.behind = _Half(t, depth, symbols), _Half(t[::-1], 2, symbols)

    def phrases(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Length by length: the words of each phrase, its count, and the numbers of the phrases of the length before that
        lack its last and its first word (it is their right and left extension)."""
        n = np.bincount(self.t, minlength=self.symbols)
        low = np.cumsum(n) - n
        words = np.flatnonzero(n[1:]) + 1
        n, low = n[words], low[words]
        none = np.zeros(0, dtype=np.int64)
        yield words[:, None], n, none, none
        if self.depth < 2:
            return
        number = np.zeros(self.symbols, dtype=np.int64)
        number[words] = np.arange(len(words))
        of, symbol, size, _, shift = self.behind.extend(low, n)  # to the right: the reverse index's symbol before
        text, n, low = np.stack([words[of], symbol], axis=1), size, low[of] + shift
        yield text, n, of, number[symbol]
        for _ in range(3, self.depth + 1):
            of, symbol, size, begin, _ = self.ahead.extend(low, n)  # to the left
            order = np.argsort(begin)
            of, symbol, size, begin = of[order], symbol[order], size[order], begin[order]
            part = np.searchsorted(low, begin, "right") - 1
            text, n, low = np.concatenate((symbol[:, None], text[of]), axis=1), size, begin
            yield text, n, part, of


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _opened(lang: str, ids: bytes, vocabulary: bytes, depth: int) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Words, (word ids, counts) by length, and the hashes of all phrases one after the other."""
    expand = zstandard.ZstdDecompressor().decompress
    words = expand(vocabulary).split(b"\n")
    t = np.frombuffer(expand(ids), dtype="<u4").astype(np.int64)
    seed = xxhash.xxh64_intdigest(lang.encode(), 3)
    own = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], dtype=U64)
    levels = [(text, n) for text, n, _, _ in Index(t, len(words) + 1, depth).phrases()]
    hashes = []
    for text, _ in levels:
        h = own[text[:, 0]]
        for k in range(1, text.shape[1]):
            h = _mix(h) + own[text[:, k]]
        hashes.append(_mix(h))
    return words, levels, np.concatenate(hashes)


def _each(b: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: a shard's index is large beside its row."""
    for i in range(b.num_rows):
        yield b.slice(i, 1).to_pylist()[0]


def _dealt(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of phrases by bucket, and where each bucket begins in it."""
    bucket = (hashes >> U64(40)) % U64(width)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(width + 1, dtype=U64))


def frequent(held: DataFrame, least: int, depth: int, width: int) -> DataFrame:
    """shard, marks (bucket, bits): of each shard's phrases, in the order they were dealt, those that may be frequent."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _each(b):
                _, levels, hashes = _opened(r["lang"], r["ids"], r["vocabulary"], depth)
                order, start = _dealt(hashes, width)
                code = hashes[order].view(np.uint8).reshape(-1, 8)[:, :5]
                n = np.concatenate([n for _, n in levels])[order].astype("<u4")
                some = np.flatnonzero(np.diff(start))
                blobs = [code[start[k]:start[k + 1]].tobytes() + n[start[k]:start[k + 1]].tobytes() for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([r["shard"]] * len(some), pa.int64()), pa.array(blobs, pa.binary())],
                                                 names=["bucket", "shard", "codes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for b in batches:
            for k, shard, blob in zip(*(c.to_pylist() for c in b.columns)):
                rows[k].append((shard, blob))
        for k, group in rows.items():
            sizes = np.array([len(blob) // 9 for _, blob in group])
            code = np.zeros((sizes.sum(), 8), dtype=np.uint8)
            code[:, :5] = np.concatenate([np.frombuffer(x, np.uint8, 5 * n).reshape(-1, 5) for (_, x), n in zip(group, sizes.tolist())])
            n = np.concatenate([np.frombuffer(x, "<u4", n, 5 * n) for (_, x), n in zip(group, sizes.tolist())]).astype(np.int64)
            code = code.view("<u8").ravel()
            order = np.argsort(code)
            start = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
            enough = np.add.reduceat(n[order], start) >= least
            ok = np.empty(len(code), dtype=bool)
            ok[order] = np.repeat(enough, np.diff(np.concatenate((start, [len(code)]))))
            bits = [np.packbits(x).tobytes() for x in np.split(ok, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in group], pa.int64()), pa.array([k] * len(group), pa.int32()), pa.array(bits, pa.binary())],
                                             names=["shard", "bucket", "bits"])

    sent = held.select("shard", "lang", "ids", "vocabulary").mapInArrow(send, "bucket int, shard long, codes binary")
    marks = sent.repartitionById(width, "bucket").mapInArrow(add, "shard long, bucket int, bits binary")
    return marks.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))


def phrase_counts(held: DataFrame, least: int, depth: int) -> DataFrame:
    """lang, phrase, words, a: phrases (single words too) with at least that count; held: shards."""
    spark = held.sparkSession
    total = held.agg(F.sum("n")).first()[0] or 0
    width = max(partitions(spark), -(-depth * total // BUCKET))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _each(b):
                words, levels, hashes = _opened(r["lang"], r["ids"], r["vocabulary"], depth)
                order, start = _dealt(hashes, width)
                ok = np.zeros(len(hashes), dtype=bool)
                for m in r["marks"]:
                    here = order[start[m["bucket"]]:start[m["bucket"] + 1]]
                    ok[here] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=len(here)).astype(bool)
                names, at = pa.array([b"", *words], pa.binary()).cast(pa.string()), 0
                for text, n in levels:
                    mine = np.flatnonzero(ok[at:at + len(n)])
                    at += len(n)
                    for k in range(0, len(mine), 100_000):
                        some = text[mine[k:k + 100_000]]
                        phrase = pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in some.T), " ")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["lang"]] * len(some), pa.string()), phrase, pa.array(np.full(len(some), text.shape[1], np.int32)), pa.array(n[mine[k:k + 100_000]], pa.int64())],
                            names=["lang", "phrase", "words", "a"])

    spelt = (held.select("shard", "lang", "ids", "vocabulary").join(frequent(held, least, depth, width), "shard")
             .select("lang", "ids", "vocabulary", "marks").mapInArrow(spell, "lang string, phrase string, words int, a long"))
    return spelt.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("a").alias("a")).where(F.col("a") >= least)


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two words or more: the cut that scores lowest, the first of equals."""
    cuts = counts.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", _part(F.lit(1), F.col("k"))).withColumn("rest", _part(F.col("k") + 1, F.col("words")))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    big = {c: F.col(c).cast("decimal(14,0)") for c in "alr"}
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big["a"] * big["a"]), big["l"] * big["r"])
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score.cast("long"))
    return (both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"))


def covered(counts: DataFrame, cover: int) -> DataFrame:
    """lang, phrase, within: for phrases inside longer ones, the largest count of these.  ``cover`` only names which matter."""
    inner = counts.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    return inner.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int | None = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases (all, if none) of 2 to ``longest`` words that
    occur ``least`` times and of which no longer phrase has ``cover`` percent."""
    held = cut(shards(docs, lang_col, text_col))
    counts = cut(phrase_counts(held, least, longest))
    alone = scored(counts).join(covered(counts, cover), ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (F.lit(100) * F.col("within") < F.lit(cover) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("__r", F.row_number().over(order))
    ranked = ranked.where(F.col("__r") <= top) if top is not None else ranked  # each task sends its first rows only
    ranked = ranked.withColumn("rank", F.col("__r").cast("long"))
    words = held.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query's rows by plain n-gram lists.
OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces),
f AS (SELECT lang, phrase, words, count(*) AS a FROM grams GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, words, a, k, array_to_string(s[1:k], ' ') AS first, array_to_string(s[k + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, words)) AS k FROM f WHERE words > 1 AND a >= 10)),
scores AS (
  SELECT c.*, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.first = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase),
low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
alone AS (
  SELECT * FROM low WHERE words = 3 OR NOT EXISTS (
    SELECT 1 FROM low t JOIN cuts c ON t.lang = c.lang AND t.phrase = c.phrase
    WHERE t.words = 3 AND t.lang = low.lang AND (c.first = low.phrase OR c.rest = low.phrase) AND 100 * t.a >= 50 * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang) n ON r.lang = n.lang WHERE r.rank <= 2000
"""
