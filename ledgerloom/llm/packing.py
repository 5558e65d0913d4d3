"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every scan task packs the documents it reads, so nothing is shuffled and no task holds more than one
window of tokens.  A sequence costs the sum over its pieces of ``linear * n + quadratic * n * n`` (the
attention of n tokens to themselves).  Per window of about ``window`` tokens:

* whole sequences are cut from documents that are at least one sequence long;
* the remainders, in descending cost, go to the sequence of least cost with room for them; one that fits
  nowhere is cut over the least costly sequences with any room left, so every sequence is full;
* what is left over (less than one sequence) opens the next window.

The last few tokens of a task are cut into sequences whose lengths are powers of two, which need no
padding.  Ids are those that ``tokenizers`` gives for the byte-level BPE vocabulary at ``vocab`` (its JSON file),
added tokens in a text included; one end id closes each document.  A text is cut at added tokens; between them a
word with the space before it is a unit of the vocabulary's split pattern, so words are looked up in a bounded cache, and
pieces with any other white space are encoded as one string.

Defined results: a null text counts as empty (one end id); rows that repeat an id are packed as documents
of their own; a null id is kept; very long texts are cut like others; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHE = 300_000


def default_vocab() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other bytes
    for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """word -> its ids as little-endian unsigned 32-bit; the word follows a space unless a newline starts it.
    Added tokens of the vocabulary file are found wherever they stand, the longest of those that start first."""

    def __init__(self, vocab: str, pattern: str) -> None:
        import tiktoken

        with open(vocab, encoding="utf-8") as f:
            held = json.load(f)
        added = {x["content"]: x["id"] for x in held.get("added_tokens") or ()}
        if any(x.get(k) for x in held.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized")) or held.get("normalizer"):
            raise ValueError("only added tokens that are matched as they stand, and no normalizer")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in w): i for w, i in held["model"]["vocab"].items() if w not in added}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {k: np.array([i], dtype="<u4").tobytes() for k, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.whole(word if word[0] == "\n" else " " + word)
        return ids

    def ids(self, text: str) -> bytes:
        if self.cut and any(a in text for a in self.added):
            return b"".join(self.added[x] if x in self.added else self.plain(x) for x in self.cut.split(text) if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        parts = text.replace("\n", " \n").split(" ")
        if len(parts) != len(text.split()) or "" in parts or "\n" in parts:
            return self.whole(text)
        return self.whole(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))


class Packer:
    """Packs one task's documents; ``rows`` collects finished pieces."""

    def __init__(self, size: int, linear: float, quadratic: float, first: int) -> None:
        self.size, self.linear, self.quadratic, self.next = size, linear, quadratic, first
        self.rows: list[tuple] = []
        self.open: list[tuple] = []  # (doc_id, doc_tokens, start, ids)
        self.held = 0

    def _put(self, seq: int, offset: int, piece: tuple, at: int, n: int) -> None:
        doc, total, start, ids = piece
        self.rows.append((doc, start + at, n, zlib.crc32(memoryview(ids)[4 * at:4 * (at + n)]), total, seq, offset))

    def add(self, doc: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        piece = (doc, total, 0, ids)
        while total - at >= self.size:
            self._put(self.next, 0, piece, at, self.size)
            self.next += 1
            at += self.size
        if total > at:
            self.open.append((doc, total, at, ids[4 * at:]))
            self.held += total - at

    def flush(self) -> None:
        """Fill as many whole sequences as the open pieces give; the rest stays open."""
        n = self.held // self.size
        if not n:
            return
        todo = sorted(self.open, key=lambda p: -len(p[3]))
        cost, room = np.zeros(n), np.full(n, self.size, dtype=np.int64)
        rest: list[tuple] = []
        for piece in todo:
            at, left = 0, len(piece[3]) // 4
            while left:
                fits = room >= left
                if not fits.any():
                    fits = room > 0
                    if not fits.any():
                        rest.append((piece[0], piece[1], piece[2] + at, piece[3][4 * at:]))
                        break
                b = int(np.argmin(np.where(fits, cost, np.inf)))
                take = int(min(left, room[b]))
                self._put(self.next + b, int(self.size - room[b]), piece, at, take)
                room[b] -= take
                cost[b] += self.linear * take + self.quadratic * take * take
                at, left = at + take, left - take
        self.next += n
        self.open, self.held = rest, sum(len(p[3]) // 4 for p in rest)

    def close(self) -> None:
        self.flush()
        total, pieces = self.held, iter(self.open)
        piece, at = next(pieces, None), 0
        for power in (1 << k for k in range(total.bit_length() - 1, -1, -1)):
            if not total & power:
                continue
            filled = 0
            while filled < power:
                n = min(len(piece[3]) // 4 - at, power - filled)
                self._put(self.next, filled, piece, at, n)
                filled, at = filled + n, at + n
                if at == len(piece[3]) // 4:
                    piece, at = next(pieces, None), 0
            self.next += 1
        self.open, self.held = [], 0


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048,
         window: int = 2_000_000, vocab: str | None = None, pattern: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if vocab is None or pattern is None:
        own = default_vocab()
        vocab, pattern = vocab or own[0], pattern or own[1]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = Words(vocab, pattern), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(size, linear, quadratic, TaskContext.get().partitionId() << 32)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc, words.ids(text) + end if text else end)
                if packer.held >= window:
                    packer.flush()
            if len(packer.rows) > 20_000:
                yield batch(packer.rows)
                packer.rows = []
        packer.close()
        yield batch(packer.rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
