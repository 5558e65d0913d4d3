"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded, documented sample of the vectors (``pivots`` of them, the first in the order of a hash
of their ids).  A vector is represented by its ``depth`` nearest pivots in order.  The index is dealt over
groups of vectors by a hash of the id; each block of a group keeps an inverted file: for every pivot the list
of its vectors that have it, with the place it has there.  A query walks the lists of its own pivots and
adds up, for each vector met, how much smaller its footrule distance (the sum over pivots of the difference
of places, a missing pivot counting as last) is than that of a vector that shares no pivot; the
``share`` of each block's vectors with the least distance is then reranked by the exact measure on the
original vectors in double precision, and the blocks' best are merged.  Angles say nothing of lengths, which inner products
grow with, so the share is taken of the vectors of each length (to a power of two) by itself.

Queries travel in blocks of about ``BLOCK`` to every group of about ``GROUP`` vectors; neither side is broadcast or
collected, a group's task handles ``BLOCK`` vectors at a time and gives k rows a query, and how many groups there
are follows from the rows alone.  The work per query follows the number of
vectors; with random directions in some 60 dimensions, fewer candidates would miss the recall of 0.9.

Ties go to the smaller id, also among candidates of equal distance.  Defined results: vectors that are
null, empty, all zero, of another length than most (of equally common lengths, the least), or hold nulls or non-finite
numbers, take no part,
neither do null ids; rows that repeat an id are candidates of their own, the query's own id is never
one; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS, DEPTH, SHARE, BLOCK, GROUP = 256, 48, 0.3, 8192, 65536


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)))


def exponents(x: np.ndarray) -> np.ndarray:
    """For each row the power of two that brings its largest component to between 1/2 and 1."""
    return np.frexp(np.abs(x).max(axis=-1))[1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -exponents(x)[:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def order_pivots(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The depth nearest pivots of every row by angle, nearest first; ties to the smaller pivot."""
    near = unit(x) @ pivots.T
    if depth < near.shape[1]:
        cut = np.sort(np.argpartition(-near, depth - 1, axis=1)[:, :depth], axis=1)
        near = np.take_along_axis(near, cut, axis=1)
        return np.take_along_axis(cut, np.argsort(-near, axis=1, kind="stable"), axis=1).astype(np.int32)
    return np.argsort(-near, axis=1, kind="stable").astype(np.int32)


class Block:
    """Inverted files of one block of vectors, in ascending id order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, depth: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.depth = ids[order], np.ascontiguousarray(x[order]), depth
        self.power = exponents(self.x)
        self.single = np.ldexp(self.x, -self.power[:, None]).astype(np.float32)
        length = self.power + np.frexp(np.linalg.norm(np.ldexp(self.x, -self.power[:, None]), axis=1))[1]
        self.strata = [np.flatnonzero(length == e) for e in np.unique(length)]
        perm = order_pivots(self.x, pivots, depth)
        flat = perm.ravel()
        post = np.argsort(flat, kind="stable")
        self.who, self.room = post // depth, (depth - post % depth).astype(np.float64)  # room: depth - place
        self.at = np.searchsorted(flat[post], np.arange(len(pivots) + 1))

    def nearest(self, query_id: int, q: np.ndarray, perm: np.ndarray, share: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the k best of this block's candidates."""
        lists = [slice(self.at[p], self.at[p + 1]) for p in perm]
        who = np.concatenate([self.who[s] for s in lists])
        # |a - b| against last places: each shared pivot lowers the distance by twice the lesser room
        gain = np.concatenate([np.minimum(self.room[s], self.depth - r) for r, s in enumerate(lists)])
        shared = np.bincount(who, weights=gain, minlength=len(self.ids))
        key = shared * len(self.ids) + np.arange(len(self.ids), 0, -1)  # ties to the smaller id
        picks = []
        for rows in self.strata:
            n = min(len(rows), max(4 * k, int(np.ceil(share * len(rows)))))
            picks.append(rows[np.argpartition(-key[rows], n - 1)[:n]] if n < len(rows) else rows)
        pick = np.concatenate(picks)
        pick = pick[self.ids[pick] != query_id]
        # single precision first: the k best and all within its error of them are scored exactly; where products may
        # overflow even in double precision, ties of infinities decide, so all are
        power = exponents(q)
        if len(pick) > k and self.power.max() + power + 16 < 1024:
            q32 = np.ldexp(q, -power).astype(np.float32)
            scale = self.power[pick] - self.power[pick].max()
            tiny, scale = scale < -900, np.maximum(scale, -900)  # too small beside the largest to be told apart here
            rough = np.where(tiny, 0.0, np.ldexp((self.single[pick] @ q32).astype(np.float64), scale))
            most = np.ldexp(np.where(tiny, float(len(q)), 1e-5 * (float(np.abs(q32).sum()) + 1)), scale)
            pick = pick[rough + most >= np.partition(rough - most, -k)[-k]]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.x[pick] * q).sum(axis=1)
        best = np.lexsort((self.ids[pick], -scores))[:k]
        return self.ids[pick][best], scores[best]


def _rows(t: pa.Table, kind: bool) -> tuple[np.ndarray, np.ndarray]:
    t = t.filter(pa.compute.equal(t.column("query"), kind)).combine_chunks()
    if not len(t):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    v = t.column("v").combine_chunks()
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(len(t), -1)


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, depth: int = DEPTH, share: float = SHARE,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common.width)
    # bounded: four times the pivots, as equal vectors are one pivot
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    known = unit(np.array([r.v for r in some], dtype=np.float64))
    _, first = np.unique(known, axis=0, return_index=True)
    base = known[np.sort(first)][:pivots]
    used = min(depth, len(base))

    n = rows.agg(F.count("*"), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1))).first()
    groups = max(-(-n[0] // GROUP), min(12, -(-2 * n[0] // BLOCK)), 1)  # by rows alone; a few tasks for small tables
    query_blocks = max(1, -(-n[1] // BLOCK))
    g = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    b = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(query_blocks)).cast("int")
    index = rows.select(F.lit(False).alias("query"), "vec_id", "v", g.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("b"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.lit(True).alias("query"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), b.alias("b"))

    def search(t: pa.Table) -> pa.Table:
        ids, x = _rows(t, False)
        qids, qx = _rows(t, True)
        best: list[list[tuple]] = [[] for _ in qids]
        if len(ids) and len(qids):
            perms = order_pivots(qx, base, used)
            for at in range(0, len(ids), BLOCK):
                block = Block(ids[at:at + BLOCK], x[at:at + BLOCK], base, used)
                for i, q in enumerate(qids.tolist()):
                    best[i].append(block.nearest(q, qx[i], perms[i], share, k))
        out: list[list] = [[], [], []]
        for q, parts in zip(qids.tolist(), best):  # the group's k best of a query
            if parts:
                got, scores = (np.concatenate(c) for c in zip(*parts))
                top = np.lexsort((got, -scores))[:k]
                out[0].append(np.full(len(top), q))
                out[1].append(got[top])
                out[2].append(scores[top])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    found = index.union(asked).groupBy("g", "b").applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
