"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

One pass turns every whole text into a short vector of statistics (``features``); it is cut to the
shared folder, and all that follows reads only that.  Statistics are standardised by the labelled rows'
mean and deviation; ``width`` cosines of seeded random directions approximate a Gaussian kernel over
them.  Each task sums its part of the normal equations, the parts are summed by matrix row over all
tasks, and the driver solves one system of ``width`` + 1 unknowns, whatever the input's size.  Raw scores
of the labelled rows are counted in ``BINS`` fixed bins, and pool-adjacent-violators turns the bins into
a monotone map from raw score to probability.

Fitting uses every labelled row that is not held out.  Defined results: a null text counts as empty; an
empty text has a score like any other (from its statistics); without usable labels every score is
0.5; rows that repeat an id get one row each, and repeated labels of an id count as often as
they are given (null labels not at all); an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "mark", "bar", "bang", "stop", "comma", "other",
         "newline", "same_next", "distinct", "top_word", "same_line", "short_word", "compress", "capital_words", "line_words")
WIDTH, GAMMA, RIDGE, SEED, BINS = 256, 0.02, 1e-3, 11, 2000


def _classes() -> np.ndarray:
    kind = np.full(256, 9, dtype=np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*#$%&@^~_=+<>\\/{}[]", b"|", b"!?", b".", b",;:", b"\n", b"abcdefghijklmnopqrstuvwxyz")):
        kind[list(chars)] = k
    kind[[32, 9, 13]] = 10
    return kind


KIND = _classes()


def statistics(text: bytes | None) -> list[float]:
    """The vector named by NAMES, of a whole text."""
    text = text or b""
    raw = np.frombuffer(text, dtype=np.uint8)
    n = np.bincount(KIND[raw], minlength=11) if len(raw) else np.zeros(11, dtype=np.int64)
    accent = int(np.count_nonzero((raw[:-1] == 0xC3) & (raw[1:] <= 0x9E))) if len(raw) else 0
    words = text.split()
    size, count = max(1, len(raw)), max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    letters = max(1, int(n[0] + n[8]) + accent)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(30.0, len(raw) / count), (n[0] + accent) / letters, n[1] / size,
        n[2] / count, n[3] / count, n[4] / count, n[5] / count, n[6] / count, n[9] / size, n[7] / count,
        sum(map(eq, words, words[1:])) / count, np.log1p(len(counts)) / np.log1p(count), max(counts.values(), default=0) / count,
        1 - len(set(lines)) / max(1, len(lines)), sum(len(w) < 3 for w in counts) / max(1, len(counts)),
        len(counts) / count, sum(w[:1].isupper() for w in counts) / max(1, len(counts)), np.log1p(count / max(1, len(lines))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x: the statistics of each row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Kernel:
    """Standardise, then cos(xW + b): a Gaussian kernel's random features, and a constant."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, width: int, gamma: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1.0)
        self.w = rng.normal(0.0, np.sqrt(2 * gamma), (len(mean), width))
        self.b = rng.uniform(0, 2 * np.pi, width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.b)) * np.cos(np.clip((x - self.mean) / self.dev, -8, 8) @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(labelled: DataFrame, width: int = WIDTH, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = SEED):
    """labelled: x, y (0 or 1).  Gives (kernel, weights, bin edges, probabilities) or None without rows."""
    size = len(NAMES)
    stats = labelled.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(size) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"]:
        return None
    kernel = Kernel(np.array([stats[f"m{i}"] for i in range(size)]), np.array([stats[f"s{i}"] for i in range(size)]), width, gamma, seed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 2))
        for b in batches:
            if len(b):
                z, y = kernel(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                total += z.T @ np.hstack([z, y[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([_matrix(t.column("v").combine_chunks()).sum(axis=0).tolist()], pa.list_(pa.float64()))})

    parts = labelled.select("x", "y").mapInArrow(sums, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>")
    a = np.zeros((width + 1, width + 2))
    for r in parts.collect():  # width + 1 rows, whatever the input
        a[r.i] = r.v
    weights = np.linalg.solve(a[:, :-1] + ridge * stats["n"] / (width + 1) * np.eye(width + 1), a[:, -1])
    score = _raw(labelled.select("y", "x"), kernel, weights, "y")
    bins = score.groupBy(F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) + 1) / 3 * (BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    at, p = isotonic(sorted((r.bin, r.n, r.y) for r in bins.collect()))  # at most BINS rows
    return kernel, weights, at, p


def isotonic(bins: list[tuple[float, float, float]], raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (bin, rows, positives); gives blocks' mean raw scores and smoothed rates,
    or, with ``raw``, their mean bins and rates as they are."""
    blocks: list[list[float]] = []  # weight, positives, weighted bin
    for b, n, y in bins:
        blocks.append([n, y, n * b])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    if raw:
        return np.array([x / n for n, _, x in blocks]), np.array([y / n for n, y, _ in blocks])
    at = np.array([(x / n + 0.5) / (BINS - 1) * 3 - 1 for n, _, x in blocks])
    return at, np.array([(y + 0.5) / (n + 1) for n, y, _ in blocks])


def _raw(rows: DataFrame, kernel: Kernel, weights: np.ndarray, key: str) -> DataFrame:
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = kernel(_matrix(b.column("x"))) @ weights if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(raw)], names=[key, "raw"])

    return rows.select(key, "x").mapInArrow(run, f"{key} {kind}, raw double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held: int = 0,
             threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted.  Labels of rows with crc32(id) mod folds = held are not read."""
    x = cut(features(docs, id_col, text_col))
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(f"y is not null and doc_id is not null")
    labelled = x.where(crc_mod("doc_id", folds) != held).join(y, "doc_id").select("x", "y")
    model = fit(labelled)
    if model is None:
        score = x.select("doc_id", F.lit(0.5).alias("score"))
    else:
        kernel, weights, at, p = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = kernel(_matrix(b.column("x"))) @ weights if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(np.interp(raw, at, p), 0.0, 1.0))], names=["doc_id", "score"])

        score = x.mapInArrow(run, "doc_id long, score double")
    return score.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
