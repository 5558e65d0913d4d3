"""Spelling variants: words that differ by one edit, found by pivotal grams.

1. Words and their counts come from the texts in DataFrame functions.
2. Bigrams are ordered by the number of words that have them, rarest first.  The alphabet has 90 letters, so this order
   has at most 8,100 rows: that is the bound on the one thing that is broadcast.
3. A word's gram prefix holds its three first bigrams in that order, and every other place of the third.  Of two words,
   take the one whose prefix ends first: one edit spoils at most one of two disjoint bigrams, so at least one of its two
   pivots is in the other word's prefix, at the same place counted from the left or from the right.  The pivots are the
   two disjoint bigrams of the prefix whose counts have the least sum, chosen by dynamic programming.
4. The pivots cut a word into a head (to the end of the first), a middle (to the end of the second) and a tail.  The edit
   lies in one of them, and the two others are the same in both words.  Words are posted under each gram of their prefix
   with the parts that lie outside of a possible edit (position limits: parts of equal length, at equal distance from the
   word's ends, words at most one letter longer or shorter), and each word looks up its own three cases.
5. Matches are verified by their edit distance.  A pair is taken in the first case that fits it, so none comes twice.

Keys hold most of a word, so no group grows with the corpus beyond what real neighbours make it; the join is an ordinary
sort-merge join which spills and which Spark splits where a key is hot.

Defined results: null texts have no words; a null id is written as the word ``null`` in the deletion rule; rows that
repeat an id count again; of near words with the same count the smallest in code-point order is the form; a word without
near words has none and is its own root; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIGNED = "key long, word string, n long, last int, same int"


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, deletes: int = 31, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """word, n: lower-cased runs of letters, some of them without one letter, that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    return _counted(named.select("run", h.alias("h")), least_length, least_count, deletes)


def _counted(runs: DataFrame, least_length: int, least_count: int, deletes: int) -> DataFrame:
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod(F.col("h"), F.lit(deletes)) == 0, less).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, c: in how many words each bigram occurs."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return words.where(F.length("word") > 1).select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))


def prefix(word: str, order: dict[str, int]) -> tuple[list[int], int]:
    """Places of the three bigrams that come first in the order, with all other places of the third; its order."""
    ranks = [order[word[i:i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[min(2, len(ranks) - 1)]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots(word: str, places: list[int], cost: dict[str, int]) -> tuple[int, int]:
    """The two disjoint bigrams at these places whose costs have the least sum; ties to the leftmost.

    best[i] is the cheapest place among the first i; a second pivot only meets those that end before it."""
    best, out, at = None, None, 0
    for j in places:
        while at < len(places) and places[at] <= j - 2:
            here = (cost[word[places[at]:places[at] + 2]], places[at])
            best = here if best is None or here < best else best
            at += 1
        if best is not None:
            whole = (best[0] + cost[word[j:j + 2]], best[1], j)
            out = whole if out is None or whole < out else out
    return out[1], out[2]


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest("|".join(map(str, parts)).encode(), 5) - (1 << 63)


def _asked(w: str, places: list[int], p: int, q: int) -> Iterator[tuple[int, int]]:
    """Keys of a word's three cases for each length that a neighbour may have, and how long a head must differ for a pair
    to be taken in this case."""
    for other in (len(w) - 1, len(w), len(w) + 1):
        yield _key(1, other, w[:q + 2]), 0
        yield _key(2, other, w[:p + 2], w[q + 2:]), q + 2
        yield _key(3, other, w[p + 2:], len(w) - q), p + 2


def _posted(w: str, places: list[int], p: int, q: int) -> Iterator[tuple[int, int]]:
    """Keys under which a word is found: each gram of its prefix with what a neighbour's other parts may be."""
    size = len(w)
    for i in places:
        yield _key(1, size, w[:i + 2]), 0
        for j in range(i + 3, size + 1):  # an edit leaves a letter or more of a middle and of a head
            yield _key(2, size, w[:i + 2], w[j:]), 0
        for j in range(1, i + 1):
            yield _key(3, size, w[j:], size - i), 0


def signatures(words: DataFrame, grams: list[tuple[str, int]], asks: bool) -> DataFrame:
    """The keys that words ask for, or those under which they are posted."""
    ordered = sorted(grams, key=lambda x: (x[1], x[0]))
    sent = words.sparkSession.sparkContext.broadcast(({g: i for i, (g, _) in enumerate(ordered)}, dict(grams)))
    keys = _asked if asks else _posted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, cost = sent.value
        for b in batches:
            for part in range(0, b.num_rows, 2000):
                rows: list[tuple] = []
                for w, n in zip(b.column(0)[part:part + 2000].to_pylist(), b.column(1)[part:part + 2000].to_pylist()):
                    places, last = prefix(w, order)
                    rows.extend((key, w, n, last, same) for key, same in keys(w, places, *pivots(w, places, cost)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()))],
                    names=["key", "word", "n", "last", "same"])

    return words.select("word", "n").mapInArrow(run, SIGNED)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: each pair of words (word, n; four letters or more) that one edit turns into each other, once."""
    grams = [(r.gram, r.c) for r in gram_counts(words).collect()]  # at most the square of the alphabet
    words = words.repartition(partitions(words.sparkSession), "word")  # few bytes, much work
    ask = signatures(words, grams, True).select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"), "same")
    post = signatures(words, grams, False).select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    first = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    fresh = (F.col("same") == 0) | (F.substring("a", F.lit(1), F.col("same")) != F.substring("b", F.lit(1), F.col("same")))
    return (ask.join(post, "key").where(first & fresh & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n."""
    sides = F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"n{y}").alias("m")) for x, y in ("ab", "ba")])
    near = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    led: Column = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame, most: int, ratio: int = 10) -> DataFrame:
    """word, root of the words that have a form.  A form is at least ``ratio`` times as frequent as its word, so chains
    have at most log(most) steps, and each round doubles what is followed."""
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)) + 1)
    held = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        held = cut(held)
        then = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = held.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return held


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, deletes: int = 31, ratio: int = 10,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: one row a word."""
    if least_length < 4:
        raise ValueError("two disjoint bigrams need words of four letters or more")
    words = cut(word_counts(docs, least_length, least_count, deletes, id_col, text_col))
    formed = cut(forms(words, near_pairs(words), ratio))
    most = formed.agg(F.max("n")).first()[0] or 1
    return (formed.join(roots(formed, most, ratio), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
