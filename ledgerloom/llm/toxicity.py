"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the symbols of a clause's words: the insult and the threat transducer say that a word of their lexicon
stands here, the target transducer that the clause names a person, the negation transducer holds for the next few
words, the reported-speech transducer to the end of the clause.  They are composed into one deterministic machine;
where it is in a state of an insult or a threat it puts out a mark with what the others say there (what names a
person may also follow, so marks leave at the end of their clause), and a document's score sums, over its clauses,
word weight times pattern weight of every mark.  A word alone is thus worth less where it is denied or quoted, and
more where it is aimed at somebody.

The lexicon holds fixed words in four languages and stems learned from labelled rows: a word's first 4 to
8 letters, or the whole word, is a stem if documents labelled 1 have it far more often than others
(a likelihood ratio that chance over all candidates would not reach); candidates are counted and chosen in Spark, only
chosen stems reach the driver.  Learning uses at most ``LABELS_1`` rows labelled 1 and ``LABELS_0`` others, taken in the
order of a hash of their ids, less near copies; of the three residues of crc32(id) modulo 4 that may be read, two give
stems and pattern weights, the third the monotone map from summed weight to probability.  Documents are scanned by
an Aho-Corasick machine; only those with a hit run the grammar, over their whole text.

Defined results: a null or empty text has no matches and the score of such; without labels of both kinds
the fixed words alone decide; rows that repeat an id give one row each; repeated labels of an id count as
often as they are given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut
from .quality import isotonic

LABELS_1, LABELS_0, PREFIXES, HELD = 4000, 8000, range(4, 9), 200_000
TOP, STEP = 60.0, 0.1  # summed weights are binned for calibration

# Words of everyday abuse and of the patterns around it.
INSULTS = """idiot moron stupid loser clown scum trash worthless pathetic disgusting imbecile cretin jerk creep coward filth vermin
 garbage bastard bitch asshole arsehole dumbass dickhead wanker twat retard scumbag degenerate parasite dumm dummkopf trottel arschloch
 abschaum wichser drecksau widerlich erbärmlich crétin connard salaud salope ordure minable répugnant imbécile débile abruti
 idiota imbécil estúpido estúpida basura escoria cabrón gilipollas asqueroso patético tarado""".split()
THREATS = """kill murder strangle stab shoot hang behead lynch töten umbringen erschießen abstechen tuer égorger étrangler poignarder
 matar asesinar estrangular apuñalar""".split()
TARGETS = """you your yours he she they him her them their people everyone guy guys woman man du dich dir ihr euch sie er ihn tu te toi vous
 il elle ils elles tú usted ustedes él ella ellos ellas""".split()
NEGATIONS = "not never no nobody neither nor hardly isn aren wasn weren don doesn didn nicht kein keine niemals nie ne pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say told wrote called calls claimed claims quoted reported allegedly sagte sagt schrieb nannte angeblich dit disait écrit appelé selon dijo dice escribió llamó según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
TOKEN = re.compile(r"\w+|[.!?;:\n]")
PRIOR = {"target": 1.25, "negated": 0.3, "reported": 0.5, "threat": 0.6}


# -- transducers -----------------------------------------------------------------------------------

class Transducer:
    """Deterministic: step[state][symbol] is the next state; flag[state] is what it says at a mark."""

    def __init__(self, step: list[list[int]], flag: list[tuple]) -> None:
        self.step, self.flag = step, flag

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same symbols; the result's states are the reachable pairs, flags are joined."""
        index, todo, step, flag = {(0, 0): 0}, [(0, 0)], [], []
        while todo:
            a, b = todo.pop(0)
            row = []
            for x, y in zip(self.step[a], other.step[b]):
                if (x, y) not in index:
                    index[x, y] = len(index)
                    todo.append((x, y))
                row.append(index[x, y])
            step.append(row)
            flag.append(self.flag[a] + other.flag[b])
        return Transducer(step, flag)


def _mark(symbol: int) -> Transducer:
    """Says so right after the symbol."""
    row = [int(s == symbol) for s in range(7)]
    return Transducer([row, row], [(False,), (True,)])


def _sticky(symbol: int) -> Transducer:
    """Set by the symbol until the clause ends."""
    rows = [[int(s == symbol) for s in range(7)], [int(s != END) for s in range(7)]]
    return Transducer(rows, [(False,), (True,)])


def _window(symbol: int, words: int) -> Transducer:
    """Set for the given number of words after the symbol; the end of the clause clears it."""
    rows = []
    for left in range(words + 2):
        rows.append([words + 1 if s == symbol else 0 if s == END else max(0, left - 1) for s in range(7)])
    return Transducer(rows, [(left > 0,) for left in range(words + 2)])


def grammar() -> Transducer:
    """Flags: insult, threat, target, negated, reported."""
    whole = _mark(INSULT)
    for part in (_mark(THREAT), _sticky(TARGET), _window(NEGATION, 3), _sticky(REPORT)):
        whole = whole.compose(part)
    return whole


GRAMMAR = grammar()
CONTEXT = {w: s for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}
CONTEXT |= {c: END for c in ".!?;:\n"}
#: All outputs: (threat, target, negated, reported).
PATTERNS = list(itertools.product((False, True), repeat=4))


class Scanner:
    """words and stems with weights; ``outputs`` runs the grammar over a text."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], patterns: dict[tuple, float] | None = None) -> None:
        self.words, self.stems = words, stems
        self.patterns = patterns or {p: (PRIOR["threat"] if p[0] else 1.0) * (PRIOR["target"] if p[1] else 1.0) * (PRIOR["negated"] if p[2] else 1.0)
                                     * (PRIOR["reported"] if p[3] else 1.0) for p in PATTERNS}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in {*words, *stems}:
            self.machine.add_word(w)
        self.machine.make_automaton()
        self.sizes = sorted({len(s) for s in stems})

    def weight(self, token: str) -> float:
        most = self.words.get(token, 0.0)
        for n in self.sizes:
            if n > len(token):
                break
            most = max(most, self.stems.get(token[:n], 0.0))
        return most

    def outputs(self, text: str) -> list[tuple[tuple, float]]:
        """(pattern, word weight) of every insult or threat in the text."""
        low = text.lower()
        if not len(self.machine) or next(self.machine.iter(low), None) is None:
            return []
        marks, clause, state, known, step, flag = [], [], 0, CONTEXT, GRAMMAR.step, GRAMMAR.flag
        for m in TOKEN.finditer(low):
            t, w = m[0], 0.0
            symbol = known.get(t, OTHER)
            if symbol == OTHER and (w := self.weight(t)):
                symbol = THREAT if t in THREAT_SET else INSULT
            if symbol == END and clause:
                marks += [((threat, flag[state][2], negated, reported), w) for (_, threat, _, negated, reported), w in clause]
                clause = []
            state = step[state][symbol]
            if flag[state][0] or flag[state][1]:
                clause.append((flag[state], w))
        return marks + [((threat, flag[state][2], negated, reported), w) for (_, threat, _, negated, reported), w in clause]

    def total(self, text: str | None) -> float:
        return sum(self.patterns[p] * w for p, w in self.outputs(text or ""))


THREAT_SET = frozenset(THREATS)


# -- learning --------------------------------------------------------------------------------------

def _sketch(text: str) -> int:
    """Least hash of the text's five-word shingles: near copies mostly share it."""
    words = text.split()
    return min(xxhash.xxh64_intdigest(" ".join(words[i:i + 5])) for i in range(max(1, len(words) - 4))) - (1 << 63)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """docs: doc_id, text; labels: doc_id, y.  The bounded labelled sample (doc_id, y, text) without near
    copies, and how many labels of each kind there are."""
    counts = {r.y: r["count"] for r in labels.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(3))
    some = labels.where("y = 1").orderBy(order, "doc_id").limit(LABELS_1).union(labels.where("y = 0").orderBy(order, "doc_id").limit(LABELS_0))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_sketch(t or "") for t in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "y", "text", "sketch"])

    picked = docs.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")  # at most LABELS_0 + LABELS_1 rows
    one = picked.mapInArrow(sketch, "doc_id long, y int, text string, sketch long").groupBy("sketch", "y").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d"))
    return cut(one.select("d.doc_id", "y", "d.text")), counts


def _stems_of(text: str) -> set[str]:
    out = set()
    for t in set(TOKEN.findall(text.lower())):
        if len(t) >= PREFIXES.start:
            out.update(t[:n] for n in PREFIXES if n <= len(t))
        if len(t) > 2:
            out.add(t + "$")
    return out


def _count(rows: DataFrame) -> DataFrame:
    """stem, n: the documents of rows (text) that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["stem", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(_stems_of(t or ""))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def chosen_stems(teach: DataFrame, n1: int, n0: int) -> list:
    """stem, odds of the stems that documents labelled 1 have far more often; teach: y, text."""
    ones = cut(_count(teach.where("y = 1")).where("n >= 3").select("stem", F.col("n").alias("t")))
    t, c, p = F.col("t"), F.coalesce("c", F.lit(0)), n1 / (n1 + n0)
    n = t + c
    gain = t * F.log(t / (n * p)) + F.when(c > 0, c * F.log(c / (n * (1 - p)))).otherwise(0.0)
    odds = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    zeros = _count(teach.where("y = 0")).select("stem", F.col("n").alias("c"))
    return (ones.join(zeros, "stem", "left").select("stem", gain.alias("gain"), odds.alias("odds"))
            .where((F.col("odds") > 1.5) & (F.col("gain") > float(np.log(ones.count() + 1)))).select("stem", "odds").collect())


def fixed_counts(teach: DataFrame) -> dict[tuple[str, int], int]:
    """Documents by (fixed word, label)."""
    fixed = frozenset((*INSULTS, *THREATS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((w, y) for w in fixed.intersection(TOKEN.findall((t or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "y", "n"])

    return {(r.word, r.y): r.n for r in teach.select("y", "text").mapInArrow(run, "word string, y int, n long").groupBy("word", "y").agg(F.sum("n").alias("n")).collect()}


def learn(rows: DataFrame, counts: dict[int, int]) -> tuple[Scanner, np.ndarray, np.ndarray]:
    """rows: doc_id, y, text.  The scanner, and the knots of the map from summed weight to probability."""
    teach, test = rows.where(crc_mod("doc_id", 4) != 3), rows.where(crc_mod("doc_id", 4) == 3)
    n1, n0 = teach.where("y = 1").count(), teach.where("y = 0").count()
    words = {w: 4.0 for w in (*INSULTS, *THREATS)}
    stems: dict[str, float] = {}
    if n1 and n0:
        for r in chosen_stems(teach, n1, n0):
            (words if r.stem.endswith("$") else stems)[r.stem.removesuffix("$")] = min(r.odds, 7.0)
        seen_words = fixed_counts(teach)
        for w in (*INSULTS, *THREATS):  # a fixed word that clean documents use as often loses its weight
            t, c = seen_words.get((w, 1), 0), seen_words.get((w, 0), 0)
            if c:
                words[w] = float(max(0.0, np.log((t + 2.0) / (n1 + 2)) - np.log((c + 0.1) / (n0 + 2))))
        words = {w: v for w, v in words.items() if v > 0.5}
        # stems that add nothing to a shorter one only make the machine larger
        stems = {s: v for s, v in stems.items() if all(stems.get(s[:n], 0.0) < v - 0.05 for n in range(PREFIXES.start, len(s)))}
    scanner = Scanner(words, stems)
    seen: Counter = Counter()
    if n1 and n0:
        def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: Counter = Counter()
            for b in batches:
                for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for p in {p for p, _ in scanner.outputs(t or "")}:
                        got[PATTERNS.index(p), y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.int32()), pa.array([k[1] for k in got], pa.int32()), pa.array(list(got.values()), pa.int64())], names=["p", "y", "n"])

        for r in teach.select("y", "text").mapInArrow(patterns, "p int, y int, n long").groupBy("p", "y").agg(F.sum("n").alias("n")).collect():
            seen[r.p, r.y] = r.n
        plain = np.log((seen[0, 1] + 1) / (n1 + 2)) - np.log((seen[0, 0] + 1) / (n0 + 2))
        for i, p in enumerate(PATTERNS):  # the prior counts as 20 documents
            t, c = seen[i, 1], seen[i, 0]
            share = (np.log((t + 1) / (n1 + 2)) - np.log((c + 1) / (n0 + 2))) / plain if plain > 0 and t + c else 1.0
            scanner.patterns[p] = float((20 * scanner.patterns[p] + (t + c) * np.clip(share, 0.0, 1.5)) / (20 + t + c))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [int(np.ceil(min(TOP, scanner.total(t)) / STEP)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.int32())], names=["y", "bin"])

    got = test.select("y", "text").mapInArrow(totals, "y int, bin int").groupBy("bin", "y").count().collect()
    size = Counter()
    for r in got:
        size[r.y] += r["count"]
    if not size[0] or not size[1]:
        return scanner, np.array([0.0, 2.0, 8.0]), np.array([0.05, 0.5, 0.95])
    share = {y: counts[y] / size[y] for y in (0, 1)}  # the sample is richer in ones than the labels are
    bins: dict[int, list[float]] = {}
    for r in got:
        b = bins.setdefault(r.bin, [0.0, 0.0])
        b[0] += r["count"] * share[r.y]
        b[1] += r["count"] * share[r.y] * r.y
    # half a document of prior belief at either end
    bins.setdefault(0, [0.0, 0.0])[0] += share[0] / 2
    high = bins.setdefault(int(TOP / STEP), [0.0, 0.0])
    high[0] += share[1] / 2
    high[1] += share[1] / 2
    rows_ = sorted((float(b), n, y) for b, (n, y) in bins.items())
    at, p = isotonic(rows_, raw=True)
    return scanner, at * STEP, p


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, matches, weight.  Labels of rows with crc32(id) mod folds = held
    are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    scanner, at, p = learn(*sample(rows, known.where(crc_mod("doc_id", folds) != held)))
    words, stems, weights = scanner.words, scanner.stems, scanner.patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(words, stems, weights)
        for b in batches:
            outs = [own.outputs(t or "") for t in b.column(1).to_pylist()]
            total = np.array([sum(own.patterns[q] * w for q, w in o) for o in outs], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(np.interp(total, at, p), 0, 1)), pa.array([len(o) for o in outs], pa.int32()), pa.array(total)],
                                             names=["doc_id", "score", "matches", "weight"])

    out = rows.mapInArrow(run, "doc_id long, score double, matches int, weight double")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches", "weight")
