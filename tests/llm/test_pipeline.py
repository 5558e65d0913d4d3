"""The corpus pipeline's stages against what each must do to its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import mixing, quality, simhash


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def least_of_groups(rows, least=0.8):
    """The smallest id of every group that exact similarities of ``least`` or more link."""
    sets = {i: shingles(t) for i, t in rows}
    ids, name = sorted(sets), {i: i for i in sets}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if name[a] != name[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((name[a], name[b]))
                name = {i: low if c == high else c for i, c in name.items()}
    return set(name.values())


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf).persist()
        seen.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == list(P.COLUMNS)
        if name == "quality_classifier":
            want = {r.doc_id for r in quality.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == want and seen[1] < seen[0]
        elif name == "exact_dedup":
            best = {r.text: r.m for r in before.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("doc_id").alias("m")).collect()}
            assert {r.doc_id for r in docs.collect()} == set(best.values())
        elif name == "simhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == least_of_groups([(r.doc_id, r.text) for r in before.collect()])
        elif name == "poisson_mixing":
            a = {(r.doc_id, r.c) for r in docs.groupBy("doc_id").agg(F.count("*").alias("c")).collect()}
            assert a == {(r.doc_id, r.c) for r in mixing.poisson_mix(before).groupBy("doc_id").agg(F.count("*").alias("c")).collect()}
        else:
            tokens = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n.to_numpy()
            assert np.all(tokens <= 2048)


WORDS = [f"word{i}" for i in range(60)]
NEAR = " ".join([*WORDS[:59], "other"])
ROWS = [(1, " ".join(WORDS), "en", "a", 1), (1, " ".join(WORDS), "en", "a", 1), (2, NEAR, "en", None, 1), (None, "some other words without an id", None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0),
        (5, " ".join(WORDS) * 300, "en", "a", 1), (6, "x " * 3 + " ".join(reversed(WORDS)), "en", "b", 1)]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Repeated rows, a near copy, null and empty texts, a null id and source, a long text, and columns of clashing names."""
    d = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("__kept", "node", "digest", "component", "copy")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


def test_quality_stage_on_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{awkward}/labels.parquet")).collect()
    kept = {r.doc_id for r in scored if r.predicted}
    got = P.quality_stage(spark, docs, awkward)
    assert got.columns == list(P.COLUMNS) and ids(got) == sorted(str(i) for i, *_ in ROWS if i in kept)


def test_exact_stage_on_awkward_rows(spark, awkward):
    got = P.exact_stage(spark, spark.read.parquet(f"{awkward}/documents.parquet"), awkward)
    assert got.columns == list(P.COLUMNS) and ids(got) == ["1", "2", "4", "5", "6", "None"]  # null counts as empty, 4 is the larger


def test_near_stage_on_awkward_rows(spark, awkward):
    got = P.near_stage(spark, spark.read.parquet(f"{awkward}/documents.parquet"), awkward)
    # both rows of id 1 stay, 2 and 5 are near copies of 1, and 4 is as empty as 3
    assert got.columns == list(P.COLUMNS) and ids(got) == ["1", "1", "3", "6", "None"]


def test_mixing_stage_on_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    got = P.mixing_stage(spark, docs, awkward)
    assert got.columns == list(P.COLUMNS) and ids(got) == ids(mixing.poisson_mix(docs))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in got.collect()} <= texts


def test_packing_stage_on_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    got = P.packing_stage(spark, docs, awkward).collect()
    per = {}
    for r in got:
        per.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    whole = {(d, n): sum(x) for (d, n), x in per.items()}
    assert {d for d, _ in whole} == {i for i, *_ in ROWS} and whole[3, 1] == whole[4, 1] == 1
    assert all(s == n * (2 if d == 1 else 1) for (d, n), s in whole.items())  # the repeated row is packed twice


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_of_nothing(spark, awkward, name, stage):
    assert stage(spark, spark.read.parquet(f"{awkward}/documents.parquet").limit(0), awkward).count() == 0


def test_near_stage_judges_rows_of_one_id_by_their_own_texts(spark):
    """A near copy goes although another row of its id stays, and so does one without an id."""
    near = lambda i: " ".join([*WORDS[:59], f"end{i}"])
    alone = lambda i: " ".join(f"{w}of{i}" for w in WORDS)
    rows = [(1, near(1)), (2, near(2)), (2, alone(2)), (None, near(3)), (None, alone(3)), (7, near(4)), (5, alone(3).replace("word0of3", "other"))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in P.near_stage(spark, docs, "").collect()}
    assert got == {(1, near(1)), (2, alone(2)), (5, rows[-1][1])}


def test_near_copies_are_found_by_simhash_first(spark, monkeypatch):
    """groups of SimHash are compared exactly; blocks that this settles do not meet again, and what SimHash misses is found all the same."""
    words = [f"w{i}" for i in range(400)]
    small = [(i, " ".join(words[:100 + i] + [f"x{i}"] + words[101 + i:])) for i in (0, 2, 3, 4, 5)]  # a word changed
    far = [f"v{i}" for i in range(404)]
    large = [(10, " ".join(far)), (11, " ".join(far + [f"k{i}" for i in range(90)]))]  # J = 400 / 490
    bits = lambda x, y: (simhash.fingerprint(x.encode(), simhash.FEATURE) ^ simhash.fingerprint(y.encode(), simhash.FEATURE)).bit_count()
    assert bits(large[0][1], large[1][1]) > simhash.NEAR >= max(bits(small[0][1], t) for _, t in small)
    met, own = [], simhash.jaccard.within_blocks
    monkeypatch.setattr(simhash.jaccard, "within_blocks", lambda texts, *a: met.append(sorted(r.doc_id for r in texts.collect())) or own(texts, *a))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in small + large], "doc_id long, text string, lang string, source string, n_chars long")
    assert ids(P.near_stage(spark, docs, "")) == ["0", "10"]
    assert met == [[0, 2, 3, 4, 5], [10, 11]]
