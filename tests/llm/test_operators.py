"""The training-data operators against brute force, and on awkward input."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, exact_dedup, html_main, mixing, packing, quality, queries, simhash, suffix_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog while nine wizards vex " * 3000


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty texts, a very long one, ties, a repeated row, a null id, clashing names."""
    rows = [(1, "same text here", "en", "a", 1), (2, "same text here", "en", None, 1), (3, None, None, "a", None), (4, "", "en", "b", 0), (5, LONG, "en", "b", len(LONG)), (6, LONG + " tail", "en", "b", 1),
            (7, "same text here", "en", "a", 1), (7, "same text here", "en", "a", 1), (None, "no id at all, but some words", "en", "a", 1), (9, " \n\t ", "en", "c", 4), (10, "ünï cödé 🙂 text", "de", "c", 5)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("copy", "__u", "digest", "salt", "fp", "key", "id", "score", "g", "b", "row", "best"):
        d = d.withColumn(c, F.lit("clash"))
    return d.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == want


# -- 1 ---------------------------------------------------------------------------------------------

def brute_repeats(rows, length):
    """doc -> (removed, spans, sha) by a dictionary of all strings."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark, own = bytearray(len(b)), []
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if seen.get(w, i) < i:
                mark[s:s + length] = b"\1" * length
            own.append(w)
        for w in own:
            seen.setdefault(w, i)
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out[i] = (sum(mark), sum(1 for k in range(len(b)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [20_000, 1_500_000])
def test_suffix_dedup_equals_brute_force(spark, sf, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    d = docs(spark, sf).repartition(3)
    want = brute_repeats([(r.doc_id, r.text) for r in d.collect()], 50)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect()}
    assert got == want


def test_suffix_dedup_short_strings_and_periods(spark):
    rows = [(1, "ab" * 40), (2, "ab" * 30 + "x" * 30), (3, "x" * 25 + "ba" * 10), (4, "short"), (5, "abcdefghijklmnopqrst")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d, length=12, gram=5).collect()}
    assert got == brute_repeats(rows, 12)


def test_suffix_sort_orders_like_plain_sort():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    starts, group = np.arange(0, 380), rng.integers(0, 5, 380)
    order = suffix_dedup.sort_suffixes(raw, suffix_dedup.Hashes(raw), starts, group, 20)
    key = lambda i: (group[i], raw[starts[i]:starts[i] + 20].tobytes())
    assert [key(i) for i in order] == sorted(key(i) for i in range(380))


def test_hash_collisions_fall_back_to_bytes(monkeypatch):
    """With a hash that always agrees, suffixes are told apart by their bytes."""
    monkeypatch.setattr(suffix_dedup.Hashes, "__call__", lambda self, start, size: np.zeros(len(start), dtype=np.uint64))
    raw = np.frombuffer(b"aaaaaaaaaaaaaaaaaaaabaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", dtype=np.uint8)
    cls = suffix_dedup.equal_strings(raw, suffix_dedup.Hashes(raw), np.array([0, 20, 40]), np.zeros(3, dtype=np.int64), np.full(3, 20))
    assert cls[0] == cls[2] != cls[1]


def test_suffix_order_decides(spark, sf, monkeypatch):
    """Without the classes of the suffix sort nothing is removed."""
    d = docs(spark, sf)
    assert sum(r.n_removed for r in suffix_dedup.remove_repeats(d).collect()) > 0
    monkeypatch.setattr(suffix_dedup, "equal_strings", lambda raw, hashes, starts, group, most: np.arange(len(starts)))
    assert sum(r.n_removed for r in suffix_dedup.remove_repeats(d).collect()) == 0


def test_suffix_hot_anchors_change_nothing(spark, monkeypatch):
    """A line that a third of all documents hold, with other text before and after it, and anchors dealt both ways."""
    rng = np.random.default_rng(21)
    some = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    line = some(90)
    rows = [(i, some(60) + line + some(60) if i % 3 == 0 else some(200)) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least, chunk in ((4, 3000), (10**9, 3000), (4, 1_500_000)):
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect()} == brute_repeats(rows, 50)


def test_suffix_awkward(spark, awkward):
    """Null and empty texts stay empty, rows that repeat an id are one document, a null id is larger than all, other columns
    are not looked at, an empty table gives an empty result."""
    ids = {r: i for i, r in enumerate(sorted({r.doc_id for r in awkward.collect() if r.doc_id is not None}))}
    rows = [(10**9 if r.doc_id is None else r.doc_id, r.text) for r in awkward.collect()]
    got = suffix_dedup.remove_repeats(awkward).collect()
    assert len(got) == len(rows) and set(ids) <= {r.doc_id for r in got}
    want = brute_repeats(rows, 50)
    assert {(10**9 if r.doc_id is None else r.doc_id): (r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.remove_repeats(awkward.limit(0)).count() == 0
    late = spark.createDataFrame([(None, "x" + LONG[:300]), (5, "y" + LONG[:300]), (5, "z" + LONG[:300])], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(late).collect()) == [("5", 0), ("5", 0), ("None", 300)]


# -- 2 ---------------------------------------------------------------------------------------------

def test_neighbours_reach_recall_and_rank_exactly(spark, sf):
    v = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet")
    pdf = v.toPandas()
    x, ids = np.array(pdf.embedding.tolist(), dtype=np.float64), pdf.vec_id.to_numpy()
    hit = total = 0
    got = defaultdict(list)
    for r in ann.neighbours(v).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        keep = ids != q
        top = ids[keep][np.lexsort((ids[keep], -s[keep]))][:20]
        rows = got[q]
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit += len(set(top) & {r.vec_id for r in rows})
        total += len(top)
    assert hit / total >= 0.9


def test_neighbours_on_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (40, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 2, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.neighbours(v.limit(0)).count() == 0


@pytest.mark.parametrize("odd", [[1e-200], [1e37], [1e39], [1e200], [1e-200, 1e39, 1e160, 1e-320, 1e307]])
@pytest.mark.parametrize("scale", [1.0, 1e39, 1e-150])
def test_finite_vectors_of_any_size_take_part(spark, odd, scale):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * scale
    for i, o in enumerate(odd):
        x[7 + 30 * i] = rng.choice([-1.0, 1.0], size=6) * o
    got = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    with np.errstate(over="ignore", invalid="ignore"):
        for q in range(0, 200, 20):
            s = (x * x[q]).sum(axis=1)
            keep = np.flatnonzero(np.arange(200) != q)
            assert got[q] == keep[np.lexsort((keep, -s[keep]))][:20].tolist()


def test_long_vectors_are_candidates_whatever_their_angle(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 24))
    x[11] *= 1e37
    found = ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).where("vec_id = 11 and rank = 1").count()
    assert found == sum((x[q] * x[11]).sum() > 0 for q in range(0, 400, 20))


def test_one_vector_of_another_length_takes_nothing_along(spark):
    """Whatever its id: its hash must not matter."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    want = sorted(ann.neighbours(spark.createDataFrame(good, "vec_id long, embedding array<double>")).collect())
    assert len(want) == 200
    for odd in (1000, 1001, 1002, 1003, 1004, 1005):
        rows = spark.createDataFrame([*good, (odd, [1.0, 2.0])], "vec_id long, embedding array<double>")
        assert sorted(ann.neighbours(rows).collect()) == want


# -- 3 ---------------------------------------------------------------------------------------------

def test_mixing_hits_its_weights(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "b").otherwise("c").alias("source"))
    n = {r.source: r["count"] for r in mixing.poisson_mix(d, {"a": 1.0, "b": 2.0, "c": 1.0}, total=8000).groupBy("source").count().collect()}
    for s, want in (("a", 2000), ("b", 4000), ("c", 2000)):
        assert abs(n[s] - want) < 6 * math.sqrt(want)


def test_poisson_counts_invert_the_distribution(spark):
    """Counts of many seeds follow the law, at small and at large rates."""
    for rate in (0.3, 4.0, 900.0):
        t = spark.createDataFrame([("s", 1, rate)], "source string, n long, rate double")
        r = mixing.distribution(t).first()
        ks = np.arange(r.low, r.low + len(r.cdf))
        mass = np.diff(np.concatenate(([0.0], r.cdf)))
        assert abs(r.cdf[-1] - 1) < 1e-9 and abs((ks * mass).sum() - rate) < 1e-6 * max(1, rate) and abs(((ks - rate) ** 2 * mass).sum() - rate) < 1e-5 * max(1, rate)


def test_mixing_beyond_the_broadcast_bound_is_the_same(spark, sf):
    a = mixing.poisson_mix(docs(spark, sf)).select("doc_id", "copy")
    for bound in ({"broadcast_sources": 2}, {"broadcast_steps": 100}):
        b = mixing.poisson_mix(docs(spark, sf), **bound).select("doc_id", "copy")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_mixing_awkward(spark, awkward):
    out = mixing.poisson_mix(awkward, {"a": 3.0, "c": 1.0, "zz": 5.0}, total=200)
    assert {r.source for r in out.select("source").distinct().collect()} <= {"a", "c"} and out.columns == [*[c for c in awkward.columns if c != "copy"], "copy", "mix_key"]
    assert mixing.poisson_mix(awkward, total=500).where("source is null").count() > 0
    assert mixing.poisson_mix(awkward.limit(0)).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------

def test_articles_come_out_whole(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_main.main_text(p).collect()}
    for r in p.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_site_tree_removes_what_a_site_repeats(spark):
    """No tag or class says what the boxes are; they are the same on every page."""
    page = "<html><body><div class='x1'><p>Our shop, since 1900</p></div><div class='y'><p>Story {i} alpha{i}</p><p>More {i} beta{i}</p></div><div class='z'><p>Call us now</p></div></body></html>"
    p = spark.createDataFrame([(i, f"https://s.example/{i}", page.replace("{i}", str(i))) for i in range(30)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.main_text(p).collect()} == {i: f"Story {i} alpha{i} More {i} beta{i}" for i in range(30)}


def test_site_tree_decides_inside_articles(spark):
    """A share box without a telling class stands in every article; only the tree can tell it."""
    page = "<html><body><article><h1>Story {i}</h1><p>alpha{i} beta{i}</p><div class='q7'><span>Tell your friends</span></div></article></body></html>"
    p = spark.createDataFrame([(i, f"https://s.example/{i}", page.replace("{i}", str(i))) for i in range(40)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.main_text(p).collect()} == {i: f"Story {i} alpha{i} beta{i}" for i in range(40)}
    few = {r.page_id: r.text for r in html_main.main_text(p.limit(3)).collect()}  # three pages say too little
    assert all(x.endswith("Tell your friends") for x in few.values())


def test_without_the_tree_nothing_goes(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_main.main_text(p).collect()}
    off = {r.page_id: r.text for r in html_main.main_text(p, least=0.0).collect()}
    assert sum(got[k] != off[k] for k in got) == len(got)


def test_site_tree_equals_brute_force(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "regexp_extract(url, '://([^/]*)', 1) AS host", "html")
    seen = defaultdict(lambda: [Counter(), Counter(), 0, 0.0, 0.0])  # node -> child sequences, texts, pages, shares, places
    for host, page in {(r.host, r.html) for r in p.collect()}:
        found, children = html_main.nodes(page)
        for node, (share, place) in html_main.places(found).items():
            x = seen[host, node]
            x[0][" ".join(children[node])] += 1
            x[1].update({t for n, t in found if n == node})
            x[2:] = x[2] + 1, x[3] + share, x[4] + place
    got = {(r.host, r.path): r for r in html_main.site_tree(p).collect()}
    assert set(got) == set(seen)
    varied, top = {}, defaultdict(float)
    for (host, node), (shapes, texts, m, share, place) in seen.items():
        entropy = -sum(k / m * math.log(k / m, m) for k in shapes.values()) if m > 1 else 1.0
        content = sum(k * (1 - math.log(k, m)) for k in texts.values()) / sum(texts.values()) if m > 1 else 1.0
        drawn = [(10 + m * max(0.0, e)) / (10 + m) for e in (entropy, content)]
        varied[host, node] = 0.1 * drawn[0] + 0.9 * drawn[1]
        if html_main.weight(node, 0.0) == 1.0 and share / m >= 0.1:
            top[host, node.startswith("main")] = max(top[host, node.startswith("main")], varied[host, node])
    for (host, node), (*_, m, share, place) in seen.items():
        want = html_main.weight(node, place / m) * min(1.0, varied[host, node] / (top[host, node.startswith("main")] or 1.0))
        assert got[host, node].pages == m and abs(got[host, node].importance - want) < 1e-9


class PlainPage(HTMLParser):
    """Paths of well-formed pages whose tags all are blocks: [(path, text)] and the child names of each path."""

    def __init__(self, page):
        super().__init__()
        self.path, self.found, self.children = (), [], defaultdict(list)
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        name = (tag, dict(attrs).get("class", ""))
        self.children[self.path].append(name)
        self.path += (name,)

    def handle_endtag(self, tag):
        self.path = self.path[:-1]

    def handle_data(self, data):
        if data.strip():
            self.found.append((self.path, " ".join(data.split())))


def plain_main_texts(pages):
    """The main texts of one host's pages, all with text in an article or all without, by the rules and nothing else."""
    parsed = [PlainPage(p) for p in pages]
    distinct = [PlainPage(p) for p in sorted(set(pages))]
    article = any(("article", "") in path for q in parsed for path, _ in q.found)
    whole = lambda path: any(t == "nav" or c in ("ad", "cookie-notice") for t, c in path)
    partly = lambda path: [i for i, (t, c) in enumerate(path) if c == "social-history"]
    away = lambda path: article and ("article", "") not in path
    part = lambda path: path[:partly(path)[-1] + 1] if partly(path) else ("out",) if away(path) and not whole(path) else ()
    nodes = {path for q in distinct for path, _ in q.found}
    score, weighty = {}, []
    for node in nodes:
        holds = [q for q in distinct if any(p == node for p, _ in q.found)]
        m = len(holds)
        size = lambda q, ok: sum(len(t) for p, t in q.found if ok(p)) / sum(len(t) for _, t in q.found)
        share = sum(size(q, lambda p: p == node) for q in holds) / m
        place = sum(size(q, lambda p: part(p) == part(node)) for q in holds) / m
        shapes = Counter(tuple(q.children[node]) for q in holds)
        texts = Counter(t for q in holds for t in {t for p, t in q.found if p == node})
        shape = 1 + sum(k / m * math.log(1 / k) for k in shapes.values()) / math.log(m) if m > 1 else 1
        text = 1 - sum(k * math.log(k) for k in texts.values()) / sum(texts.values()) / math.log(m) if m > 1 else 1
        varied = sum(w * (10 + m * max(0, e)) / (10 + m) for w, e in ((0.1, shape), (0.9, text)))
        role = (0.2 if whole(node) else 1) * ((0.2 + 0.8 * place ** 3) if partly(node) else 1) * ((0.2 + 0.8 * place ** 3) if away(node) else 1)
        score[node] = [role, varied]
        if share >= 0.1 and not (whole(node) or partly(node) or away(node)):
            weighty.append(varied)
    low = {n for n, (role, varied) in score.items() if role * min(1, varied / max(weighty, default=1)) < 0.3}
    stays = lambda path: not any(all(n in low for n in nodes if n[:k] == path[:k]) for k in range(1, len(path) + 1))
    return [" ".join(t for path, t in q.found if stays(path)) for q in parsed]


def site(n, page):
    return [page.replace("{i}", str(i)).replace("{k}", str(i % 2)) for i in range(n)]


def texts_of(spark, pages):
    p = spark.createDataFrame([(i, f"https://s.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_main.main_text(p).orderBy("page_id").collect()]


SITES = ["<html><body><nav><p>menu {i}</p></nav><article><h1>Story {i}</h1><p>alpha{i} beta{i} gamma delta</p><div class='q7'><p>Tell your friends</p></div></article><div class='z'><p>Call {k}</p></div></body></html>",
         "<html><body><div class='m7'><p>Home</p><p>About</p></div><div class='social-history'><h1>Year {i}</h1><p>What {i} people did in the year {i} and after</p></div><div class='ad'><p>Buy {i}</p></div></body></html>",
         "<html><body><article><h1>One story</h1><p>told on every page of the host</p></article><div class='cookie-notice'><p>{i} cookies</p></div></body></html>",
         "<html><body><article><p>teaser {i}</p></article><div class='w'><p>long text {i} that stands outside of it, and goes on for {i} and more words</p><p>to its end {k}</p></div></body></html>"]


@pytest.mark.parametrize("n", [1, 4, 40])
@pytest.mark.parametrize("page", SITES)
def test_removal_equals_plain_code(spark, page, n):
    assert texts_of(spark, site(n, page)) == plain_main_texts(site(n, page))


@pytest.mark.parametrize("n", [5, 15, 20, 25, 30, 60])
def test_articles_stay_however_many_pages_show_them(spark, n):
    page = "<html><body><nav><p>menu {i}</p></nav><article><h1>One story</h1><p>told on every page of the host</p></article></body></html>"
    assert set(texts_of(spark, site(n, page))) == {"One story told on every page of the host"}


def test_variety_and_place_outweigh_a_part_of_a_name(spark):
    assert texts_of(spark, site(30, SITES[1])) == [f"Year {i} What {i} people did in the year {i} and after" for i in range(30)]


def test_variety_decides_beside_the_roles(spark, monkeypatch):
    """With every node taken for varied the roles alone remove other branches than the tree does."""
    tree = texts_of(spark, site(40, SITES[0]))
    monkeypatch.setattr(html_main, "PRIOR", 1e12)
    roles = texts_of(spark, site(40, SITES[0]))
    assert all("friends" in r and "friends" not in t and "menu" not in r + t for r, t in zip(roles, tree))


def test_many_removed_branches_are_joined(spark, sf, monkeypatch):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(html_main.main_text(p).collect())
    monkeypatch.setattr(html_main, "BROADCAST_BYTES", 0)
    assert sorted(html_main.main_text(p).collect()) == want


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b>c</p><p>d", "abc d"), ("<script>var x='</p>'; if (a<b) {}</script><p>t</p>", "t"), ("<p>x</p><script>never closed <p>gone</p>", "x"),
    ("<article><p>in</p><aside>ad</aside><div id='comments'>c</div></article><p>out</p>", "in"), ("<nav>n</nav><header>h</header><p>t</p><footer>f</footer><form><p>q</p></form>", "t"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a b 1 2"), ("<p>&#x41;&nbsp;&copy;\n\t  z</p>", "A © z"), ("<!-- <p>no</p> --><p title='a>b'>yes</p>", "yes"), ("<div hidden>h</div><div style='display: none'>h</div><p>v</p>", "v"),
    ("<body class='has-sidebar'><div class='site-header'>h</div><div class='no-ads'>t</div><main class='with-nav'><header>m</header></main>", "m"), ("<body class='has-sidebar'><div class='site-header'>h</div><div class='no-ads'>t</div>", "t"),
    ("<div class='ad-banner'>buy</div><div class='badge'>ok</div>", "ok"), ("< p>1 < 2</p>", "< p>1 < 2"), ("<article></article><p>outside</p>", "outside")])
def test_blocks(page, text):
    assert html_main.extract(page) == text


def test_pages_awkward(spark):
    p = spark.createDataFrame([(1, None, None), (2, "", "<p>" + "x " * 50_000), (2, "", "<p>y"), (None, "http://h/", "<p>z")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert sorted((r.n_chars, r.text[:1]) for r in html_main.main_text(p).collect()) == [(0, ""), (1, "y"), (1, "z"), (99_999, "x")]
    assert html_main.main_text(p.limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------

def test_exact_dedup_awkward(spark, awkward):
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(awkward, salts=3).collect())
    assert got == [(-1, None, 1, True), (1, 7, 4, False), (2, 7, 4, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 4, True), (7, 7, 4, True), (9, 9, 1, True), (10, 10, 1, True)]
    kept = exact_dedup.keep_rows(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 6, 7, 9, 10]
    assert exact_dedup.decide(awkward.limit(0)).count() == exact_dedup.keep_rows(awkward.limit(0)).count() == 0


def test_kept_null_text_stays_null(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in exact_dedup.keep_rows(d).collect()} == {(1, None), (2, "x")}


# -- 6 and 7 -----------------------------------------------------------------------------------------

def auc(score, y):
    order = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("op,label,size,least", [(queries.op6_toxicity, "toxic", "0.1", 0.92), (queries.op7_quality, "quality", "0.01", 0.97)])
def test_held_out_rows_are_told_apart(spark, sf, op, label, size, least):
    big = sf.replace("0.001", size)
    got = op(spark, big).toPandas().merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) for i in got.doc_id]) % (4 if label == "toxic" else 5)
    assert ((fold == (2 if label == "toxic" else 0)) == got.held_out).all() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    h = got[got.held_out]
    assert auc(h.score.to_numpy(), h[label].to_numpy()) >= least


@pytest.mark.parametrize("classify", [toxicity.score, quality.classify])
def test_classifiers_awkward(spark, awkward, labels, classify):
    got = classify(awkward, labels)
    assert got.count() == 11 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert classify(awkward, labels.limit(0)).count() == 11 and classify(awkward.limit(0), labels).count() == 0


def test_grammar_weighs_target_negation_and_report():
    s = toxicity.Scanner({"idiot": 4.0, "kill": 4.0}, {})
    w = s.total
    assert w("you are an idiot") > w("an idiot") > w("he said: x. they said an idiot") > w("not an idiot") > 0
    assert w("never. an idiot") == w("an idiot") and w("idiotic") == 0 and w("I will kill you") > w("kill time") > 0 and w(None) == 0
    assert w("what an idiot you are") > w("what an idiot. you are")


def test_composition_is_the_product():
    g = toxicity.GRAMMAR
    # insult and threat exclude each other, and a word of theirs can't open the full window of a negation
    assert len(g.step) == (1 * 2 * 5 + 2 * 2 * 4) * 2 and all(len(r) == 7 and max(r) < len(g.step) for r in g.step)
    rng = np.random.default_rng(5)
    parts = [toxicity._mark(toxicity.INSULT), toxicity._mark(toxicity.THREAT), toxicity._sticky(toxicity.TARGET), toxicity._window(toxicity.NEGATION, 3), toxicity._sticky(toxicity.REPORT)]
    state, own = 0, [0] * 5
    for s in rng.integers(0, 7, 2000).tolist():
        state, own = g.step[state][s], [p.step[x][s] for p, x in zip(parts, own)]
        assert g.flag[state] == tuple(p.flag[x][0] for p, x in zip(parts, own))


@pytest.mark.parametrize("symbol,text", [(toxicity.INSULT, "you are an idiot"), (toxicity.THREAT, "i will kill you")])
def test_insult_and_threat_transducers_decide(monkeypatch, symbol, text):
    """Without the transducer of its own kind a word of the lexicon puts out nothing; the other kind's stays."""
    s = toxicity.Scanner({"idiot": 4.0, "kill": 4.0}, {})
    both = {t: s.total(t) for t in ("you are an idiot", "i will kill you")}
    assert both["you are an idiot"] != both["i will kill you"] and min(both.values()) > 0
    mark = toxicity._mark
    monkeypatch.setattr(toxicity, "_mark", lambda x: toxicity.Transducer(mark(x).step, [(False,), (x != symbol,)]))
    monkeypatch.setattr(toxicity, "GRAMMAR", toxicity.grammar())
    assert {t: s.total(t) for t in both} == both | {text: 0}


def test_isotonic_is_monotone():
    at, p = quality.isotonic([(0, 10, 5), (1, 10, 2), (2, 10, 9), (3, 10, 8)])
    assert (np.diff(p) > 0).all() and len(at) == 2


def test_summed_normal_equations_equal_one_solve(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.NAMES)))
    y = (x[:, 0] > 0).astype(int)
    d = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, y int").repartition(5)
    kernel, weights, _, _ = quality.fit(d, width=16)
    z = kernel(x)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * 300 / 17 * np.eye(17), z.T @ y)
    assert np.allclose(weights, want)


def test_quality_scores_equal_one_machines_fit(spark, sf):
    """The whole score by plain numpy on all labelled rows at once: kernel features, ridge, calibration by pooling."""
    d, labels = docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.classify(d, labels).collect()}
    x = {r.doc_id: np.array(quality.statistics((r.text or "").encode())) for r in d.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    train, target = np.array([x[i] for i in y]), np.array(list(y.values()), dtype=float)
    mean, dev = train.mean(axis=0), train.std(axis=0)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0.0, np.sqrt(2 * quality.GAMMA), (len(mean), quality.WIDTH)), rng.uniform(0, 2 * np.pi, quality.WIDTH)

    def lift(v):
        z = np.clip((v - mean) / np.where(dev > 1e-9, dev, 1.0), -8, 8)
        return np.hstack([np.sqrt(2.0 / quality.WIDTH) * np.cos(z @ w + b), np.ones((len(v), 1))])

    z = lift(train)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) / z.shape[1] * np.eye(z.shape[1]), z.T @ target)
    bins = defaultdict(lambda: [0, 0.0])
    for s, v in zip(z @ weights, target):
        k = bins[int(np.floor((min(2.0, max(-1.0, s)) + 1) / 3 * (quality.BINS - 1)))]
        k[0] += 1
        k[1] += v
    blocks = [[n, p, n * k] for k, (n, p) in sorted(bins.items())]
    i = 0
    while i < len(blocks) - 1:  # join the first pair out of order, and look again from the start
        if blocks[i][1] / blocks[i][0] >= blocks[i + 1][1] / blocks[i + 1][0]:
            blocks[i:i + 2] = [[u + v for u, v in zip(blocks[i], blocks[i + 1])]]
            i = 0
        else:
            i += 1
    at, p = [(k / n + 0.5) / (quality.BINS - 1) * 3 - 1 for n, _, k in blocks], [(q + 0.5) / (n + 1) for n, q, _ in blocks]
    ids = list(x)
    want = np.clip(np.interp(lift(np.array([x[i] for i in ids])) @ weights, at, p), 0, 1)
    off = np.abs(want - np.array([got[i] for i in ids]))
    assert np.quantile(off, 0.98) < 1e-6  # a sum in another order may move a score over the edge of its bin


def test_grammar_equals_a_plain_reading():
    """Marks of random clauses against a reading that keeps no machine: every word looks at its clause."""
    rng = np.random.default_rng(8)
    lexicon = {"idiot": 4.0, "kill": 3.0, "scum": 2.0}
    s = toxicity.Scanner(lexicon, {})
    pool = ["idiot", "kill", "scum", "you", "not", "said", "tree", "runs", "far", "."]
    for _ in range(300):
        words = [pool[i] for i in rng.integers(0, len(pool), 25)]
        want, clause = [], []
        for w in [*words, "."]:
            if w != ".":
                clause.append(w)
                continue
            for i, v in enumerate(clause):
                if v in lexicon:
                    want.append(((v == "kill", "you" in clause, "not" in clause[max(0, i - 3):i], "said" in clause[:i]), lexicon[v]))
            clause = []
        assert s.outputs(" ".join(words)) == want


# -- 8 ---------------------------------------------------------------------------------------------

def check_packing(pieces, want):
    """want: list of (doc_id, ids); rows of one id are matched as a multiset of their pieces."""
    from itertools import groupby

    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 2048
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    per = Counter()
    for doc, ids in want:
        per[doc] += len(ids)
    assert {d: sum(p.length for p in ps) for d, ps in by.items()} == dict(per)
    for doc, group in groupby(sorted(want, key=lambda x: (x[0] is None, x[0] or 0)), key=lambda x: x[0]):
        group = list(group)
        if len(group) == 1:
            ids, at = np.array(group[0][1], dtype="<u4"), 0
            for p in sorted(by[doc], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes()) and p.doc_tokens == len(ids)
                at += p.length
    return [sum(n for _, n in s) for s in seqs.values()]


def test_packing_is_an_exact_round_trip_with_no_padding(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = docs(spark, sf).repartition(2)
    want = [(r.doc_id, t.encode(r.text, add_special_tokens=False).ids + [1]) for r in d.collect()]
    sizes = check_packing(packing.pack(d).collect(), want)
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sum(n != 2048 for n in sizes) <= 2 * 11


@pytest.mark.parametrize("text", ["a  b", "a\n\nb", " lead", "trail ", "tab\tx", "a  b", "x\r\ny", "it's <|endoftext|> 12,5 %", "\n", "é ü", "a \nb", "日本 語", "don't 'll", "hello <|endoftext|> you", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", "x\u00a0<|endoftext|>  y"])
def test_cached_words_give_the_librarys_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.Words(*packing.default_vocab()).ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_awkward(spark, awkward):
    words = packing.Words(*packing.default_vocab())
    want = [(r.doc_id, np.frombuffer(words.ids(r.text), "<u4").tolist() + [1] if r.text else [1]) for r in awkward.collect()]
    check_packing(packing.pack(awkward, window=3000).collect(), want)
    assert packing.pack(awkward.limit(0)).count() == 0


def test_packing_balances_cost():
    p = packing.Packer(100, 1.0, 0.01, 0)
    for i, n in enumerate((60, 60, 40, 40, 10, 10, 10, 10, 30, 30)):
        p.add(i, b"\0" * 4 * n)
    p.flush()
    cost = Counter()
    for doc, _, n, _, _, seq, _ in p.rows:
        cost[seq] += n + 0.01 * n * n
    assert len(cost) == 3 and max(cost.values()) / min(cost.values()) < 1.3


# -- 9 ---------------------------------------------------------------------------------------------

def test_warc_awkward(spark):
    rows = [(1, "http://b.example/x", "p" * 150), (2, "http://a.example/x?q=1 2", "p" * 150), (3, None, None), (4, "not a url", "short"), (5, "http://ü.example/", "short"), (6, "http://b.example/x", "WARC/1.1\r\n\r\n\r\n" * 20), (7, "http://b.example/x", "p" * 150),
            (None, "http://c/", "none"), (4, "not a url", "short"), (None, "http://b.example/x", "p" * 150), (None, None, "q" * 120), (None, None, "q" * 120), (8, "http://s/", "r" * 120), (8, "http://s/", "s" * 130)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("digest", F.lit(1))
    order = lambda r: tuple(map(str, r))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(p).collect()), key=order)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    again = lambda i, t: i != 1 and t == "p" * 150
    want = [(i, len((t or "").encode()), sha(t), "revisit" if again(i, t) else "response", 1 if again(i, t) else None) for i, _, t in rows]
    assert got == sorted(want, key=order)
    assert warc.round_trip(p.limit(0)).count() == 0


def test_hosts_with_control_characters_give_their_rows(spark):
    urls = ["http://a\tb/x", "http://a\nb/x", "http://a\rb/x", "http://a\r\nb:80/x", "http:///x", "http://", "", "\t\n", "http://a\x00b/\x7f", "http://u:p@a\tb/", "http://a\u2028b/x"]
    p = spark.createDataFrame([(i, u, "t" * 120 if i % 2 else str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(p).collect()}
    assert got == {i: ("revisit", 1, 120) if i % 2 and i > 1 else ("response", None, 120 if i % 2 else len(str(i))) for i in range(len(urls))}


def test_capture_index_is_sorted_and_reads_ranges(spark, sf, tmp_path):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    folder = f"file://{tmp_path}/w"
    files = sorted((r.first_key, r.file) for r in warc.write(warc.plan(p), folder, block=7).collect())
    reader = warc.Reader(folder, files)
    for r in warc.keyed(p, "page_id", "url", "html").select("page_id", warc.capture_key("url", "page_id", "digest").alias("key"), F.col("payload").alias("html")).collect():
        fields, payload = reader.capture(r.key)
        assert fields["X-Page"] == str(r.page_id) and payload == bytes(r.html)
    assert reader.capture("zzz") is None and reader.capture("") is None
    keys = [k for _, f in files for k in reader._directory(f)[0]]
    assert keys == sorted(keys)


def test_archives_leave_no_files(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    try:
        assert warc.round_trip(spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")).count() == 1
        assert not list(tmp_path.rglob("*.warc.gz")) and not list(tmp_path.rglob("*.cdx"))
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)


def test_hadoops_names_of_stores():
    assert [warc.store_uri(x) for x in ("s3a://b/x", "s3n://b", "hdfs://n:1/x", "file:///x", "file:/x")] == ["s3://b/x", "s3://b", "hdfs://n:1/x", "file:///x", "file:/x"]


# -- 10 --------------------------------------------------------------------------------------------

def slow_fingerprint(text, words=4):
    import xxhash

    tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    fp = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= distance
    low = np.arange(len(fp))
    while True:
        new = np.where(near, low[None], len(fp)).min(axis=1)
        if (new == low).all():
            return low
        low = new


def test_simhash_equals_brute_force(spark, sf):
    rows = docs(spark, sf).select("doc_id", "text").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    comp = brute_components(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, sf).collect()}
    assert got == {r.doc_id: (f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, comp)}


@pytest.mark.parametrize("distance", [1, 3, 4, 6])
@pytest.mark.parametrize("probe_cost", [1e-3, 200.0])
def test_links_lose_none(spark, monkeypatch, distance, probe_cost):
    """Planted fingerprints around and beyond the distance; cheap probes make the plan use unequal thresholds."""
    monkeypatch.setattr(simhash, "PROBE_COST", probe_cost)
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = list(base)
    for b in base:
        for n in (1, distance, distance + 1):
            fps.append(b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, n, replace=False))))
    fps += [base[0] ^ np.uint64(i) for i in range(300)]
    fps = list(dict.fromkeys(int(f) for f in fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    comp = {r.node: r.component for r in simhash.components(simhash.links(nodes, distance)).collect()}
    assert [comp.get(i, i) for i in range(len(fps))] == brute_components(fps, distance).tolist()


def test_plan_holds_the_pigeonhole_bound():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for nodes in (10, 10**5, 10**9):
        for distance in (2, 4, 7):
            parts = simhash.plan(sample, nodes, distance)
            assert sorted(b for g, _ in parts for b in g) == list(range(64)) and sum(t + 1 for _, t in parts) == distance + 1


def test_large_groups_split_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 100, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    f = simhash.Forest()
    n = len(fp)
    simhash.Group(fp, np.arange(n), np.ones(n, dtype=bool), 4).split(np.arange(n), f)
    assert [f.root(i) for i in range(n)] == brute_components(fp, 4).tolist()


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(e).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def test_fingerprints_without_ids_link_and_bridge(spark, monkeypatch):
    fps = {7: 0b0, None: 0b1111, 9: 0b11111111}  # 7 and 9 only meet over the row without an id
    rows = spark.createDataFrame([(i, f) for i, f in fps.items()] + [(None, 0x7C << 56)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: rows)
    got = sorted((r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [("0" * 16, 7), ("0" * 14 + "0f", 7), ("0" * 14 + "ff", 7), ("7c" + "0" * 14, None)]


def test_simhash_awkward(spark, awkward):
    got = sorted((r.doc_id or -1, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(awkward).collect())
    assert [(d, c) for d, z, c in got if z] == [(3, 3), (4, 3), (9, 3)] and [c for d, _, c in got if d in (1, 2, 7)] == [1, 1, 1, 1] and len(got) == 11
    assert [c for d, _, c in got if d in (5, 6)] == [5, 5] and simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_similar_groups_find_small_edits(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        t = list(rng.choice(words, 300))
        rows.append((10 * i, " ".join(t)))
        for e in range(1, 4):
            u = list(t)
            for k in rng.choice(300, e, replace=False):
                u[k] = "changed"
            rows.append((10 * i + e, " ".join(u)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_groups(rows)


def block_edits():
    """Pairs of distinct words whose five-word shingles have J of 0.8 to 0.9 after one block is added, removed or replaced,
    and pairs just below 0.8."""
    rng, rows, far = np.random.default_rng(11), [], []
    word = iter(f"w{i}" for i in rng.permutation(2_000_000))
    fresh = lambda n: [next(word) for _ in range(n)]
    for i in range(120):
        t = fresh(404)  # 400 shingles
        kind, j = i % 4, (0.8, 0.85, 0.9)[i % 3]
        if kind == 0:
            u = t + fresh(round(400 / j) - 400)
        elif kind == 1:
            u = t[round(400 * (1 - j)):]
        elif kind == 2:  # n of 400 shingles differ in both: J = (400 - n) / (400 + n)
            n = int(400 * (1 - j) / (1 + j))
            u = t[:404 - n] + fresh(n)
        else:
            u = t + fresh(102)  # J = 400 / 502
            far.append(2 * i)
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    return rows, far


def exact_groups(rows, t=0.8, n=5):
    sets = [(d, {tuple(x.split()[i:i + n]) for i in range(max(1, len(x.split()) - n + 1))}) for d, x in rows]
    name = {d: d for d, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if a < b and name[a] != name[b] and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((name[a], name[b]))
                name = {d: low if c == high else c for d, c in name.items()}
    return name


def test_similar_groups_are_exact_for_block_edits(spark):
    rows, far = block_edits()
    want = exact_groups(rows)
    assert all(want[d] == d and want[d + 1] == d + 1 for d in far) and sum(want[d] == d - 1 for d in want if d % 2) == 90
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()} == want


def test_parities_err_as_they_say():
    """Bins apart never exceed the shingles that sets do not share, follow the mean and deviation of ``odd_bins``, and halves
    laid over each other give the bitmap of half as many bins."""
    rng = np.random.default_rng(31)
    J = simhash.jaccard
    z = []
    for _ in range(200):
        n, apart = int(rng.integers(50, 900)), int(rng.integers(1, 300))
        s = rng.integers(0, 1 << 63, n + apart, dtype=np.uint64)
        x, y = np.sort(s[:n]), np.sort(s[apart:])
        got, bins = J.bins_apart([J.parities(x)], [J.parities(y)])
        unshared = len(np.setxor1d(x, y))
        assert got[0] <= unshared
        mean, sd = J.odd_bins(np.array([unshared]), bins)
        z.append((got[0] - mean[0]) / max(sd[0], 0.5))
    assert abs(np.mean(z)) < 0.3 and max(map(abs, z)) < 5
    whole = np.frombuffer(J.parities(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)), "<u8")
    assert len(whole) * 64 == 2048


def test_similar_groups_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(simhash.jaccard, "SMALL", 4)
    monkeypatch.setattr(simhash.jaccard, "TILE", 16)
    rng, rows = np.random.default_rng(12), []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(200)]
        for i in range(50):
            at = int(rng.integers(0, 150))
            rows.append((100 * f + i, " ".join(base[:at] + [f"x{f}-{i}-{k}" for k in range(int(rng.integers(5, 30)))] + base[at + int(rng.integers(0, 25)):])))
    want = exact_groups(rows)
    assert len(set(want.values())) > 3
    d = spark.createDataFrame(rows + [(None, rows[0][1]), (None, "alone and without an id")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.similar_groups(d).collect()]
    assert {a: b for a, b in got if a is not None} == want and sorted(str(b) for a, b in got if a is None) == ["0", "None"]


def family(k, f=0):
    """A family of near copies about 0.8 apart."""
    rng, rows = np.random.default_rng(12 + f), []
    base = [f"f{f}w{i}" for i in range(200)]
    for i in range(k):
        at = int(rng.integers(0, 150))
        rows.append((1000 * f + i, " ".join(base[:at] + [f"x{f}-{i}-{j}" for j in range(int(rng.integers(5, 30)))] + base[at + int(rng.integers(0, 25)):])))
    return rows


def test_near_copies_send_rows_in_proportion(spark):
    """Four times the members of a family send about four times the rows to find it, and not sixteen times."""
    J, none = simhash.jaccard, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent = [J.neighbours(spark.createDataFrame(family(k), "doc_id long, text string"), 5, 0.8, none).count() for k in (60, 240)]
    assert 59 <= sent[0] and sent[1] <= 6 * sent[0]


def test_block_edges_are_pairs_with_room_whatever_the_partitions(spark):
    """Chance meetings beyond a pair's room hang nothing together, and more partitions give no more edges."""
    J, none = simhash.jaccard, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def edges(*posts):
        cols = zip(*posts)
        return len(J._neighbours([len(posts).to_bytes(8, "little") + b"".join(np.array(c).astype(k).tobytes() for c, (_, k) in zip(cols, J.POST))], 0.8)[0])

    assert edges((7, 1, 100, 11), (7, 2, 100, 11)) == 1
    assert edges((7, 1, 100, 11), (7, 2, 100, 15)) == 0  # at most 85 shared of 115 in all
    assert edges((7, 1, 100, 11), (7, 2, 100, 15), (7, 3, 85, 0)) == 2  # both have room with the third
    own, sent = spark.conf.get("spark.sql.shuffle.partitions"), set()
    d = spark.createDataFrame(family(60) + family(40, 1) + family(9, 2), "doc_id long, text string")
    try:
        for n in (1, 3, 24):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sent.add(J.neighbours(d, 5, 0.8, none).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert len(sent) == 1


def test_nodes_with_room_hang_together(monkeypatch):
    """By sizes and reaches of large groups: the components of all pairs, or unions of them beyond ``TILE``."""
    rng, J = np.random.default_rng(3), simhash.jaccard
    for _ in range(40):
        n = np.sort(rng.integers(20, 60, 70))
        reach = n * rng.choice([0.85, 0.95, 1.0, 1.1, 1.25], len(n))
        a, b = np.nonzero((n <= reach[:, None]) & (n[:, None] <= reach) & ~np.eye(len(n), dtype=bool))
        want = J.least_reachable(len(n), a, b)
        monkeypatch.setattr(J, "TILE", 70)
        assert J._near_sizes(n, reach, 0.8).tolist() == want.tolist()
        monkeypatch.setattr(J, "TILE", 69)
        got = J._near_sizes(n, reach, 0.8)
        assert len(set(zip(want.tolist(), got.tolist()))) == len(set(want.tolist()))


def test_similar_groups_of_blocks_too_large_for_a_task(spark, monkeypatch):
    rows = family(40) + family(3, 1) + family(2, 2)
    d = spark.createDataFrame(rows + [(None, rows[0][1]), (7777, rows[0][1].upper())], "doc_id long, text string")
    want = exact_groups(rows)
    for most in (8192, 4):
        monkeypatch.setattr(simhash.jaccard, "BLOCK_NODES", most)
        got = [(r.doc_id, r.component_id) for r in simhash.similar_groups(d).collect()]
        assert sorted(x for x in got if x[0] is not None) == sorted([*want.items(), (7777, want[0])]) and (None, want[0]) in got


def test_texts_of_large_blocks_move_once(spark, monkeypatch):
    """What is read several times for large blocks is stored, and not joined out of all texts each time."""
    plans, own = [], simhash._large_groups
    monkeypatch.setattr(simhash.jaccard, "BLOCK_NODES", 4)
    monkeypatch.setattr(simhash, "_large_groups", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or own(rows, *a))
    simhash.similar_groups(spark.createDataFrame(family(9), "doc_id long, text string")).collect()
    assert len(plans) == 1 and "Join" not in plans[0]


def test_components_of_a_block_are_exact():
    rng = np.random.default_rng(5)
    some = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for families, k, n in ((1, 90, 260), (60, 2, 260), (1, 60, 12)):
        sets = []
        for _ in range(families):
            base = some(n)
            sets += [np.unique(np.concatenate([base[rng.random(n) < rng.choice([0.8, 0.9, 0.95])], some(int(rng.integers(1, n // 8 + 2)))])) for _ in range(k)]
        name = list(range(len(sets)))
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                both = len(np.intersect1d(x, y))
                if name[a] != name[b] and 5 * both >= 4 * (len(x) + len(y) - both):
                    name = [name[b] if c == name[a] else c for c in name]
        got = simhash.jaccard._components(sets, 0.8).tolist()
        assert len(set(name)) == len(set(got)) == len(set(zip(name, got))) < len(sets)


def test_suffix_runs_of_other_content_are_not_equal(spark):
    """Documents that share a passage, their runs at its ends told apart only by bytes far from the anchor."""
    rng = np.random.default_rng(7)
    some = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    passage = some(60)
    texts = [some(40) + passage + some(40) for _ in range(3000)]
    rows = list(enumerate(t.decode() for t in texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, 50)


def test_suffix_very_long_text(spark):
    """A repeat beyond 2**24 bytes of one text, whose own part of another document's text goes as well."""
    rng = np.random.default_rng(8)
    some = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    shared, later = some(300), some(200)
    long = some((1 << 24) + 5000) + shared + some(3000) + later + some(2000)
    rows = [(1, "A" + later + "B"), (2, long), (3, "C" + shared + "D")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 200, 3: 300}


def test_suffix_pieces_of_documents(spark, monkeypatch):
    rng = np.random.default_rng(9)
    some = lambda n: rng.integers(97, 101, n, dtype=np.uint8).tobytes().decode()
    bits = [some(int(n)) for n in rng.integers(20, 400, 12)]
    rows = [(i, some(30).join(bits[k] for k in rng.integers(0, 12, 8))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(suffix_dedup.remove_repeats(d).collect())
    monkeypatch.setattr(suffix_dedup, "CHUNK", 90)
    assert sorted(suffix_dedup.remove_repeats(d).collect()) == want
