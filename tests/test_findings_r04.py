"""What the fourth round's findings named."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.plans.stream_queries import deliver
from ledgerloom.streaming import streams as T

from test_streams import events, state, stream  # noqa: F401


def held(spark, stream, name):  # noqa: F811
    return spark.read.format("statestore").option("stateVarName", name).load(f"{stream.folder}/judge")


def test_a_batch_adds_its_own_ids_to_a_large_slot(spark, stream, monkeypatch):  # noqa: F811
    """a large slot is not written anew by each batch; ids of its parts are known like any others."""
    monkeypatch.setattr(T, "SLOTS", 1)
    stream.deliver([(i, "A", i, "c", None, i) for i in range(T.WHOLE + 50)])
    stream.deliver([(900, "A", i, "c", None, i) for i in range(T.WHOLE, T.WHOLE + 60)])
    stream.deliver([(901, "A", i, "c", None, i, i + (i % 2)) for i in range(T.WHOLE + 40, T.WHOLE + 62)])
    assert [len(r.ids) // T.ID for r in held(spark, stream, "content").select("value.ids").collect()] == [T.WHOLE + 50]
    assert sorted(len(r.ids) // T.ID for r in held(spark, stream, "added").select("list_element.ids").collect()) == [2, 10]
    assert sorted(r.sequence for r in stream.rejects().collect()) == list(range(T.WHOLE + 41, T.WHOLE + 60, 2))
    assert stream.history().count() == T.WHOLE + 62 and state(stream.mirror()) == {i: i + (i == T.WHOLE + 61) for i in range(T.WHOLE + 62)}


class Kept:
    """A state variable in memory that counts what is written."""

    def __init__(self, log):
        self.log, self.value, self.items = log, None, []

    def get(self):
        return iter(self.items) if self.value is None else self.value

    def update(self, value):
        self.value = value
        self.log.append(len(value[0]))

    def appendValue(self, value):  # noqa: N802
        self.items.append(value)
        self.log.append(len(value[0]))

    def clear(self):
        self.items = []


def test_many_batches_write_little_more_than_they_add():
    """what batches write to a slot, by ids, and that parts become one value again."""
    log, judge = [], T.Judge()
    judge.content, judge.added = Kept(log), Kept(log)
    judge.content.get = lambda: judge.content.value
    name = lambda i: f"{i:0{T.ID}d}"
    got, n = [], 20 * T.WHOLE
    for start in range(0, n, 64):
        rows = [Row(id=name(i), line=str(i), place="0" * T.DIGEST, at_ms=0) for i in range(max(0, start - 5), start + 64)]
        got += [(r.line, r.verdict) for r in judge.handleInputRows(None, iter(rows), None)]
    assert got == [(str(i), "accepted") for i in range(n)]
    ids = judge.content.value[0] + "".join(p[0] for p in judge.added.items)
    assert ids == "".join(map(name, range(n))) and len(judge.added.items) <= T.PARTS
    assert sum(log) < 4 * n * T.ID  # written anew by each batch: over 40 times


def test_lines_are_delivered_compressed(spark, tmp_path):
    out = deliver(events(spark, [(i, "A", i, "c", None, i) for i in range(50)]), f"file://{tmp_path}/in")
    names = [r.f for r in spark.read.text(f"{out}/payload").select(F.input_file_name().alias("f")).distinct().collect()]
    assert names and all(n.endswith(".gz") for n in names)
