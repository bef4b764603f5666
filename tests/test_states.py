"""State of streams: equal to the batch forms wherever the batches are cut, and forgotten in time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import limits
from passagework.streaming import admission, status


@pytest.fixture(autouse=True)
def rocks(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": status.ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def streamed(spark, tmp_path, batches, schema, make):
    """What comes out of ``make`` when the batches come one after another, each a run of its own from the same checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return spark.read.parquet(out).collect()


def cut(rows, cuts):
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("cuts", [[], [40], [3, 4, 90]])
def test_sliding_log(spark, tmp_path, cuts):
    rng = random.Random(2)
    rows = sorted(((rng.randrange(4), i, 1_700_000_000.0 + rng.randrange(400)) for i in range(150)), key=lambda r: (r[2], r[1]))
    schema = "k int, i int, s double"

    def make(stream):
        return admission.sliding_log(stream.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))), "k", "ts", "i", 3, 60.0)

    got = sorted((r.id, r.admitted) for r in streamed(spark, tmp_path, cut(rows, cuts), schema, make))
    want = limits.sliding_log(spark.createDataFrame(rows, schema), "k", "s", "i", 3, 60.0)
    assert got == sorted((r.i, r.admitted) for r in want.collect())


def test_a_key_is_forgotten_after_its_window(spark, tmp_path):
    start = 1_700_000_000.0
    batches = [[(1, 1, start), (1, 2, start + 1)], [(2, 3, start + 4000)], [(2, 4, start + 9000)], [(2, 5, start + 9001)]]
    schema = "k int, i int, s double"

    def make(stream):
        return admission.sliding_log(stream.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))), "k", "ts", "i", 1, 60.0)

    got = {r.id: r.admitted for r in streamed(spark, tmp_path, batches, schema, make)}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    left = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "log").load()
    assert {r.key[0] for r in left.collect()} == {2}


@pytest.mark.parametrize("cuts", [[], [30], [1, 2, 50, 51]])
def test_gauge(spark, tmp_path, cuts):
    rng = random.Random(5)
    spans = [(rng.randrange(3), i, float(rng.randrange(200)), 0.0) for i in range(60)]
    spans = [(k, i, s, s + rng.randrange(1, 40)) for k, i, s, _ in spans]
    events = sorted([(k, i, "start", s) for k, i, s, _ in spans] + [(k, i, "end", e) for k, i, _, e in spans], key=lambda r: (r[3], r[2] != "end", r[1]))
    got = sorted((r.id, r.admitted) for r in streamed(spark, tmp_path, cut(events, cuts), "k int, i int, kind string, at double", lambda s: admission.gauge(s, "k", "i", "kind", "at", 2)))
    want = limits.concurrent(spark.createDataFrame(spans, "k int, i int, s double, e double"), "k", "s", "e", "i", 2)
    assert got == sorted((r.i, r.admitted) for r in want.collect())


def test_a_slot_whose_end_is_lost_is_free_in_time(spark, tmp_path):
    import time

    def make(stream):
        return admission.gauge(stream, "k", "i", "kind", "at", 1, ttl_ms=1500)

    schema = "k int, i int, kind string, at double"
    assert [r.admitted for r in streamed(spark, tmp_path, [[(1, 1, "start", 0.0)]], schema, make)] == [True]
    time.sleep(2)
    got = streamed(spark, tmp_path, [[(1, 2, "start", 1.0), (1, 9, "end", 1.0), (1, 3, "start", 2.0), (None, 4, "start", 2.0), (1, 5, "pause", 2.0)]], schema, make)
    assert {r.id: r.admitted for r in got} == {1: True, 2: True, 3: False, 4: True}


@pytest.mark.parametrize("cuts", [[], [5], [1, 2, 9]])
def test_lives_of_documents(spark, tmp_path, cuts):
    """Late, repeated and illegal events, in one batch or several."""
    good = [("a", 0, k, s, None) for k, s in enumerate(("Uploaded", "Extracting", "Graphing", "Ready"))]
    events = [*good, ("b", 0, 0, "Uploaded", None), ("b", 0, 3, "Failed", "why"), ("b", 0, 3, "Failed", "why"), ("b", 0, 1, "Extracting", None), ("b", 1, 0, "Uploaded", None), ("b", 1, 3, "Ready", None), ("c", 0, 2, "Graphing", None), ("a", 1, 0, "Uploaded", None), ("d", None, None, None, None)]
    got = streamed(spark, tmp_path, cut(events, cuts), "document_id string, round long, seq int, status string, reason string", status.lives)
    state, want = {}, []
    for batch in cut(events, cuts):
        for d in sorted({e[0] for e in batch}):
            mine = sorted(((e[1] or 0, e[2] or 0, e[3]) for e in batch if e[0] == d), key=lambda e: (e[0], e[1], e[2] or ""))
            for e, (verdict, last, current) in zip(mine, status.judged(mine, *state.get(d, (None, None)))):
                state[d] = (last, current)
                want.append((d, *e, verdict, current))
    assert sorted(map(repr, ((r.document_id, r.round, r.seq, r.status, r.verdict, r.current) for r in got))) == sorted(map(repr, want))
    if not cuts:
        # a batch goes by place, so an event that came late is in time
        assert {(r.document_id, r.seq, r.verdict) for r in got if r.document_id == "b" and r.round == 0} == {("b", 0, "accepted"), ("b", 1, "accepted"), ("b", 3, "accepted"), ("b", 3, "repeated")}


class Store:
    """A map state that counts its calls, as its own handle."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def _called(self, found=None):
        self.calls += 1
        return found

    def exists(self):
        return self._called(bool(self.kept))

    def keys(self):
        return iter(self._called(list(self.kept)))

    def getValue(self, key):
        return self._called(self.kept.get(key))

    def updateValue(self, key, value):
        self._called(self.kept.update({key: value}))

    def removeKey(self, key):
        self._called(self.kept.pop(key))


def test_documents_of_a_bucket_share_the_calls_to_the_store():
    store, lives = Store(), status.Lives()
    lives.init(store)
    rows = [{"document_id": d and f"{d}", "round": 0, "seq": 0, "status": "Failed", "reason": None} for d in (None, *range(1, 500))]
    assert {r.verdict for r in lives.handleInputRows((3,), iter(rows), None)} == {"illegal"}
    assert store.calls == 1 and not store.kept
    first = [{**rows[0], "status": "Uploaded", "document_id": d} for d in ("7", None)]
    assert [r.verdict for r in lives.handleInputRows((3,), iter(first), None)] == ["accepted"] * 2
    again = list(lives.handleInputRows((3,), iter([{**first[0], "seq": 1, "status": "Extracting"}, first[0], first[1]]), None))
    assert [(r.document_id, r.seq, r.verdict) for r in again] == [(None, 0, "repeated"), ("7", 0, "repeated"), ("7", 1, "accepted")]
    assert store.kept == {("7",): (0, 1, "Extracting"), (None,): (0, 0, "Uploaded")}


def test_lives_of_documents_without_an_id(spark, tmp_path):
    events = [(None, 0, 0, "Uploaded", None), (None, 0, 1, "Extracting", None), ("", 0, 0, "Uploaded", None)]
    got = streamed(spark, tmp_path, cut(events, [1]), "document_id string, round long, seq int, status string, reason string", status.lives)
    assert sorted((r.document_id or repr(r.document_id), r.seq, r.verdict) for r in got) == [("''", 0, "accepted"), ("None", 0, "accepted"), ("None", 1, "accepted")]


def test_slots_that_are_freed_in_their_batch_never_come_to_the_store():
    store, gauge = Store(), admission.Gauge(2, 1000)
    gauge.init(store)

    def told(*rows):
        return [(r.id, r.admitted) for r in gauge.handleInputRows((1,), iter([dict(zip(("id", "kind", "at"), r)) for r in rows]), None)]

    pairs = [x for i in range(100) for x in ((i, "start", i), (i, "end", i + 0.5))]
    assert told(*pairs, (200, "start", 200.0)) == [*((i, True) for i in range(100)), (200, True)]
    assert store.calls == 2 and store.kept == {("200",): (200.0,)}
    # one that was held is freed and taken again: its time is the new one's
    assert told((200, "end", 201.0), (200, "start", 202.0), (201, "start", 203.0), (202, "start", 204.0)) == [(200, True), (201, True), (202, False)]
    assert store.kept == {("200",): (202.0,), ("201",): (203.0,)}
    assert told((200, "end", 205.0)) == [] and store.kept == {("201",): (203.0,)}
