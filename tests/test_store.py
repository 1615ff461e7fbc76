import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaymark.store.buckets import BucketTable
from quaymark.store.runs import MARK, RunStore
from quaymark.store.states import STATE, TRACE, StateStore, TraceWriter

T0 = dt.datetime(2031, 4, 5, 6, 0)


@pytest.fixture
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "store"), buckets=4)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "event_id string")


def got(d, c="event_id"):
    return sorted(r[c] for r in d.collect())


def state(wf, version, s="MOORED", data=None, at=0):
    return (wf, wf.split(":")[0], s, data, version, f"e{version}", T0 + dt.timedelta(seconds=at))


def trace(event, sec, stage, wf=None, lock=None, detail=None):
    return (event, T0 + dt.timedelta(seconds=sec), stage, wf, lock, detail)


def test_claims(spark, store):
    assert got(store.claim(ids(spark, "p", "q", "q", None), 100)) == ["p", "q"]
    store.mark_dispatched(ids(spark, "p", "unknown"))
    assert got(store.claim(ids(spark, "p", "q", "r"), 200)) == ["q", "r"]  # q wasn't dispatched: again
    assert {r.event_id: (r.received_ms, r.status) for r in store.messages.read().collect()} == {"p": (100, "DISPATCHED"), "q": (100, "RECEIVED"), "r": (200, "RECEIVED")}
    many = spark.range(700).select(F.concat(F.lit("m"), "id").alias("event_id"))
    assert store.claim(many, 300).count() == 700
    store.mark_dispatched(many)
    assert store.claim(many, 400).count() == 0
    assert {r.status: r.n for r in store.message_counts("m").collect()} == {"DISPATCHED": 700}
    assert store.sweep(250) == 3 and store.sweep(250) == 0 and got(store.claim(ids(spark, "p", "m1"), 500)) == ["p"]
    assert store.claim(ids(spark), 1).count() == 0


def test_checkpoints(spark, store):
    save = lambda *r: store.save_checkpoints(spark.createDataFrame(list(r), "stream string, shard string, position string"))
    assert store.checkpoint("tide", "0") is None
    save(("tide", "0", "10"), ("tide", "1", "4"), ("wind", "0", "7"))
    save(("tide", "0", "20"))
    assert (store.checkpoint("tide", "0"), store.checkpoint("tide", "1"), store.checkpoint("wind", "0")) == ("20", "4", "7")


def test_states_only_move_forward(spark, store):
    put = lambda *r: store.upsert(spark.createDataFrame(list(r), STATE))
    put(state("ship:a", 2, "MOORED"), state("ship:b", 1))
    put(state("ship:a", 1, "LATE"), state("ship:b", 3, "SAILED"), state("ship:b", 2, "MIDWAY"))
    put(*[state("ship:race", v, f"S{v}") for v in range(40, 0, -1)])
    assert {r.workflow_id: (r.state, r.version, r.last_event_id) for r in store.states.read().collect()} == {"ship:a": ("MOORED", 2, "e2"), "ship:b": ("SAILED", 3, "e3"), "ship:race": ("S40", 40, "e40")}
    assert got(store.load(spark.createDataFrame([("ship:a",), ("ship:none",)], "workflow_id string")), "workflow_id") == ["ship:a"]


def test_scans(spark, store):
    data = lambda name, n: json.dumps({"captain": {"name": name, "trips": n, "sober": True}, "holds": [{"t": 3}], "flag": None})
    store.upsert(spark.createDataFrame([state("ship:x1", 1, data=data("Ines", 4)), state("ship:x2", 1, data=data("Olaf", 9)), state("ship:x3", 1), state("ship:x4", 1, data="no JSON"), state("tug:x1", 1, data=data("Ines", 4))], STATE))
    assert got(store.scan("ship:x"), "workflow_id") == ["ship:x1", "ship:x2", "ship:x3", "ship:x4"]
    find = lambda path, v: got(store.scan("ship:", path, v), "workflow_id")
    assert find("captain.name", "Ines") == ["ship:x1"] and find("captain.trips", "9") == ["ship:x2"] and find("captain.sober", "true") == ["ship:x1", "ship:x2"] and find("captain.age", "1") == find("flag", "x") == []


def test_traces(spark, store):
    rows = [trace("e1", 0, "RECEIVED", "ship:a"), trace("e1", 2, "LOCK_GRANTED", "ship:a", "berth:4", "waitedMs=2"), trace("e1", 5, "DONE", "ship:a"), trace("e2", 7, "DONE", "ship:a"), trace("f3", 9, "DROPPED", "ship:b", None, "twice"), trace("f4", 10, "RECEIVED", "ship:b")]
    store.append_traces(spark.createDataFrame(rows[:3], TRACE))
    store.upsert(spark.createDataFrame([state("ship:a", 1)], STATE), spark.createDataFrame(rows[3:], TRACE))
    assert [r.stage for r in store.trace_of_event("e1").collect()] == ["RECEIVED", "LOCK_GRANTED", "DONE"] and store.trace_of_event("e1").collect()[1].lock_key == "berth:4"
    assert [r.event_id for r in store.trace_of_workflow("ship:a", 2).collect()] == ["e2", "e1"]
    assert [r.event_id for r in store.recent_events(2).collect()] == ["f3", "e2"]
    assert [r.event_id for r in store.traces_since("2031-04-05 06:00:07").collect()] == ["f4", "f3", "e2"] and store.traces_since("2031-04-05 06:00:00", cap=4).count() == 4
    assert got(store.scan_traces("e", "DONE")) == ["e1", "e2"]
    n = store.traces.read().count()
    many = spark.range(4000).select(F.concat(F.lit("t"), "id").alias("event_id"), F.lit(T0).alias("ts"), F.lit("DONE").alias("stage"), *[F.lit(None).cast("string").alias(c) for c in ("workflow_id", "lock_key", "detail")])
    store.append_traces(many, basis_points=1000)
    kept = store.traces.read().count() - n
    assert 250 < kept < 550
    store.traces.compact()
    assert store.traces.read().count() == n + kept and all(len(p) == 1 for p in store.traces.standing()["buckets"].values())


def test_purge_takes_one_flow(spark, store):
    store.upsert(spark.createDataFrame([state("pilot:1", 1), state("pilot:2", 1), state("ship:1", 1)], STATE), spark.createDataFrame([trace("z1", 0, "DONE", "pilot:1"), trace("z2", 0, "DONE", "ship:1"), trace("z3", 0, "DONE")], TRACE))
    store.save_checkpoints(spark.createDataFrame([("pilots", "0", "1"), ("ships", "0", "2")], "stream string, shard string, position string"))
    assert store.purge(["pilot"], ["pilot:"], "pilots") == 4
    assert got(store.states.read(), "workflow_id") == ["ship:1"] and got(store.traces.read()) == ["z2", "z3"] and store.checkpoint("pilots", "0") is None and store.checkpoint("ships", "0") == "2"
    assert store.purge(["pilot"], [], "pilots") == 0


def test_bucket_table_emptied_and_filled(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path), "k string, n int", "k", 3)
    row = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    assert t.read().count() == 0 and t.apply(row(("a", 1), ("b", 2)), lambda now, new: now.unionByName(new), 5)
    assert not t.apply(row(("c", 1)), lambda now, new: now.unionByName(new), 5)
    assert t.apply(None, lambda now, _: now.where("false")) and t.read().count() == 0
    assert t.append(row(("a", 3), ("a", 4))) and t.append(row(("a", 5))) and got(t.read(), "n") == [3, 4, 5]
    t.append(row(("b", None)))
    t.expire("n", 5)
    assert {(r.k, r.n) for r in t.read().collect()} == {("a", 5), ("b", None)}


def test_traces_are_written_in_batches(spark, store):
    t = [0.0]
    w = TraceWriter(store, batch=3, wait_ms=50, most=4, clock=lambda: t[0])
    assert not w.due() and w.flush() == 0
    assert w.offer(*trace("a", 0, "DONE")) and not w.due()
    t[0] = 0.06
    assert w.due() and w.flush() == 1 and not w.due()
    assert [w.offer(*trace(f"b{i}", i, "DONE")) for i in range(6)] == [True] * 4 + [False] * 2 and w.dropped == 2 and w.due()
    assert w.flush() == 4 and store.traces.read().count() == 5


def test_runs(spark, tmp_path):
    folder = str(tmp_path / "runs")
    s = RunStore(spark, folder)
    run = lambda i: (i, "tides", "laptop", "small", 10.0, 60, False, T0)
    cols = "run_id string, flow string, machine string, preset string, rate double, duration_sec int, chaos boolean, started_at timestamp"
    s.start(spark.createDataFrame([run("a"), run("b")], cols))
    sample = lambda i, t, loading, rate, p95: (i, T0, t, loading, rate, rate + 1, 5, 1, 0, 1.0, p95, 9.0)
    s.add_samples(spark.createDataFrame([sample("a", 0, False, 1.0, 5.0), sample("a", 1, True, 10.0, 6.0), sample("a", 2, True, 20.0, 8.0)], s.samples.schema))
    s.add_marks(spark.createDataFrame([("a", T0, a, "x", None) for a in ("CHAOS 1", "KILL", "NOTE", "STOP")], MARK))
    end = lambda *r: s.end(spark.createDataFrame(list(r), "run_id string, ended_at timestamp, status string"))
    end(("a", T0, "done"))
    end(("a", T0 + dt.timedelta(hours=1), "failed"))
    r = {x.run_id: x for x in s.summaries().collect()}
    assert (r["a"].status, r["a"].ended_at, r["a"].samples, r["a"].avg_completed_per_sec, r["a"].peak_completed_per_sec, r["a"].completed, r["a"].latency_p95, r["a"].disruptions) == ("done", T0, 3, 15.0, 20.0, 15, 7.0, 3)
    assert (r["b"].status, r["b"].samples, r["b"].disruptions) == ("running", 0, 0)
    again = {x.run_id: x.status for x in RunStore(spark, folder).runs.read().collect()}
    assert again == {"a": "done", "b": "interrupted"}
