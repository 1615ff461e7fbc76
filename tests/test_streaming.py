import json
import time

from pyspark.sql import functions as F

from quaymark.operators.machine_fold import Transitions
from quaymark.store.buckets import VersionedTable
from quaymark.streaming.pipeline import bars, deduplicated, deliver, envelopes, folded, kafka_options, live_history, per_window, repeated, snapshot_topics, split_bad, time_table

SPEC = Transitions.parse("NEW", "NEW -open-> OPEN; OPEN -pay-> PAID")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(dict(zip(("event_id", "sm_type", "instance_key", "event_type", "ingest_ts_millis", "seq"), r))) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def drain(q):
    try:
        assert q.awaitTermination(60), "the query doesn't end"
        assert q.exception() is None
    finally:
        q.stop()


def test_dedupe_fold_and_restart(spark, tmp_path):
    src, cp = tmp_path / "in", str(tmp_path / "cp")
    got = {}

    def go():
        good, _ = split_bad(envelopes(spark, str(src)))
        one = deduplicated(good, "event_id", F.timestamp_millis("ingest_ts_millis"))
        q = folded(one, SPEC, "instance_key", "event_type", "seq").writeStream.outputMode("update").option("checkpointLocation", cp)
        drain(q.foreachBatch(lambda d, _: got.update({r.key: (r.state, r.version, r.rejected) for r in d.collect()})).trigger(availableNow=True).start())

    put(src, "a.json", [("1", "o", "x", "open", 1000, 1), ("1", "o", "x", "open", 1000, 1), ("2", "o", "y", "pay", 1000, 2), "not json", ("3", None, "x", "open", 1000, 3)])
    go()
    assert got == {"x": ("OPEN", 1, 0), "y": ("NEW", 0, 1)}
    put(src, "b.json", [("1", "o", "x", "open", 2000, 4), ("4", "o", "x", "pay", 2000, 5)])
    go()
    assert got["x"] == ("PAID", 2, 0)


def test_upsert_applies_each_batch_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id string, version bigint, state string, at bigint", "id", "version", "at")
    mk = lambda *r: spark.createDataFrame(list(r), "id string, version bigint, state string, at bigint")
    t.upsert(mk(("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 2, "z", 3), ("b", 5, "p", 1)), 0)
    t.upsert(mk(("a", 2, "late", 9), ("b", 6, "q", 1)), 1)
    t.upsert(mk(("a", 9, "never", 9)), 1)  # the same batch again
    assert {r.id: (r.version, r.state) for r in t.read().collect()} == {"a": (2, "z"), "b": (6, "q")}
    again = VersionedTable(spark, str(tmp_path / "t"), "id string, version bigint, state string, at bigint", "id", "version", "at")
    again.upsert(mk(("c", 1, "n", 1)), 2)
    assert again.read().count() == 3


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    schema = "id string, version bigint, state string, at bigint"
    t = VersionedTable(spark, f"file:{tmp_path}/t", schema, "id", "version", "at", buckets=8)
    mk = lambda *r: spark.createDataFrame(list(r), schema)
    t.upsert(mk(*[(f"k{i}", 1, "x", 1) for i in range(200)], (None, 1, "x", 1)), 0)
    before = t.standing()["buckets"]
    assert len(before) == 8
    for b in range(1, 5):
        t.upsert(mk(("k7", b + 1, f"s{b}", 1)), b)
    after = t.standing()["buckets"]
    assert sum(before[k] != after[k] for k in before) == 1 and all(len(p) == 1 for p in after.values())
    rows = {r.id: (r.version, r.state) for r in t.read().collect()}
    assert len(rows) == 200 and rows["k7"] == (5, "s4") and rows["k8"] == (1, "x")
    kept = [p for p in (tmp_path / "t" / "data").rglob("__bucket=*")]
    assert len(kept) == 9 and len(t.standings()) == 2  # the eight that stand, and one before for readers
    t.upsert(mk(), 9)
    assert t.standing()["batch"] == 9 and t.read().count() == 200


def test_windows(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.json", [("1", "o", "x", "open", 1000, 1), ("2", "o", "x", "open", 61_000, 2), ("3", "p", "x", "open", 62_000, 3)])
    d = envelopes(spark, str(src)).withColumn("ts", F.timestamp_millis("ingest_ts_millis"))
    seen = []
    q = per_window(d, "ts", "1 minute", ["sm_type"], "10 seconds").writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp"))
    drain(q.foreachBatch(lambda b, _: seen.append(sorted((r.sm_type, r.n) for r in b.collect()))).trigger(availableNow=True).start())
    assert seen[-1] == [("o", 1), ("o", 1), ("p", 1)]


def test_live_history(spark, tmp_path):
    schema = "symbol string, mid double, at bigint, seq bigint"
    quotes = lambda *r: spark.createDataFrame(list(r), schema)
    positions = spark.createDataFrame([("A", 10), ("B", -5), ("C", 1)], "symbol string, quantity bigint")
    step, latest, history = live_history(quotes(), str(tmp_path), positions, "symbol", "mid", "at", "seq")
    step(quotes(("A", 2.0, 1, 1), ("A", 3.0, 2, 2), ("X", 9.0, 2, 1)), 0)
    step(quotes(("A", 1.0, 1, 1), ("B", 4.0, 5, 1)), 1)  # an old quote of A comes late
    step(quotes(("B", 7.0, 9, 9)), 1)  # the batch again
    step(quotes(("C", 100.0, 7, 1)), 2)
    assert sorted(map(tuple, history.read().collect())) == [(0, 2, 1, 30.0), (1, 5, 2, 10.0), (2, 7, 3, 110.0)]
    src, seen = tmp_path / "in", []
    src.mkdir()
    quotes(("A", 5.0, 20, 20)).write.json(str(src / "q"))
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(src))
    drain(s.writeStream.foreachBatch(lambda b, i: (step(b, i + 3), seen.append(i))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert seen == [0] and history.read().where("batch = 3").first().value == 130.0


def test_delivery_sets_bad_rows_aside(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(60)] + [("k7", 700)], "id string, n int")
    stored, tries, aside = [], [], []

    def write(d):
        got = [r.id for r in d.collect()]
        tries.append(len(got))
        if {"k7", "k33"} & set(got):
            raise ValueError("no\n  sevens " + "x" * 3000)
        stored.extend(got)

    deliver(rows, "id", write, lambda d: aside.extend(d.collect()), "here", max_attempts=2, buckets=8)
    assert sorted(stored) == sorted(f"k{i}" for i in range(60) if i not in (7, 33)) and tries[:2] == [61, 61]
    assert sorted(json.loads(r.original)["n"] for r in aside) == [7, 33, 700]
    assert {(r.target, r.attempts, len(r.error), "\n" in r.error) for r in aside} == {("here", 2, 2000, False)}
    stored.clear()
    deliver(rows.where("id not in ('k7', 'k33')"), "id", write, lambda d: aside.append("none"), "here")
    assert len(stored) == 58 and "none" not in aside


def test_topics():
    assert snapshot_topics(["orders", "snapshots.b", "entity-snapshots", "snapshots.a.c", "my-snapshots.x", "snapshots."]) == ["entity-snapshots", "snapshots.a.c", "snapshots.b"]
    assert snapshot_topics(["other"]) == ["entity-snapshots"]
    assert kafka_options("h:1")["failOnDataLoss"] == "false"


def test_bars_of_a_stream(spark, tmp_path):
    rows = [("A", 1000, 1, 5.0, 10), ("A", 1000, 2, 6.0, 10), ("A", 59_000, 3, 4.0, 20), ("A", 61_000, 4, 9.0, 1), ("B", 2000, 1, 7.0, 0)]
    schema = "symbol string, ms bigint, seq bigint, price double, size bigint"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("ms"))
    seen = []
    q = bars(s, "symbol", "ts", F.col("seq"), "price", "size", "1 minute", "10 seconds").writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp"))
    drain(q.foreachBatch(lambda b, _: seen.append(sorted(tuple(r)[1:] for r in b.collect()))).trigger(availableNow=True).start())
    assert seen[-1] == [("A", 5.0, 6.0, 4.0, 4.0, 40, 4.75, 3), ("A", 9.0, 9.0, 9.0, 9.0, 1, 9.0, 1), ("B", 7.0, 7.0, 7.0, 7.0, 0, None, 1)]


def test_idle_keys_expire(spark, tmp_path):
    src, cp, got = tmp_path / "in", str(tmp_path / "cp"), []

    def go():
        good, _ = split_bad(envelopes(spark, str(src)))
        q = folded(good, SPEC, "instance_key", "event_type", "seq", idle_ms=1).writeStream.outputMode("update").option("checkpointLocation", cp)
        drain(q.foreachBatch(lambda d, _: got.extend((r.key, r.state, r.expired) for r in d.collect())).trigger(once=True).start())

    put(src, "a.json", [("1", "o", "x", "open", 1000, 1)])
    go()
    put(src, "b.json", [("2", "o", "y", "open", 1000, 2)])
    go()
    put(src, "c.json", [("3", "o", "x", "pay", 1000, 3)])
    go()
    assert ("x", "OPEN", False) in got and ("x", "OPEN", True) in got and ("x", "NEW", False) in got  # x began anew, where paying is no step


def test_time_table(spark):
    assert [r.ms for r in time_table(spark, 1500, 4000, 1000).selectExpr("unix_millis(ts) as ms").orderBy("ms").collect()] == [2000, 3000]


def test_repeated(spark, tmp_path):
    seen = []
    q = repeated(spark, "1 second", seen.append, str(tmp_path / "cp"))
    try:
        end = time.time() + 40
        while len(seen) < 3 and time.time() < end:
            time.sleep(0.2)
        assert seen[:3] == [0, 1, 2] and q.exception() is None
    finally:
        q.stop()
