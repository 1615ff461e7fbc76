import json

import pytest
from pyspark.sql import functions as F

from quaymark.operators.event_flows import EVENTS, STATES, Blocking, Handler, Rejected, _keys, components, decide, lock_keys, run_flows


def create(p, ctx):
    if not p.get("lines"):
        raise Rejected("no lines")
    ctx.save(f"order:{p['id']}", {"status": "CREATED"})
    for sku in p["lines"]:
        ctx.emit("Reserve", {"sku": sku, "order": p["id"]})
    ctx.emit("Expire", {"id": p["id"]}, at_ms=5000)


def reserve(p, ctx):
    key = f"sku:{p['sku']}"
    n = (ctx.state(key) or {"left": 1})["left"]
    ctx.save(key, {"left": n - 1})
    if n < 1:
        raise ValueError("out of stock")


def pay(p, ctx):
    if p.get("poison"):
        raise Blocking("look at it")
    ctx.save(f"order:{p['id']}", {"status": "PAID"})


def flaky(p, ctx):
    if ctx.attempt < 3:
        raise RuntimeError("again")


def expire(p, ctx):
    pass


HANDLERS = {
    "Create": Handler(create, "orders", ("order:{id}", "customer:{customer}")), "Reserve": Handler(reserve, "stock", ("sku:{sku}",)), "Pay": Handler(pay, "orders", ("order:{id}",)),
    "Flaky": Handler(flaky, "misc", retries=2), "Flakier": Handler(flaky, "misc", retries=1, on_error="block"), "Expire": Handler(expire, "orders", ("order:{id}",)),
}


def ev(i, kind, payload, seq):
    return (i, kind, payload if isinstance(payload, str) or payload is None else json.dumps(payload), seq, 0, None, None, 0)


def go(spark, rows, states=(), now=1000):
    s = spark.createDataFrame(list(states), STATES) if not hasattr(states, "columns") else states
    out, st, left = run_flows(spark.createDataFrame(rows, EVENTS), s, HANDLERS, now)
    return {r.event_id: r for r in out.collect()}, st, {r.event_id for r in left.collect()}


def test_keys():
    assert lock_keys(("b:{x}", "a:{x}", "a:{x}"), {"x": 1}, "d", "e") == ("a:1", "b:1")
    assert lock_keys((), {}, "d", "e") == ("d:e",)
    with pytest.raises(Rejected):
        lock_keys(("a:{y}",), {"y": " "}, "d", "e")


def test_components(spark):
    links = [("a", "1"), ("a", "2"), ("b", "2"), ("c", "3"), ("d", "4"), ("d", "5"), ("e", "5"), ("f", "1")] + [(f"x{i:03}", f"k{j}") for i in range(60) for j in (i, i + 1)]
    got = {r.event_id: r.label for r in components(spark.createDataFrame(links, "event_id string, key string")).collect()}
    assert got["a"] == got["b"] == got["f"] == "a" and got["c"] == "c" and got["d"] == got["e"] == "d" and {v for k, v in got.items() if k[0] == "x"} == {"x000"}


def test_flow(spark):
    rows = [
        ev("e1", "Create", {"id": "1", "customer": "c", "lines": ["A", "B"]}, 1), ev("e2", "Create", {"id": "2", "customer": "c", "lines": ["A"]}, 2), ev("e3", "Create", {"id": "3", "customer": "c", "lines": []}, 3),
        ev("e4", "Create", {"id": "4", "lines": ["A"]}, 4), ev("e5", "Nope", {}, 5), ev("e6", "Pay", "broken", 6), ev("e7", "Pay", {"id": "1", "poison": True}, 7), ev("e8", "Pay", {"id": "1"}, 8), ev("e9", "Pay", {"id": "2"}, 9),
        ev("f1", "Flaky", {}, 10), ev("f2", "Flakier", {}, 11),
    ]
    out, states, left = go(spark, rows)
    assert {i: r.status for i, r in out.items()} == {
        "e1": "DONE", "e2": "DONE", "e3": "REJECTED", "e4": "REJECTED", "e5": "REJECTED", "e6": "REJECTED", "e7": "BLOCKED", "e9": "DONE", "f1": "DONE", "f2": "BLOCKED", "e1.1": "DONE", "e1.2": "DONE", "e2.1": "PARKED",
    }
    assert out["f1"].attempts == 3 and out["e1"].children == ["e1.1", "e1.2", "e1.3"] and (out["e1.1"].parent, out["e1.1"].root, out["e1.1"].depth) == ("e1", "e1", 1)
    assert left == {"e8", "e1.3", "e2.2"}
    docs = {r.key: json.loads(r.doc) for r in states.collect()}
    assert docs["sku:A"] == {"left": 0} and docs["order:2"]["status"] == "PAID" and docs["order:1"]["__held"] == "e7"
    freed = decide(states, "e7")
    assert json.loads(freed.where(F.col("key") == "order:1").first().doc) == {"status": "CREATED"}
    out, _, left = go(spark, [rows[7]], freed)
    assert out["e8"].status == "DONE" and not left


def test_empty(spark):
    out, _, left = go(spark, [])
    assert out == {} and left == set()


def test_keys_of_events_as_expressions(spark):
    payloads = ['{"id":"1","customer":"c"}', '{"id":7,"customer":"c"}', '{"id":" ","customer":"c"}', '{"customer":"c"}', '{"id":null}', "[1]", "broken", "", None]
    d = spark.createDataFrame([(f"e{i}", "Create", p) for i, p in enumerate(payloads)] + [("n", "Nope", "{}"), ("f", "Flaky", "{}")], "event_id string, event_type string, payload string")
    keys, error = _keys(HANDLERS)
    got = {r.event_id: (r.k, r.e) for r in d.select("event_id", keys.alias("k"), error.alias("e")).collect()}
    assert got["e0"] == (["customer:c", "order:1"], None) and got["e1"] == (["customer:c", "order:7"], None) and got["f"] == (["misc:f"], None) and got["n"] == (["event:n"], None)
    assert [got[f"e{i}"][1] for i in range(2, 9)] == ["no id for order:{id}"] * 3 + [None] * 4
    assert all(got[f"e{i}"][0] == [f"event:e{i}"] for i in range(5, 9))


def test_a_busy_key_streams_in_order(spark):
    def count(p, ctx):
        ctx.save("k:1", {"n": (ctx.state("k:1") or {"n": 0})["n"] + 1, "last": p["i"]})

    n = 3000
    rows = [(f"e{i:05}", "Count", json.dumps({"i": i, "k": 1}), i, 0, None, None, 0) for i in reversed(range(n))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out, states, left = run_flows(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([("k:1", '{"n": 5}', 3)], STATES), {"Count": Handler(count, "d", ("k:{k}",))}, 0)
        assert out.where("status = 'DONE'").count() == n and left.count() == 0
        assert [(json.loads(r.doc), r.version) for r in states.collect()] == [({"n": n + 5, "last": n - 1}, n + 3)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_payloads_are_checked_before_the_handler(spark):
    h = {"Pay": Handler(pay, "orders", ("order:{id}",), check=lambda p: [] if "sum" in p else ["sum: missing"])}
    out, states, _ = run_flows(spark.createDataFrame([ev("a", "Pay", {"id": "1"}, 1), ev("b", "Pay", {"id": "1", "sum": 2}, 2)], EVENTS), spark.createDataFrame([], STATES), h, 0)
    assert {r.event_id: (r.status, r.error) for r in out.collect()} == {"a": ("REJECTED", "sum: missing"), "b": ("DONE", None)} and states.count() == 1
