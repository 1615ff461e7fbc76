import numpy as np
from pyspark.sql import functions as F

from quaymark.models import mapping
from quaymark.models.language import Resolved, parse
from quaymark.models.provision import listing, plan, provision, schema_hash
from quaymark.functions.text import utf16_key
from quaymark.operators.machine_fold import Transitions, entities, replay
from quaymark.sources.market import BRIDGE_BITS, Clock, Feed, accounts, bridge, fnv1a, instruments, isin, price, ticks, venues
from quaymark.sources.walks import INVALID, events, ways


def test_isin():
    assert isin("US", 37833100) == "US0378331005"


def test_slices_agree(spark):
    whole = {(r.symbol, r.seq): r for r in ticks(spark, 7, 1_000_000, 1_060_000, n=5).collect()}
    part = {(r.symbol, r.seq): r for r in ticks(spark, 7, 1_020_000, 1_030_000, n=5).repartition(3).collect()}
    assert len(whole) == 300 and len(part) == 50 and all(whole[k] == r for k, r in part.items())
    other = {(r.symbol, r.seq): r for r in ticks(spark, 8, 1_020_000, 1_030_000, n=5).collect()}
    assert other.values() != part.values()
    assert all(r.bid < r.mid < r.ask for r in whole.values()) and 0.3 < np.mean([r.last is not None for r in whole.values()]) < 0.7
    assert len({r.symbol for r in instruments(spark, 7).collect()}) == 50


def test_price_moves_a_little():
    ms = np.arange(0, 86_400_000, 1000)
    p = price(1, np.zeros(len(ms), np.int64), np.full(len(ms), 100.0), ms)
    assert p.min() > 80 and p.max() < 125 and p.std() > 0.1 and np.abs(np.diff(p)).max() < 0.5
    night = price(1, np.zeros(3, np.int64), np.full(3, 100.0), np.array([86_399_999, 86_400_000, 86_400_001]))
    assert np.ptp(night) < 0.2 and np.allclose(night * 100, np.round(night * 100))
    assert price(1, np.array([0]), np.array([100.0]), np.array([-5]))[0] > 0


def test_provision(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS prov LOCATION '{}'".format(tmp_path / "w"))
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase("prov")
    try:
        src = "Class t::Root {{ a: String[1]; {more} }} Class t::Item {{ n: Integer[1]; }} Association t::A {{ root: Root[1]; items: Item[*]; }}"
        old = mapping.schema(Resolved(parse(src.format(more=""))), {"thing": "t::Root"})
        new = mapping.schema(Resolved(parse(src.format(more="b: Decimal[0..1];"))), {"thing": "t::Root"})
        assert [s.sql.split()[0] for s in provision(spark, old)] == ["CREATE", "CREATE", "CREATE"]
        assert plan(spark, old) == [] and schema_hash(old) != schema_hash(new)
        assert [s.sql.split()[0] for s in provision(spark, new)] == ["ALTER"]  # the view names none of the root's own columns
        wider = mapping.schema(Resolved(parse(src.format(more="b: Decimal[0..1];").replace("n: Integer[1];", "n: Integer[1]; m: String[1];"))), {"thing": "t::Root"})
        assert [s.sql.split()[0] for s in provision(spark, wider)] == ["ALTER", "CREATE"] and plan(spark, wider) == []
        assert dict(spark.table("things").dtypes)["b"] == "decimal(38,4)"
        kinds = {(r.table, r.kind) for r in listing(spark, new).collect()}
        assert {("things", "root"), ("thing_items", "child"), ("thing_items_with_things", "other")} <= kinds
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql("DROP DATABASE IF EXISTS prov CASCADE")


def test_bridge():
    n = 4000
    k, day, full = np.arange(n), np.zeros(n, np.int64), 1 << BRIDGE_BITS
    at = lambda share: bridge(3, k, day, np.full(n, int(full * share)))
    assert (at(0) == 0).all() and (at(1) == 0).all()
    for share in (0.5, 0.25, 0.1):
        assert abs(at(share).var() / (share * (1 - share)) - 1) < 0.1
    assert abs(np.corrcoef(at(0.25), at(0.75))[0, 1] - 1 / 3) < 0.06


def test_levels_return_to_the_reference():
    days = np.arange(20_000, 24_000)
    z = np.log(price(5, np.zeros(len(days), np.int64), np.full(len(days), 1000.0), days * 86_400_000, 0.01) / 1000) / 0.01
    assert abs(z.mean()) < 0.3 and abs(z.var() / (1 / (1 - 0.64)) - 1) < 0.15 and abs(np.corrcoef(z[1:], z[:-1])[0, 1] - 0.8) < 0.05


def test_fnv1a():
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C


def test_clock_and_feed(spark):
    t = [0.0]
    clock = Clock(1_000_000, speed=10, wall=lambda: t[0])
    feed = Feed(spark, 1, clock, n=2)
    assert feed.next().count() == 0
    t[0] = 0.5
    assert clock.now() == 1_005_000 and feed.next().count() == 10
    clock.pause()
    t[0] = 9.0
    assert clock.now() == 1_005_000 and feed.next().count() == 0
    clock.resume()
    clock.set_speed(1)
    t[0] = 12.0
    assert clock.now() == 1_008_000 and {r.seq for r in feed.next().collect()} == {1005, 1006, 1007}


def test_universe(spark):
    a = accounts(spark, 4).collect()
    assert len({r.account for r in a}) == 20 and {r.venue for r in a} <= {r.venue for r in venues(spark).collect()}
    assert a == accounts(spark, 4).collect() and a != accounts(spark, 5).collect()


HATCH = Transitions.parse("EGG", "EGG -warm-> CHICK; CHICK -feed-> HEN; HEN -feed-> HEN; EGG -drop-> LOST; CHICK -flee-> LOST; HEN -sell-> SOLD")


def test_ways():
    assert ways(HATCH) == [["warm", "feed", "sell"], ["warm", "flee"], ["drop"]]
    assert ways(Transitions("A", {("A", "x"): "B", ("B", "y"): "A"})) == [["x", "y", "x", "y", "x"]]
    assert ways(Transitions("A", {})) == []
    wide = Transitions("S", {("S", f"e{i}"): f"T{i}" for i in range(80)}, frozenset(f"T{i}" for i in range(80)))
    assert len(ways(wide)) == 50


def test_generated_events_come_to_an_end(spark):
    e = events(spark, HATCH, "hatch", 30, start_ms=1000, per_second=2, invalid_every=5)
    rows = e.collect()
    assert len({r.event_id for r in rows}) == len(rows) == 10 * (3 + 2 + 1) + 6
    assert min(r.due_ms for r in rows) == 1000 and {r.payload for r in rows if r.instance_key == "hatch-3"} == {'{"id": "hatch-3"}'}
    told = replay(e, F.col("instance_key"), F.col("event_type"), [F.col("seq")], F.lit(0), HATCH, F.col("event_id"))
    assert {r.event for r in told.where("outcome = 'REJECTED'").collect()} == {INVALID} and told.where("outcome = 'REJECTED'").count() == 6
    assert {(r.state, r.n) for r in entities(told).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()} == {("SOLD", 10), ("LOST", 20)}


def test_utf16_order(spark):
    words = ["a", "\uffff", "\U0001f600", "é", "", "ab", "\U00010000b"]
    got = [r.w for r in spark.createDataFrame([(w,) for w in words], "w string").orderBy(utf16_key(F.col("w"))).collect()]
    assert got == sorted(words, key=lambda w: w.encode("utf-16-be"))
