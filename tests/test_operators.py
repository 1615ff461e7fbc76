import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.functions.hashes import sampled, sha_prefix, string_hash31
from quaymark.functions.text import causation_depth, flow_of, log_filter, normalized_message
from quaymark.operators import ranks, series
from quaymark.operators.asof import asof_join
from quaymark.operators.latest import latest_by, versioned_upsert
from quaymark.plans.relation import Catalog, QueryError, run
from quaymark.plans.sql_guard import Refused, checked, guarded


@pytest.mark.parametrize("strict", [False, True])
def test_asof_against_brute_force(spark, strict):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *[rng.randrange(1000)] * 9])) for i in range(300)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *[rng.randrange(0, 1000, 5)] * 9]), n) for n in range(150)]
    l, r = spark.createDataFrame(left, "id int, k string, t bigint"), spark.createDataFrame(right, "k string, u bigint, n bigint")
    want = {}
    for i, k, t in left:
        c = [(u, n) for kk, u, n in right if k is not None and kk == k and t is not None and u is not None and (u < t if strict else u <= t)]
        want[i] = max(c)[1] if c else None
    for width in (7, 10**6):
        got = {x.id: x.n for x in asof_join(l, r, ["k"], F.col("t"), F.col("u"), ["n"], tie=[F.col("n")], bucket_us=width, strict=strict).collect()}
        assert got == want
        inner = asof_join(l, r, ["k"], F.col("t"), F.col("u"), ["n"], how="inner", tie=[F.col("n")], bucket_us=width, strict=strict)
        assert {x.id for x in inner.collect()} == {i for i, n in want.items() if n is not None}


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.lognormal(size=3000).round(2), "b": np.array([5.0, 1.0, 3.0]), "c": np.full(500, 2.0)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("a", float("nan")), ("d", None)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(3)
    ps = [0.0, 0.5, 0.95, 1.0]
    for rule, index in (("floor", lambda p, n: min(n - 1, int(p * n))), ("nearest", lambda p, n: max(int(np.ceil(p * n)) - 1, 0))):
        got = {(r.k, r.p): r.value for r in ranks.at_ranks(d, ["k"], F.col("v"), ps, rule).collect()}
        assert got == {(k, p): np.sort(v)[index(p, len(v))] for k, v in data.items() for p in ps}
    got = {(r.k, r.p): r.value for r in ranks.interpolated(d, ["k"], F.col("v"), ps).collect()}
    for (k, p), v in got.items():
        assert v == pytest.approx(np.percentile(data[k], p * 100))
    whole = {r.p: r.value for r in ranks.at_ranks(d.where("k = 'b'"), [], F.col("v"), [0.5, 0.95], "floor").collect()}
    assert whole == {0.5: 3.0, 0.95: 5.0}
    assert ranks.at_ranks(d.where("k = 'd'"), ["k"], F.col("v"), ps, "floor").collect() == []


def test_trade_bars(spark):
    rows = [("A", 0, "10.00", "10.00", 0), ("A", 1, "10.05", "10.10", 100), ("A", 2, "10.05", "9.90", 300), ("A", 3, "10.20", "9.90", 0), ("B", 0, "10.00", None, 0), ("B", 30, "10.30", None, None)]
    d = spark.createDataFrame(rows, "s string, t int, mid string, last string, size bigint").withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("mid", "last")})
    b = {r.symbol: r for r in series.trade_bars(d, "s", F.floor(F.col("t") / 60), [F.col("t")], F.col("mid"), F.col("last"), F.col("size")).collect()}
    a = b["A"]
    assert [float(a[c]) for c in ("open", "high", "low", "close", "volume", "vwap", "trades", "ticks")] == [10.1, 10.1, 9.9, 9.9, 400, 9.95, 2, 4]
    q = b["B"]
    assert (float(q.open), float(q.close), q.vwap, q.volume, q.trades, q.ticks) == (10.0, 10.3, None, 0, 0, 2)


def test_lifetimes_and_rates(spark):
    d = spark.createDataFrame([("w", 1, "S"), ("w", 5, "E"), ("w", 6, "S"), ("w", 7, "S"), ("w", 9, "E"), ("w", 11, "E"), ("x", 2, "E"), ("y", 3, "S")], "k string, t bigint, e string")
    got = sorted((r.k, r.started_us, r.ended_us or 0) for r in series.lifetimes(d, ["k"], F.col("t"), F.col("e") == "S", F.col("e") == "E").collect())
    assert got == [("w", 1, 5), ("w", 6, 0), ("w", 7, 9), ("y", 3, 0)]
    c = spark.createDataFrame([("w", 0, 5), ("w", 2, 9), ("w", 3, 1), ("w", 5, 5)], "k string, s int, v bigint")
    assert [r.rate for r in series.counter_rate(c, ["k"], F.col("s"), F.col("v")).orderBy("s").collect()] == [None, 2.0, None, 2.0]


def test_latest_and_upsert(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 1, "n")], "k string, v bigint, s string")
    assert sorted((r.k or "", r.s) for r in latest_by(d, ["k"], [F.col("v")]).collect()) == [("", "n"), ("a", "y")]
    stored = spark.createDataFrame([("a", 3, "kept"), ("b", 1, "old")], "k string, v bigint, s string")
    new = spark.createDataFrame([("a", 3, "equal"), ("b", 2, "new"), ("c", 0, "first")], "k string, v bigint, s string")
    assert sorted(tuple(r) for r in versioned_upsert(stored, new, "k", "v", F.col("s")).collect()) == [("a", 3, "kept"), ("b", 2, "new"), ("c", 0, "first")]


def test_texts(spark):
    col = lambda rows, e: [r[0] for r in spark.createDataFrame([(x,) for x in rows], "m string").select(e(F.col("m"))).collect()]
    assert col(["order 12 failed: 3fa85f64-5717-4562-b3fc-2c963f66afa6 after 30ms", None, ""], normalized_message) == ["order # failed: … after #ms", None, ""]
    assert col(["evproc:orders:k:1", "order:O-1", "", None, "plain"], flow_of) == ["ev:orders", "order", None, None, "plain"]
    assert col(["a", "a.1", "a.1.2", "a.b.3"], causation_depth) == [0, 1, 2, 1]
    lines = ["ERROR disk full", "ERROR net down", "WARN disk", None]
    hits = lambda p: [r[0] for r in spark.createDataFrame([(x,) for x in lines], "m string").where(log_filter(F.col("m"), p)).collect()]
    assert hits("ERROR disk") == lines[:1] and hits("?net ?WARN") == lines[1:3] and hits("ERROR -net") == lines[:1] and hits('"disk full"') == lines[:1] and hits("error") == [] and hits("{$.a=1}") == lines and hits("") == lines


def java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_hashes(spark):
    words = ["", "a", "hello world", "ACCOUNT-ID-1039", "é", "x" * 500]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in d.select(string_hash31(F.col("w"))).collect()] == [java_hash(w) for w in words]

    def keep(w, bp):
        h = (java_hash(w) * 0x9E3779B1) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        return h % 10000 < bp

    assert [r[0] for r in d.select(sampled(F.col("w"), 5000)).collect()] == [keep(w, 5000) for w in words]
    assert len(d.select(sha_prefix(F.col("w"))).first()[0]) == 16


def test_model_queries(spark):
    cat = Catalog({"t": lambda: spark.createDataFrame([("a", 1, 2.0), ("b", 5, None)], "k string, n int, x double")})
    assert [tuple(r) for r in run("#>{s.t}#->filter(r|$r.n > 0 && $r.x->isEmpty())->select(~[k, n])", cat).collect()] == [("b", 5)]
    assert [tuple(r) for r in run("#>{s.t}#->extend(~y: r|if($r.n > 2, |'big', |'small'))->sort([~n->descending()])->select(~[y])->limit(1)", cat).collect()] == [("big",)]
    assert [tuple(r) for r in run("#>{s.t}#->groupBy(~[], ~[s: r|$r.n : y|$y->sum()])", cat).collect()] == [(6,)]
    for bad in ("#>{s.nope}#", "#>{s.t}#->filter(r|$r.zzz > 1)", "#>{s.t}#->filter(r|$q.n > 1)", "#>{s.t}#->explode()", "#>{s.t}#->filter(r|$r.n >", "Nope.all()", "#>{s.t}# extra", "#>{s.t}#->filter(r|$r.n->frob())"):
        with pytest.raises(QueryError):
            run(bad, cat)


def test_sql_guard(spark):
    for ok in ("SELECT 1", " with a as (select 1 x) select * from a;", "SHOW TABLES", "describe x", "EXPLAIN SELECT 1", "select 'drop table x; delete' as s", "select replace('a','b','c') -- insert"):
        checked(ok)
    for bad in ("", ";", "DROP TABLE x", "select 1; select 2", "insert into x values (1)", "with a as (select 1) insert into b select * from a", "explain drop table x", "set spark.x=1", "/* select */ delete from x", "create table t as select 1"):
        with pytest.raises(Refused):
            checked(bad)
    d, more = guarded(spark, "SELECT id FROM range(10)", rows=3)
    assert d.count() == 3 and more
    assert not guarded(spark, "SELECT id FROM range(3)", rows=3)[1]
