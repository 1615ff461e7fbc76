import random

import numpy as np
from pyspark.sql import functions as F

from quaymark.operators.machine_fold import Transitions, composed, entities, replay

SPEC = Transitions.parse("NEW", "NEW -open-> OPEN; OPEN -pay-> PAID; OPEN -open-> OPEN; PAID -ship-> SENT; OPEN -drop-> GONE; PAID -drop-> GONE")


def oracle(rows):
    out, held = [], {}
    for k, e, i, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[3], r[2])):
        s, v = held.get(k, (SPEC.initial, 0))
        t = SPEC.edges.get((s, e))
        if t:
            v += 1
        out.append((k, i, s, t or s, "REJECTED" if not t else "TERMINAL" if t in SPEC.terminals else "ACCEPTED", v))
        held[k] = (t or s, v)
    return sorted(out)


def run(spark, rows, width):
    d = spark.createDataFrame(rows, "k string, e string, id string, t bigint")
    return replay(d, F.col("k"), F.col("e"), [F.col("t"), F.col("id")], F.floor(F.col("t") / width), SPEC, F.col("id"))


def test_terminals():
    assert SPEC.terminals == {"SENT", "GONE"}


def test_against_a_plain_fold(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b", "c", None]), rng.choice(["open", "pay", "ship", "drop", "open", "nope", None]), f"i{i}", rng.randrange(200)) for i in range(500)]
    for width in (10, 10_000):
        told = run(spark, rows, width)
        assert sorted((r.key, r.event_id, r.from_state, r.to_state, r.outcome, r.version) for r in told.collect()) == oracle(rows)
    last = {}
    for k, i, _, t, o, v in sorted(oracle(rows), key=lambda r: r[5]):
        if o != "REJECTED":
            last[k] = (t, v, i)
    assert {r.key: (r.state, r.version, r.last_event_id) for r in entities(told).collect()} == last


def test_empty(spark):
    assert run(spark, [], 10).collect() == []


def test_composed_against_a_walk():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        to, counts, first = rng.integers(0, 4, (n, 4)), rng.integers(0, 2, (n, 4)), rng.random(n) < 0.05
        at, total = composed(to, counts, first)
        for s in range(4):
            state, seen = s, 0
            for i in range(n):
                if first[i] or i == 0:
                    state, seen = s, 0
                seen += counts[i, state]
                state = to[i, state]
                assert (at[i, s], total[i, s]) == (state, seen)


def test_stretches_longer_than_a_batch(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b"]), rng.choice(["open", "pay", "ship", "drop", "open"]), f"i{i:05}", i) for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for width in (100, 10_000):
            assert sorted((r.key, r.event_id, r.from_state, r.to_state, r.outcome, r.version) for r in run(spark, rows, width).collect()) == oracle(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
