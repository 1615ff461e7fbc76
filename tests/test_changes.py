import random

import pytest
from pyspark.sql import functions as F

from quaymark.operators.changes import apply_changes

BASE, FEED = "k string, v bigint, s string, row int, live int", "k string, v bigint, s string, t bigint, gone boolean"


def run(spark, base, feed, columns=("s",), block=2):
    b = spark.createDataFrame([(*r, 0, 0) for r in base], BASE)
    c = spark.createDataFrame(feed, FEED)
    r = apply_changes(b, c, key=F.col("k"), base_key=F.col("k"), version=F.col("v"), base_version=F.col("v"), deleted=F.col("gone"), tie=[F.col("t")] if columns else (), columns=columns, block=block)
    return {x[0]: tuple(x[1:]) for x in r.collect()}


def fold(base, feed):
    held = {k: (v or 0, s) for k, v, s in base}
    for k, v, s, _, gone in sorted((r for r in feed if r[0] is not None), key=lambda r: (r[1] or 0, bool(r[4]), -r[3])):
        v = v or 0
        if k in held and v <= held[k][0]:
            continue
        if gone:
            held.pop(k, None)
        else:
            held[k] = (v, s)
    return held


@pytest.mark.parametrize("seed", range(3))
def test_random_feeds(spark, seed):
    rng = random.Random(seed)
    base = [(f"e{i}", rng.randint(1, 6), "base") for i in range(0, 12)]
    feed = []
    for i in range(400):
        v = rng.choice([None, *range(0, 12)])
        feed.append((rng.choice([None, *(f"e{j}" for j in range(20))]), v, f"s{i}", i, rng.random() < 0.25))
    feed += rng.sample(feed, 60)  # repeats
    rng.shuffle(feed)
    want = fold(base, feed)
    assert run(spark, base, feed) == want
    assert run(spark, base, feed, columns=(), block=100) == {k: (v,) for k, (v, _) in want.items()}


def test_edges(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("a", None, "x")], []) == {"a": (0, "x")}
    assert run(spark, [], [("a", None, "x", 1, False)]) == {"a": (0, "x")}
    assert run(spark, [("a", 3, "x")], [("a", 5, None, 1, True)]) == {}
    assert run(spark, [("a", 3, "x")], [("a", 5, None, 1, True), ("a", 5, "y", 2, None)]) == {"a": (5, "y")}
