import random

from pyspark.sql import functions as F

from quaymark.llm.nearest import nearest_join
from quaymark.llm.queries import oracle_sql, queries
from quaymark.sources.envelopes import symbol_key, time_us
from tests.oracle import bags

TOL = 700_000


def run(spark, left, right):
    l = spark.createDataFrame(left, "id int, e string, t bigint, seq int, at bigint, level int")
    r = spark.createDataFrame(right, "e string, at bigint, seq bigint, id int")
    j = nearest_join(l, r, entity=F.col("e"), at=F.col("t"), right_entity=F.col("e"), right_at=F.col("at"), seq=F.col("seq"), tolerance_us=TOL)
    return sorted((x.id, x.match_seq) for x in j.collect())


def brute(left, right):
    out = []
    for i, e, t, *_ in left:
        near = [(abs(t - a), a, s) for f, a, s, _ in right if e is not None and f == e and t is not None and a is not None and abs(t - a) <= TOL]
        if near:
            out.append((i, min(near)[2]))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    for spread in (3_000_000, 60_000_000):
        left = [(i, rng.choice(["A", "B", None]), rng.choice([None, rng.randrange(-spread, spread)]) if i % 50 == 0 else rng.randrange(-spread, spread), 0, 0, 0) for i in range(1500)]
        right = [(rng.choice(["A", "A", "B", None]), None if i % 70 == 0 else rng.randrange(-spread, spread) // 1000 * 1000, i, 0) for i in range(400)]
        right += right[:50] + [("A", right[3][1], 9999, 0)]
        assert run(spark, left, right) == brute(left, right)


def test_ties_edges_and_empty(spark):
    right = [("A", 0, 1, 0), ("A", 1000, 2, 0), ("A", 1000, 0, 0), ("A", 10_000_000, 3, 0)]
    left = [(1, "A", 500, 0, 0, 0), (2, "A", 501, 0, 0, 0), (3, "A", 1000 + TOL, 0, 0, 0), (4, "A", 1001 + TOL, 0, 0, 0), (5, "A", -TOL, 0, 0, 0), (6, "A", -TOL - 1, 0, 0, 0), (6, "A", 0, 0, 0, 0), (6, "A", 0, 0, 0, 0)]
    assert run(spark, left, right) == [(1, 1), (2, 0), (3, 0), (5, 1), (6, 1), (6, 1)] == brute(left, right)
    assert run(spark, [], right) == run(spark, left, []) == []


def test_spellings(spark):
    d = spark.createDataFrame([(t,) for t in ["2025-03-03T09:00:00Z", "2025-03-03T18:00:00.000+09:00", "2025-03-03 09:00:00", "1740992400", "1740992400000", " 1740992400000000 ", "2025-03-03T04:00:00-0500", "soon", "", None]], "t string")
    assert [r.u for r in d.select(time_us(F.col("t")).alias("u")).collect()] == [1740992400000000] * 7 + [None] * 3
    s = spark.createDataFrame([(t,) for t in [" abc ", "ABC.XVEN", "xven:abc", "ABC", "", None]], "s string")
    assert [r.k for r in s.select(symbol_key(F.col("s")).alias("k")).collect()] == ["ABC"] * 4 + [None] * 2


def test_query_against_sql(spark, tiny):
    got, want = bags(queries()["p2_found"](spark, tiny), oracle_sql()["p2_found"], tiny)
    assert got == want
