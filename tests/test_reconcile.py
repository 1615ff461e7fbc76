import json
import random

from pyspark.sql import functions as F

from quaymark.functions.json_text import canonical
from quaymark.operators import reconcile as module
from quaymark.operators.reconcile import reconcile

DDL = "id string, version bigint, name string, data string, key string, row int, leaf int"
FIELDS = ("version", "name", "data")


def run(spark, a, b, **kw):
    x, y = spark.createDataFrame(a, DDL), spark.createDataFrame(b, DDL)
    r = reconcile(x, y, key=F.trim("id"), version=F.col("version"), fields={f: F.col(f) for f in FIELDS}, json_fields=["data"], **kw)
    return sorted((k, f) for k, f in r.collect())


def row(i, v=1, n="n", d="{}"):
    return (i, v, n, d, "k", 0, 0)


def test_canonical_spelling():
    same = ['{"a":1.50,"b":[1,2]}', '{ "b": [1, 2.0], "a": 15e-1 }', '{"\\u0061":1.5,"b":[1,2]}']
    assert len({canonical(s) for s in same}) == 1
    assert canonical('{"a":"1"}') != canonical('{"a":1}')
    assert canonical("nope") != canonical('"nope"')
    assert canonical(None) is None


def test_findings(spark):
    a = [row("x"), row(" y ", 2), row("z", n=None), row("j", d='{"a":1.0,"b":null}'), row("q", d=None), row(None), row("same"), row("same")]
    b = [row("y", 1), row("y", 2, "other"), row("z", n="n"), row("j", d='{ "b":null, "a":1}'), row("q", d="null"), row("w"), row("same\t".strip()), row(None)]
    assert run(spark, a, b) == [("q", "data"), ("w", "missing_left"), ("x", "missing_right"), ("y", "name"), ("z", "name")]


def test_empty_sides(spark):
    assert run(spark, [], []) == []
    assert run(spark, [row("a")], []) == [("a", "missing_right")]
    assert run(spark, [], [row("a")], missing_left=None) == []


def test_many_ranges(spark):
    rng = random.Random(3)
    a = [row(f"k{i}", i % 5, f"n{i}", json.dumps({"i": i, "long": "x" * (200 if i % 97 else 20000)})) for i in range(3000)]
    b = [list(r) for r in a]
    rng.shuffle(b)
    want = []
    for i in rng.sample(range(3000), 40):
        r = next(x for x in b if x[0] == f"k{i}")
        r[2] = "changed"
        want.append((f"k{i}", "name"))
    assert run(spark, a, [tuple(r) for r in b], leaf_rows=8) == sorted(want)


UNLIKE = [
    ('{"a":9007199254740993e0}', '{"a":9007199254740992e0}'), ('{"a":1.00000000000000001E2}', '{"a":1.00000000000000002E2}'), ('{"a":' + "1" * 50 + "}", '{"a":' + "1" * 49 + "2}"),
    ('{"a":1}', '{"a":1} x'), ('{"a":1}', '{"a":1}]'), ("1", "1,2"), ('{"a":"\\ud800"}', '{"a":"?"}'), ('{"a":null}', "{}"), ("null", "NULL"), ('{"a":0.1}', '{"a":0.10000000000000000000000000000000000000001}'),
]
ALIKE = [('{"a":1e2,"b":[]}', '{"b" : [], "a": 100.0}'), ('{"a":-0.0}', '{"a":0}'), ('{"\\u0061":"\\u00e9\\ud83d\\ude00"}', '{"a":"é😀"}'), ('{"a":12e-1}', '{"a":1.20}')]


def test_no_difference_of_json_is_lost(spark):
    a, b = [row(f"u{i}", d=x) for i, (x, _) in enumerate(UNLIKE)], [row(f"u{i}", d=y) for i, (_, y) in enumerate(UNLIKE)]
    assert run(spark, a, b) == sorted((f"u{i}", "data") for i in range(len(UNLIKE)))
    a, b = [row(f"u{i}", d=x) for i, (x, _) in enumerate(ALIKE)], [row(f"u{i}", d=y) for i, (_, y) in enumerate(ALIKE)]
    assert run(spark, a, b) == []


def test_narrow_fields_travel_with_the_checksum(spark):
    x, y = spark.createDataFrame([row("a", 1), row("b", None), row("c", 3), row("d", 4)], DDL), spark.createDataFrame([row("a", 2), row("b", 0), row("c", 3)], DDL)
    r = reconcile(x, y, key=F.trim("id"), version=F.col("version"), fields={"version": F.col("version")})
    assert sorted(map(tuple, r.collect())) == [("a", "version"), ("b", "version"), ("d", "missing_right")]


def test_descent_sums_only_open_ranges(spark):
    sides = spark.range(4000).selectExpr("explode(array(0, 1)) as side", "id as key", "xxhash64('place', id) as place", "xxhash64(id) + if(id = 7 and side = 1, 1, 0) as sum")
    levels = module.depths(4000, leaf_rows=8, step=3)
    assert levels == [3, 6, 9]
    left = [sides.count()]
    open_, above, rest = None, 0, sides
    for bits in levels:
        rest = module.within(rest, open_, above)
        left.append(rest.count())
        open_, above = module.differing_ranges(rest, bits), bits
        assert open_.count() == 1
    assert left[1] == 8000 and left[2] < 8000 / 6 and left[3] < left[2] / 6
    assert module.descend(sides, levels).where("key = 7").count() == 2
