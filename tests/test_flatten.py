import json
import random

import numpy as np
from pyspark.sql import functions as F

from quaymark.operators.flatten import Child, Shape, byte_slices, flat_rows, flatten, two_decimals
from quaymark.operators.structural import Index


def index(texts, names):
    raw = [t.encode() for t in texts]
    return Index(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), names)


def is_json(t):
    try:
        json.loads(t)
        return True
    except ValueError:
        return False


def test_validity_and_values_of_random_texts():
    rng = random.Random(5)

    def value(d=0):
        k = rng.random()
        if d > 3 or k < 0.4:
            return rng.choice([1, -2.5, 1e40, "s", 'a"b', "c\\", "é", "", None, True, "[x", "{y", 'x","y'])
        if k < 0.7:
            return [value(d + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice("abcdef"): value(d + 1) for _ in range(rng.randint(0, 4))}

    texts = []
    for _ in range(2500):
        t = json.dumps(value(), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", " : ")]))
        if rng.random() < 0.5:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "{", "}", '"', ",", "[", "]", "x", ":", "\\", "\n", "0"]) + t[i + rng.randint(0, 1) :]
        texts.append(t)
    ix = index(texts, ["a", "b"])
    assert [bool(v) for v in ix.valid] == [is_json(t) for t in texts]
    count = np.bincount(ix.doc, minlength=len(texts))

    def nodes(o):
        return 1 + (sum(map(nodes, o)) if isinstance(o, list) else sum(nodes(v) for _, v in o.items()) if isinstance(o, dict) else 0)

    for t, v, c in zip(texts, ix.valid, count):
        if v:
            pairs = json.loads(t, object_pairs_hook=lambda p: dict(enumerate(x for _, x in p)))
            if not isinstance(pairs, str):
                assert nodes(pairs) == c, t


LINES = Shape((Child("lines", "sku", (Child("parts", "sku"),)),))


def rows(spark, texts, shape=LINES):
    d = spark.createDataFrame([(f"r{i}", t, "x", 1) for i, t in enumerate(texts)], "id string, body string, text string, idx int")
    return sorted((r.record_id, r.child_path, r.idx, r.item) for r in flatten(d, F.col("id"), F.col("body"), shape).collect())


def test_shapes(spark):
    texts = [
        '{"lines":[{"sku":"A"},null,{"product":{"sku":"B"},"parts":[{"sku":"p"},{"q":1}]}]}',
        '{"lines":{"sku":"C","parts":{"sku":"p"}}}',
        '{"lines":{"items":[{"sku":"D"}]}}',
        '"{\\"lines\\":[{\\"sku\\":\\"E\\"}]}"',
        '{"lines":"[{\\"sku\\":\\"F\\"}]"}',
        '{"lines":[{"sku":null},{"sku":""},{"sku":7}]}',
        '{"lines":[{"sku":"x"}',
        "", None, "null", "[]", '{"lines":null}', '{"lines":[]}', '{"lines":[[{"sku":"deep"}]]}', '{"sku":"top"}',
        '{"l\\u0069nes":[{"sku":"\\u00e9\\n"}]}',
    ]
    assert rows(spark, texts) == [
        ("r0", "lines", "0", "A"), ("r0", "lines", "2", "B"), ("r0", "lines.parts", "2.0", "p"), ("r1", "lines", "0", "C"), ("r1", "lines.parts", "0.0", "p"),
        ("r15", "lines", "0", "é\n"), ("r2", "lines", "0", "D"), ("r3", "lines", "0", "E"), ("r4", "lines", "0", "F"), ("r5", "lines", "1", ""), ("r5", "lines", "2", "7"),
    ]


def test_long_and_empty(spark):
    many = json.dumps({"lines": [{"sku": f"S{i}", "note": "y" * 50} for i in range(20000)]})
    got = rows(spark, [many])
    assert len(got) == 20000 and ("r0", "lines", "19999", "S19999") in got
    empty = spark.createDataFrame([], "id string, body string")
    assert flatten(empty, F.col("id"), F.col("body"), LINES).collect() == []


def test_amounts(spark):
    shape = Shape((Child("claimed", "amount", spell=two_decimals),))
    texts = ['{"claimed":{"amount":5}}', '{"claimed":{"money":{"amount":"7.125"}}}', '{"claimed":[{"amount":1e2},{"amount":null},{"amount":"n/a"}]}']
    assert rows(spark, texts, shape) == [("r0", "claimed", "0", "5.00"), ("r1", "claimed", "0", "7.13"), ("r2", "claimed", "0", "100.00")]


def test_texts_are_indexed_in_slices_of_bytes():
    offsets = np.array([0, 3, 3, 9, 30, 31, 33])
    assert list(byte_slices(offsets, 10)) == [(0, 3), (3, 4), (4, 6)]
    assert list(byte_slices(offsets, 1)) == [(i, i + 1) for i in range(6)]
    assert list(byte_slices(np.array([0]))) == []


def test_strings_in_strings_however_deep():
    text = '{"lines":[{"sku":"A"}]}'
    inner = json.dumps([{"sku": "A"}])
    for _ in range(18):
        inner = json.dumps(inner)
    assert len(inner) > 2**17
    for t in (text, f'  \t{text}', json.dumps(text), "\n " + json.dumps(json.dumps(text)), '{"lines":' + inner + "}"):
        raw = t.encode()
        got = flat_rows(["r"], np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), Shape((Child("lines", "sku"),)))
        assert got.column(4).to_pylist() == ["A"], t[:40]
