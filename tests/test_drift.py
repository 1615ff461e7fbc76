import json

from pyspark.sql import functions as F

from quaymark.operators import drift

COLS = "array<struct<name string, type string, source string, path array<string>>>"


def spec(spark, releases):
    rows = []
    for no, h, cols in releases:
        rows.append((no, "f", h, "things", "ROOT", [], [("entity_id", "STRING", "ENTITY_ID", [])] + [(n, t, "MODEL", p.split(".")) for n, t, p in cols], no))
    return spark.createDataFrame(rows, f"release_no bigint, spec_file string, schema_hash string, table_name string, kind string, source_path array<string>, columns {COLS}, published_at int")


def found(spark, releases, models):
    tables = drift.schemas(spec(spark, releases))
    m = spark.createDataFrame(models, "entity_id string, schema_hash string, version bigint, model_json string")
    shared = drift.shared_values(m, tables, entity=F.col("entity_id"), schema_hash=F.col("schema_hash"), version=F.col("version"), text=F.col("model_json"))
    return tables, drift.scripts(tables, shared), m


A = [("a", "STRING", "a"), ("b", "BIGINT", "b"), ("c", "STRING", "c")]
B = [("a", "string", "a"), ("x", "BIGINT", "x"), ("c", "DOUBLE", "c")]
C = [("c", "DOUBLE", "c"), ("in_x", "BIGINT", "in.x"), ("a", "STRING", "a"), ("new", "STRING", "new")]


def test_changes_and_unified(spark):
    models = [
        ("e1", "A", 1, '{"a":"p","b":1,"c":"3"}'), ("e1", "B", 2, '{"a":"p","x":1.0,"c":3}'), ("e2", "A", 1, '{"a":"q","b":2}'), ("e2", "B", 2, '{"x":2}'),
        ("e2", "A", 0, '{"b":99}'), ("e3", "A", 1, "broken"), ("e3", "B", 1, '{"x":5}'), (None, "A", 1, '{"b":7}'), (None, "B", 1, '{"x":8}'),
        ("e1", "C", 3, '{"in":{"x":1},"c":3}'), ("e4", "A", None, "[1]"), ("e5", "Z", 1, "{}"),
    ]
    tables, scripts, m = found(spark, [(0, "A", A), (0, "A", A), (1, "B", B), (3, "C", C)], models)
    got = sorted((c.release, c.change, c.column, c.new_name) for c in drift.changes(scripts))
    assert got == [(1, "renamed", "b", "x"), (1, "retyped", "c", ""), (3, "added", "new", ""), (3, "renamed", "x", "in_x")]
    u = drift.unified(m, tables["things"], scripts, {"entity_id": F.col("entity_id")}, schema_hash=F.col("schema_hash"), text=F.col("model_json"))
    assert set(u.columns) == {"entity_id", "a", "in_x", "c", "new"} and dict(u.dtypes)["in_x"] == "bigint" and dict(u.dtypes)["c"] == "string"
    assert sorted(r.in_x for r in u.where("entity_id = 'e1'").collect()) == [1, 1, 1]
    assert u.count() == len(models) - 1


def test_differing_values_are_no_renaming(spark):
    models = [("e1", "A", 1, '{"b":1}'), ("e1", "B", 2, '{"x":1}'), ("e2", "A", 1, '{"b":2}'), ("e2", "B", 2, '{"x":3}')]
    _, scripts, _ = found(spark, [(0, "A", A), (1, "B", B)], models)
    got = {(c.change, c.column) for c in drift.changes(scripts)}
    assert got == {("removed", "b"), ("added", "x"), ("retyped", "c")}


def test_no_evidence_and_empty(spark):
    _, scripts, _ = found(spark, [(0, "A", A), (1, "B", B)], [])
    assert {(c.change, c.column) for c in drift.changes(scripts)} == {("removed", "b"), ("added", "x"), ("retyped", "c")}
    assert found(spark, [], [])[1] == {}


def test_crossed_renamings_become_moves(spark):
    old = [("a1", "STRING", "a1"), ("z1", "STRING", "z1")]
    new = [("b2", "STRING", "b2"), ("y2", "STRING", "y2")]
    models = [("e", "A", 1, json.dumps({"a1": "u", "z1": "v"})), ("e", "B", 2, json.dumps({"b2": "v", "y2": "u"}))]
    _, scripts, _ = found(spark, [(0, "A", old), (1, "B", new)], models)
    assert {(c.change, c.column, c.new_name) for c in drift.changes(scripts)} == {("renamed", "a1", "y2"), ("renamed", "z1", "b2")}
