"""Tables of a schema in a catalog: created, extended, never narrowed."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quaymark.models.mapping import SPARK, SchemaSpec, TableSpec


def schema_hash(spec: SchemaSpec) -> str:
    """16 hexadecimal characters that change with any table, column or type."""
    plain = [[t.name, t.sm_type, t.parent, [[c.name, c.type, list(c.path)] for c in t.columns]] for t in spec.tables]
    return hashlib.sha256(json.dumps(plain).encode()).hexdigest()[:16]


def create_table(t: TableSpec, using: str = "parquet") -> str:
    cols = ", ".join(f"`{c.name}` {SPARK[c.type]}" for c in t.columns)
    return f"CREATE TABLE IF NOT EXISTS `{t.name}` ({cols}) USING {using}"


def child_view(root: TableSpec, child: TableSpec) -> str:
    """The rows of a child table with the state of their root, joined on entity and version."""
    own = ", ".join(f"c.`{c.name}`" for c in child.columns)
    body = f"SELECT {own}, r.`sm_state` FROM `{child.name}` c JOIN `{root.name}` r ON c.entity_id = r.entity_id AND c.entity_version = r.entity_version"
    return f"CREATE OR REPLACE VIEW `{_view_name(root, child)}` TBLPROPERTIES ('{DEFINITION}' = '{_digest(body)}') AS {body}"


#: The property under which a view keeps the hash of its definition.
DEFINITION = "definition.hash"


def _view_name(root: TableSpec, child: TableSpec) -> str:
    return f"{child.name}_with_{root.name}"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _stands(spark: SparkSession, view: str, sql: str) -> bool:
    """Whether the view is there with that definition."""
    if not spark.catalog.tableExists(view):
        return False
    return any(r.key == DEFINITION and f"'{r.value}'" in sql for r in spark.sql(f"SHOW TBLPROPERTIES `{view}`").collect())


@dataclass(frozen=True)
class Step:
    table: str
    sql: str


class TypeChanged(ValueError):
    pass


def plan(spark: SparkSession, spec: SchemaSpec) -> list[Step]:
    """What is missing: tables, columns, then views whose definition is another. Running the steps and planning again leaves nothing. A column of another type is an error."""
    steps = []
    for t in spec.tables:
        if not spark.catalog.tableExists(t.name):
            steps.append(Step(t.name, create_table(t)))
            continue
        have = dict(spark.table(t.name).dtypes)
        for c in t.columns:
            if c.name in have and have[c.name] != SPARK[c.type]:
                raise TypeChanged(f"{t.name}.{c.name} is {have[c.name]}, not {SPARK[c.type]}")
        new = [f"`{c.name}` {SPARK[c.type]}" for c in t.columns if c.name not in have]
        if new:
            steps.append(Step(t.name, f"ALTER TABLE `{t.name}` ADD COLUMNS ({', '.join(new)})"))
    views = [(_view_name(t, c), Step(c.name, child_view(t, c))) for t in spec.tables if t.parent is None for c in spec.children(t)]
    steps += [step for name, step in views if not _stands(spark, name, step.sql)]
    return steps


def provision(spark: SparkSession, spec: SchemaSpec) -> list[Step]:
    steps = plan(spark, spec)
    for s in steps:
        spark.sql(s.sql)
    return steps


def listing(spark: SparkSession, spec: SchemaSpec) -> DataFrame:
    """(table, kind, position, column, type) of all tables of the catalog; kind is root, child or other."""
    kinds = {t.name: "child" if t.parent else "root" for t in spec.tables}
    rows = []
    for t in spark.catalog.listTables():
        for i, (n, k) in enumerate(spark.table(t.name).dtypes):
            rows.append((t.name, kinds.get(t.name, "other"), i, n, k))
    return spark.createDataFrame(rows, "table string, kind string, position int, column string, type string")
