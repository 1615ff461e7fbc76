"""From model classes to tables: names, columns, types; and from snapshots to rows of these tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.models.language import PRIMITIVES, ModelError, Resolved

#: Neutral types of the built-in ones, and Spark's of the neutral ones.
NEUTRAL = {"String": "STRING", "Date": "STRING", "Integer": "BIGINT", "Float": "DOUBLE", "Number": "DOUBLE", "Decimal": "DECIMAL", "Boolean": "BOOLEAN", "StrictDate": "DATE", "DateTime": "TIMESTAMPTZ"}
SPARK = {"STRING": "string", "ENUM": "string", "JSON": "string", "BIGINT": "bigint", "DOUBLE": "double", "DECIMAL": "decimal(38,4)", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMPTZ": "timestamp"}
#: Columns every root and every child table begins with, and those of event lifecycles.
ROOT_COLUMNS = (("entity_id", "STRING"), ("entity_version", "BIGINT"), ("sm_type", "STRING"), ("sm_state", "STRING"), ("created_at", "TIMESTAMPTZ"), ("completed_at", "TIMESTAMPTZ"), ("model_json", "JSON"))
CHILD_COLUMNS = (("entity_id", "STRING"), ("entity_version", "BIGINT"), ("idx", "BIGINT"))
EVENT_COLUMNS = (
    ("event_id", "STRING", "eventId"), ("event_type", "STRING", "eventType"), ("domain", "STRING", "domain"), ("status", "STRING", "status"), ("outcome", "STRING", "outcome"), ("error", "STRING", "error"), ("attempts", "BIGINT", "attempts"),
    ("retries", "BIGINT", "retries"), ("parent_event_id", "STRING", "parentEventId"), ("causation_root", "STRING", "causationRoot"), ("depth", "BIGINT", "depth"), ("processor_key", "STRING", "processorKey"), ("request_id", "STRING", "requestId"),
    ("scheduled_at_ms", "BIGINT", "scheduledAt"), ("lock_keys", "JSON", "keys"), ("children", "JSON", "children"),
)
#: Levels of value classes that become columns of their own; deeper ones are kept as JSON.
DEPTH = 3


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    path: tuple[str, ...] = ()
    group: str | None = None

    @property
    def in_model(self) -> bool:
        return bool(self.path)


@dataclass
class TableSpec:
    name: str
    sm_type: str
    cls: str
    columns: list[ColumnSpec]
    parent: str | None = None
    source_path: tuple[str, ...] = ()

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class SchemaSpec:
    tables: list[TableSpec] = field(default_factory=list)

    def root(self, sm_type: str) -> TableSpec | None:
        return next((t for t in self.tables if t.sm_type == sm_type and t.parent is None), None)

    def table(self, name: str) -> TableSpec | None:
        return next((t for t in self.tables if t.name == name), None)

    def children(self, root: TableSpec) -> list[TableSpec]:
        return [t for t in self.tables if t.parent == root.name]


def snake(name: str) -> str:
    """A capital that begins a word gets an underscore before it: mooringLine gives mooring_line, VHFChannel vhf_channel."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def event_type_name(name: str) -> str:
    """The lifecycle type of an event class: evt_ and its name in snake case; digits stand apart from the word after them."""
    return "evt_" + re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def plural(word: str) -> str:
    if re.search(r"[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(s|x|z|ch|sh)$", word) else "s")


def roots_of(text: str) -> dict[str, str]:
    """`type:package::Class, ...`"""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        kind, sep, cls = part.partition(":")
        if not sep or not kind.strip() or not cls or cls.startswith(":"):
            raise ModelError(f"no root: {part}")
        out[kind.strip()] = cls.strip()
    return out


def env_list(env: Mapping[str, str], name: str, default: str) -> str:
    """A variable (or the default), then those with a suffix, in order of the suffix; blank ones don't count."""
    parts = [env.get(name) or default] + [env[k] for k in sorted(env) if k.startswith(name + "_")]
    return ",".join(p.strip() for p in parts if p and p.strip())


def schema(resolved: Resolved, roots: Mapping[str, str]) -> SchemaSpec:
    """The tables of the root classes and of the lists they own."""
    model = resolved.model
    for cls in roots.values():
        if cls not in model.classes:
            raise ModelError(f"no class: {cls}")
    out = SchemaSpec()

    def columns(cls: str, start: tuple[tuple[str, ...], str], depth: int, chain: tuple[str, ...], group: str | None, lists_here: set[str]) -> list[ColumnSpec]:
        path, prefix = start
        cols: list[ColumnSpec] = []
        members = [(p.name, kind, p.multiplicity.many) for p, kind in resolved.properties(cls)]
        members += [(p.name, kind, p.multiplicity.many) for p, kind in resolved.owned(cls) if p.name not in lists_here]
        for name, kind, many in members:
            col, at = prefix + snake(name), (*path, name)
            if many:
                cols.append(ColumnSpec(col, "JSON", at, group))
            elif kind in PRIMITIVES:
                cols.append(ColumnSpec(col, NEUTRAL[kind], at, group))
            elif kind in model.enums:
                cols.append(ColumnSpec(col, "ENUM", at, group))
            elif depth + 1 >= DEPTH or kind in chain:
                cols.append(ColumnSpec(col, "JSON", at, group))
            else:
                cols += columns(kind, (at, col + "_"), depth + 1, (*chain, kind), group or name, set())
        return cols

    def distinct(fixed: list[ColumnSpec], more: list[ColumnSpec]) -> list[ColumnSpec]:
        taken = {c.name for c in fixed}
        for c in more:
            name = c.name if c.name not in taken else f"model_{c.name}"
            taken.add(name)
            fixed.append(ColumnSpec(name, c.type, c.path, c.group))
        return fixed

    for sm_type, cls in roots.items():
        event = sm_type.startswith("evt_")
        head = [ColumnSpec(n, t) for n, t in ROOT_COLUMNS]
        if event:
            head += [ColumnSpec(n, t, (p,)) for n, t, p in EVENT_COLUMNS]
        lists = [(p, kind) for p, kind in resolved.owned(cls) if p.multiplicity.many]
        elsewhere = {p.name for p, kind in lists if kind in roots.values()}
        mine = [(p, kind) for p, kind in lists if p.name not in elsewhere]
        base = ("payload",) if event else ()
        body = columns(cls, (base, ""), 0, (cls,), None, {p.name for p, _ in lists})
        root = TableSpec(plural(snake(sm_type)), sm_type, cls, distinct(head, body))
        out.tables.append(root)
        for p, kind in mine:
            cols = distinct([ColumnSpec(n, t) for n, t in CHILD_COLUMNS], columns(kind, ((), ""), 0, (kind,), None, set()))
            out.tables.append(TableSpec(f"{snake(sm_type)}_{snake(p.name)}", sm_type, kind, cols, root.name, (*base, p.name)))
    return out


# -- snapshots to rows --


def _at(path: tuple[str, ...]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def _value(c: ColumnSpec, v: str) -> Column:
    text = F.try_variant_get(v, _at(c.path), "string")
    if c.type == "BOOLEAN":
        return F.try_variant_get(v, _at(c.path), "boolean").alias(c.name)
    if c.type in ("STRING", "ENUM", "JSON"):
        return text.alias(c.name)
    return F.trim(text).try_cast(SPARK[c.type]).alias(c.name)


def decoded(snapshots: DataFrame, text: Column, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Snapshot messages as (good, bad): bad ones aren't JSON objects, lack entityId or smType, or have an unreadable time; null texts (deletions) are neither.

    Good rows: entity_id, entity_version (missing: 0), sm_type, sm_state, created_at, completed_at, model (variant), model_json. Bad rows: original, error.
    """
    d = snapshots.select(*keep, text.alias("original")).where("original is not null").withColumn("v", F.try_parse_json("original"))
    g = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
    error = (
        F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(g("entityId").isNull(), "no entityId").when(g("smType").isNull(), "no smType")
        .when(g("createdAt").isNotNull() & g("createdAt").try_cast("timestamp").isNull(), "unreadable createdAt").when(g("completedAt").isNotNull() & g("completedAt").try_cast("timestamp").isNull(), "unreadable completedAt")
    )
    d = d.withColumn("error", error)
    good = d.where("error is null").select(
        *keep, g("entityId").alias("entity_id"), F.coalesce(g("version", "bigint"), F.lit(0)).alias("entity_version"), g("smType").alias("sm_type"), g("state").alias("sm_state"),
        g("createdAt").try_cast("timestamp").alias("created_at"), g("completedAt").try_cast("timestamp").alias("completed_at"), F.try_variant_get("v", "$.model", "variant").alias("model"), F.try_variant_get("v", "$.model", "string").alias("model_json"),
    )
    return good, d.where("error is not null").select(*keep, "original", F.substring(F.regexp_replace("error", r"\s+", " "), 1, 2000).alias("error"))


def table_rows(good: DataFrame, spec: SchemaSpec, name: str) -> DataFrame:
    """The rows of one table from decoded snapshots of its type. Values that don't fit are null; entities whose list is empty or missing have no child rows."""
    t = spec.table(name)
    if t is None:
        raise KeyError(name)
    d = good.where(F.col("sm_type") == t.sm_type)
    if t.parent is None:
        return d.select(*[_value(c, "model") if c.in_model else F.col(c.name) for c in t.columns])
    items = F.try_variant_get("model", _at(t.source_path), "array<variant>")
    e = d.select("entity_id", "entity_version", F.posexplode(items).alias("idx", "element"))
    return e.select(*[_value(c, "element") if c.in_model else F.col(c.name).cast(SPARK[c.type]).alias(c.name) for c in t.columns])
