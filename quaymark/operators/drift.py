"""Schemas that drift between releases: the changes, and one consistent table.

The schemas of a table are trees (a column's path leads to its leaf). Between two releases the
tree edit distance gives the cheapest script of deletions, additions and renamings, after which
a deleted and an added leaf that carry the same values become a move. What two columns share is
counted in the data: the entities that have readable models under both schemas, per pair of
columns. The scripts of all releases compile into one projection per schema.

The schemas are metadata: their number is checked and they are handled on the driver. The
models aren't: each row becomes the hashes of the columns in question, rows of one entity meet
once, and only counts per pair of columns come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.json_text import canonical
from quaymark.operators.structural import ARRAY, OBJECT, PRIMITIVE, Index

#: Schema rows that the driver takes at most.
MAX_SPECS = 100_000
_RENAME_BY_VALUES, _MOVE, _EDIT = 0.5, 0.75, 1.0


@dataclass(frozen=True)
class ColumnOf:
    name: str
    type: str
    path: tuple[str, ...]
    in_model: bool


@dataclass(frozen=True)
class Schema:
    """One table in one release."""

    table: str
    release: int
    hash: str
    list_path: tuple[str, ...]
    columns: tuple[ColumnOf, ...]

    def by_name(self) -> dict[str, ColumnOf]:
        return {c.name: c for c in self.columns}


@dataclass(frozen=True)
class Change:
    table: str
    release: int
    change: str
    column: str
    new_name: str


def schemas(spec: DataFrame) -> dict[str, list[Schema]]:
    """The releases of each table, in order. Of repeated rows the last published counts."""
    d = spec.select(F.btrim("table_name").alias("t"), "release_no", "schema_hash", "source_path", "columns", "published_at", "kind").dropDuplicates(["t", "release_no", "schema_hash", "published_at", "columns"])
    rows = d.limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} schema rows")
    out: dict[str, dict[int, Schema]] = {}
    for r in sorted(rows, key=lambda r: (str(r.published_at), r.schema_hash or "", str(r["columns"]))):
        if r.t is None or r.release_no is None:
            continue
        cols = tuple(ColumnOf(c["name"], (c["type"] or "").upper(), tuple(c["path"] or ()), (c["source"] or "").upper() == "MODEL") for c in r["columns"] or () if c is not None and c["name"] is not None)
        out.setdefault(r.t, {})[r.release_no] = Schema(r.t, r.release_no, r.schema_hash, tuple(r.source_path or ()), cols)
    return {t: [rel[k] for k in sorted(rel)] for t, rel in sorted(out.items())}


# -- what two columns share in the data --


def _digest(ix: Index, node: int) -> int:
    k = ix.kind[node]
    if k in (OBJECT, ARRAY):
        raise AssertionError
    return xxhash.xxh3_64_intdigest(_number_text(ix.text(node), k == PRIMITIVE)) >> 1


def _number_text(text: str | None, primitive: bool) -> str:
    return (canonical(text) if primitive else text) or ""


def _values(texts: list[str], schema_of: list[int], plans: list[list[tuple[tuple[str, ...], tuple[str, ...]]]]) -> tuple[np.ndarray, list[list[int | None]]]:
    """For each text whether it is a JSON object, and the hash of the value of each of its schema's columns in question (None: absent)."""
    names = sorted({p for plan in plans for lp, path in plan for p in (*lp, *path)})
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ix = Index(np.frombuffer(b"".join(raw), np.uint8), offsets, names)
    code = {n: i + 1 for i, n in enumerate(names)}
    child = {n: ix.child(code[n]) for n in names}
    tops = np.full(len(texts), -1, np.int64)
    at = np.flatnonzero((ix.parent == -1) & (ix.kind == OBJECT))
    tops[ix.doc[at]] = at
    which = np.asarray(schema_of)
    out: list[list[int | None]] = [[] for _ in texts]
    ends = _span_ends(ix)

    def follow(nodes: np.ndarray, path: tuple[str, ...]) -> np.ndarray:
        for p in path:
            nodes = np.where(nodes >= 0, child[p][nodes], -1)
        return nodes

    def digest(node: int) -> int | None:
        if node < 0:
            return None
        if ix.kind[node] in (OBJECT, ARRAY):
            return xxhash.xxh3_64_intdigest(canonical(ix.buf[ix.start[node] : ends(node)].tobytes().decode("utf-8", "replace")) or "") >> 1
        if ix.text(node) is None:
            return None
        return _digest(ix, node)

    for s, plan in enumerate(plans):
        rows = np.flatnonzero((which == s) & (tops >= 0))
        if not len(rows):
            continue
        for lp, path in plan:
            start = follow(tops[rows], lp)
            if not lp:
                for r, n in zip(rows.tolist(), follow(start, path).tolist()):
                    out[r].append(digest(n))
                continue
            has = np.flatnonzero(start >= 0)
            who, value, place = ix.elements(start[has], np.ones(len(ix.doc), bool))
            leaf = follow(np.where(ix.kind[value] == OBJECT, value, -1), path)
            got: dict[int, list[tuple[int, int | None]]] = {}
            for w, p, n in zip(has[who].tolist(), place.tolist(), leaf.tolist()):
                got.setdefault(w, []).append((p, digest(n)))
            for i, r in enumerate(rows.tolist()):
                vs = [v for _, v in sorted(got.get(i, []), key=lambda x: x[0])]
                out[r].append(None if all(v is None for v in vs) else xxhash.xxh3_64_intdigest(repr(vs)) >> 1)
    return tops >= 0, out


def _span_ends(ix: Index):  # noqa: ANN202
    """The end of a container's span: after its matching bracket."""
    import json

    decoder = json.JSONDecoder()

    def end(node: int) -> int:
        a = int(ix.start[node])
        b = int(ix.offsets[ix.doc[node] + 1])
        text = ix.buf[a:b].tobytes().decode("utf-8", "replace")
        _, n = decoder.raw_decode(text)
        return a + len(text[:n].encode())

    return end


def shared_values(models: DataFrame, tables: dict[str, list[Schema]], *, entity: Column, schema_hash: Column, version: Column, text: Column) -> dict[tuple[str, int, str, str], tuple[int, int]]:
    """For each (table, release, column gone, column come) how many entities have equal values, and how many differing ones.

    Counted are entities whose models are readable under both schemas and where either value is
    present; of several models under one schema that of the highest version counts (null as 0).
    """
    pairs: list[tuple[str, int, str, str]] = []
    used: dict[str, dict[tuple[tuple[str, ...], tuple[str, ...]], int]] = {}
    todo: list[tuple[str, str, int, int, int]] = []
    for rel in tables.values():
        for old, new in zip(rel, rel[1:]):
            a, b = old.by_name(), new.by_name()
            gone = [c for n, c in a.items() if n not in b and c.in_model]
            come = [c for n, c in b.items() if n not in a and c.in_model]
            for g in gone:
                for k in come:
                    i = used.setdefault(old.hash, {}).setdefault((old.list_path, g.path), len(used[old.hash]))
                    j = used.setdefault(new.hash, {}).setdefault((new.list_path, k.path), len(used[new.hash]))
                    todo.append((old.hash, new.hash, i, j, len(pairs)))
                    pairs.append((new.table, new.release, g.name, k.name))
    if not pairs:
        return {}
    hashes = sorted(used)
    place = {h: i for i, h in enumerate(hashes)}
    plans = [list(used[h]) for h in hashes]
    # The pairs of columns by pair of schemas, as places in the schemas' values.
    by_schemas: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for a, b, i, j, k in todo:
        by_schemas.setdefault((place[a], place[b]), []).append((i, j, k))
    pairs_of = {ab: np.asarray(ijk).T for ab, ijk in by_schemas.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = [place[x] for x in b.column(1).to_pylist()]
            good, vals = _values(b.column(3).to_pylist(), h, plans)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(np.asarray(h, np.int32)[keep]), b.column(2).take(pa.array(keep)), pa.array([vals[i] for i in keep.tolist()], pa.list_(pa.int64()))], ["entity", "s", "v", "vals"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eq, ne = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            met = b.column(0)
            row = np.repeat(np.arange(b.num_rows), met.value_lengths().to_numpy(zero_copy_only=False))
            each = met.flatten()
            which, vals = each.field(0).to_numpy(zero_copy_only=False), each.field(1)
            of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for s in np.unique(which).tolist():
                at = np.flatnonzero(which == s)
                flat = vals.take(pa.array(at)).flatten().fill_null(-1)  # hashes are not negative
                of[s] = row[at], flat.to_numpy(zero_copy_only=False).reshape(len(at), -1)
            for (a, c), (i, j, k) in pairs_of.items():
                if a not in of or c not in of:
                    continue
                _, x, y = np.intersect1d(of[a][0], of[c][0], assume_unique=True, return_indices=True)
                u, v = of[a][1][x][:, i], of[c][1][y][:, j]
                some = (u >= 0) | (v >= 0)
                eq[k] += (some & (u == v)).sum(0)
                ne[k] += (some & (u != v)).sum(0)
        hit = np.flatnonzero(eq + ne)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(eq[hit]), pa.array(ne[hit])], ["k", "eq", "ne"])

    rows = models.select(entity.alias("entity"), schema_hash.alias("h"), F.coalesce(version, F.lit(0)).cast("bigint").alias("v"), text.alias("t")).where(F.col("entity").isNotNull() & F.col("t").isNotNull() & F.col("h").isin(hashes))
    rows = rows.mapInArrow(hashed, "entity string, s int, v bigint, vals array<bigint>")
    one = rows.groupBy("entity", "s").agg(F.max_by("vals", F.struct("v", F.xxhash64("vals"))).alias("vals"))
    # At most one row per schema: the list is bounded by the number of schemas.
    met = one.groupBy("entity").agg(F.collect_list(F.struct("s", "vals")).alias("m")).where("size(m) > 1").select("m")
    counts = met.mapInArrow(counted, "k int, eq bigint, ne bigint").groupBy("k").agg(F.sum("eq").alias("eq"), F.sum("ne").alias("ne"))
    return {pairs[r.k]: (r.eq, r.ne) for r in counts.collect()}


# -- tree edit distance --


class _Tree:
    """A schema as an ordered tree in postorder; children are sorted by name, so column order doesn't matter."""

    def __init__(self, schema: Schema) -> None:
        root: dict = {}
        for c in schema.columns:
            at = root
            for p in c.path[:-1] if c.in_model else ():
                at = at.setdefault(("node", p), {})
            at[("leaf", c.name)] = c
        self.label: list[tuple[str, str]] = []
        self.column: list[ColumnOf | None] = []
        self.left: list[int] = []
        self._walk(root, ("node", ""))
        firsts = {}
        for i, lf in enumerate(self.left):
            firsts[lf] = i
        self.keyroots = sorted(firsts.values())

    def _walk(self, node: object, label: tuple[str, str]) -> int:
        first = None
        if isinstance(node, dict):
            for k in sorted(node):
                f = self._walk(node[k], k)
                first = f if first is None else first
        i = len(self.label)
        self.label.append(label)
        self.column.append(node if isinstance(node, ColumnOf) else None)
        self.left.append(i if first is None else first)
        return self.left[i]


def edit_script(old: Schema, new: Schema, same_values: set[tuple[str, str]]) -> list[tuple[str, ColumnOf | None, ColumnOf | None]]:
    """The cheapest script between two schemas: (keep|rename|move|delete|add, old column, new column).

    A column stays itself under the same name, for nothing. Two names may only be matched if they
    carry the same values. What the ordered tree can't match although the values are the same
    (columns that change place) becomes a move.
    """
    a, b = _Tree(old), _Tree(new)

    def swap(i: int, j: int) -> float:
        x, y = a.column[i], b.column[j]
        if (x is None) != (y is None):
            return 3.0
        if x is None:
            return 0.0 if a.label[i] == b.label[j] else _EDIT
        if x.name == y.name:
            return 0.0
        return _RENAME_BY_VALUES if (x.name, y.name) in same_values else 3.0

    n, m = len(a.label), len(b.label)
    dist = np.zeros((n, m))
    trace: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in a.keyroots:
        for j in b.keyroots:
            li, lj = a.left[i], b.left[j]
            fd = np.zeros((i - li + 2, j - lj + 2))
            fd[1:, 0] = np.arange(1, i - li + 2)
            fd[0, 1:] = np.arange(1, j - lj + 2)
            how = {}
            for x in range(li, i + 1):
                for y in range(lj, j + 1):
                    p, q = x - li + 1, y - lj + 1
                    up, side = fd[p - 1, q] + _EDIT, fd[p, q - 1] + _EDIT
                    if a.left[x] == li and b.left[y] == lj:
                        diag, step = fd[p - 1, q - 1] + swap(x, y), "pair"
                    else:
                        diag, step = fd[a.left[x] - li, b.left[y] - lj] + dist[x, y], "tree"
                    best = min(diag, up, side)
                    fd[p, q] = best
                    how[p, q] = step if best == diag else ("del" if best == up else "add")
                    if a.left[x] == li and b.left[y] == lj:
                        dist[x, y] = best
                        trace[x, y] = None  # filled below
            for x in range(li, i + 1):
                for y in range(lj, j + 1):
                    if a.left[x] == li and b.left[y] == lj:
                        trace[x, y] = (how, li, lj)
    matched: list[tuple[int, int]] = []
    stack = [(n - 1, m - 1)]
    while stack:
        x, y = stack.pop()
        how, li, lj = trace[x, y]
        p, q = x - li + 1, y - lj + 1
        while p > 0 and q > 0:
            step = how[p, q]
            if step == "pair":
                matched.append((p + li - 1, q + lj - 1))
                p, q = p - 1, q - 1
            elif step == "tree":
                xx, yy = p + li - 1, q + lj - 1
                stack.append((xx, yy))
                p, q = a.left[xx] - li, b.left[yy] - lj
            elif step == "del":
                p -= 1
            else:
                q -= 1
    used_a, used_b = set(), set()
    script = []
    for x, y in matched:
        u, v = a.column[x], b.column[y]
        if u is not None and v is not None and (u.name == v.name or (u.name, v.name) in same_values):
            used_a.add(u.name)
            used_b.add(v.name)
            script.append(("keep" if u.name == v.name else "rename", u, v))
    left, right = [c for c in old.columns if c.name not in used_a], [c for c in new.columns if c.name not in used_b]
    for u in left:  # the rest of the same name, then of the same values
        for v in right:
            if v.name not in used_b and v.name == u.name:
                script.append(("move", u, v))
                used_a.add(u.name)
                used_b.add(v.name)
    for u in left:
        near = sorted((v for v in right if v.name not in used_b and (u.name, v.name) in same_values), key=lambda v: (v.type != u.type, v.path[-1:] != u.path[-1:], v.name))
        if u.name not in used_a and near:
            script.append(("move", u, near[0]))
            used_a.add(u.name)
            used_b.add(near[0].name)
    script += [("delete", u, None) for u in left if u.name not in used_a]
    script += [("add", None, v) for v in right if v.name not in used_b]
    return script


def scripts(tables: dict[str, list[Schema]], shared: dict[tuple[str, int, str, str], tuple[int, int]]) -> dict[tuple[str, int], list]:
    out = {}
    for t, rel in tables.items():
        for old, new in zip(rel, rel[1:]):
            same = {(g, k) for (tt, r, g, k), (eq, ne) in shared.items() if tt == t and r == new.release and eq and not ne}
            out[t, new.release] = edit_script(old, new, same)
    return out


def changes(found: dict[tuple[str, int], list]) -> list[Change]:
    """What each script changes by column name: added, removed, renamed, retyped."""
    out = []
    for (t, r), script in found.items():
        for op, u, v in script:
            if op == "add":
                out.append(Change(t, r, "added", v.name, ""))
            elif op == "delete":
                out.append(Change(t, r, "removed", u.name, ""))
            elif u.name != v.name:
                out.append(Change(t, r, "renamed", u.name, v.name))
            elif u.type != v.type:
                out.append(Change(t, r, "retyped", u.name, ""))
    return out


def changes_frame(spark: SparkSession, cs: list[Change]) -> DataFrame:
    return spark.createDataFrame([(c.table, c.release, c.change, c.column, c.new_name) for c in cs], "table_name string, release_no bigint, change string, column_name string, new_name string")


# -- one consistent table --

_SPARK_TYPE = {"STRING": "string", "ENUM": "string", "JSON": "string", "BIGINT": "bigint", "DOUBLE": "double", "DECIMAL": "decimal(38,4)", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMPTZ": "timestamp"}


def unified_columns(rel: list[Schema], found: dict[tuple[str, int], list]) -> tuple[dict[str, str], dict[str, dict[str, ColumnOf]]]:
    """The columns of the consistent table (name: type), and for each schema hash where each is read from.

    A column bears its latest name; a name that was used twice for different columns gets the
    release it went with. Columns whose type changed are strings.
    """
    line: dict[str, int] = {}
    names: dict[int, str] = {}
    kinds: dict[int, set[str]] = {}
    read: dict[str, dict[int, ColumnOf]] = {}
    last: dict[int, int] = {}
    fresh = iter(range(10**9))
    for k, s in enumerate(rel):
        nxt: dict[str, int] = {}
        if k:
            for op, u, v in found[s.table, s.release]:
                if op in ("keep", "rename", "move"):
                    nxt[v.name] = line[u.name]
        for c in s.columns:
            i = nxt.setdefault(c.name, next(fresh))
            names[i] = c.name
            last[i] = s.release
            kinds.setdefault(i, set()).add(c.type)
            read.setdefault(s.hash, {})[i] = c
        line = nxt
    taken: dict[str, int] = {}
    final = {}
    for i in sorted(names, key=lambda i: (-last[i], i)):
        n = names[i]
        final[i] = n if n not in taken else f"{n}_until_{last[i]}"
        taken[n] = i
    types = {final[i]: _SPARK_TYPE.get(next(iter(kinds[i])), "string") if len(kinds[i]) == 1 else "string" for i in sorted(names)}
    return types, {h: {final[i]: c for i, c in m.items()} for h, m in read.items()}


def unified(models: DataFrame, rel: list[Schema], found: dict[tuple[str, int], list], system: dict[str, Column], *, schema_hash: Column, text: Column) -> DataFrame:
    """All rows of one table under one schema: each row through the projection compiled for its schema.

    Child tables give a row per element of their list (`idx`). system: columns that don't come
    from the model. A value that doesn't fit its type, and every value of a model that isn't a
    JSON object, is null; rows of unknown schemas aren't of this table.
    """
    types, read = unified_columns(rel, found)
    hashes = sorted(h for h in read if h is not None)
    d = models.where(schema_hash.isin(hashes)).select(schema_hash.alias("__h"), F.try_parse_json(text).alias("__v"), F.struct(*[c.alias(n) for n, c in system.items()]).alias("__s"))
    lp = rel[-1].list_path
    if lp:
        at = "$" + "".join(f".{p}" for p in lp)
        listed = F.coalesce(F.try_variant_get("__v", at, "array<variant>"), F.array(F.try_variant_get("__v", at, "variant")))
        d = d.select("__h", "__s", F.posexplode(listed).alias("__i", "__v")).where("__v is not null")

    def place(c: ColumnOf) -> str:
        return "$" + "".join(f"['{p}']" for p in c.path)

    cols = []
    for n, kind in types.items():
        of = {h: m[n] for h, m in read.items() if n in m and h is not None}
        if not any(c.in_model for c in of.values()):
            src = system.get(n) is not None and F.col("__s")[n]
            cols.append((src if src is not False else (F.col("__i").cast("bigint") if n == "idx" and lp else F.lit(None).cast(kind))).alias(n))
            continue
        paths: dict[str, list[str]] = {}
        for h, c in of.items():
            paths.setdefault(place(c), []).append(h)
        e = None
        for p, hs in paths.items():
            v = F.try_variant_get("__v", p, "string")
            e = F.when(F.col("__h").isin(hs), v) if e is None else e.when(F.col("__h").isin(hs), v)
        cols.append((e if kind == "string" else e.try_cast(kind)).alias(n))
    return d.select(*cols)

