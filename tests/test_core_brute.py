"""The nested-record and schema queries against plain programs that read the same files row by row."""

import json
from collections import Counter
from decimal import Decimal, InvalidOperation

import pyarrow.parquet as pq
import pytest

from quaymark.plans import core_problems
from tests.oracle import connection

PAD = " \t\r\n\f\xa0"


def rows(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def opened(v):
    if isinstance(v, str):
        t = v.strip()
        if t[:1] in ("{", "[", '"'):
            try:
                inner = json.loads(t, parse_float=Decimal)
            except ValueError:
                return v
            return opened(inner) if isinstance(inner, (dict, list, str)) else v
        return v
    if isinstance(v, list):
        return [opened(x) for x in v]
    if isinstance(v, dict):
        return {k: opened(x) for k, x in v.items()}
    return v


def record(text):
    try:
        v = opened(json.loads(text, parse_float=Decimal))
    except (ValueError, TypeError):
        return None
    return v if isinstance(v, dict) else None


def member(obj, name, stop=()):
    """The member of that name, or that of the first wrapper that has one."""
    if name in obj:
        return obj[name]
    for k, v in obj.items():
        if isinstance(v, dict) and k not in stop:
            found = member(v, name, stop)
            if found is not None:
                return found
    return None


def elements(v, is_item):
    if isinstance(v, list):
        return list(enumerate(v))
    if isinstance(v, dict):
        if is_item(v):
            return [(0, v)]
        inner = [x for x in v.values() if isinstance(x, list)] or [x for x in v.values() if isinstance(x, dict)]
        return [e for x in inner for e in elements(x, is_item)]
    return []


def text_of(v):
    if v is None or isinstance(v, (dict, list)):
        return None
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v)


def walk(top, table, below, item, spell=lambda t: t):
    """(path, idx, item) of a table and of the one below it."""
    has = lambda o: (item is not None and text_of(member(o, item, (below[0],) if below else ())) is not None) or (below is not None and below[0] in o)
    for i, o in elements(member(top, table), has):
        if not isinstance(o, dict):
            continue
        if item is not None:
            t = text_of(member(o, item, (below[0],) if below else ()))
            t = spell(t) if t is not None else None
            if t is not None:
                yield table, str(i), t
        if below:
            name, key = below
            for j, p in elements(member(o, name), lambda x: text_of(member(x, key)) is not None):
                t = text_of(member(p, key)) if isinstance(p, dict) else None
                if t is not None:
                    yield f"{table}.{name}", f"{i}.{j}", t


def two_places(t):
    try:
        return str(Decimal(t.strip()).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP"))
    except InvalidOperation:
        return None


def flat(sf_dir):
    first = {}
    for r in rows(sf_dir, "event_envelope"):
        if r["event_type"] == "OrderCreateEvent" or (r["sm_type"] == "claim" and r["event_type"] == "file"):
            k = (r["event_id"] or "").strip(PAD).lower()
            rank = (r["ingest_ts_millis"] == 0, r["ingest_ts_millis"], r["delivery_id"])
            if k and (k not in first or rank < first[k][0]):
                first[k] = (rank, r)
    out = Counter()
    for k, (_, r) in first.items():
        top = record(r["payload"])
        if top is not None:
            found = walk(top, "lines", ("components", "sku"), "sku") if r["event_type"] == "OrderCreateEvent" else walk(top, "claimed", None, "amount", two_places)
            out.update((k, *x) for x in found)
    last = {}
    for r in rows(sf_dir, "entity_snapshot"):
        if r["sm_type"] == "gen_trading_order" and (r["state"] is not None or r["model_json"] is not None):
            k = (r["entity_id"] or "").strip(PAD)
            rank = (r["version"] or 0, r["published_at"], r["topic_partition"], r["topic_offset"])
            if k and (k not in last or rank > last[k][0]):
                last[k] = (rank, r)
    for k, (_, r) in last.items():
        top = record(r["model_json"])
        if top is not None:
            out.update((k, *x) for x in walk(top, "executions", ("fills", "fillId"), None))
    return out


def test_p6_found(spark, tiny):
    got = Counter(tuple(r) for r in core_problems.p6_found(spark, tiny).select("record_id", "child_path", "idx", "item").collect())
    want = flat(tiny)
    assert len({p for _, p, _, _ in want}) == 4 and got == want


def at(v, path):
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def latest_specs(sf_dir, table):
    out = {}
    for r in sorted(rows(sf_dir, "table_spec"), key=lambda r: r["published_at"]):
        if r["table_name"].strip() == table:
            out[r["release_no"]] = r
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("table", ["orders", "order_lines", "claims", "gen_trading_orders", "policies", "loans"])
def test_p3_tables(spark, tiny, table):
    """Each column's values, by the name it bears last, read with each release's own path."""
    renamed = {(r, new): old for t, r, c, old, new in connection(tiny).sql(core_problems.P3_SQL).fetchall() if t == table and c == "renamed"}
    specs = latest_specs(tiny, table)
    of: dict[str, list] = {}  # the line of a column: (hash, path) where it is
    now: dict[str, str] = {}
    for s in specs:
        nxt = {}
        for c in s["columns"]:
            old = renamed.get((s["release_no"], c["name"]), c["name"])
            line = now.get(old, f"{c['name']}@{s['release_no']}")
            nxt[c["name"]] = line
            if (c["source"] or "").upper() == "MODEL":
                of.setdefault(line, []).append((s["schema_hash"], tuple(c["path"])))
        now = nxt
    got = core_problems.queries()[f"p3_{table}"](spark, tiny)
    kinds, data = dict(got.dtypes), got.collect()
    hashes, lines = {s["schema_hash"] for s in specs}, specs[-1]["source_path"] or []
    content = []
    for r in rows(tiny, "entity_snapshot"):
        if r["schema_hash"] not in hashes:
            continue
        try:
            m = json.loads(r["model_json"], parse_float=Decimal) if r["model_json"] is not None else None
        except ValueError:
            m = None
        if not lines:
            content.append((r, m))
            continue
        v = at(m, lines)
        content += [(r, x) for x in (v if isinstance(v, list) else [] if v is None else [v]) if x is not None]
    assert len(data) == len(content)
    checked = 0
    for name, line in now.items():
        if line not in of:
            continue
        where = {}
        for h, p in of[line]:
            where.setdefault(h, p)

        def plain(v):
            if v is None or isinstance(v, (dict, list)):
                return v if v is None else "…"
            if kinds[name] in ("bigint", "double") or kinds[name].startswith("decimal"):  # noqa: B023
                try:
                    return round(float(str(v)), 4)
                except ValueError:
                    return None
            if kinds[name] in ("date", "timestamp"):  # noqa: B023
                return str(v)[:10]
            if isinstance(v, bool):
                return str(v).lower()
            try:
                return str(Decimal(str(v)).normalize()) if kinds[name] == "string" and not isinstance(v, str) else str(v).lower() if kinds[name] == "boolean" else str(v)  # noqa: B023
            except InvalidOperation:
                return str(v)

        want = Counter(plain(at(x, where[r["schema_hash"]])) if r["schema_hash"] in where else None for r, x in content)
        have = Counter()
        for row in data:
            v = row[name]
            if kinds[name] == "string" and v is not None:
                try:
                    v = str(Decimal(v).normalize()) if v[:1] not in "{[" else "…"
                except InvalidOperation:
                    pass
            have[plain(v)] += 1
        want = _numbers(want)
        if kinds[name] == "bigint":
            want, have = (Counter({k: n for k, n in c.items() if k is not None}) for c in (want, have))
        assert have == want, name
        checked += 1
    assert checked >= 3


def _number(t):
    try:
        Decimal(t)
        return True
    except InvalidOperation:
        return False


def _numbers(c):
    out = Counter()
    for k, n in c.items():
        out[str(Decimal(k).normalize()) if isinstance(k, str) and _number(k) else k] += n
    return out
