"""Queries of the general training-data operations (p1, p3, p4, p6, p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import message_id, micros, millis_floor, trimmed
from quaymark.operators import drift
from quaymark.operators.changes import apply_changes
from quaymark.operators.dedupe import absorb, keep_first, unseen
from quaymark.operators.flatten import Child, Shape, flatten, two_decimals
from quaymark.operators.reconcile import reconcile
from quaymark.sources.envelopes import arrival_order
from quaymark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, replica, feed = (table(spark, sf_dir, t) for t in ("sm_state", "sm_state_replica", "entity_snapshot"))
    fields = {c: F.col(c) for c in ("sm_type", "state", "data", "version", "last_event_id")} | {"updated_at": millis_floor("updated_at")}
    key, version = trimmed("workflow_id"), F.col("version")
    copies = reconcile(state, replica, key=key, version=version, fields=fields, json_fields=["data"], missing_right="missing_in_replica", missing_left="missing_in_state")
    content = feed.where("state is not null or model_json is not null")
    fed = F.coalesce("version", F.lit(0)).cast("bigint")
    versions = reconcile(state, content, key=key, version=version, fields={"snapshot_version": version}, right_key=trimmed("entity_id"), right_version=fed, right_fields={"snapshot_version": fed}, missing_right=None, missing_left=None)
    return copies.unionAll(versions).select(F.col("key").alias("workflow_id"), "finding")


def _drift(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    tables = drift.schemas(table(spark, sf_dir, "table_spec"))
    feed = table(spark, sf_dir, "entity_snapshot")
    shared = drift.shared_values(feed, tables, entity=trimmed("entity_id"), schema_hash=F.col("schema_hash"), version=F.col("version"), text=F.col("model_json"))
    return tables, drift.scripts(tables, shared)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes_frame(spark, drift.changes(_drift(spark, sf_dir)[1]))


def _unified(name: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables, found = _drift(spark, sf_dir)
        feed = table(spark, sf_dir, "entity_snapshot")
        system = {"entity_id": trimmed("entity_id"), "entity_version": F.coalesce("version", F.lit(0)).cast("bigint"), "sm_type": F.col("sm_type"), "sm_state": F.col("state"), "created_at": F.col("created_at"), "completed_at": F.col("completed_at"), "model_json": F.col("model_json")}
        return drift.unified(feed, tables[name], found, system, schema_hash=F.col("schema_hash"), text=F.col("model_json"))

    query.__doc__ = f"All content of {name}, whatever release wrote it, under one schema."
    return query


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = table(spark, sf_dir, "event_envelope").select("event_id", "ingest_ts_millis", "delivery_id")
    done = table(spark, sf_dir, "processed_event").select("event_id", micros("received_at").alias("us"))
    a = keep_first(env, message_id("event_id"), arrival_order(), copies="n", key_name="id").where("n > 1 and id is not null")
    b = keep_first(done, message_id("event_id"), [F.col("us")], copies="n", key_name="id").where("n > 1 and id is not null")
    return a.select(F.lit("event_envelope").alias("origin"), F.col("id").alias("event_id"), F.col("delivery_id").alias("kept")).unionAll(b.select(F.lit("processed_event"), "id", "us"))


def p4_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of event_envelope once, whole."""
    return keep_first(table(spark, sf_dir, "event_envelope"), message_id("event_id"), arrival_order(), copies="copies")


#: Shards that are taken in turn at most; more are an error.
MAX_SHARDS = 1000


def p4_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after the shards' deliveries came to it one shard after the other: of every message the copy that came first, from the first shard that had it."""
    env = table(spark, sf_dir, "event_envelope").select("event_id", "shard_id", "ingest_ts_millis", "delivery_id").where(message_id("event_id").isNotNull() & F.col("shard_id").isNotNull())
    shards = sorted(r[0] for r in env.select("shard_id").distinct().limit(MAX_SHARDS + 1).collect())
    if len(shards) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    held = absorb([env.where(F.col("shard_id") == s) for s in shards] or [env], message_id("event_id"), arrival_order())
    return held.select(message_id("event_id").alias("event_id"), "shard_id", "delivery_id")


def p4_undispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of event_envelope that processed_event doesn't hold as dispatched, one copy of each."""
    env = table(spark, sf_dir, "event_envelope").select("event_id", "sm_type", "event_type", "ingest_ts_millis", "delivery_id")
    done = table(spark, sf_dir, "processed_event").where("status = 'DISPATCHED'")
    left = unseen(env, message_id("event_id"), done, message_id("event_id"), arrival_order())
    return left.select(message_id("event_id").alias("event_id"), "sm_type", "event_type", "delivery_id")


def _current(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    state = table(spark, sf_dir, "sm_state").withColumn("entity_id", F.col("workflow_id"))
    feed = table(spark, sf_dir, "entity_snapshot")
    return apply_changes(
        state, feed, key=trimmed("entity_id"), base_key=trimmed("workflow_id"), version=F.col("version"), base_version=F.col("version"),
        deleted=F.col("state").isNull() & F.col("model_json").isNull(), columns=columns,
        tie=[micros("published_at"), F.col("topic_partition"), F.col("topic_offset")] if columns else (), key_name="entity_id",
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir, ())


def p7_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current entities with the state they are in."""
    return _current(spark, sf_dir, ("sm_type", "state"))


LINES = Shape((Child("lines", "sku", (Child("components", "sku"),)),))
CLAIMED = Shape((Child("claimed", "amount", spell=two_decimals),))
FILLS = Shape((Child("executions", None, (Child("fills", "fillId"),)),))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = table(spark, sf_dir, "event_envelope")
    orders = F.col("event_type") == "OrderCreateEvent"
    claims = (F.col("sm_type") == "claim") & (F.col("event_type") == "file")
    events = env.where(orders | claims).select("event_id", "sm_type", "event_type", "ingest_ts_millis", "delivery_id", "payload")
    once = keep_first(events, message_id("event_id"), arrival_order(), key_name="id").where("id is not null")
    feed = table(spark, sf_dir, "entity_snapshot").where("sm_type = 'gen_trading_order' and (state is not null or model_json is not null)")
    newest = keep_first(
        feed.select("entity_id", "version", "published_at", "topic_partition", "topic_offset", "model_json"), trimmed("entity_id"),
        [-F.coalesce(F.col("version"), F.lit(0)), -micros("published_at"), -F.col("topic_partition"), -F.col("topic_offset")], key_name="id",
    ).where("id is not null")
    parts = [(once.where(orders), LINES), (once.where(claims), CLAIMED)]
    rows = [flatten(d, F.col("id"), F.col("payload"), shape) for d, shape in parts] + [flatten(newest, F.col("id"), F.col("model_json"), FILLS)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("record_id", "child_path", "idx", "item")


def queries() -> dict:
    unified = {f"p3_{t}": _unified(t) for t in ("orders", "order_lines", "claims", "gen_trading_orders", "policies", "loans")}
    return {"p3_found": p3_found} | unified | {f.__name__: f for f in (p1_found, p4_found, p4_deliveries, p4_undispatched, p4_absorbed, p6_found, p7_found, p7_state)}


_PAD = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160)"

#: JSON as the sorted list of its values, each with its path: what two spellings of one value share.
_TREE = "(SELECT list_sort(list(struct_pack(k := fullkey, t := CASE WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE') THEN 'NUMBER' ELSE type END, x := CASE WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE') THEN CAST(CAST(atom AS double) AS varchar) ELSE atom ->> '$' END))) FROM json_tree({}))"

P1_SQL = f"""
WITH a AS (SELECT *, trim(workflow_id, {_PAD}) AS id FROM sm_state QUALIFY row_number() OVER (PARTITION BY trim(workflow_id, {_PAD}) ORDER BY version DESC) = 1),
b AS (SELECT *, trim(workflow_id, {_PAD}) AS id FROM sm_state_replica QUALIFY row_number() OVER (PARTITION BY trim(workflow_id, {_PAD}) ORDER BY version DESC) = 1),
v AS (SELECT trim(entity_id, {_PAD}) AS id, max(coalesce(version, 0)) AS version FROM entity_snapshot WHERE entity_id IS NOT NULL AND (state IS NOT NULL OR model_json IS NOT NULL) GROUP BY 1),
j AS (SELECT a.id, a.data AS u, b.data AS v FROM a JOIN b ON a.id = b.id WHERE a.data IS DISTINCT FROM b.data),
d AS (SELECT id FROM j WHERE u IS NULL OR v IS NULL OR {_TREE.format("j.u")} IS DISTINCT FROM {_TREE.format("j.v")})
SELECT id AS workflow_id, 'missing_in_replica' AS finding FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'missing_in_state' FROM b WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT a.id, unnest(list_filter([CASE WHEN a.sm_type IS DISTINCT FROM b.sm_type THEN 'sm_type' END, CASE WHEN a.state IS DISTINCT FROM b.state THEN 'state' END, CASE WHEN a.version IS DISTINCT FROM b.version THEN 'version' END,
  CASE WHEN a.last_event_id IS DISTINCT FROM b.last_event_id THEN 'last_event_id' END, CASE WHEN epoch_us(a.updated_at) // 1000 IS DISTINCT FROM epoch_us(b.updated_at) // 1000 THEN 'updated_at' END], lambda x: x IS NOT NULL)) FROM a JOIN b ON a.id = b.id
UNION ALL SELECT id, 'data' FROM d
UNION ALL SELECT a.id, 'snapshot_version' FROM a JOIN v ON a.id = v.id WHERE a.version <> v.version
"""

_SAME = "CASE WHEN json_type({v}) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(CAST({v} AS double) AS varchar) WHEN json_type({v}) = 'NULL' THEN NULL ELSE {v} ->> '$' END"
_AT = "CASE WHEN len({c}.lp) = 0 THEN " + _SAME.format(v="json_extract({m}, {c}.path)") + " ELSE nullif(CAST(list_transform({l}, lambda x: coalesce(" + _SAME.format(v="json_extract(x, {c}.path)") + ", '')) AS varchar), CAST(list_transform({l}, lambda x: '') AS varchar)) END"
_AT = _AT.replace("{l}", "(CASE WHEN json_type(json_extract({m}, {c}.lp)) = 'ARRAY' THEN CAST(json_extract({m}, {c}.lp) AS JSON[]) ELSE [json_extract({m}, {c}.lp)] END)")

P3_SQL = f"""
WITH s AS (SELECT trim(table_name) AS t, release_no AS r, schema_hash AS h, CASE WHEN len(source_path) = 0 THEN '' ELSE '$.' || array_to_string(source_path, '.') END AS lp, columns AS cs FROM table_spec
  QUALIFY row_number() OVER (PARTITION BY trim(table_name), release_no ORDER BY published_at DESC) = 1),
o AS (SELECT *, lag(r) OVER (PARTITION BY t ORDER BY r) AS r0 FROM s),
c AS (SELECT t, r, h, lp, x.name AS name, upper(x.type) AS type, upper(x.source) = 'MODEL' AS own, '$.' || array_to_string(x.path, '.') AS path FROM (SELECT t, r, h, lp, unnest(cs) AS x FROM s)),
gone AS (SELECT o.r AS upto, a.* FROM o JOIN c a ON a.t = o.t AND a.r = o.r0 WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.t = o.t AND b.r = o.r AND b.name = a.name)),
come AS (SELECT b.* FROM o JOIN c b ON b.t = o.t AND b.r = o.r WHERE o.r0 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c a WHERE a.t = o.t AND a.r = o.r0 AND a.name = b.name)),
m AS (SELECT trim(entity_id) AS e, schema_hash AS h, model_json AS j FROM entity_snapshot WHERE entity_id IS NOT NULL AND json_valid(model_json) AND json_type(CASE WHEN json_valid(model_json) THEN model_json END) = 'OBJECT'
  QUALIFY row_number() OVER (PARTITION BY trim(entity_id), schema_hash ORDER BY coalesce(version, 0) DESC) = 1),
v AS (SELECT g.t, g.upto AS r, g.name AS g, k.name AS k, {_AT.replace("{m}", "x.j").replace("{c}", "g")} AS a, {_AT.replace("{m}", "y.j").replace("{c}", "k")} AS b
  FROM gone g JOIN come k ON g.t = k.t AND g.upto = k.r AND g.own AND k.own JOIN m x ON x.h = g.h JOIN m y ON y.h = k.h AND y.e = x.e),
n AS (SELECT t, r, g, k FROM v WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING bool_and(coalesce(a = b, false)))
SELECT t AS table_name, r AS release_no, 'renamed' AS change, g AS column_name, k AS new_name FROM n
UNION ALL SELECT t, upto, 'removed', name, '' FROM gone WHERE (t, upto, name) NOT IN (SELECT t, r, g FROM n)
UNION ALL SELECT t, r, 'added', name, '' FROM come WHERE (t, r, name) NOT IN (SELECT t, r, k FROM n)
UNION ALL SELECT o.t, o.r, 'retyped', a.name, '' FROM o JOIN c a ON a.t = o.t AND a.r = o.r0 JOIN c b ON b.t = o.t AND b.r = o.r AND b.name = a.name WHERE a.type <> b.type
"""

def _list_of(x: str, *item: str) -> str:
    """The JSON values that x stands for: a list's elements, an item alone, else the list or objects that a wrapper holds; JSON in a string is opened."""
    opened = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"
    own = " OR ".join(f"json_exists({opened}, '$.{i}')" for i in item)
    inner = f"map_values(CAST({opened} AS MAP(varchar, JSON)))"
    listed = f"list_filter({inner}, lambda e: json_type(e) = 'ARRAY')"
    return f"""(CASE json_type({opened}) WHEN 'ARRAY' THEN CAST({opened} AS JSON[]) WHEN 'OBJECT' THEN CASE WHEN {own} THEN [{opened}] WHEN len({listed}) > 0 THEN CAST({listed}[1] AS JSON[]) ELSE list_filter({inner}, lambda e: json_type(e) = 'OBJECT') END ELSE [] END)"""


P6_SQL = f"""
WITH e AS (SELECT lower(trim(event_id, {_PAD})) AS id, sm_type, event_type, payload, row_number() OVER (PARTITION BY lower(trim(event_id, {_PAD})) ORDER BY ingest_ts_millis = 0, ingest_ts_millis, delivery_id) AS rn
  FROM event_envelope WHERE event_type = 'OrderCreateEvent' OR (sm_type = 'claim' AND event_type = 'file')),
j AS (SELECT id, event_type, CAST(CASE WHEN json_valid(payload) THEN payload END AS JSON) AS p FROM e WHERE rn = 1 AND id <> ''),
o AS (SELECT id, event_type, CASE WHEN json_type(p) = 'VARCHAR' AND json_valid(p ->> '$') THEN CAST(p ->> '$' AS JSON) ELSE p END AS p FROM j),
l AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM (SELECT id, {_list_of("json_extract(p, '$.lines')", "sku", "product", "components")} AS x FROM o WHERE event_type = 'OrderCreateEvent' AND json_type(p) = 'OBJECT')),
k AS (SELECT id, i, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS v FROM (SELECT id, i, {_list_of("json_extract(v, '$.components')", "sku", "product")} AS x FROM l)),
c AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM (SELECT id, {_list_of("json_extract(p, '$.claimed')", "amount", "money")} AS x FROM o WHERE event_type = 'file' AND json_type(p) = 'OBJECT')),
s AS (SELECT trim(entity_id, {_PAD}) AS id, CAST(CASE WHEN json_valid(model_json) THEN model_json END AS JSON) AS p FROM entity_snapshot WHERE sm_type = 'gen_trading_order' AND entity_id IS NOT NULL AND (state IS NOT NULL OR model_json IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY trim(entity_id, {_PAD}) ORDER BY coalesce(version, 0) DESC, published_at DESC, topic_partition DESC, topic_offset DESC) = 1),
x AS (SELECT id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM (SELECT id, {_list_of("json_extract(p, '$.executions')", "fills")} AS x FROM s WHERE json_type(p) = 'OBJECT')),
f AS (SELECT id, i, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS v FROM (SELECT id, i, {_list_of("json_extract(v, '$.fills')", "fillId")} AS x FROM x)),
r AS (SELECT id AS record_id, 'lines' AS child_path, CAST(i AS varchar) AS idx, coalesce(v ->> '$.sku', v ->> '$.product.sku') AS item FROM l
  UNION ALL SELECT id, 'lines.components', i || '.' || n, coalesce(v ->> '$.sku', v ->> '$.product.sku') FROM k
  UNION ALL SELECT id, 'claimed', CAST(i AS varchar), CAST(CAST(round(try_cast(coalesce(v ->> '$.amount', v ->> '$.money.amount') AS decimal(38, 8)), 2) AS decimal(38, 2)) AS varchar) FROM c
  UNION ALL SELECT id, 'executions.fills', i || '.' || n, v ->> '$.fillId' FROM f)
SELECT * FROM r WHERE item IS NOT NULL
"""

P4_SQL = f"""
WITH e AS (SELECT lower(trim(event_id, {_PAD})) AS id, delivery_id, ingest_ts_millis AS ms FROM event_envelope),
p AS (SELECT lower(trim(event_id, {_PAD})) AS id, epoch_us(received_at) AS us FROM processed_event)
SELECT 'event_envelope' AS origin, id AS event_id, arg_min(delivery_id, struct_pack(a := ms = 0, b := ms, c := delivery_id)) AS kept
FROM e WHERE id <> '' GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'processed_event', id, min(us) FROM p WHERE id <> '' GROUP BY id HAVING count(*) > 1
"""

P4_DELIVERIES_SQL = f"""
SELECT * EXCLUDE (rn, id) FROM (SELECT *, lower(trim(event_id, {_PAD})) AS id, count(*) OVER (PARTITION BY lower(trim(event_id, {_PAD}))) AS copies,
  row_number() OVER (PARTITION BY lower(trim(event_id, {_PAD})) ORDER BY ingest_ts_millis = 0, ingest_ts_millis, delivery_id) AS rn FROM event_envelope) WHERE rn = 1
"""

P4_UNDISPATCHED_SQL = f"""
WITH e AS (SELECT lower(trim(event_id, {_PAD})) AS event_id, sm_type, event_type, delivery_id,
  row_number() OVER (PARTITION BY lower(trim(event_id, {_PAD})) ORDER BY ingest_ts_millis = 0, ingest_ts_millis, delivery_id) AS rn FROM event_envelope)
SELECT event_id, sm_type, event_type, delivery_id FROM e
WHERE rn = 1 AND event_id NOT IN (SELECT lower(trim(event_id, {_PAD})) FROM processed_event WHERE status = 'DISPATCHED')
"""

P4_ABSORBED_SQL = f"""
SELECT id AS event_id, shard_id, delivery_id FROM (SELECT lower(trim(event_id, {_PAD})) AS id, shard_id, delivery_id,
  row_number() OVER (PARTITION BY lower(trim(event_id, {_PAD})) ORDER BY shard_id, ingest_ts_millis = 0, ingest_ts_millis, delivery_id) AS rn FROM event_envelope WHERE shard_id IS NOT NULL) WHERE rn = 1 AND id <> ''
"""

_P7 = """
WITH base AS (SELECT workflow_id AS entity_id, max(version) AS version, arg_max(state, version) AS state, arg_max(sm_type, version) AS sm_type FROM sm_state GROUP BY 1),
c AS (SELECT entity_id, coalesce(version, 0) AS version, max(state IS NOT NULL OR model_json IS NOT NULL) AS live,
        arg_max(struct_pack(s := state, t := sm_type), struct_pack(a := state IS NOT NULL OR model_json IS NOT NULL, b := published_at, c := topic_partition, d := topic_offset)) AS row
      FROM entity_snapshot WHERE entity_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT c.* FROM c LEFT JOIN base b USING (entity_id) WHERE b.version IS NULL OR c.version > b.version QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY c.version DESC) = 1)
"""
P7_SQL = _P7 + "SELECT entity_id, coalesce(l.version, b.version) AS version FROM base b FULL JOIN l USING (entity_id) WHERE coalesce(l.live, true)"
P7_STATE_SQL = _P7 + "SELECT entity_id, coalesce(l.version, b.version) AS version, CASE WHEN l.version IS NULL THEN b.sm_type ELSE l.row.t END AS sm_type, CASE WHEN l.version IS NULL THEN b.state ELSE l.row.s END AS state FROM base b FULL JOIN l USING (entity_id) WHERE coalesce(l.live, true)"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p6_found": P6_SQL, "p4_found": P4_SQL, "p4_deliveries": P4_DELIVERIES_SQL, "p4_undispatched": P4_UNDISPATCHED_SQL, "p4_absorbed": P4_ABSORBED_SQL, "p7_found": P7_SQL, "p7_state": P7_STATE_SQL}
