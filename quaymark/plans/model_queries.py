"""Queries written in the model-query language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaymark.plans import domain
from quaymark.plans.relation import Catalog, run
from quaymark.sources.tables import table

TEXTS = {
    "relation_versions": "#>{db.snapshots}#->filter(x|$x.version > 1)->groupBy(~[state, sm_type], ~[lowest: x|$x.version : y|$y->min(), mean: x|$x.version : y|$y->average(), kept: x|$x.entity_id : y|$y->distinctCount()])",
    "relation_slowest": "#>{db.snapshots}#->filter(x|$x.completed_at->isNotEmpty() && $x.created_at->isNotEmpty())->extend(~hours: x|dateDiff($x.created_at->toOne(), $x.completed_at->toOne(), DurationUnit.HOURS))->select(~[entity_id, sm_type, hours])->sort([~hours->descending(), ~entity_id->ascending()])->take(25)",
    "relation_opened_daily": "#>{db.snapshots}#->filter(x|$x.created_at->isNotEmpty())->extend(~opened: x|$x.created_at->toOne()->timeBucket(1, DurationUnit.DAYS))->groupBy(~[opened, sm_type], ~entities: x|$x.entity_id : y|$y->count())->sort([~opened->ascending(), ~sm_type->ascending()])",
    "class_project": "shop::Order.all()->filter(x|$x.status == Status.F && $x.totalPrice > 100000.0)->project([x|$x.orderKey, x|$x.totalPrice, x|$x.lines.quantity], ['key', 'price', 'quantity'])",
    "class_value_path": "shop::Order.all()->filter(x|$x.price.band == '5-LOW')->project([x|$x.orderKey, x|$x.price.amount], ['key', 'amount'])",
    "class_group": "shop::Order.all()->groupBy([x|$x.status], [agg(x|$x.totalPrice, y|$y->max()), agg(x|$x.orderKey, y|$y->count())], ['status', 'largest', 'count'])->sort([desc('count')])",
}

_L = "(" + domain.SQL["snapshots_latest"] + ")"
SQL = {
    "relation_versions": f"SELECT state, sm_type, min(version) AS lowest, avg(version) AS mean, count(DISTINCT entity_id) AS kept FROM {_L} WHERE version > 1 GROUP BY 1, 2",
    "relation_slowest": f"SELECT entity_id, sm_type, trunc((epoch_us(completed_at) - epoch_us(created_at)) / 3600000000)::bigint AS hours FROM {_L} WHERE completed_at IS NOT NULL AND created_at IS NOT NULL ORDER BY hours DESC, entity_id LIMIT 25",
    "relation_opened_daily": f"SELECT date_trunc('day', created_at)::timestamp AS opened, sm_type, count(*) AS entities FROM {_L} WHERE created_at IS NOT NULL GROUP BY 1, 2",
    "class_project": "SELECT o_orderkey AS key, o_totalprice AS price, l_quantity AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "class_value_path": "SELECT o_orderkey AS key, o_totalprice AS amount FROM orders WHERE o_orderpriority = '5-LOW'",
    "class_group": "SELECT o_orderstatus AS status, max(o_totalprice) AS largest, count(*) AS count FROM orders GROUP BY 1",
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    from pyspark.sql import functions as F

    orders = lambda: table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "entity_id"}).withColumn("entity_version", F.lit(1))
    lines = lambda: table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "entity_id"}).withColumn("entity_version", F.lit(1))
    classes = {"shop::Order": ("orders", {("orderKey",): "entity_id", ("status",): "o_orderstatus", ("totalPrice",): "o_totalprice", ("price", "amount"): "o_totalprice", ("price", "band"): "o_orderpriority"}, {"lines": ("lines", {("quantity",): "l_quantity", ("price",): "l_extendedprice"})})}
    return Catalog({"snapshots": lambda: domain.snapshots_latest(spark, sf_dir), "orders": orders, "lines": lines}, classes)


def _query(name: str):  # noqa: ANN202
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(TEXTS[name], catalog(spark, sf_dir))

    q.__doc__ = TEXTS[name]
    return q


def queries() -> dict:
    return {n: _query(n) for n in TEXTS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
