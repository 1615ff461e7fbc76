"""Sources mixed to target weights, in tokens (problem 9).

The tree has domains, in these languages, in these sources (or whatever levels are asked for). A
leaf weighs what its source's share of the target is worth in it: the share, times the part of
the source's tokens that lie in the leaf; a family weighs what its leaves weigh together, so the
sources hold their shares whatever the tree. Budgets run down the tree by weight, on the driver. A
leaf takes at most its tokens times its source's cap of repeats, and what it can't take goes to
its siblings first, then to the families above. Each leaf then spends its budget in epochs: whole passes over all its documents, then a prefix of
tokens of one more pass in a seeded order. The prefix is found through sums over ranges of the
seeded order, so that only the range in which the budget ends is looked at row by row.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions.columns import trimmed
from quaymark.session import materialize
from quaymark.sources.tables import table

#: Where the files of public tokenizers lie, and which one counts.
TOKENIZERS = os.environ.get("QUAYMARK_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
SEED = 20250301
#: Leaves that the driver takes at most, and ranges of the seeded order per leaf.
MAX_LEAVES = 100_000
RANGES = 4096
#: The split into pieces before byte pairs are merged, of the 50k vocabulary. A fixed value.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_ENCODERS: dict = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, keep: Sequence[Column], text: Column, path: str | None = None) -> DataFrame:
    """The columns `keep` and `tokens`: of the whole text; null and empty texts have none."""
    path = path or os.path.join(TOKENIZERS, TOKENIZER)
    d = df.select(*keep, text.cast("string").alias("__text"))
    kept = [f for f in d.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "tokens"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens bigint"
    return d.mapInArrow(run, ddl)


@dataclass
class Node:
    """A family or a leaf. weight: its share among its siblings; a leaf has tokens and a cap of repeats."""

    name: str
    weight: float
    children: list[Node] = field(default_factory=list)
    tokens: int = 0
    repeats: int = 1
    budget: float = 0.0

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children) if self.children else float(self.tokens) * self.repeats


def allocate(node: Node, budget: float) -> float:
    """Spread a budget over the tree; returns what the whole tree can't take.

    Children are filled by weight; what some can't take is spread by weight over their siblings
    that still can, until all is taken or all are full. Only the rest goes to the caller, that is
    to the node's own siblings.
    """
    if not node.children:
        node.budget = min(budget, node.capacity())
        return budget - node.budget
    takes = dict.fromkeys(range(len(node.children)), 0.0)
    caps = [c.capacity() for c in node.children]
    open_ = [i for i, c in enumerate(node.children) if c.weight > 0 and caps[i] > 0]
    left = budget
    while left > 1e-9 and open_:
        total = sum(node.children[i].weight for i in open_)
        full = [i for i in open_ if caps[i] - takes[i] <= left * node.children[i].weight / total]
        for i in full or open_:
            share = caps[i] - takes[i] if full else left * node.children[i].weight / total
            takes[i] += share
        left = budget - sum(takes.values())
        if not full:
            break
        open_ = [i for i in open_ if i not in full]
    for i, c in enumerate(node.children):
        allocate(c, takes[i])
    node.budget = sum(takes.values())
    return max(budget - node.budget, 0.0)


def leaf_selection(docs: DataFrame, leaf: str, doc_id: str, tokens: str, budgets: dict[str, tuple[float, int]], seed: int = SEED) -> DataFrame:
    """docs with `uses`: how often each document is taken so that its leaf spends its budget.

    A leaf's budget is (tokens of its documents, budget) in whole passes and a prefix of the seeded
    order of the next pass. The document in which the budget ends is taken if that brings the sum
    nearer. Documents of other leaves, without tokens, or not taken aren't returned.
    """
    spark = docs.sparkSession
    plan = spark.createDataFrame([(k, int(b // t), float(b - (b // t) * t)) for k, (b, t) in budgets.items() if t > 0 and b > 0], "leaf string, passes int, rest double")
    d = docs.where(F.col(tokens) > 0).join(F.broadcast(plan), F.col(leaf) == F.col("leaf")).drop("leaf")
    d = d.withColumn("__o", F.xxhash64(F.lit(seed), F.col("passes"), F.col(doc_id))).withColumn("__r", F.shiftrightunsigned("__o", 52).cast("int"))
    sums = d.groupBy(leaf, "__r").agg(F.sum(tokens).alias("__s"))
    # At most RANGES rows per leaf.
    cum = sums.select(leaf, "__r", (F.sum("__s").over(Window.partitionBy(leaf).orderBy("__r")) - F.col("__s")).alias("__before"), F.col("__s"))
    d = d.join(cum, [leaf, "__r"])
    w = Window.partitionBy(leaf, "__r").orderBy("__o", doc_id)
    inside = (F.col("__before") < F.col("rest")) & (F.col("__before") + F.col("__s") > F.col("rest"))
    edge = d.where(inside).withColumn("__c", F.col("__before") + F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("__more", (F.col("__c") <= F.col("rest")) | ((F.col("__c") - F.col(tokens) < F.col("rest")) & (F.col("__c") - F.col("rest") < F.col("rest") - F.col("__c") + F.col(tokens)))).drop("__c")
    flat = d.where(~inside).withColumn("__more", F.col("__before") < F.col("rest"))
    out = flat.unionByName(edge).withColumn("uses", F.col("passes") + F.col("__more").cast("int"))
    return out.where("uses > 0").drop("__o", "__r", "__s", "__before", "__more", "passes", "rest")


def tree(sizes: Sequence[tuple[tuple[str, ...], str, int]], targets: dict[str, tuple[float, int]]) -> tuple[Node, dict[tuple[str, ...], Node]]:
    """(root, leaves) from (path, source, tokens) per leaf and (share, cap of repeats) per source; families are in order of their names."""
    of_source: dict[str, int] = {}
    for _, source, tokens in sizes:
        of_source[source] = of_source.get(source, 0) + tokens
    root, leaves, nodes = Node("", 0.0), {}, {}
    for path, source, tokens in sorted(sizes):
        share, cap = targets[source]
        weight = share * tokens / of_source[source] if of_source[source] else 0.0
        at = root
        at.weight += weight
        for depth, name in enumerate(path, 1):
            nxt = nodes.get(path[:depth])
            if nxt is None:
                nxt = nodes[path[:depth]] = Node(name, 0.0)
                at.children.append(nxt)
            nxt.weight += weight
            at = nxt
        at.tokens, at.repeats = tokens, cap
        leaves[path] = at
    return root, leaves


def feasible(leaves: Sequence[Node]) -> float:
    """The largest budget with which every leaf that has anything holds its weight among those."""
    have = [c for c in leaves if c.weight > 0 and c.capacity() > 0]
    total = sum(c.weight for c in have)
    return min((c.capacity() * total / c.weight for c in have), default=0.0)


def mix(docs: DataFrame, targets: DataFrame, *, levels: Sequence[str], source: str = "source", doc_id: str = "doc_id", tokens: str = "tokens", total: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A selection whose sources hold their target shares, and a report of the shares.

    docs: doc_id, tokens and the columns of the tree's levels, from the top; one of them is the
    source, which targets names (source, target_share, max_repeats). total: tokens to spend; by
    default the largest total with which every source that has documents holds its share among
    those. Sources without documents, and what others can't take, leave their share to the rest:
    to the sources of the same family first. Returns (selection: docs columns with uses; report:
    source, target_share, max_repeats, available, budget). Targets that repeat a source count with
    the largest share; null or non-positive shares and caps give nothing; equal documents are
    documents of their own. More than MAX_LEAVES targets or leaves are an error.
    """
    spark = docs.sparkSession
    if source not in levels:
        raise ValueError(f"{source} is no level of the tree")
    docs = docs.withColumn("__leaf", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels]))
    rows = targets.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("s")).select("source", "s.*").where("source is not null and target_share > 0 and max_repeats > 0").limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} target sources")
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in sorted(rows)}
    sizes = docs.join(F.broadcast(spark.createDataFrame([(k,) for k in want] or [("",)], "want string")), F.col(source) == F.col("want")).groupBy(F.col(source).alias("source"), "__leaf").agg(F.sum(tokens).alias("t")).limit(MAX_LEAVES + 1).collect()
    if len(sizes) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    root, leaves = tree([(tuple(r["__leaf"].split("\x1f")), r.source, int(r.t or 0)) for r in sizes], want)
    allocate(root, feasible(list(leaves.values())) if total is None else float(total))
    chosen = leaf_selection(docs, "__leaf", doc_id, tokens, {"\x1f".join(k): (n.budget, n.tokens) for k, n in leaves.items()}, seed).drop("__leaf")
    have, budget = dict.fromkeys(want, 0), dict.fromkeys(want, 0.0)
    for r in sizes:
        have[r.source] += int(r.t or 0)
        budget[r.source] += leaves[tuple(r["__leaf"].split("\x1f"))].budget
    report = spark.createDataFrame([(k, w, cap, have[k], budget[k]) for k, (w, cap) in want.items()], "source string, target_share double, max_repeats int, available bigint, budget double")
    return chosen, report


def source_key(c: Column) -> Column:
    """Sources compare trimmed and without regard to case."""
    return F.lower(trimmed(c))


#: Spellings of languages.
LANGUAGES = {"en": ("en", "eng"), "de": ("de", "ger", "deu"), "fr": ("fr", "fre", "fra"), "es": ("es", "spa")}


def language_key(c: Column) -> Column:
    low = F.lower(trimmed(c))
    out = low
    for k, names in LANGUAGES.items():
        out = F.when(low.isin(list(names)), F.lit(k)).otherwise(out)
    return out


def domain_key(season: Column, episode: Column) -> Column:
    """series: part of one; single: a film or the like."""
    return F.when(season.isNotNull() | episode.isNotNull(), F.lit("series")).otherwise(F.lit("single"))


def _mixed(spark: SparkSession, sf_dir: str, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """full: spend as many tokens as the documents of the target sources have, instead of what keeps all shares."""
    docs = table(spark, sf_dir, "documents")
    counted = token_counts(docs, [F.col("doc_id"), domain_key(F.col("season"), F.col("episode")).alias("domain"), source_key(F.col("source")).alias("source"), F.coalesce(language_key(F.col("lang")), F.lit("und")).alias("lang")], F.col("text"))
    targets = table(spark, sf_dir, "mix_target").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    counted = materialize(counted, "tokens")
    usable = targets.where("target_share > 0 and max_repeats > 0")
    total = (counted.join(F.broadcast(usable), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0) if full else None
    return mix(counted, targets, levels=["domain", "lang", "source"], total=total)


def _selection(chosen: DataFrame, report: DataFrame) -> DataFrame:
    spent = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("spent"))
    shares = spent.select("source", (F.col("spent") / F.sum("spent").over(Window.partitionBy(F.lit(1)))).alias("reached_share"))
    shares = shares.join(report.select("source", "target_share"), "source")
    return chosen.select("doc_id", "domain", "lang", "source", "tokens", "uses").join(F.broadcast(shares), "source").select("doc_id", "domain", "lang", "source", "tokens", "uses", "target_share", "reached_share")


def _shares(chosen: DataFrame, report: DataFrame) -> DataFrame:
    spent = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("spent"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    j = report.join(spent, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    total = F.sum(F.coalesce("spent", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    return j.select("source", "target_share", "max_repeats", "available", F.round("budget", 0).cast("bigint").alias("budget"), zero("spent"), zero("documents"), zero("most_uses"), F.round(F.coalesce("spent", F.lit(0)) / total, 6).alias("reached_share"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, uses, target_share, reached_share): the selection, with the shares of its sources."""
    return _selection(*_mixed(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target source: its share, what it has, what the mix takes, the share reached and the most often used document."""
    return _shares(*_mixed(spark, sf_dir))


def p9_full_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_selection of as many tokens as the target sources have: sources that run short at their cap leave the rest to the others."""
    return _selection(*_mixed(spark, sf_dir, full=True))


def p9_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_shares of that selection."""
    return _shares(*_mixed(spark, sf_dir, full=True))


def p9_shares_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target source with documents, whether p9_selection uses none of its documents too often and gives it its share, to the few documents in which its leaves' budgets end."""
    chosen, report = _mixed(spark, sf_dir)
    spent = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("spent"), F.max("uses").alias("most"), F.max("tokens").alias("longest"), F.count_distinct("domain", "lang").alias("leaves"))
    one = Window.partitionBy(F.lit(1))  # a row per source
    j = report.where("available > 0").join(spent, "source", "left").na.fill(0)
    want = F.col("target_share") / F.sum("target_share").over(one) * F.sum("spent").over(one)
    room = F.sum(F.col("longest") * F.col("leaves")).over(one)
    return j.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("spent") - want) <= room).alias("holds_share"))


def queries() -> dict:
    return {f.__name__: f for f in (p9_selection, p9_shares, p9_full_selection, p9_full_shares, p9_shares_hold)}


P9_SHARES_HOLD_SQL = "SELECT DISTINCT lower(trim(source)) AS source, true AS within_cap, true AS holds_share FROM mix_target WHERE target_share > 0 AND max_repeats > 0 AND lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents WHERE n_chars > 0)"


def oracle_sql() -> dict[str, str]:
    return {"p9_shares_hold": P9_SHARES_HOLD_SQL}
