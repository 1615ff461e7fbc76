import os
import random

import pytest
from pyspark.sql import functions as F

from quaymark.llm.mixing import TOKENIZER, TOKENIZERS, Node, allocate, feasible, mix, token_counts, tree


def test_shortage_stays_among_siblings():
    poor, rich = Node("poor", 0.5, tokens=10, repeats=2), Node("rich", 0.5, tokens=1000)
    root = Node("", 1, [Node("family", 0.5, [poor, rich]), Node("other", 0.5, tokens=1000)])
    assert allocate(root, 200) == 0
    assert (poor.budget, rich.budget, root.children[1].budget) == (20, 80, 100)
    tight = Node("", 1, [Node("family", 0.5, [Node("a", 1, tokens=30)]), Node("other", 0.5, tokens=1000)])
    assert allocate(tight, 200) == 0 and tight.children[1].budget == 170
    assert allocate(tight, 5000) == pytest.approx(3970)
    assert feasible(tight.children[0].children + [tight.children[1]]) == 45 and feasible([]) == 0


def test_weights_run_through_domains_languages_sources():
    """A source short in one language leaves that to the language's other sources, then to the domain's other languages."""
    sizes = [(("film", "en", "a"), "a", 100), (("film", "en", "b"), "b", 300), (("film", "de", "b"), "b", 100), (("series", "en", "b"), "b", 600)]
    root, leaves = tree(sizes, {"a": (0.5, 1), "b": (0.5, 1)})
    film, series = root.children
    assert [(film.weight, series.weight), (leaves["film", "en", "a"].weight, leaves["film", "de", "b"].weight)] == [pytest.approx((0.7, 0.3)), pytest.approx((0.5, 0.05))]
    assert feasible(list(leaves.values())) == pytest.approx(200)
    assert allocate(root, 600) == 0
    got = {k: n.budget for k, n in leaves.items()}
    # film takes 420: German 30; English 390, of which a takes all it has and b the rest.
    assert got == {("film", "en", "a"): pytest.approx(100), ("film", "en", "b"): pytest.approx(290), ("film", "de", "b"): pytest.approx(30), ("series", "en", "b"): pytest.approx(180)}
    assert allocate(root, 800) == 0
    got = {k: n.budget for k, n in leaves.items()}
    # film can take 500 of its 560, and 60 more go to series.
    assert got == {("film", "en", "a"): 100, ("film", "en", "b"): 300, ("film", "de", "b"): 100, ("series", "en", "b"): pytest.approx(300)}


def sources(spark, n=3000):
    rng = random.Random(2)
    rows = [(i, "a" if i % 3 else rng.choice(["b", "c", None]), rng.choice(["en", "de"]), rng.randint(0, 50), 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint, uses int").drop("uses"), rows


def test_shares_and_caps(spark):
    d, rows = sources(spark)
    t = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 4), ("c", 0.1, 1), ("nowhere", 0.1, 9), (None, 0.5, 2), ("d", -1.0, 2)], "source string, target_share double, max_repeats int")
    for levels in (["source"], ["source", "lang"]):
        chosen, report = mix(d, t, levels=levels)
        got = chosen.collect()
        assert len({r.doc_id for r in got}) == len(got)
        spent = {}
        for r in got:
            spent[r.source] = spent.get(r.source, 0) + r.tokens * r.uses
        total = sum(spent.values())
        for s, w, cap in (("a", 0.3, 2), ("b", 0.5, 4), ("c", 0.1, 1)):
            assert abs(spent[s] / total - w / 0.9) < 0.01
            assert max(r.uses for r in got if r.source == s) <= cap
        assert {r.source: r.available for r in report.collect()}["nowhere"] == 0
        assert sorted((r.doc_id, r.uses) for r in mix(d.repartition(5), t, levels=levels)[0].collect()) == sorted((r.doc_id, r.uses) for r in got)


def test_given_total_spreads_shortage(spark):
    d, rows = sources(spark)
    have = sum(r[3] for r in rows if r[1] == "c")
    t = spark.createDataFrame([("a", 0.5, 2), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mix(d, t, levels=["source"], total=have * 4.0)
    spent = {r.source: r.n for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n")).collect()}
    assert spent["c"] == have and abs(spent["a"] - 3 * have) < 60


def test_empty(spark):
    d, _ = sources(spark, 30)
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mix(d.limit(0), t, levels=["source"])[0].collect() == []
    assert mix(d, t.limit(0), levels=["source"])[0].collect() == []


def test_token_counts(spark):
    path = os.path.join(TOKENIZERS, TOKENIZER)
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    d = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, " " * 100_000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in token_counts(d, [F.col("doc_id")], F.col("text")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 0 and got[5] > 1


def test_too_many_targets_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("quaymark.llm.mixing.MAX_LEAVES", 3)
    d, _ = sources(spark, 30)
    for n in (3, 4):
        t = spark.createDataFrame([(f"s{i}", 1.0, 2) for i in range(n)], "source string, target_share double, max_repeats int")
        if n > 3:
            with pytest.raises(ValueError, match="target sources"):
                mix(d, t, levels=["source"])
        else:
            assert mix(d, t, levels=["source"])[0].collect() == []


def filled(members, budget):
    """Water level: each member (weight, room) takes level * weight or its room, where the level spends the budget."""
    low, high = 0.0, budget / min([w for w, r in members if w > 0 and r > 0], default=1.0)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(r, mid * w) for w, r in members) < budget else (low, mid)
    return [min(r, high * w) for w, r in members]


def test_full_total_against_water_levels(spark, tiny):
    """The budgets of a stated total, worked out level by level from the selection's own documents."""
    from quaymark.llm.mixing import p9_full_selection, p9_full_shares, p9_shares

    if not os.path.exists(os.path.join(TOKENIZERS, TOKENIZER)):
        pytest.skip("no tokenizer files here")
    got = {r.source: r for r in p9_full_shares(spark, tiny).collect()}
    total = sum(r.available for r in got.values())
    assert total > sum(r.budget for r in p9_shares(spark, tiny).collect())
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id", "if(season is null and episode is null, 'single', 'series') as domain", "lang", "lower(trim(source)) as source", "text")
    from quaymark.llm.mixing import language_key

    counted = token_counts(docs, [F.col("domain"), F.coalesce(language_key(F.col("lang")), F.lit("und")).alias("lang"), F.col("source")], F.col("text"))
    leaves = {(r.domain, r.lang, r.source): r.t for r in counted.where(F.col("source").isin(list(got))).groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("t")).collect()}
    weight = {k: got[k[2]].target_share * t / got[k[2]].available for k, t in leaves.items()}
    room = {k: t * got[k[2]].max_repeats for k, t in leaves.items()}

    def spread(keys, budget, depth):
        if depth == 3:
            return {keys[0]: budget}
        names = sorted({k[depth] for k in keys})
        parts = [[k for k in keys if k[depth] == n] for n in names]
        return {k: b for p, x in zip(parts, filled([(sum(weight[k] for k in p), sum(room[k] for k in p)) for p in parts], budget)) for k, b in spread(p, x, depth + 1).items()}

    want = {}
    for k, b in spread(list(leaves), float(total), 0).items():
        want[k[2]] = want.get(k[2], 0) + b
    for s, b in want.items():
        assert abs(got[s].budget - b) <= 1 and got[s].most_uses <= got[s].max_repeats and abs(got[s].spent - b) < 20_000
    assert any(r.spent and r.spent == r.available * r.max_repeats for r in got.values())
    spent = {}
    for r in p9_full_selection(spark, tiny).collect():
        spent[r.source] = spent.get(r.source, 0) + r.tokens * r.uses
    assert spent == {s: r.spent for s, r in got.items() if r.spent}
