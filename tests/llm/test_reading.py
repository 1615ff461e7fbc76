import random

import numpy as np
from pyspark.sql import functions as F

from quaymark.llm.reading import VARIANCE, reading_levels, step_difficulties

EASY = "the sun is in a big red box and we sat by it".split()
MIDDLE = "although nobody remembered yesterday another stranger carried lanterns through villages before dinner".split()
HARD = "notwithstanding institutional reconciliation systematically perpetuates epistemological stratification thereby circumscribing jurisdictional proportionality".split()
LEVELS = (EASY, MIDDLE, HARD)


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        k = rng.randrange(3)
        other = rng.randrange(3)
        parts = [rng.choices(LEVELS[k], k=30), rng.choices(LEVELS[k], k=30), rng.choices(LEVELS[other], k=25)]
        rng.shuffle(parts)
        truth[i] = k + 1
        docs.append((i, " ".join(w for p in parts for w in p), 9))
    return docs, truth


def levels(spark, docs, labels, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, level int").repartition(4)
    l = spark.createDataFrame(labels, "doc_id bigint, level int, rater string")
    r = reading_levels(d, l, doc_id=F.col("doc_id"), text=F.col("text"), label_id=F.col("doc_id"), level=F.col("level"), **kw)
    return {x.doc_id: x.level for x in r.collect()}


def test_held_out(spark):
    docs, truth = corpus(300, 1)
    rng = random.Random(5)
    labels = [(i, truth[i] if rng.random() > 0.1 else rng.randint(1, 3), "r") for i in range(60)]
    got = levels(spark, docs, labels)
    assert np.mean([got[i] == truth[i] for i in range(60, 300)]) > 0.97


def test_edges(spark):
    docs, truth = corpus(40, 2)
    odd = [(900, None, 0), (901, "", 0), (902, "too short", 0), (903, " ".join(HARD * 30_000), 0), (904, " ".join(EASY * 3), 0), (904, " ".join(EASY * 3), 0)]
    labels = [(i, truth[i], "r") for i in range(30)] + [(0, truth[0], "s"), (1, None, "s"), (2, 7, "s"), (5000, 1, "s"), (None, 1, "s")]
    got = levels(spark, docs + odd, labels)
    assert not {900, 901, 902} & set(got) and got[903] == 3 and got[904] == 1
    assert set(levels(spark, docs, []).values()) <= {1, 2, 3}
    assert levels(spark, [], labels) == {}


def test_levels_spread_over_linked_words(spark, caplog):
    """Only words of the first group are labelled; each later group is linked to the one before."""
    rng = random.Random(3)
    group = lambda k, g: [f"w{k}{g}{i}xyz" for i in range(8)]
    docs, truth = [], {}
    for k in (1, 2, 3):
        for g in range(5):
            for _ in range(12):
                words = [w for a, b in zip(rng.choices(group(k, g), k=40), rng.choices(group(k, g + 1), k=40)) for w in (a, b)]
                truth[len(docs)] = (k, g)
                docs.append((len(docs), " ".join(words), 0))
        truth[len(docs)] = (k, 5)
        docs.append((len(docs), " ".join(rng.choices(group(k, 5), k=80)), 0))
    labels = [(i, k, "r") for i, (k, g) in truth.items() if g == 0]
    with caplog.at_level("INFO", "quaymark.llm.reading"):
        got = levels(spark, docs, labels)
    assert {i: k for i, (k, g) in truth.items()} == got
    seen = [r.args[0] for r in caplog.records if r.levelname == "INFO"]
    assert len(seen) > 2 and seen[-1] < 1e-3 <= seen[-2]
    assert not [r for r in caplog.records if r.levelname == "WARNING"]
    with caplog.at_level("WARNING", "quaymark.llm.reading"):
        assert levels(spark, docs, labels, passes=1) != got
    assert [r for r in caplog.records if r.levelname == "WARNING"]


def test_newton_ends_at_the_maximum():
    rng = np.random.default_rng(4)
    counts = rng.gamma(0.5, 20, (200, 3)) * (rng.random((200, 3)) < 0.7)
    exposure, centre = np.array([5000.0, 9000.0, 300.0]), rng.normal(size=(200, 2))
    steps, best = step_difficulties(counts, exposure, centre)

    def objective(s):
        depth = np.concatenate([np.zeros((200, 1)), -s.cumsum(1)], 1) + np.log(exposure)
        return (counts * (depth - np.log(np.exp(depth).sum(1, keepdims=True)))).sum() - ((s - centre) ** 2).sum() / (2 * VARIANCE)

    assert abs(objective(steps) - best) < 1e-6
    for i in rng.integers(0, 200, 20):
        for j in (0, 1):
            for by in (-1e-2, 1e-2):
                other = steps.copy()
                other[i, j] += by
                assert objective(other) < best
    unseen, _ = step_difficulties(np.zeros((2, 3)), exposure, centre[:2])
    assert np.allclose(unseen, centre[:2])
