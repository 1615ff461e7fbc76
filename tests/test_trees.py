from quaymark.operators.trees import rooted


def ways(links):
    """Every way down from a root, step by step."""
    out = []
    for node, parent in links:
        if node is not None and parent is None:
            todo = [(node, 0)]
            while todo:
                n, d = todo.pop()
                out.append((node, n, d))
                todo += [(c, d + 1) for c, p in links if p == n]
    return sorted(out)


def got(spark, links):
    d = spark.createDataFrame(links, "id string, up string")
    return sorted((r.root, r.node, r.depth) for r in rooted(d, "id", "up").collect())


def test_against_a_walk(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("lone", None), ("lost", "nobody"), ("lost2", "lost"), ("r1", "r2"), ("r2", "r1"), ("hang", "r1"), ("two", "a"), ("two", "c"), ("below", "two")]
    assert got(spark, links) == ways(links)


def test_deeper_than_a_hundred(spark):
    n = 130
    links = [("0", None)] + [(str(i), str(i - 1)) for i in range(1, n)]
    assert got(spark, links) == sorted(("0", str(i), i) for i in range(n))


def test_no_roots(spark):
    assert got(spark, [("a", "b"), ("b", "a")]) == []
    d = spark.createDataFrame([], "id string, up string")
    assert rooted(d, "id", "up").collect() == []
