import random

from tributary.llm import components as parts
from tributary.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def roots(spark, edges):
    return dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))


def test_shapes(spark):
    rnd = random.Random(1)
    names = rnd.sample(range(-(10**12), 10**12), 700)
    path = list(zip(names[:300], names[1:300], strict=False))
    star = [(names[300], n) for n in names[301:600]]
    rest = [(rnd.choice(names[600:]), rnd.choice(names[600:])) for _ in range(70)]
    edges = path + star + rest
    rnd.shuffle(edges)
    edges = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in edges] * 2
    assert roots(spark, edges) == brute([(a, b) for a, b in edges if a != b])


def test_loops_nulls_and_nothing(spark):
    assert roots(spark, [(1, 1), (None, 2), (3, None), (5, 4)]) == {5: 4, 4: 4}
    assert roots(spark, []) == {}


def test_few_and_many_edges_alike(spark, monkeypatch):
    rnd = random.Random(4)
    edges = [(rnd.randrange(900), rnd.randrange(900)) for _ in range(700)]
    want = brute([(a, b) for a, b in edges if a != b])
    assert roots(spark, edges) == want
    monkeypatch.setattr(parts, "FEW", 0)
    assert roots(spark, edges) == want
    test_shapes(spark)
    test_loops_nulls_and_nothing(spark)
