"""Components of chains, stars and random graphs, and the number of steps they take."""

import random

from navscore.llm import components as C


def plain(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


def check(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in C.components(frame).collect()}
    assert got == {x: r for x, r in plain(edges).items() if any(x in e and e[0] != e[1] for e in edges)}


def test_chain_takes_logarithmic_steps(spark, monkeypatch):
    steps = []
    stored = C.stored

    def counted(frame, label):
        steps.append(label)
        return stored(frame, label)

    monkeypatch.setattr(C, "stored", counted)
    check(spark, [(i, i + 1) for i in range(1000)])
    assert steps.count("jumps") <= 12 and steps.count("hooks") == 1


def test_other_graphs(spark):
    rng = random.Random(2)
    edges = [(900 - i, 1000 + i) for i in range(30)] + [(2000, 2001 + i) for i in range(40)]
    edges += [(3000 + i, 4000) for i in range(40)]  # a hub above its leaves
    edges += [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (7000, 7000), (1, 2), (2, 1)]
    check(spark, edges)


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []
