import random

from termsieve.llm.graph import connected_components
from termsieve.llm.scratch import Scratch


def test_components_of_chains_stars_and_random_graphs(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(120)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "g").collect()}
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "g").count() == 0
