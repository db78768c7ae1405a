"""Components of edges and of a task's links against a plain union."""

import random

from leadforge.llm.components import components
from leadforge.llm.ngrams import stars


def plain(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_chains_cycles_and_hubs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 201), (201, 202), (202, 200)] + [(300, i) for i in range(301, 360)] + [(420, 400), (420, 401)]
    edges += [(rng.randint(500, 560), rng.randint(500, 560)) for _ in range(40)]
    rows = [e if rng.random() < 0.5 else e[::-1] for e in edges] + [(200, 201), (7, 7), (None, 3), (3, None)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    expected = plain([(a, b) for a, b in edges if a != b])
    assert got == expected


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_task_passes_on_stars():
    rng = random.Random(6)
    node = [bytes([x]) for x in rng.sample(range(256), 60)]
    for _ in range(50):
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(0, 50))]
        links = [(i, j) for i, j in links if i != j]
        root = plain([(node[i], node[j]) for i, j in links])
        assert sorted(stars(links, node)) == sorted((x, r) for x, r in root.items() if x != r)
