"""Components of long chains, however their nodes are numbered."""

import random

import pytest

from siftlane.llm.components import connected_components

N = 1000


@pytest.mark.parametrize("ids", [random.Random(1).sample(range(N), N), [0, *range(N - 1, 0, -1)]], ids=["random", "falling"])
def test_a_long_chain_is_one_component(spark, ids):
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(N), 0)


def test_components_of_random_edges_are_those_of_a_search(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, 5), (None, 1), (2, None)]
    want = {x: x for a, b in pairs if a != b and a is not None and b is not None for x in (a, b)}
    for _ in want:
        for a, b in pairs:
            if a in want and b in want and a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == want
