"""One crowd of near copies: links and rows sent grow with its size, not with its square."""

import random

import pytest

from siftlane.llm import minhash
from tests_helper_brute import brute_components


def crowd(n, most, seed=1):
    """n near copies of one text of 120 words, each with up to `most` words changed at random."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(120), r.randint(0, most)):
            w[k] = f"x{i}-{k}"
        out.append(" ".join(w))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, digest string")


@pytest.mark.parametrize("most", [1, 8])
def test_links_and_rows_grow_with_the_crowd(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "CHUNK", 24)
    links, sent = [], []
    components, tiles = minhash.connected_components, minhash.tiles

    def counted(edges, name):
        links.append(edges.count())
        return components(edges, name)

    def dealt(known):
        out = tiles(known)
        sent.append((out.count(), known.where("rest = 1").count()))
        return out

    monkeypatch.setattr(minhash, "connected_components", counted)
    monkeypatch.setattr(minhash, "tiles", dealt)
    n = 100
    for n in (100, 400):
        texts = crowd(n, most)
        links.clear()
        sent.clear()
        got = {r.id: r.component_id for r in minhash.near_duplicates(table(spark, texts), shingle=3, percent=85, rows=6, bands=20).collect()}
        if n == 100:
            assert got == dict(enumerate(brute_components(texts, 3, 85)))
        assert len(links) == 3 and all(x <= 1.5 * n for x in links)
        rows, rest = sent[0]
        # Outside the core each document meets the crowd's chunks; the core's are sent once for each chunk of the rest.
        assert rows <= (rest + 24) * (n / 24 + 8) * 2 + n and (most > 1 or rest == rows == 0)


def test_two_crowds_of_unlike_sizes_and_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 6)
    texts = crowd(40, 6, 2) + [t + " " + " ".join(f"tail{k}" for k in range(90)) for t in crowd(40, 6, 3)] + ["a b c d", "a b c d e f"]
    got = {r.id: r.component_id for r in minhash.near_duplicates(table(spark, texts), shingle=3, percent=85, rows=3, bands=40).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 85)))
    same = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (0, "a b c d"), (0, "a b c d")], "doc_id long, text string")
    rows = sorted((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(same, shingle=3, percent=85).collect())
    assert rows == [(0, 0, True), (0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False)]


def test_bridges_join_classes_once():
    import numpy as np

    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 3, 4], [9, 10], [1, 2, 3], [9, 10, 11], [50])]
    classes, side = np.array([1, 1, 3, 4, 5, 6]), np.array([0, 0, 0, 1, 1, 1])
    assert minhash.bridges(sets, classes, side, 60) == [(1, 4), (3, 5)]
    assert minhash.bridges(sets, classes, np.zeros(6, int), 60) == [(1, 4), (3, 5)]
    assert minhash.bridges(sets, classes, np.ones(6, int), 60) == []


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 70000}" for k in range(300000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short"), (4, long.upper())], "doc_id long, text string")
    got = {r.id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(df).collect()}
    assert got == {1: (1, 70000), 2: (1, 70001), 3: (3, 1), 4: (1, 70000)}
