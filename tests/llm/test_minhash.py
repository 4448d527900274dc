import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import graph, minhash
from papyra.llm.text import Words

from . import brute
from .conftest import prose, rows


def test_against_plain(docs, texts):
    assert rows(minhash.near_duplicates(docs)) == sorted(brute.near(texts), key=repr)


@pytest.mark.parametrize("tile,hub", [(256, 100), (3, 2)])
def test_links_off_the_hub(spark, monkeypatch, tile, hub):
    """Texts that share buckets with a common hub but link with each other only."""
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "HUB", hub)
    monkeypatch.setattr(graph, "HUB", hub)
    base = prose(1, 200).split()

    def other(seed, share):
        w = list(base)
        for k in range(int(len(w) * share)):
            w[k * len(w) // max(1, int(len(w) * share))] = f"s{seed}x{k}"
        return w

    own = []
    for g in range(12):
        x = other(g, 0.06)
        own += [" ".join(x), " ".join([*x[:100], f"q{g}", *x[101:]])]
    own += [" ".join(base)] * 3 + [prose(50 + i, 80) for i in range(20)]
    data = [(i, t) for i, t in enumerate(own)]
    got = rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == sorted(brute.near(data), key=repr)
    assert 12 < len({r[2] for r in got}) < len(own)


def test_small_tiles(docs, texts, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 2)
    assert rows(minhash.near_duplicates(docs)) == sorted(brute.near(texts), key=repr)


def test_odd_ids(spark):
    t = prose(3, 50)
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (-3, t), (None, None), (7, None)], "doc_id long, text string")
    assert rows(minhash.near_duplicates(df), "doc_id", "component_id", "kept") == sorted([(5, -3, False), (5, -3, False), (-3, -3, True), (None, None, True), (None, None, True), (7, 7, True)], key=repr)


def test_empty(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(1)
    for n in (7, 40, 400, 5000):
        w = [f"w{i}" for i in range(n + 4)]
        x = list(w)
        for i in rng.choice(n, max(1, n // 60), replace=False):
            x[i] += "!"
        h, first = minhash.shingles(Words(pa.array([" ".join(w), " ".join(x)])))
        a, b = set(h[first[0] : first[1]].tolist()), set(h[first[1] :].tolist())
        one, two = minhash.bands(h, first, 2000, 1)
        assert abs((one == two).mean() - len(a & b) / len(a | b)) < 0.05


@pytest.mark.parametrize("hub", [100, 1])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 201), (201, 203), (203, 205)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {i: 201 for i in (201, 203, 205)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
