"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import graph, neardup


def brute(docs, t=0.8):
    sets = {}
    for k, (i, text) in enumerate(docs):
        s = next(iter(neardup.shingle_sets([text])))
        sets[k] = (i, frozenset(s.tolist()), text or "")
    n = len(docs)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(n):
            sa, sb = sets[a][1], sets[b][1]
            same = (sa == sb and (sa or sets[a][2] == sets[b][2]))
            near = same or (sa and sb and len(sa & sb) >= t * len(sa | sb) - 1e-9)
            if a != b and near:
                links[a] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {sets[k][0]: (min(sets[x][0] for x in range(n) if root(x) == root(k)), links[k]) for k in range(n)}


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split()
            for _ in range(r.randrange(0, 6)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 8, 30, 70, 90, 200]))))
    return list(enumerate([*out, "", None, "***", "***", "Same words, here", "same WORDS here"]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    out = neardup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == brute(docs)


def test_large_groups_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_DOCS", 7)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    docs = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        docs.append((k, " ".join(w)))
    out = neardup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in out} == brute(docs)


def test_overlaps_dense_and_sparse():
    r = np.random.default_rng(3)
    sets = [np.unique(r.choice(np.arange(200, dtype=np.uint64), size=r.integers(0, 80))) for _ in range(90)]
    got = neardup.overlaps(sets)
    for a in range(90):
        for b in range(90):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    for n in (5, 12, 40, 66, 85, 300):
        for _ in range(40):
            x = r.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2)
            i = int(np.ceil(0.8 * n))
            k = int(r.integers(0, n - i + 1))
            a, b = np.sort(np.concatenate([x[:i], x[i:i + k]])), np.sort(np.concatenate([x[:i], x[i + k:]]))
            assert np.intersect1d(neardup.bands(a), neardup.bands(b)).size


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b"), (2, None)], "doc_id long, text string")
    out = neardup.jaccard_join(df).collect()
    assert len(out) == 4 and {r["doc_id"] for r in out} == {1, 2, None}
    assert neardup.jaccard_join(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neardup.jaccard_join(df, threshold=0.5)


def test_null_ids_are_linked(spark):
    w = [f"w{k}" for k in range(60)]
    docs = [(9, " ".join(w)), (None, " ".join([*w, "x"])), (None, " ".join([*w, "x"])), (None, " ".join(["y", *w])), (None, "else"), (4, None), (None, None)]
    out = neardup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] is None, x["class_id"] if x["class_id"] < 1 << 62 else -1, x["n_links"]) for x in out) == [(False, 4, 1), (False, 9, 3), (True, -1, 0), (True, 4, 1), (True, 9, 3), (True, 9, 3), (True, 9, 3)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    out = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert out == {x: root(x) for x in list(parent)}


def test_few_long_copies_are_counted_once(spark, monkeypatch):
    """Blocks that stay empty leave tiles (i, j) with one side; its pairs belong to tile (i, i)."""
    monkeypatch.setattr(neardup, "TILE_SHINGLES", 50)
    docs = []
    for k in range(8):
        w = [f"w{k}x{i}" for i in range(150)]
        docs += [(3 * k + j, " ".join([*w, *(f"y{j}" for _ in range(j))])) for j in range(3)]
    out = neardup.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["class_id"], x["n_links"]) for x in out} == brute(docs)
