import time

import numpy as np

from kgspark.llm import neighbours as n


def make(spark, x, ids=None):
    rows = [(ids[i] if ids else f"v{i:05d}", None if v is None else [float(a) for a in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "zettel_id string, embedding array<float>, updated_at int")
    return n.usable(df, "zettel_id", "embedding", "updated_at", 64)


def truth(x, k=3):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1)[:, :k]


def test_recall(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(60, 64))
    x = c[rng.integers(0, 60, 3000)] + 0.25 * rng.normal(size=(3000, 64))
    got = {}
    for r in n.nearest(make(spark, x)).collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
    want = truth(x)
    recall = np.mean([len(got.get(i, set()) & set(want[i].tolist())) / 3 for i in range(3000)])
    assert recall >= 0.95 and all(len(v) == 3 for v in got.values()) and len(got) == 3000


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 8)).astype(np.float32)
    t = n.Tree(x, 10)
    seen = t.visit(x[:50], t.leaves)
    assert all(sorted(r.tolist()) == list(range(t.leaves)) for r in seen)
    first = t.visit(x, 1)[:, 0]
    assert len(np.unique(first)) > 0.8 * t.leaves


def test_unusable_and_repeated_vectors(spark):
    one = np.ones(64)
    bad = one.copy()
    bad[3] = np.nan
    x = [one, 2 * one, None, np.zeros(64), np.ones(10), bad, -one, one]
    got = sorted((r.id, r.other) for r in n.nearest(make(spark, x, ["a", "b", "c", "d", "e", "f", "g", "a"])).collect())
    assert got == [("a", "b"), ("a", "g"), ("b", "a"), ("b", "g"), ("g", "a"), ("g", "b")]


def test_equal_vectors_take_the_smallest_ids(spark):
    rng = np.random.default_rng(3)
    x = [np.ones(64)] * 40 + list(rng.normal(size=(60, 64)))
    got = {}
    for r in n.nearest(make(spark, x)).collect():
        got.setdefault(r.id, []).append(r.other)
    assert all(len(v) == 3 for v in got.values()) and len(got) == 100
    assert sorted(got["v00039"]) == ["v00000", "v00001", "v00002"] and sorted(got["v00000"]) == ["v00001", "v00002", "v00003"]


def test_few_or_no_vectors(spark):
    assert n.nearest(make(spark, [np.ones(64)])).count() == 0
    assert n.nearest(make(spark, [np.ones(64)]).limit(0)).count() == 0


def test_large_leaves_get_trees_of_their_own(spark):
    """A tree fitted on some 100 rows has a dozen leaves; recall holds and most of the products are saved."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=(400, 64))
    x = c[rng.integers(0, 400, 8000)] + 0.25 * rng.normal(size=(8000, 64))
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert sum(len(a) * len(p) for a, p in n._pieces(y, y[:800], 4, 1000)) < 0.5 * 8000 * 800
    got = {}
    for r in n.nearest(make(spark, x), most=100, split=500).collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
    want = truth(x)
    assert np.mean([len(got[i] & set(want[i].tolist())) / 3 for i in range(8000)]) >= 0.98


def test_cost_of_more_leaves_does_not_jump():
    """From 64 leaves on the queue of a query used to be as wide as the tree."""
    x = np.random.default_rng(1).normal(size=(12_000, 64)).astype(np.float32)
    t = n.Tree(x, 8)

    def cost(visits):
        began = time.process_time()
        t.visit(x[:1000], visits)
        return time.process_time() - began

    assert min(cost(72) for _ in range(3)) < 2 * min(cost(56) for _ in range(3))


def test_top_of_many_columns():
    s = np.random.default_rng(6).normal(size=(50, 1003)).astype(np.float32)
    for k in (1, 4, 9, 40):
        assert (np.sort(np.take_along_axis(s, n._top(s, k), axis=1)) == np.sort(s)[:, -k:]).all()


def test_recall_with_few_sample_rows_a_leaf(spark):
    """Leaves made of some 8 rows: the queries calibrated on are not among these, and no pair is returned twice."""
    rng = np.random.default_rng(8)
    c = rng.normal(size=(1500, 64))
    x = np.repeat(c, 8, axis=0) + 0.25 * rng.normal(size=(12_000, 64))
    got = n.nearest(make(spark, x), most=800).collect()
    pairs = {(int(r.id[1:]), int(r.other[1:])) for r in got}
    want = truth(x)
    assert len(pairs) == len(got) == 36_000
    assert np.mean([(i, j) in pairs for i in range(12_000) for j in want[i]]) >= 0.99
