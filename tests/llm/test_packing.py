import random
from collections import defaultdict

import numpy as np
import pytest

from kgspark.llm import packing as p


def check(rows, caps, sizes):
    """Every item whole in one container, long ones cut into full pieces and a rest; no container overfull."""
    used, got = defaultdict(int), defaultdict(int)
    for r in rows:
        used[r.kind, r.container] += r.size
        got[r.kind, r.id] += r.size
    assert all(v <= caps[k] for (k, _), v in used.items())
    assert {(k, i): n for k in caps for i, n in sizes.items()} == dict(got)
    return defaultdict(int, {k: sum(1 for x in used if x[0] == k) for k in caps})


def test_pack_and_bounds(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 5, 60, 100, 130, 260, 700]) for i in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "id bigint, n_tokens bigint")
    caps = {0: 128, 1: 512}
    rows = p.number(p.pack(df, caps, per_partition=500)).collect()
    n = check(rows, caps, sizes)
    for k, cap in caps.items():
        least = -(-sum(sizes.values()) // cap)
        rest = np.array([s - cap * max(0, (s - 1) // cap) for s in sizes.values()])
        full = sum(max(0, (s - 1) // cap) for s in sizes.values())
        assert n[k] >= max(least, full + p.lower_bound(rest, cap)) and n[k] <= 1.05 * max(least, full + p.lower_bound(rest, cap)) + 2


def test_exchange_closes_gaps(spark):
    """Partitions that each keep a nearly empty container hand their rests together."""
    sizes = {i: 60 for i in range(40)}
    df = spark.createDataFrame(list(sizes.items()), "id bigint, n_tokens bigint")
    caps = {0: 600}
    n = check(p.number(p.pack(df, caps, per_partition=7)).collect(), caps, sizes)
    assert n[0] <= 6


@pytest.mark.parametrize("cap", [10, 97, 512])
def test_lower_bound_is_a_lower_bound(cap):
    rng = np.random.default_rng(cap)
    for _ in range(30):
        s = rng.integers(0, cap + 1, rng.integers(1, 60))
        place, free = p.best_fit_decreasing(s, cap)
        assert p.lower_bound(s, cap) <= len(free)
        assert all(s[place == i].sum() + f == cap for i, f in enumerate(free))


def test_bound_sees_more_than_volume():
    assert p.lower_bound(np.array([60] * 10), 100) == 10


def test_edges(spark):
    t = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "слово " * 3000, 9), (3, "слово", 9), (None, "x", 9)], "doc_id bigint, text string, n_tokens int")
    n = {r.id: r.n_tokens for r in p.token_counts(t, "doc_id", "text").groupBy("id").max("n_tokens").withColumnRenamed("max(n_tokens)", "n_tokens").collect()}
    assert n[1] == n[2] == 0 and n[3] > 1000 and None not in n
    caps = {0: 64}
    rows = p.number(p.pack(p.token_counts(t, "doc_id", "text"), caps)).collect()
    check(rows, caps, n)
    assert p.pack(p.token_counts(t.limit(0), "doc_id", "text"), caps).count() == 0


def test_exact_capacity_fills_one(spark):
    df = spark.createDataFrame([(1, 64), (2, 128), (3, 65)], "id bigint, n_tokens bigint")
    rows = p.number(p.pack(df, {0: 64})).collect()
    assert sorted((r.id, r.piece, r.size) for r in rows) == [(1, 0, 64), (2, 0, 64), (2, 1, 64), (3, 0, 64), (3, 1, 1)]


def test_bound_tries_every_threshold():
    """3,000 items of 6,000 need a container each; no item of 4,001 fits beside them."""
    sizes = np.repeat([6000, 4001], 3000)
    assert p.lower_bound(sizes, 10_000) >= 4201


def test_rounds_go_on_while_they_save(spark, monkeypatch):
    deals, deal = [], p._deal
    monkeypatch.setattr(p, "_deal", lambda *a: deals.append(1) or deal(*a))
    rng = random.Random(3)
    sizes = {i: rng.randint(150, 480) for i in range(2400)}
    df = spark.createDataFrame(list(sizes.items()), "id bigint, n_tokens bigint")
    check(p.number(p.pack(df, {0: 1000}, per_partition=40)).collect(), {0: 1000}, sizes)
    assert len(deals) > 5


def test_bounds_of_counts_and_certificates(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 100, 500)
    s, n = np.unique(sizes, return_counts=True)
    assert p.lower_bound(sizes, 100) == p.lower_bound(s, 100, n) >= -(-sizes.sum() // 100)
    df = spark.createDataFrame([(i, 60) for i in range(7)] + [(9, 40)], "id bigint, n_tokens bigint")
    packed = p.pack(df, {0: 100, 1: 200})
    assert {r.kind: r.bound for r in p.certificates(packed, {0: 100, 1: 200}).collect()} == {0: 7, 1: 3}
