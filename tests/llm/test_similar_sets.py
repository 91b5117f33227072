import inspect
import math
import random

import numpy as np

from kgspark.llm import similar_sets as s


def brute(texts, least):
    import re

    sets = {k: frozenset(re.findall(r"[^\W_]+", (t or "").lower().replace("ё", "е"))) for k, t in texts}
    keys = sorted(k for k, w in sets.items() if len(w) >= 8)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-12}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rng.shuffle(w)
        else:
            w = rng.sample(words, rng.randint(9, 40))
        out.append((f"k{i:04d}", " ".join(w)))
    return out


def found(spark, rows, extra=()):
    df = spark.createDataFrame([(k, t, 1, *extra) for k, t in rows], "zettel_id string, content string, updated_at int")
    m = s.set_classes(df, "zettel_id", "content", "updated_at", 8)
    return {(r.key_a, r.key_b) for r in s.similar_pairs(m, s.similar_classes(m, 0.7)).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    got, want = found(spark, rows), brute(rows, 0.7)
    assert got <= want and len(got) >= 0.99 * len(want) > 50


def test_boundary_copies_nulls_and_case(spark):
    base = "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1".split()
    rows = [("x", " ".join(base)), ("y", " ".join(base[:7])), ("z", " ".join(base[:8])), ("c", ", ".join(reversed(base)).upper()), ("n", None), ("b", "  "), ("v", "ё" + " ".join(base)), ("x", " ".join(base))]
    got = found(spark, rows)
    assert ("c", "x") in got and ("x", "z") in got and not any("n" in p or "b" in p or "y" in p for p in got)


def test_many_near_copies_of_one_text(spark):
    """A node that no further word splits: nearly equal sets, in the salted comparison."""
    base = [f"b{i}" for i in range(60)]
    rows = [(f"k{i:03d}", " ".join([*base, f"u{i}"])) for i in range(120)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "zettel_id string, content string, updated_at int")
    m = s.set_classes(df, "zettel_id", "content", "updated_at", 8)
    got = s.similar_pairs(m, s.similar_classes(m, 0.7, leaf=10)).count()
    assert got >= 0.99 * 120 * 119 / 2


def test_empty(spark):
    assert found(spark, []) == set()


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("q", "q"), ("b", "a")], "u string, v string")
    assert {(r.v, r.root) for r in s.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    b[:60] = rng.integers(1, 2**63, 60, dtype=np.uint64)
    s0, s1 = s.sketches(np.concatenate([a, b]), np.array([0, 400, 800]))
    differ = int(np.bitwise_count(s0[0] ^ s0[1])) + int(np.bitwise_count(s1[0] ^ s1[1]))
    assert abs(1 - 2 * differ / 128 - 340 / 460) < 0.25


def test_sketch_bound_keeps_pairs_at_the_threshold():
    most = s._limits(0.7)[1]
    bits = 64 * sum(c.startswith("s") for c in s._NODE.split(", "))
    lost = sum(math.comb(bits, k) * 0.15**k * 0.85 ** (bits - k) for k in range(most + 1, bits + 1))
    assert lost < 0.0005


def test_trees_keep_pairs_at_the_threshold_six_words_deep():
    """Sets of 20 words and 14 of them: similarity 0.7 in the shape that has the fewest common paths."""
    trees = inspect.signature(s.similar_classes).parameters["trees"].default
    n, rng = 2000, np.random.default_rng(1)
    words = rng.integers(1, 2**63, (n, 20), dtype=np.uint64)
    values, off = np.concatenate([words.ravel(), words[:, :14].ravel()]), np.append(np.arange(n) * 20, n * 20 + np.arange(n + 1) * 14)
    met = np.zeros(n, bool)
    for seed in s._seeds(trees):
        path, own = np.full(2 * n, seed, np.uint64), np.arange(2 * n)
        for _ in range(6):
            path, own = s._branch(path, own, values, off, 0.7 * 0.94)
        left, right = own < n, own >= n
        both = set(zip(path[left].tolist(), own[left].tolist(), strict=True)) & set(zip(path[right].tolist(), (own[right] - n).tolist(), strict=True))
        met[[k for _, k in both]] = True
    assert met.mean() > 0.985


def test_large_classes_are_dealt_to_salts(spark):
    """One text held by a third of the rows, with near copies; the pairs are the same as undealt."""
    base = [f"w{i}" for i in range(20)]
    rows = [(f"c{i:03d}", " ".join(base)) for i in range(60)] + [(f"d{i:03d}", " ".join([*base[1:], f"x{i % 3}"])) for i in range(40)] + corpus(40)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "zettel_id string, content string, updated_at int")
    m = s.set_classes(df, "zettel_id", "content", "updated_at", 8)
    classes = s.similar_classes(m, 0.7)
    got = [(r.key_a, r.key_b) for r in s.similar_pairs(m, classes, many=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)
