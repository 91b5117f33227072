import math

from kgspark.llm import cooccurrence as c


def assoc(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "zettel_id string, tags array<string>, updated_at int, items int")
    return {(r.a, r.b): r for r in c.associations(c.baskets(df, "zettel_id", "tags", "updated_at"), **kw).collect()}


def test_counts_lift_and_pmi(spark):
    rows = [("1", ["A b", "c", "a-b", None, " "]), ("2", ["a_b", "c"]), ("3", ["d"]), ("4", None), ("5", []), ("6", [None]), ("1", ["A b", "c", "a-b", None, " "]), (None, ["a_b", "c"])]
    got = assoc(spark, rows)
    r = got["a_b", "c"]
    assert set(got) == {("a_b", "c")} and (r.n_ab, r.n_a, r.n_b, r.n) == (2, 2, 2, 3)
    assert math.isclose(r.lift, 1.5) and math.isclose(r.pmi, math.log2(1.5))


def test_thresholds_are_inclusive_and_long_baskets_whole(spark):
    rows = [(str(i), ["x", "y"]) for i in range(5)] + [("big", [f"t{i}" for i in range(200)])]
    got = assoc(spark, rows, min_pairs=5)
    assert set(got) == {("x", "y")}
    assert len(assoc(spark, rows)) == 1 + 200 * 199 // 2


def test_empty(spark):
    assert assoc(spark, []) == {}
