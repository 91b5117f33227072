from kgspark.operators.hierarchy import canonical_id, descendants, hierarchy, resolve_parents

CARD = "zettel_id string, user_id string, luhmann_id string, parent_id string, parent_luhmann_id string"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_resolve_all_ways(spark):
    c = spark.createDataFrame(
        [
            ("A1", "u", "1", None, None),
            ("b2", "u", "1.1", "{a1}", None),  # by id, other spelling
            ("b2", "u", "1.1", "{a1}", None),  # the same row again
            ("c3", "u", "1.1a", "nan", "1.1"),  # by the parent's hierarchical id
            ("d4", "u", "1.1a1", "NULL", ""),  # by the own id
            ("e5", "u", "9", " ", None),  # a bare number
            ("f6", "u", "2.1", None, None),  # parent 2 is missing
            ("g7", "v", "1.1", None, "1"),  # other tenant: lost
            ("h8", "v", None, "b2", None),  # belongs to another tenant: lost
            ("i9", None, None, None, None),
            (None, "u", "3", None, None),
        ],
        CARD,
    )
    got = rows(resolve_parents(c), "id", "parent", "lost")
    assert got == sorted([("A1", None, False), ("b2", "A1", False), ("c3", "b2", False), ("d4", "c3", False), ("e5", None, False), ("f6", None, True), ("g7", None, True), ("h8", None, True), ("i9", None, False)], key=repr)


def test_states_paths_and_clashing_columns(spark):
    e = spark.createDataFrame(
        [("r", None, False, "x"), ("a", "r", False, "x"), ("b", "a", False, "x"), ("l", None, True, "x"), ("m", "l", False, "x"), ("s", "s", False, "x"), ("t", "s", False, "x"), ("p", "q", False, "x"), ("q", "p", False, "x"), ("w", "t", False, "x")],
        "id string, parent string, lost boolean, path string",
    )
    t = hierarchy(e.select("id", "parent", "lost"))
    got = {r.id: (r.root, r.depth, r.status, r.path) for r in t.collect()}
    assert got["b"] == ("r", 2, "tree", ["r", "a", "b"])
    assert got["m"][:3] == ("l", 1, "detached")
    assert got["s"][2] == "on_cycle" and got["p"][2] == "on_cycle" and got["q"][:2] == (None, -1)
    assert got["t"][2] == "below_cycle" and got["w"][2] == "below_cycle"
    assert rows(descendants(t), "ancestor", "descendant", "distance") == [("a", "b", 1), ("l", "m", 1), ("r", "a", 1), ("r", "b", 2)]


def test_deep_chain_and_hot_parent(spark):
    deep = [("n0", None, False)] + [(f"n{i}", f"n{i - 1}", False) for i in range(1, 40)]
    hot = [("h", None, False)] + [(f"k{i}", "h", False) for i in range(300)] + [("z", "k7", False)]
    t = hierarchy(spark.createDataFrame(deep + hot, "id string, parent string, lost boolean"), hot_children=100, splits=4)
    d = {r.id: r.depth for r in t.collect()}
    assert d["n39"] == 39 and d["z"] == 2 and len(d) == len(deep) + len(hot)


def test_very_deep_chain(spark):
    n = 100_000
    e = spark.range(n).selectExpr("cast(id AS string) AS id", "CASE WHEN id > 0 THEN cast(id - 1 AS string) END AS parent", "false AS lost")
    t = hierarchy(e, with_path=False)
    assert t.where("depth = cast(id AS bigint) AND root = '0' AND status = 'tree'").count() == n


def test_long_tails_below_cycles(spark):
    e = [("a", "b", False), ("b", "a", False), ("t0", "a", False)] + [(f"t{i}", f"t{i - 1}", False) for i in range(1, 60)] + [("x", None, False)]
    t = hierarchy(spark.createDataFrame(e, "id string, parent string, lost boolean"))
    got = {r.id: (r.depth, r.status) for r in t.collect()}
    assert got["a"] == got["b"] == (-1, "on_cycle") and got["x"] == (0, "tree")
    assert all(got[f"t{i}"] == (-1, "below_cycle") for i in range(60)) and len(got) == len(e)


def test_empty(spark):
    t = hierarchy(resolve_parents(spark.createDataFrame([], CARD)))
    assert t.count() == 0 and descendants(t).count() == 0


def test_id_spellings(spark):
    c = spark.createDataFrame([("{AB-1}",), (" ab-1 ",), ("urn:uuid:AB-1",), ("None",), ("",), (None,)], "x string")
    assert [r[0] for r in c.select(canonical_id(c.x)).collect()] == ["ab-1", "ab-1", "ab-1", None, None, None]
