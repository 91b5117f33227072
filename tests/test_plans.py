from pyspark.sql import functions as F

from kgspark import providers
from kgspark.operators import assign, graph, oplog
from kgspark.operators.metrics import linking as lm
from kgspark.plans import linking, retrieval

THOUGHT = "note_id string, pos int, content string, thought_type string, tags array<string>, parent_hint string, is_root_topic boolean"


def test_build_cards(spark):
    t = spark.createDataFrame(
        [
            ("n", 0, "Root one.", "fact", ["A b"], None, True),
            ("n", 1, "Child", "fact", None, "Root one.", False),
            ("n", 2, "Grandchild.", "fact", [], "Child", False),  # quote of an uncleaned text: nulled, so a root
            ("n", 3, "Second child.", "idea", None, "Root one.", False),
            ("n", 4, "  ", "idea", None, None, False),
            ("n", 5, "Self.", "idea", None, "Self.", False),
            ("m", 0, "No root flagged.", "fact", None, None, None),
        ],
        THOUGHT,
    )
    got = {(r.note_id, r.pos): (r.luhmann_id, r.content, r.is_root_topic) for r in linking.build_cards(linking.validated(t)).collect()}
    assert got == {("n", 0): ("1", "Root one.", True), ("n", 1): ("1.1", "Child.", False), ("n", 2): ("2", "Grandchild.", True), ("n", 3): ("1.2", "Second child.", False), ("n", 5): ("3", "Self.", True), ("m", 0): ("1", "No root flagged.", True)}


def test_fold_reads_its_own_writes(spark):
    v = lambda *x: [float(i) for i in x]
    c = spark.createDataFrame([("u", 1, "a", None, v(1, 0)), ("u", 2, "b", None, v(0.8, 0.6)), ("u", 3, "c", "b", None), ("u", 4, "d", None, v(1, 0)), ("u", 5, "e", "zz", v(0, -1)), ("w", 1, "f", None, v(1, 0))], "user_id string, seq bigint, zettel_id string, parent_id string, embedding array<double>")
    got = {r.zettel_id: (r.action, r.target_id, r.luhmann_id) for r in linking.fold(c, providers.threshold_decider).collect()}
    assert got == {"a": ("new_root", None, "1"), "b": ("child_of", "a", "1.1"), "c": ("child_of", "b", "1.1a"), "d": ("update_of", "a", "1"), "e": ("new_root", None, "2"), "f": ("new_root", None, "1")}


def test_oplog(spark):
    card = "seq bigint, user_id string, zettel_id string, parent_id string, luhmann_id string, content string, thought_type string, tags array<string>"
    cards = spark.createDataFrame([(1, "u", "a", None, "1", "x", "fact", ["t", "only"]), (2, "u", "b", "a", "1.1", "y", "fact", ["T"]), (3, "u", "c", "zz", "9", "z", "fact", None), (4, "v", "d", None, "1", "q", "fact", ["t"])], card)
    ops = oplog.created(cards)
    assert ops.count() == 3  # the child of an unknown parent is created nowhere
    ch = spark.createDataFrame([(5, "u", "b", "new"), (6, "u", "nope", "new")], "seq bigint, user_id string, zettel_id string, content string")
    ops = ops.unionByName(oplog.updated(ch, ops))
    view = oplog.current(ops)
    assert {r.zettel_id: (r.content, r.luhmann_id) for r in view.collect()} == {"a": ("x", "1"), "b": ("new", "1.1"), "d": ("q", "1")}
    gone = oplog.cascade(view, view.where("zettel_id = 'a'"))
    rep = oplog.deletion_report(view, gone).head()
    assert (rep.deleted_count, rep.removed_entities, rep.luhmann_id) == (2, 2, "1")
    left = oplog.current(ops.unionByName(oplog.tombstones(gone, 9)))
    assert [r.zettel_id for r in left.collect()] == ["d"]


def test_related_hops_zero_and_limit(spark):
    e = spark.createDataFrame([("u", "a", "b"), ("u", "b", "c"), ("u", "b", "a"), ("v", "a", "x")], "user_id string, a_id string, b_id string")
    assert graph.related(e, 0, 10).count() == 0
    got = [(r.other_id, r.ord) for r in graph.related(e, 2, 10).where("user_id = 'u' and zettel_id = 'a'").orderBy("ord").collect()]
    assert got == [("b", 1), ("c", 2)]


def test_next_children(spark):
    have = spark.createDataFrame([("u", "1", 26)], "user_id string, parent_luhmann string, n_last int")
    new = spark.createDataFrame([("u", "1", 1, "a"), ("u", "1", 2, "b"), ("u", None, 1, "c")], "user_id string, parent_luhmann string, seq int, key string")
    got = {r.key: r.luhmann_id for r in assign.next_children(have, new).collect()}
    assert got == {"a": "1.27", "b": "1.28", "c": "1"}


def test_constant_histograms_have_no_similarity(spark):
    r = spark.createDataFrame([(1, "new_root", "1", 1.0)], "seq bigint, action string, luhmann_id string, latency_sec double")
    assert lm.structure_similarity(r, r).head()[0] == 0.0
    assert lm.structure_similarity(r.limit(0), r.limit(0)).head()[0] == 0.0


def test_empty_context_needs_no_model(spark):
    c = spark.createDataFrame([("q1", ""), ("q2", "FACT:\n- x"), ("q3", None)], "query_id string, context string")

    def boom(_):
        raise ValueError

    got = {r.query_id: (r.answer, r.status) for r in providers.answers(c, boom).collect()}
    assert got == {"q1": (providers.NO_CONTEXT, "empty"), "q2": (None, "error: ValueError"), "q3": (providers.NO_CONTEXT, "empty")}


def test_context_paths_are_bounded(spark, data):
    from kgspark.queries_plans import context_paths

    assert context_paths(spark, data).agg(F.max("ord")).head()[0] <= 5
    assert retrieval.ROLES["entry"] == 0


def test_embeddings_are_deterministic(spark):
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string")
    got = [r.v for r in providers.embedded(df, "t", "v", providers.hashed_embedder).collect()]
    assert got[0] == got[2] and got[1] is None and len(got[0]) == 64


def test_judges_and_readers(spark):
    r = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "wild")], "id string, prompt string")

    def make():
        def judge(t):
            if t == "bad":
                raise TimeoutError
            return {"x": 2.0 if t == "wild" else 0.5}

        return judge

    got = {r.id: (r.x, r.status) for r in providers.judged(r, "prompt", ["x"], make).collect()}
    assert got == {"a": (0.5, "ok"), "b": (None, "error: TimeoutError"), "c": (None, "error: ValueError")}
    f = spark.createDataFrame([("p.txt", b"hi", "txt"), ("p.pdf", b"x", "pdf"), ("p.doc", b"x", "unsupported")], "path string, content binary, reader string")
    pages = {(r.path, r.page): (r.text, r.status) for r in providers.read_documents(f, {"pdf": lambda b: [("one", []), ("two", ["|t|"])]}).collect()}
    assert pages == {("p.txt", 1): ("hi", "ok"), ("p.pdf", 1): ("one", "ok"), ("p.pdf", 2): ("two", "ok"), ("p.doc", 0): (None, "unsupported")}


def test_build_cards_keeps_long_chains(spark):
    """Every thought quotes the one before: more levels than 32."""
    rows = [("n", i, f"thought number {i}", "fact", [], f"thought number {i - 1}" if i else None, i == 0) for i in range(36)]
    t = spark.createDataFrame(rows, "note_id string, pos int, content string, thought_type string, tags array<string>, parent_hint string, is_root_topic boolean")
    got = {r.pos: r.parent_temp for r in linking.build_cards(t).collect()}
    assert got == {i: f"n#{i - 1}" if i else None for i in range(36)}


def test_borderline_matches_are_verified(spark):
    rows = [("q", "a", 0.9, "x", "y"), ("q", "b", 0.5, "plan", "the plan"), ("q", "c", 0.5, "plan", "other"), ("q", "d", 0.5, "boom", "z"), ("q", "e", 0.2, "plan", "the plan"), ("q", "f", None, "plan", "the plan")]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, question string, content string")

    def make():
        def verify(question, content):
            if question == "boom":
                raise TimeoutError
            return question in content

        return verify

    got = {r.id: (r.relevant, r.status) for r in providers.annotated(df, make, 0.6, 0.45).collect()}
    assert got == {"a": (True, "score"), "b": (True, "verified"), "c": (False, "verified"), "d": (False, "error: TimeoutError"), "e": (False, "score"), "f": (False, "score")}


def test_batch_run_times_cards_and_skips_failures(spark):
    notes = spark.createDataFrame([("n1", "one. two."), ("n2", "boom"), ("n3", None), ("n4", "three.")], "note_id string, text string")

    def make():
        def split(t):
            if t == "boom":
                raise ValueError
            return [{"content": x.strip(), "thought_type": "fact", "tags": ["t"], "is_root_topic": True} for x in t.split(".") if x.strip()]

        return split

    rows = providers.batch_run(notes, make).collect()
    assert sorted((r.note_id, r.pos, r.content, r.cards_count) for r in rows) == [("n1", 0, "one", 2), ("n1", 1, "two", 2), ("n4", 0, "three", 1)]
    assert all(abs(r.latency_ms_per_card - r.latency_ms_total / r.cards_count) <= 0.011 for r in rows)


def test_tenants_never_see_each_other(spark):
    """The same notes for two tenants: search, expansion and deletion stay within one."""
    from kgspark.operators import vector

    z = spark.createDataFrame([(u, f"{u}{i}", str(i), f"note {i}", [1.0, float(i)]) for u in "uv" for i in range(4)], "user_id string, zettel_id string, luhmann_id string, content string, embedding array<double>")
    e = spark.createDataFrame([(u, f"{u}{i}", f"{u}0") for u in "uv" for i in (1, 2)], "user_id string, child_id string, parent_id string")
    r = spark.createDataFrame([("u", "u0", "u3")], "user_id string, a_id string, b_id string")
    q = z.where("zettel_id = 'u1'").select(F.col("zettel_id").alias("query_id"), F.col("embedding").alias("q"), "user_id")
    hits = vector.search(q, z.select(F.col("zettel_id").alias("id"), F.col("embedding").alias("v"), "user_id"), 5, 0.0, ["user_id"])
    assert {h.id for h in hits.collect()} == {"u0", "u2", "u3"}
    entries = hits.select("query_id", F.lit("u").alias("user_id"), F.col("id").alias("zettel_id"), F.col("rank").alias("entry_rank"))
    assert all(x.zettel_id.startswith("u") for x in retrieval.expand(entries, z, e, r, 1).collect())
    view = z.select("user_id", "zettel_id").join(e.withColumnRenamed("child_id", "zettel_id"), ["user_id", "zettel_id"], "left")
    gone = oplog.cascade(view, z.where("zettel_id = 'u0'").select("user_id", "zettel_id"))
    assert {x.zettel_id for x in gone.collect()} == {"u0", "u1", "u2"}
