import json

from pyspark.sql import functions as F

from kgspark.sources import files


def test_text_pages_and_maps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\r\ny")
    assert files.text_files(spark, str(tmp_path / "a.txt")).head().content == "x\ny"
    p = spark.createDataFrame([("d", 2, "two", []), ("d", 1, "one", ["|t1|", "|t2|"])], "path string, page int, text string, tables array<string>")
    assert files.joined_pages(p).head().content == "--- page 1 ---\none\n|t1|\n|t2|\n\n--- page 2 ---\ntwo"
    (tmp_path / "m.json").write_text(json.dumps({"n1": ["a", "b"], "n2": []}))
    assert sorted(map(tuple, files.note_map(spark, str(tmp_path / "m.json")).collect())) == [("n1", "a"), ("n1", "b")]


def test_model_files(spark, tmp_path):
    for n in ("test_alpha.csv", "test_beta_backup.csv"):
        (tmp_path / n).write_text("k,v\n1,2\n")
    got = files.model_files(spark, str(tmp_path / "*.csv"), "backup", "k int, v int").collect()
    assert [(r.k, r.v, r.model) for r in got] == [(1, 2, "alpha")]


def test_samples_and_pools(spark):
    n = spark.createDataFrame([(f"n{i}", "text") for i in range(20)], "note_id string, note_text string")
    a, b = (sorted(r.note_id for r in files.backup_questions(n, 5).collect()) for _ in range(2))
    assert a == b and len(a) == 5
    got = {r.key: r["count"] for r in files.weighted_pool(spark, {"a": 0.55, "b": 0.45}, 11).groupBy("key").count().collect()}
    assert sum(got.values()) == 11
    assert files.synthetic_notes(spark, 30, ["x", "y"], ["s"]).where(F.col("num_sentences").between(3, 10)).count() == 30


def test_tables_and_statements(spark):
    files.create_tables(spark, "kgspark_test")
    files.create_tables(spark, "kgspark_test")
    assert files.run(spark, "SELECT :a + 1 AS x", a=2).head().x == 3
    files.clear_messages(spark, "kgspark_test")
    assert spark.table("kgspark_test.history_messages").count() == 0
    spark.sql("DROP DATABASE kgspark_test CASCADE")


def test_items_and_reports(spark, tmp_path):
    c = spark.createDataFrame([("n", "2", "b", "y", "fact"), ("n", "1", "a", "x", "fact")], "note_id string, luhmann_id string, zettel_id string, content string, thought_type string")
    item = json.loads(files.dataset_items(c).head().item)
    assert [e["luhmann_id"] for e in item["expected"]] == ["1", "2"]
    r = files.report_rows(spark.createDataFrame([("m", 1)], "model string, n int"), "s")
    assert tuple(r.head()) == ("s", "m.n", "1")
    files.write_report(r, str(tmp_path / "rep"))
    assert files.missing_columns(r, ["section", "nope"]) == ["nope"]
