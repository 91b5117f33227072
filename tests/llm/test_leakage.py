from kgspark.llm import leakage as k

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def rows(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, question string, reference_answer string, text string")
    return sorted(tuple(r) for r in k.leaks(d, i, **kw).collect())


def test_passages_and_offsets(spark):
    text = "Intro. ONE, two\n- three (four) «five» six; seven eight nine... ten eleven! End ten"
    got = rows(spark, [(1, text, "x"), (2, "one two three four five six seven eight nine", "x"), (3, None, "x"), (4, "", "x")], [(7, "One two three four", "five six seven eight nine ten eleven twelve", "x")])
    assert [(d, i, n) for d, i, _, _, n in got] == [(1, 7, 11)]
    assert text[got[0][2] : got[0][3]].startswith("ONE") and text[got[0][2] : got[0][3]].endswith("eleven")


def test_across_the_blank_yo_and_blocks(spark):
    items = [(1, "а ё в г д", "е ж з и к л", "x"), (2, ITEM, None, "x"), (3, "short", "item", "x"), (None, ITEM, "", "x")]
    docs = [(1, "А Е в г д е ж з и к", "x"), (2, f"pre {ITEM} post {ITEM}", "x"), (2, f"pre {ITEM} post {ITEM}", "x")]
    got = {(d, i) for d, i, *_ in rows(spark, docs, items, max_item_chars=20)}
    assert got == {(1, 1), (2, 2)}


def test_long_text_and_empty_tables(spark):
    assert {(d, i) for d, i, *_ in rows(spark, [(5, "x " * 300_000 + ITEM, "x")], [(2, ITEM, "", "x")])} == {(5, 2)}
    assert rows(spark, [], [(2, ITEM, "", "x")]) == [] and rows(spark, [(1, ITEM, "x")], []) == []


def test_offsets_where_lower_case_is_longer(spark):
    text = "İİİ İstanbul " + ITEM.replace("four", "FOUR") + " end"
    (got,) = rows(spark, [(1, text, "x")], [(2, ITEM, "", "x")])
    assert text[got[2] : got[3]] == ITEM.replace("four", "FOUR")
