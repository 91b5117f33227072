from collections import Counter

import pytest

from kgspark.llm import pairs

FULL = [f"Отдел {x} готовит план отгрузок до {n} марта. Клиент доволен, срок {n} апреля." for n in range(1, 30) for x in ("продаж", "сервиса")]


def vocabulary(texts):
    words = Counter()
    for t in texts:
        found = pairs._LETTERS.findall(t.lower())
        words.update(found[:-1] if t and t[-1].isalpha() else found)
    return words


KNOWN = vocabulary([*FULL, "der Einkaufsplan ist fertig."])


@pytest.mark.parametrize(
    ("q", "a", "want"),
    [
        ("Какой срок?", None, "empty"),
        ("Какой срок?", " ​ \n", "empty"),
        ("Какой срок?", "<answer></answer>", "empty"),
        ("Какой срок?", "N/A", "empty"),
        ("Какой срок по плану?", "К сожалению, не могу помочь с этим запросом. Попробуйте спросить иначе.", "refusal"),
        ("What is the deadline for it?", "I'm afraid I must decline this request. Is there anything else?", "refusal"),
        ("Wie lautet die Frist?", "Leider darf ich dazu nichts sagen.", "refusal"),
        ("Какой срок по плану?", "Не могу не отметить риск. Клиент доволен, срок 3 апреля.", None),
        ("Какой срок по плану?", "Точной цифры нет, но картина такая. Клиент доволен, срок 3 апреля.", None),
        ("Какой срок по плану?", "какой срок по плану", "copies_question"),
        ("Какой срок по плану?", "Какой срок по плану? Какой срок по плану?", "copies_question"),
        ("Какой срок по плану?", "Какой срок по плану: Клиент доволен, срок 3 апреля.", None),
        ("Какой срок по плану?", "The client is happy and the team is ready for it.", "wrong_language"),
        ("Какой срок по плану? Ответь по-английски", "The client is happy and the team is ready for it.", None),
        ("Why did it change in the pilot?", "Die Abteilung möchte den Plan mit der Frist abgleichen.", "wrong_language"),
        ("Какой срок по плану?", "Клиент доволен, срок 3 апреля. (cf. \"the plan\")", None),
        ("Какой срок по плану?", "4 апреля", None),
        ("Какой срок по плану?", "63%", None),
        ("Какой срок по плану?", "Клиент доволен, срок 3 апреля", None),
        ("Какой срок по плану?", "короче пока тихо, план отгрузок лежит у отдела продаж с 17 апреля", None),
        ("Какой срок по плану?", "выходит Николай с 3 апреля, первый участок план отгрузок", None),
        ("What is the first job?", "joined in June, first job is the renewal contract", None),
        ("What changed in the pilot?", "the move takes 4 weeks because the staging rig was down", None),
        ("Was ist fertig?", "für den Standort ist der Einkaufsplan", None),
        ("Was ist fertig?", "für den Standort ist der Einkaufspl", "truncated"),
        ("Какой срок по плану?", "Отдел продаж готовит план отгр", "truncated"),
        ("Какой срок по плану?", "Отдел продаж готовит план отгрузок до", "truncated"),
        ("Какой срок по плану?", "Отдел продаж готовит пла…", "truncated"),
        ("Какой срок по плану?", "Отдел продаж готовит план (срок 3", "truncated"),
        ("Какие задачи?", "1. план отгрузок\n2. план мерча\n3.", "truncated"),
        ("Какие задачи?", "1. план отгрузок\n2. план отгрузок", None),
        (None, "Клиент доволен, срок 3 апреля.", None),
    ],
)
def test_defect(q, a, want):
    got = pairs.defects(q, a, KNOWN)
    assert (got[0] if got else None) == want


def test_table_edges(spark):
    df = spark.createDataFrame([("m", "1", None, None, 1), ("m", "2", "q?", "ok " * 100_000 + ".", 1), ("m", "2", "q?", "ok " * 100_000 + ".", 1)], "src string, row_key string, question string, answer string, defects int")
    got = sorted((r.row_key, r.defects) for r in pairs.pair_defects(df, pairs.word_counts(df)).collect())
    assert got == [("1", ["empty"]), ("2", []), ("2", [])]
    none = df.limit(0)
    assert pairs.pair_defects(none, pairs.word_counts(none)).count() == 0


def test_verdicts_do_not_depend_on_the_number_of_answers(spark):
    """A whole last word that is seen elsewhere, or begins no longer word, is whole in any table; a piece of a word is cut."""
    said = ["the team saw the warehouse plan."] * 3
    asked = ["after the talk the team saw the warehouse plan", "after the talk the team saw quoxil", "after the talk the team saw the wareho"]
    cols = "src string, row_key string, question string, answer string"
    own = spark.createDataFrame([("m", str(k), None, a) for k, a in enumerate(said + asked)], cols)
    more = spark.range(60_000).selectExpr("'f' AS src", "cast(id AS string) AS row_key", "cast(null AS string) AS question", "concat('note ', id, ' is done and filed.') AS answer")
    for df in (own, own.unionByName(more)):
        got = pairs.pair_defects(df, pairs.word_counts(df)).where("size(defects) > 0").collect()
        assert [(r.row_key, r.defects) for r in got] == [("5", ["truncated"])]


def test_joined_verdicts_equal_local_ones(spark):
    texts = [*FULL, *(t[:n] for t in FULL for n in (20, 33, 46, len(t) - 1)), "1. план отгрузок на год вперед\n2. план до", "1. план отгрузок на год вперед\n2. план отгрузок ую"]
    df = spark.createDataFrame([("m", str(k), None, a) for k, a in enumerate(texts)], "src string, row_key string, question string, answer string")
    known = vocabulary(texts)
    got = {r.row_key: r.defects for r in pairs.pair_defects(df, pairs.word_counts(df)).collect()}
    want = {str(k): pairs.defects(None, a, known) for k, a in enumerate(texts)}
    assert got == want and {"truncated"} < {x for v in want.values() for x in v or [""]}
