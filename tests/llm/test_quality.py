import numpy as np
import pytest

from kgspark.llm import quality, quality_fit

PROSE = "Команда собрала отзывы в филиале, и главный вывод такой: не хватило рук на приёмке. Решили повторно проверить план и вернуться к теме на демо."
CASES = [
    (PROSE, "prose"),
    ("короче пока тихо и мы ждём ответа от клиента до пятницы потому что он не готов", "prose"),
    ("We agreed to check the plan and to revisit the topic at the demo, as the client is not ready for it yet.", "prose"),
    ("- план отгрузок\n- отчёт подрядчиков;\n- реестр складских остатков\n- сверить график командировок\n- опрос наставничества (3 мая)", "list"),
    ("Список на неделю:\n" + "\n".join(f"{i}. {w}" for i, w in enumerate(("макет мерча", "тариф оттока", "разослать план найма", "журнал закупок", "бриф поставок", "портрет возвратов"), 1)), "list"),
    ("| маржа | выручка | срок |\n|---|---|---|\n" + "\n".join(f"| Проект{i} | {i}0% | 0{i}.05.2025 |" for i in range(1, 7)), "table"),
    ("маржа;выручка;отток\n" + "\n".join(f"Проект{i};{i}5%;0{i}.05.2025" for i in range(1, 7)), "table"),
    ("план мерча " * 40, "junk"),
    ("", "junk"),
    (None, "junk"),
    ("​ \n", "junk"),
]


@pytest.mark.parametrize(("text", "kind"), CASES)
def test_kinds(spark, text, kind):
    df = spark.createDataFrame([(text, "mine")], "text string, _parts string")
    row = quality.with_kind(df).head()
    assert row.kind == kind and row._parts == "mine"


def test_statistics(spark):
    df = spark.createDataFrame([("Это план, и он готов.\nДа",), ("a" * 100_000 + ".",), (None,)], "text string")
    a, b, c = (r.stats for r in quality.with_statistics(df).collect())
    assert (a.n_words, a.n_lines, a.end_punct_share) == (6, 2, 0.5)
    assert a.mean_word_len == pytest.approx(20 / 6 - 1 / 6 - 1 / 6, abs=0.4) and 0 < a.symbol_ratio < 0.2
    assert b.n_words == 1 and b.mean_word_len == 100_000
    assert (c.n_words, c.mean_word_len, c.common_share) == (0, 0.0, 0.0)


def test_empty_table(spark):
    assert quality.with_kind(spark.createDataFrame([], "text string")).count() == 0


def test_irep_learns_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = np.where(x[:, 0] > 0.7, "junk", np.where((x[:, 1] < 0.3) & (x[:, 2] > 0.5), "list", "prose")).astype(object)
    rules = quality_fit.irep(x[:2000], y[:2000], ["a", "b", "c"])
    assert (quality_fit.apply_rules(rules, x[2000:], ["a", "b", "c"]) == y[2000:]).mean() > 0.97


def test_sql_case_equals_rules(spark):
    rules = [("junk", [("n_words", "<=", 2.0)]), ("list", [("n_words", ">=", 5.0), ("n_lines", ">=", 2.0)])]
    df = spark.createDataFrame([("a b",), ("a b c\nd e f",), ("a b c d",)], "text string")
    assert [r.kind for r in quality.with_kind(df, rules=rules).collect()] == ["junk", "list", "prose"]


def test_labeller_agrees_with_the_cases():
    assert all(quality_fit.label(t) in (k, None) for t, k in CASES)
