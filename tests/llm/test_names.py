import pytest

from kgspark.llm import names as n

SAME = [
    ("Елена Бошажамская", "boshazhamskaya_elena"),
    ("Лиз", None),
    ("elizabeth_stivinonwick", "Liz Stivinonwick"),
    ("Стазетегева Екатерина", "Катя Стазтеегева"),
    ("Роговизину Дмитрию", "Д.А. Роговизин"),
    ("Бруретидская ТЮ", "татьяна_бруретидская"),
    ("ООО «Тронажлит Медиа»", "Тронажлит Мед."),
    ("«Лубуодлан Фарма»", "ЛубуодланФарма"),
    ("Piriaslit Servis Tsentr LLC", "ПСЦ"),
    ("Агро Пузеенвент", "Puzeenvent Agro"),
]
OTHER = [
    ("Кетушусенко Наталья", "Кетушусенко Ксения"),
    ("Robert A. Laloshetford", "Robert E. Laloshetford"),
    ("Мария Марковна Грибова", "Мария Олеговна Грибова"),
    ("склад", "складской учёт"),
    ("ООО «Водевент Логистика»", "логистика"),
    ("Зогуувмар Медиа", "Зогуувмар Аудит"),
    ("Александр Грибов", "Александра Грибова"),
]


@pytest.mark.parametrize(("a", "b"), [p for p in SAME if p[1]])
def test_variants(a, b):
    assert n.same(n.parse(a), n.parse(b)) and n.same(n.parse(b), n.parse(a))


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_others(a, b):
    pa, pb = n.parse(a), n.parse(b)
    for p in (pa, pb):
        if p:
            p["common"] = ["logistika", "media", "audit", "sklad"]
    assert pa is None or pb is None or n.same(pa, pb) is None


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "user_id string, name string, display_name string, row string")
    return {(r.user_id, r.name_a, r.name_b) for r in n.linked_names(df).collect()}


def test_tenants_nulls_and_repeats(spark):
    rows = [("u", "a", "Ольга Чопедигук"), ("u", "a", "Ольга Чопедигук"), ("u", "b", "Чопедигук Оля"), ("v", "c", "Чопедигук Ольга"), (None, "d", "Ольга Чопедигук"), ("u", None, "x"), ("u", " ", "Ольга Чопедигук"), ("u", "чопедигук_ольга", None)]
    assert linked(spark, rows) == {("u", "a", "b"), ("u", "a", "чопедигук_ольга"), ("u", "b", "чопедигук_ольга")}


def test_bare_family_name_needs_one_bearer(spark):
    one = [("u", "a", "Kizgozhelson Patricia"), ("u", "b", "Kizgozhelson")]
    assert linked(spark, one) == {("u", "a", "b")}
    assert linked(spark, [*one, ("u", "c", "Kizgozhelson Robert")]) == set()


def test_common_suffixes_are_refined_not_lost(spark):
    """More names than COMMON share a suffix; the pair is still found."""
    letters = "бвгджзклмнпр"
    many = [("u", f"n{i}{j}", f"Иван {a.upper()}о{b}опетрушенко") for i, a in enumerate(letters) for j, b in enumerate(letters)]
    got = linked(spark, [*many, ("u", "zz", "Ваня Бовопетрушенко")])
    assert ("u", "n01", "zz") in got


def test_subject_words_are_told_by_their_tenants(spark):
    """A word that many tenants use names no organisation; one that few use does, whatever its ending."""
    rows = [(f"u{i}", "s", "логистика") for i in range(6)]
    rows += [("u0", "a", "ООО «Буквиум Логистика»"), ("u0", "b", "Логистика Буквиум"), ("u0", "c", "Буквиум"), ("u0", "d", "логистка отгрузок")]
    assert linked(spark, rows) == {("u0", "a", "b"), ("u0", "a", "c"), ("u0", "b", "c")}


def test_spellings_are_chained_through_a_third(spark):
    rows = [("u", "a", "Елена Бошажамская"), ("u", "b", "Елена Бошажамкая"), ("u", "c", "Боеажамская Елена"), ("u", "d", "Ольга Бошажамкая")]
    assert {("u", "a", "b"), ("u", "a", "c"), ("u", "b", "c")} == linked(spark, rows)


def test_empty(spark):
    assert linked(spark, []) == set()


def test_lcs_ratio():
    assert n.lcs_ratio("abcd", "abcd") == 1.0 and n.lcs_ratio("abcd", "abd") == 6 / 7 and n.lcs_ratio("", "a") == 0.0


def test_misspelt_variants_of_a_frequent_name_are_kept(spark):
    """More than COMMON names share every key of the misspelt one, with the same initial."""
    many = [("u", f"n{i:03d}", "Иван Бошажамовский") for i in range(n.COMMON + 10)]
    got = linked(spark, [*many, ("u", "zz", "Иван Бошажмовский")])
    assert {("u", m[1], "zz") for m in many} <= got


def test_bare_names_meet_all_refinements(spark):
    many = [("u", f"n{i:03d}", "Иван Бошажамовский") for i in range(n.COMMON + 10)]
    got = linked(spark, [*many, ("u", "zz", "Бошажмовский")])
    assert {("u", m[1], "zz") for m in many} <= got


def test_short_family_names_are_compared(spark):
    rows = [("u", "a", "Ольга Ким"), ("u", "b", "Ким Оля"), ("u", "c", "Ольга Ли"), ("u", "d", "ли_оля"), ("u", "e", "Ирина Ким")]
    assert linked(spark, rows) == {("u", "a", "b"), ("u", "c", "d")}


def test_two_capitals_stay_initials():
    assert n.parse("Бруретидская ТЮ")["second"] == "yu" and n.parse("Елена ТЮ")["kind"] != "person"
