from datetime import date

import pytest

from kgspark.llm import pii

KEY = b"test"


def kinds(text):
    return [(text[a:b], k) for a, b, k in pii.find(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Пишите a.b+c@mail.site.example сегодня.", [("a.b+c@mail.site.example", "email")]),
        ("to x_1(at)host (dot) test please", [("x_1(at)host (dot) test", "email")]),
        ("Почта k.lim собака post точка example.", [("k.lim собака post точка example", "email")]),
        ("цена за шт@опт 71 руб., 5 boxes @ $ 4 each, Ping @bot_x now", []),
        ("Набрать +7 (062) 448-88-23 после обеда", [("+7 (062) 448-88-23", "phone")]),
        ("Набрать 555-0101 после обеда", [("555-0101", "phone")]),
        ("Заказ 89282292913 закрыт. Договор № 7520498-50. Сумма 912 545 212 рублей. Версия 4.72.853.1", []),
        ("нужен паспорт серия 48 05 номер 953566.", [("48 05 номер 953566", "identity_number")]),
        ("указан 495514396409 (ИНН). Паспорт найма готов на 57%.", [("495514396409", "identity_number")]),
        ("On file: SSN 000-45-0000, passport no. X42451507.", [("000-45-0000", "identity_number"), ("X42451507", "identity_number")]),
        ("Живёт: г. Крапувск, Грурширский проспект, д. 145-189.", [("г. Крапувск, Грурширский проспект, д. 145-189", "street_address")]),
        ("адрес улица Крижизова 29к1, кв. 151", [("улица Крижизова 29к1, кв. 151", "street_address")]),
        ("г. Дропукск, ряд 45, стеллаж 6", []),
        ("Home is 145 Vekub Road, Flat 11.", [("145 Vekub Road, Flat 11", "street_address")]),
        ("За план отвечает Бревезук Ольга Игоревна?", [("Бревезук Ольга Игоревна", "person_name")]),
        ("в команду выходит Т. Мисопева с 28 марта", [("Т. Мисопева", "person_name")]),
        ("Дана Нагазижеву Александру премия", [("Нагазижеву Александру", "person_name")]),
        ("From now on Liz R. Grarogizhwick leads Katana", [("Liz R. Grarogizhwick", "person_name")]),
        ("Глубина просмотра выросла. По проекту Вусашида тихо.", []),
        ("", []),
        # texts unlike those of the tables
        ("Ask Robert Kowalski or A. S. Byatt.", [("Robert Kowalski", "person_name"), ("A. S. Byatt", "person_name")]),
        ("Вчера Ирина Гогоберидзе и Н. В. Гоголь спорили", [("Ирина Гогоберидзе", "person_name"), ("Н. В. Гоголь", "person_name")]),
        ("Steuer-ID 86095742719, geb. am 05.03.1981", [("86095742719", "identity_number"), ("05.03.1981", "date")]),
        ("паспорт 4805 953566, выдан 12/03/2010, сдать 01.02.2026 г.", [("4805 953566", "identity_number"), ("12/03/2010", "date"), ("01.02.2026", "date")]),
        ("Отчёт от 12.03.2010, версия 1.2.2010", []),
    ],
)
def test_find(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("digits", ["7", "12", "123", "0000", "123456789012", "9" * 25])
def test_digits_round_trip(digits):
    new = pii.permute_digits(digits, KEY)
    assert len(new) == len(digits) and new.isdigit()
    assert pii.permute_digits(new, KEY, undo=True) == digits


def test_feistel_is_a_permutation_and_keyed():
    all_ = {pii.permute_digits(f"{i:03d}", KEY) for i in range(1000)}
    assert len(all_) == 1000
    assert sum(pii.permute_digits(f"{i:03d}", KEY) != pii.permute_digits(f"{i:03d}", b"other") for i in range(100)) > 90


def test_dates_round_trip():
    seen = set()
    for d in (date(1900, 1, 1), date(1987, 5, 4), date(2099, 12, 31), date(2024, 2, 29)):
        p = pii.permute_date(d, KEY)
        assert 1900 <= p.year <= 2099 and pii.permute_date(p, KEY, undo=True) == d
        seen.add(p)
    assert len(seen) == 4 and pii.permute_date(date(1800, 1, 1), KEY) == date(1800, 1, 1)


CHECKED = ["7707083893", "11223344595", "86095742719", "500100732259", "4539578763621486"]


@pytest.mark.parametrize("digits", [*CHECKED, "7707083894", "12345678901", "4805953566", "123456", "500100732250"])
def test_numbers_keep_length_and_check_digits(digits):
    new = pii.permute_valid(digits, KEY, "identity_number")
    assert len(new) == len(digits) and new != digits and pii.permute_valid(new, KEY, "identity_number", undo=True) == digits
    assert pii._check(new) == pii._check(digits) and (pii._check(digits) is not None) == (digits in CHECKED)


def test_no_valid_number_and_no_calendar_date():
    assert pii.permute_number("000 000 000", KEY, "phone") is None and pii.permute_number("12 34", KEY, "identity_number") is None
    assert pii.permute_written("31.02.2001", KEY) is None and pii.permute_written("1.2.2001 г", KEY) is None


@pytest.mark.parametrize("text", ["05.03.1981", "05/03/1981", "1981-03-05", "05-03-1981"])
def test_written_dates_round_trip_and_stay_linked(text):
    new = pii.permute_written(text, KEY)
    assert new != text and pii.permute_written(new, KEY, undo=True) == text
    m, first = pii.DATE.fullmatch(new), pii.DATE.fullmatch(pii.permute_written("05.03.1981", KEY))
    assert pii._day(m) == pii._day(first)
    line = f"born {text}, passport 4805 953566"
    out = pii.redact(line, KEY)
    assert out == f"born [date:{new}], passport [identity_number:{pii.permute_number('4805 953566', KEY, 'identity_number')}]"
    assert pii.replace(line, KEY)[1] == ["identity_number"]


def test_equal_numbers_stay_linked_and_text_is_kept():
    a, b = pii.redact("моб +7 036 357-16-75 вечером", KEY), pii.redact("Call +7 (036) 357 16 75.", KEY)
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(a) == digits(b) != "70363571675"
    assert a.startswith("моб [phone:+7 ") and a.endswith("] вечером")
    c = pii.redact("8 036 357 16 75", KEY)
    assert digits(c)[1:] == digits(a)[1:] and c.startswith("[phone:8 ")
    assert pii.redact("отвечает Бревезук Ольга Игоревна.", KEY).endswith("].")
    assert pii.redact("план на 57%", KEY) == "план на 57%"


def test_table_edges(spark):
    df = spark.createDataFrame([("m", "1", None, 0), ("m", "2", "", 0), ("m", "3", "a@b.test", 0), ("m", "3", "a@b.test", 0), ("m", "4", "x " * 200_000 + "a@b.test", 0), (None, None, "555-0101", 0)], "src string, row_key string, text string, kinds int")
    got = {r.row_key: r.kinds for r in pii.replaced(df, KEY).collect()}
    assert got == {"1": None, "2": [], "3": ["email"], "4": ["email"], None: ["phone"]}
    assert pii.replaced(df.limit(0), KEY).count() == 0
