"""Personal information inside free text: finding it and replacing it by typed pseudonyms.

``replaced`` is the operator: it finds the spans of e-mail addresses, phone numbers, identity numbers, street
addresses and person names of each text, and of dates that stand beside an identity number or
after a word for a birth, and puts ``[type:pseudonym]`` in their place. Pseudonyms are keyed permutations within the
format of the value: the digits of a validated number (``valid_number``) go through a Feistel network over all
digit strings of that length; where a check digit holds, the pseudonym's holds too; where none does, none
appears by chance (cycle walking). Dates are permuted among the days of two centuries and written as the
original was. So equal values have equal pseudonyms in every document and spelling, different ones different ones,
and the key holder can undo it. Letters (names, mailboxes, streets) and digits that are no valid number get a keyed token.

Scale: one pass of Arrow batches per table, without a shuffle; the texts are read whole and only rows
and columns needed reach Python. The rules are fixed, so nothing is broadcast.

Defined results: a null or blank text stays as it is and has no spans; where two rules claim
overlapping spans the earlier in ``ORDER`` wins; a date that no calendar has stays; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.tables import table

# ---------------------------------------------------------------- format-preserving pseudonyms


def _round(key: bytes, tweak: bytes, i: int, half: str, width: int) -> int:
    mac = hmac.new(key, b"%s|%d|%d|%s" % (tweak, i, width, half.encode()), hashlib.sha256).digest()
    return int.from_bytes(mac[:16], "big") % 10**width


def permute_digits(digits: str, key: bytes, tweak: bytes = b"", undo: bool = False, rounds: int = 8) -> str:
    """A keyed permutation of all digit strings of one length: an alternating Feistel network.

    A single digit is shifted by a keyed amount.
    """
    n = len(digits)
    if n < 2:
        shift = _round(key, tweak, 0, "", 1) * (-1 if undo else 1)
        return digits and str((int(digits) + shift) % 10)
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(rounds)) if undo else range(rounds):
        if i % 2 == 0:
            f = _round(key, tweak, i, b, u) * (-1 if undo else 1)
            a = str((int(a) + f) % 10**u).zfill(u)
        else:
            f = _round(key, tweak, i, a, n - u) * (-1 if undo else 1)
            b = str((int(b) + f) % 10 ** (n - u)).zfill(n - u)
    return a + b


FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31


def permute_date(day: date, key: bytes, undo: bool = False) -> date:
    """A keyed permutation of the days from 1900 to 2099, by cycle walking; other days stay."""
    n = (day - FIRST_DAY).days
    if not 0 <= n < DAYS:
        return day
    while True:
        n = int(permute_digits(f"{n:05d}", key, b"date", undo))
        if n < DAYS:
            return FIRST_DAY + timedelta(days=n)


def _luhn(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _weighted(body: str, weights: tuple[int, ...]) -> str:
    return str(sum(int(c) * w for c, w in zip(body, weights, strict=True)) % 11 % 10)


def _inn12(body: str) -> str:
    first = _weighted(body, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))
    return first + _weighted(body + first, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))


def _snils(body: str) -> str:
    return f"{sum(int(c) * (9 - i) for i, c in enumerate(body)) % 101 % 100:02d}"


def _mod_11_10(body: str) -> str:
    p = 10
    for c in body:
        p = (int(c) + p) % 10 or 10
        p = p * 2 % 11
    return str((11 - p) % 10)


#: Check digits by length of an identity number, in the order they are tried: (their number, how they follow from the digits before).
CHECKS: dict[int, tuple[tuple[int, Callable[[str], str]], ...]] = {
    10: ((1, lambda b: _weighted(b, (2, 4, 10, 3, 5, 9, 4, 6, 8))),),
    11: ((2, _snils), (1, _mod_11_10)),
    12: ((2, _inn12),),
    16: ((1, _luhn),),
}


def _check(digits: str) -> tuple[int, Callable[[str], str]] | None:
    return next(((n, f) for n, f in CHECKS.get(len(digits), ()) if f(digits[:-n]) == digits[-n:]), None)


def valid_number(digits: str, kind: str) -> bool:
    """Whether digits can be a number of the kind: by length, and not one digit throughout."""
    least, most = (7, 15) if kind == "phone" else (6, 26)
    return least <= len(digits) <= most and len(set(digits)) > 1


def permute_valid(digits: str, key: bytes, kind: str, undo: bool = False) -> str:
    """A keyed permutation of the valid numbers of one length that keeps whether a check digit holds, and which."""
    tweak = kind.encode()
    found = _check(digits) if kind == "identity_number" else None
    if found:
        n, check = found
        new = digits
        while True:  # within the numbers whose first holding check is the same
            body = permute_digits(new[:-n], key, tweak + b"|%d" % n, undo)
            new = body + check(body)
            if _check(new) == found and len(set(new)) > 1:
                return new
    new = digits
    while True:
        new = permute_digits(new, key, tweak, undo)
        if len(set(new)) > 1 and not (kind == "identity_number" and _check(new)):
            return new


def permute_number(text: str, key: bytes, kind: str, undo: bool = False) -> str | None:
    """``text`` with its digits permuted together and everything else in place, or None for no valid number.

    A leading country code stays.
    """
    m = re.match(r"\+(?:7|1|4\d|3\d)(?=\D|\d{10})", text) if kind == "phone" else None
    keep = m.end() if m else 0
    if kind == "phone" and not m and re.match(r"8\D?", text) and sum(c.isdigit() for c in text) == 11:
        keep = 1  # the domestic prefix stands for +7
    rest = text[keep:]
    digits = "".join(str(int(c)) for c in rest if c.isdecimal())
    if not valid_number(digits, kind):
        return None
    new = iter(permute_valid(digits, key, kind, undo))
    return text[:keep] + "".join(next(new) if c.isdecimal() else c for c in rest)


DATE = re.compile(r"(?<![\d.])(?:(?P<d>\d{1,2})(?P<s>[./-])(?P<m>\d{1,2})(?P=s)(?P<y>(?:19|20)\d\d)|(?P<y2>(?:19|20)\d\d)-(?P<m2>\d\d)-(?P<d2>\d\d))(?![\d])(?!\.\d)")
_BORN = re.compile(r"(?:рожд\w*|д\.\s?р\.|г\.\s?р\.|born(?: on)?|birth(?: ?date|day)?|dob|geb(?:oren|urtsdatum)?\.?(?: am)?)\s*[:,—–-]?\s*$", re.I)
#: Letters between an identity number and a date that belongs to it.
BESIDE = 30


def _day(m: re.Match) -> date | None:
    try:
        return date(int(m["y"] or m["y2"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"]))
    except ValueError:
        return None


def permute_written(text: str, key: bytes, undo: bool = False) -> str | None:
    """A written date with its day permuted and its spelling kept; None where no calendar has it.

    Days are written with two digits, so that the length of the original does not tell them.
    """
    m = DATE.fullmatch(text)
    day = m and _day(m)
    if not day:
        return None
    new = permute_date(day, key, undo)
    return f"{new:%Y-%m-%d}" if m["y2"] else f"{new:%d}{m['s']}{new:%m}{m['s']}{new:%Y}"


def token(text: str, key: bytes, kind: str) -> str:
    plain = " ".join(re.findall(r"\w+", text.lower().replace("ё", "е")))
    return hmac.new(key, f"{kind}|{plain}".encode(), hashlib.sha256).hexdigest()[:10]


# ---------------------------------------------------------------- rules

#: Given names and their short forms.
RU_NAMES = frozenset(
    "александр алексей андрей антон артем борис вадим валентин валерий василий виктор виталий владимир вячеслав геннадий "
    "григорий дмитрий евгений егор иван игорь илья кирилл константин максим матвей михаил никита николай олег павел петр роман "
    "сергей степан тимур федор юрий ярослав анастасия анна валентина варвара вероника виктория галина дарья екатерина елена "
    "елизавета ирина кристина ксения лидия людмила маргарита марина мария надежда наталья нина оксана ольга полина раиса "
    "светлана софия софья тамара татьяна ульяна юлия яна "
    "саша леша алеша федя ваня вова володя гриша дима митя женя коля костя катя лена лиза маша миша настя наташа оля паша петя "
    "поля рита света сережа слава соня таня толя юля юра яша аня нюра ксюша даша ник".split()
)
EN_NAMES = frozenset(
    "robert margaret william patricia jennifer susan michael andrew elizabeth edward samuel thomas katherine benjamin james mary "
    "john linda david barbara richard jessica joseph sarah charles karen daniel nancy matthew lisa anthony betty mark helen "
    "donald sandra steven donna paul carol george ruth kenneth sharon peter laura kevin emily "
    "peggy tom sue ted liz mike sam bill trish drew jen ben kate bob rob maggie will pat jenny andy beth betsy ed eddie sammy "
    "tommy kathy jim joe dan dave dick steve meg jenn susie suzy billy bobby mick tommy katie benny becky "
    "aleksandr aleksey alexey fyodor sergey mariya ksenia kseniya ivan elena pavel olga natalya darya yuliya vladimir dmitriy dmitry "
    "mikhail svetlana yuriy nikolay grigoriy tatyana pyotr anna ekaterina polina konstantin igor oleg irina galina marina".split()
)
_RU_SUR = r"(?:[оеё]в|[иы]н|[оеё]ва|[иы]на|енко|[сц]кий|[сц]кая|ук|юк)"
_RU_CASE = r"(?:(?:[оеё]в|[иы]н)(?:а|у|ым|е|ой)|(?:[сц]к)(?:ого|ому|им|ом|ой|ую)|[ую]к(?:а|у|ом|е))"
_EN_SUR = r"(?:son|ley|ford|by|wick|[oe]v|in|[oe]va|ina|enko|skiy|sky|skaya|uk|yuk)"
_SURNAME = re.compile(rf"[А-ЯЁ][а-яё]{{2,}}(?:{_RU_SUR}|{_RU_CASE})|[A-Z][a-z]{{2,}}{_EN_SUR}")
_PATRONYMIC = re.compile(r"[А-ЯЁ][а-яё]+(?:[оеё]вич|ич|[оеё]вна|ична|инична)(?:а|у|ем|е|ы|ой)?")
#: Ordinary words that end like family names.
ORDINARY = frozenset(
    "глубина причина половина основа новинка корзина машина картина вершина страна цена сторона магазин термин вагон "
    "один магазина каков готов здоров таков снова основ слов голов домов часов заказов отзывов этапов планов сроков итогов "
    "main login begin plugin admin berlin dublin within margin coin join again train certain remain captain domain captain "
    "sky whisky reason season lesson person comparison version valley volley alley trolley barley medley parsley oxford "
    "baby hobby lobby standby nearby ruby sandwich wicked session mission commission john benjamin katherine catherine catalog "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember "
    "звук наук бамбук стук внук звука внука сундук каблук паук крюк люк утюг сюртук".split()
)
_TITLE = re.compile(r"[^\W\d_]+")
_INIT_RU, _INIT_EN = r"[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.)?", r"[A-Z]\.\s?(?:[A-Z]\.)?"
_CAP = r"[А-ЯЁA-Z][а-яёa-z]+"
_FULL = rf"(?:{_INIT_RU}|{_INIT_EN}|{_CAP}\.?)"

#: What stands right before or after a person in business notes.
_BEFORE = (
    r"обеща(?:ет|ют)\s|созвонились:\s|выходит\s|получает\s|на линии\s|нормально,\s|коллеги\s\(|чтобы\s|отвечает\s(?!за)|теперь\s|"
    r"waiting for\s|thanks to\s|on the call\s|now on\s|\d:\s|sagte\s|was said by\s|approved by\s|автор:?\s|контактное лицо:?\s"
)
_AFTER = (
    r"\s(?:отвечает за|обещает|считает,|и отдел|owns the|leads|expects|promised|übernimmt|has promised|takes over)"
)
_SLOT = re.compile(rf"(?:(?i:{_BEFORE}))(?P<a>{_CAP}(?:,?\s{_FULL}){{0,2}})|(?P<b>{_CAP}(?:,?\s{_FULL}){{0,2}})(?=(?i:{_AFTER}))")
_PROJECT = re.compile(r"(?:ион|ара|экс|ант|ея|ида|ум|оль|ion|ara|eks|ant|eya|ida|um|ol)$")
_NOT_PERSON_BEFORE = re.compile(
    r"(?:проекту?|тем[аеуы]|модул\w+|направлени\w+|лини[ия]|команд[ауы]|клиент\w*|компани\w+|показ|фонд\w*|кампани\w+|"
    r"ооо|оао|ао|пао|зао|ип|llc|ltd|inc|gmbh|project|client|team|\bв)\s[«\"“]?$|[«\"“@#/]$",
    re.I,
)
_STREET_BEFORE = re.compile(r"(?:ул\.?|улиц\w+|пер\.?|переул\w+|пр-т|просп\w*\.?|наб\w*\.?|б-р|бульвар\w*|пл\.?|площад\w+|ш\.|шоссе|г\.|город\w*)\s$", re.I)

EMAIL = re.compile(
    r"(?:<?mailto:)?[\w.+%-]*\w\s?(?:@|\s?(?:\(at\)|\[at\]|\{at\}|\(собака\)|\[собака\])\s?|(?<=\w)\s(?:собака|собачка)\s)"
    r"[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\(точка\)|\[точка\])\s?|\s(?:точка|dot)\s)[\w-]+)*"
    r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\(точка\)|\[точка\])\s?|\s(?:точка|dot)\s)[^\W\d_]{2,}>?"
    r"|[\w.+%-]*\w\sat\s[\w-]+(?:\sdot\s[\w-]+)*\sdot\s[^\W\d_]{2,}",
    re.I,
)
_SEP = r"[\s.\-‐–]"
PHONE = re.compile(
    rf"(?<![\w+])\+\d{{1,3}}{_SEP}?\(?\d{{2,4}}\)?(?:{_SEP}?\d{{2,8}}){{1,4}}(?!\d)"
    rf"|(?<![\w.\-])8(?:{_SEP}\(?|\()\d{{3}}\)?{_SEP}?\d{{3}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}(?!\d)"
    r"|(?<![\w)])\(\d{3,4}\)\s?\d{3}[\s-]?\d{2}[\s-]?\d{2}(?!\d)"
    r"|(?<![\w)])\(\d{3}\)\s?\d{3}-\d{4}(?!\d)|(?<![\w.\-])555-\d{4}(?![\w-])"
)
PHONE_CUED = re.compile(
    r"(?:тел(?:ефон\w*|\.)?|моб(?:ильн\w*|\.)?|сот(?:овый|\.)|набрать|позвонить|перезвонить|звон(?:и|ите|ить)|whatsapp|"
    r"mobile|phone|cell|call|ring(?: back)?(?: on)?|tel\.?|mobil|handy|anrufen)\s?(?:на|по|on|at|:|unter)?\s?"
    r"(?P<n>\+?\(?\d[\d\s().\-]{5,17}\d)",
    re.I,
)
_DOC = (
    r"(?:загран)?паспорт\w{0,2}|снилс\w?|инн|водительск\w+ удостоверени\w+|удостоверени\w+|в/у|вод\.?\s?права|полис\w{0,2}(?: омс| дмс)?|омс|"
    r"свидетельств\w+|passports?|ssn|social security(?: number)?|national id|identity card|id card|driver'?s?’?s?\s?(?:licen[cs]e)|"
    r"driving licen[cs]e|tax (?:id|number|no\.?)|tin|nino|national insurance|insurance (?:no\.?|number|policy)|"
    r"reisepass\w*|personalausweis\w*|steuer-?\s?id\w*|steuernummer|führerschein\w*|sozialversicherungsnummer|ausweis\w*"
)
_FILL = r"(?:\s*(?:физ\.?\s?лица|серии|серия|сер\.|номер\w?|ном\.|no\.?|nr\.?|number|num\.?|выдан|№|n°|#|:|—|–|-|is|,|\())*"
_NUM = r"[A-ZА-Я]{0,3}\s?\d(?:[\d\s\-/]|\s?№\s?|\s?номер\s|\s?no\.?\s){3,24}\d(?!\d)|[A-Z]{1,2}\d{6,9}"
IDENTITY = re.compile(rf"(?<!\w)(?:{_DOC})(?!\w){_FILL}\s*(?P<n>{_NUM})", re.I)
IDENTITY_BACK = re.compile(rf"(?<![\w-])(?P<n>[A-ZА-Я]{{0,2}}\d[\d\s\-]{{4,18}}\d)\s*(?:,\s*это|\(|—\s*это|\s-\s*это|,\s*(?:this )?is(?: the| my)?|,\s*das ist)\s*(?:мой |его |её |the |my )?(?:{_DOC})(?!\w)", re.I)
_STREET_W = r"(?i:ул\.|улиц[аеуы]|пер\.|переул(?:ок|ке|ка)|пр-т|просп\.|проспект[еа]?|наб\.|набережн(?:ая|ой|ую)|б-р|бульвар[еа]?|пл\.|площад[ьи]|проезд[еа]?|туп\.|тупик|аллея|ш\.|шоссе)"
_STREET_SEEN = re.compile(_STREET_W)
_HOUSE = r"(?:,?\s*(?i:д\.|дом)?\s*№?\s*\d{1,4}\s?(?:[а-яА-Я](?![а-яА-Я\d]))?(?:\s?(?i:к|корп\.?|стр\.?|/)\s?\d+)?(?:-\d+)?)"
_ROOM = r"(?:,?\s*(?i:кв\.?|квартира|подъезд|под\.|оф\.?|офис|этаж|эт\.|корп\.|корпус|стр\.|строение|комн\.)\s*\d+\w?)*"
_PRE = r"(?:\d{6},\s*)?(?:(?i:г\.|город)\s?[А-ЯЁ][\w-]+,\s*)?"
_RUNAME = r"[А-ЯЁ][а-яё-]+(?:\s[А-ЯЁ][а-яё-]+)?"
ADDRESS_RU = re.compile(rf"{_PRE}(?:{_STREET_W}\s*{_RUNAME}|{_RUNAME}\s+{_STREET_W}){_HOUSE}{_ROOM}")
_EN_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Crescent|Cres|Drive|Dr|Court|Ct|Square|Sq|Way|Close|Place|Terrace|Boulevard|Blvd|Gardens|Grove|Hill|Row|Walk)"
ADDRESS_EN = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit)\s?\w{{1,4}},\s*)?(?<![\w,.])\d{{1,4}}[A-Za-z]?\s+(?:[A-Z][\w'-]+\s+){{1,2}}{_EN_STREET}(?!\w)\.?(?:,?\s+(?:Flat|Apt\.?|Apartment|Suite|Unit)\s?\w{{1,4}})?(?:,\s[A-Z][a-z]+(?:ton|ford|ham|bury|ville|burg|field)?(?=[\s.,]))?"
)
ADDRESS_DE = re.compile(r"[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|damm)\s+\d{1,4}\s?[a-z]?(?!\w)|(?:Am|An der|Im)\s[A-ZÄÖÜ]\w+\s\d{1,3}(?=,\s\d{5})")

#: Types in order of precedence over overlapping spans.
ORDER = ("email", "street_address", "identity_number", "phone", "date", "person_name")
#: The types of personal information; dates are replaced beside them and are none themselves.
TYPES = tuple(k for k in ORDER if k != "date")


def _given(word: str) -> bool:
    low = word.lower().replace("ё", "е")
    if low in RU_NAMES or low in EN_NAMES:
        return True
    if not "а" <= low[0] <= "я" or len(low) < 4:
        return False
    for cut_, ends in ((1, ("", "й", "а", "я", "ь")), (2, ("", "й", "а", "я", "ия")), (3, ("й",))):
        tail = low[-cut_:]
        if tail in _CASES and any(low[:-cut_] + e in RU_NAMES for e in ends):
            return True
    return False


_CASES = frozenset("а у е ы и ю я ой ей ом ем ью ия".split())


def _close_name(word: str) -> bool:
    """A given name with one letter dropped, doubled, swapped or replaced."""
    low = word.lower().replace("ё", "е")
    if len(low) < 5:
        return False
    names = RU_NAMES if "а" <= low[0] <= "я" else EN_NAMES
    for i in range(len(low)):
        if low[:i] + low[i + 1 :] in names:
            return len(low) > 5
        if i and low[: i - 1] + low[i] + low[i - 1] + low[i + 1 :] in names:
            return True
    return any(len(n) > 5 and (len(n) - len(low) in (0, 1)) and _one_off(low, n) for n in names)


def _one_off(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


_SEEN_WORDS: dict[str, int] = {}


def _word_kind(w: str) -> int:
    """3: given name, 2: family name, 1: patronymic, 0: neither. Kept per process, as words repeat."""
    k = _SEEN_WORDS.get(w)
    if k is None:
        low = w.lower()
        if low in ORDINARY:
            k = 0
        elif _given(w):
            k = 3
        elif _PATRONYMIC.fullmatch(w):
            k = 1
        elif _SURNAME.fullmatch(w):
            k = 2
        else:
            k = 0
        if len(_SEEN_WORDS) > 200_000:
            _SEEN_WORDS.clear()
        _SEEN_WORDS[w] = k
    return k


_CAPWORD = re.compile(r"[А-ЯЁA-Z][а-яёa-z]{1,}")
_INITIALS = re.compile(rf"\s?(?:{_INIT_RU}|{_INIT_EN}|[А-ЯЁA-Z]{{1,2}}(?![\w.]))")
_INITIALS_AHEAD = re.compile(rf"(?:{_INIT_RU}|{_INIT_EN})\s?$")


#: A capitalised word right behind a given name: any in Latin letters, one with an ending of family names in Cyrillic.
_FAMILY_NEXT = re.compile(r"\s([A-Z][a-zäöüßéèçñ'’-]{2,}|[А-ЯЁ][а-яё-]*(?:янц?|дзе|швили|ец|ич|[ыи]х|ко|ой|ман|штейн|берг|[аяи]к|ль|ер))(?![\w@])(?<!['’-])")
#: Two initials and a capitalised word.
_TWO_INITIALS = re.compile(r"(?<![\w.])(?:[А-ЯЁ]\.\s?[А-ЯЁ]\.\s?[А-ЯЁ][а-яё-]{2,}|[A-Z]\.\s?[A-Z]\.\s?[A-Z][a-z'’-]{2,})(?!\w)")
_BESIDE = re.compile(r",?\s([А-ЯЁA-Z][а-яёa-z]+)")
_BESIDE_BACK = re.compile(r"([А-ЯЁA-Z][а-яёa-z]+),?\s$")


def _names(text: str, shouted: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of names; ``shouted`` text had no lower case, so endings alone prove nothing there."""
    for m in _CAPWORD.finditer(text):
        if _word_kind(m.group()):
            a, b = m.span()
            if a and (text[a - 1].isalnum() or text[a - 1] in "@#_/") or b < len(text) and (text[b].isalnum() or text[b] in "@_"):
                continue
            before = text[max(0, a - 16) : a]
            if _STREET_BEFORE.search(before) or _word_kind(m.group()) == 2 and _NOT_PERSON_BEFORE.search(before):
                continue
            left = _INITIALS_AHEAD.search(text[max(0, a - 6) : a])
            if left:
                a -= len(left.group())
            right = _INITIALS.match(text, b)
            if right and right.end() > b + 1 and "." in right.group():
                b = right.end()
            if shouted and _word_kind(m.group()) < 3 and (a, b) == m.span():
                near = _BESIDE.match(text, b), _BESIDE_BACK.search(text[max(0, a - 24) : a])
                if not any(x and _word_kind(x.group(1)) == 3 for x in near):
                    continue
            if _word_kind(m.group()) == 3 and not shouted and (next_ := _FAMILY_NEXT.match(text, b)) and next_.group(1).lower() not in ORDINARY:
                b = next_.end()
            yield a, b
    for m in _TWO_INITIALS.finditer(text):
        yield m.span()
    for m in _SLOT.finditer(text):
        g = "a" if m.group("a") else "b"
        words = _CAPWORD.findall(m.group(g))
        if not words or any(_PROJECT.search(w.lower()) and not _word_kind(w) for w in words):
            continue
        if any(_word_kind(w) for w in words) or any(_close_name(w) for w in words) or len(words) == 1 and re.search(r"[А-ЯЁA-Z]\.", m.group(g)):
            yield m.span(g)
        elif len(words) == 1 and _late_surname(words[0]):
            yield m.span(g)


def _merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans, and those with only a blank or a comma between them, as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and (a <= out[-1][1] or text[out[-1][1] : a] in (" ", ", ")):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    out = [(a, a + len(text[a:b].rstrip())) for a, b in out]
    return [(a, b - 1 if re.search(r"[^\W\d_]{4}\.$", text[a:b]) else b) for a, b in out]  # a sentence's full stop


def _late_surname(word: str) -> bool:
    """A family name whose ending was mistyped: one swap, drop or doubled letter away from an ending."""
    low = word.lower()
    if low in ORDINARY or len(low) < 6:
        return False
    return bool(re.search(r"(?:ен?ко|екно|енок|с?кй?и|скя|сая|окв|вео|оов|оав|еав|нии|ниа|иан|snо|sno|osn|lye|ely|fodr|frod|ofrd|yb|wcik|wikc|iwck|so?n|le?y|fo?rd|wi?c?k)$", low))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of each piece of personal information, in order, without overlaps."""
    spans: list[tuple[int, int, str]] = []
    digits = any(c in text for c in "0123456789")
    if "@" in text or "at" in text.lower() or "собак" in text.lower():
        spans += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if digits:
        for rx in (ADDRESS_RU, ADDRESS_EN, ADDRESS_DE) if _STREET_SEEN.search(text) else (ADDRESS_EN, ADDRESS_DE):
            spans += [(*m.span(), "street_address") for m in rx.finditer(text)]
        for rx in (IDENTITY, IDENTITY_BACK):
            for m in rx.finditer(text):
                a, b = m.span("n")
                day = DATE.search(text, a, b)
                if day and day.start() > a:  # a date that follows a number is none of its digits
                    b = a + len(re.sub(r"\D+$", "", text[a : day.start()]))
                if sum(c.isdigit() for c in text[a:b]) >= 6:
                    spans.append((a, b, "identity_number"))
        spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 7 <= sum(c.isdigit() for c in m.group()) <= 15]
        spans += [(*m.span("n"), "phone") for m in PHONE_CUED.finditer(text) if 7 <= sum(c.isdigit() for c in m.group("n")) <= 15]
        numbers = [(a, b) for a, b, kind in spans if kind == "identity_number"]
        for m in DATE.finditer(text):
            a, b = m.span()
            beside = any(0 <= a - y <= BESIDE or 0 <= x - b <= BESIDE for x, y in numbers) or _BORN.search(text[max(0, a - 24) : a])
            if beside and _day(m):
                spans.append((a, b, "date"))
    shown = text
    if text.isupper():
        shown = _TITLE.sub(lambda m: m.group()[0] + m.group()[1:].lower(), text)
        if len(shown) != len(text):
            shown = text
    spans += [(a, b, "person_name") for a, b in _merged(shown, sorted(_names(shown, text.isupper())))]
    spans.sort(key=lambda s: (ORDER.index(s[2]), s[0] - s[1]))
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def replace(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with each span replaced by ``[type:pseudonym]`` and the rest unchanged, and the types that occur."""
    out, at, kinds = [], 0, set()
    for a, b, kind in find(text):
        piece = text[a:b]
        pseudo = permute_written(piece, key) if kind == "date" else permute_number(piece, key, kind) if kind in ("phone", "identity_number") else None
        out += [text[at:a], f"[{kind}:{pseudo or token(piece, key, kind)}]"]
        at = b
        kinds.add(kind)
    return "".join([*out, text[at:]]), sorted(kinds.intersection(TYPES))


def redact(text: str, key: bytes) -> str:
    return replace(text, key)[0]


def replaced(df: DataFrame, key: bytes) -> DataFrame:
    """(src, row_key, text, kinds) from (src, row_key, text): the texts with pseudonyms and the types found in each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None) if t is None else replace(t, key) for t in b.column(2).to_pylist()]
            cols = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["src", "row_key", "text", "kinds"])

    return df.select("src", "row_key", "text").mapInArrow(scan, "src string, row_key string, text string, kinds array<string>")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "history_messages", "id", "message_text")
    z = table(spark, d, "zettel_node", "zettel_id", "content")
    m = m.select(F.lit("message").alias("src"), F.col("id").cast("string").alias("row_key"), F.col("message_text").alias("text"))
    return m.unionByName(z.select(F.lit("zettel").alias("src"), F.col("zettel_id").alias("row_key"), F.col("content").alias("text")))


#: Stands in where no secret is configured; a real run sets ``spark.kgspark.pseudonymKey``.
DEFAULT_KEY = "not-a-secret"


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    return replaced(_texts(spark, d), spark.conf.get("spark.kgspark.pseudonymKey", DEFAULT_KEY).encode())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d).select("src", "row_key", F.explode("kinds").alias("pii_type")).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _replaced(spark, d).select("src", "row_key", "text")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL: dict[str, str] = {}
