"""Variant spellings of names typed by people: suffix blocking and longest-common-subsequence links.

``parse`` reads a typed name as a person (family name, given name or initial, second name) or an
organisation (leading word and further words); ordinary subject words are neither. Names are
transliterated to Latin letters, short forms are brought to one given name, case endings and legal
forms are dropped. The suffixes of the leading word from ``MIN_SUFFIX`` letters on are its blocking keys
within the tenant, together with its forms with one letter left out, so that an edit near the end
still leaves a common key. A key that more than ``COMMON`` names of a tenant share is refined part by
part: kind, initial, given name, second name and gender of a person, letters of the other words of an
organisation, first letters of the key's word. Parts are chosen so that names they separate can't be
linked; a name without the part meets all values of it, and nothing is discarded: what stays common
after the last part is compared whole. Pairs in a block are compared by LCS ratio and by their other parts. A
name that leaves out what tells two others apart (a bare family name, a bare initial) is linked only
if all its matches agree with each other.

Scale: keys are a few dozen short rows per name, counted with partial aggregation; pairs are built by
an equi-join on (tenant, key) whose blocks are bounded but for names that agree in every part, which
are mostly results and are spread by salt; a hot tenant is spread over its keys.

Defined results: null or blank names and null tenants give no rows; repeated rows of (tenant, name)
count once (the first display name by code points); an empty table gives no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import cut
from kgspark.tables import table

MIN_SUFFIX, COMMON, LEAST_RATIO = 5, 60, 0.8
#: Least ratio of two spellings that a third one links.
CHAINED = 0.76
#: A word of organisations and subjects that more than ``FEW`` tenants and this share of them use names no organisation.
FEW, SHARE = 3, 0.01
#: Parts of a refinement, and the salts of a block that stays common after the last.
PARTS, SALTS = 6, 16

#: Latin spellings of Cyrillic letters.
LATIN = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye", strict=True)) | {
    "ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya",
}
#: Short form to given name, transliterated.
SHORT = dict(
    x.split("=")
    for x in (
        "sasha=aleksandr shura=aleksandr lyosha=aleksey lesha=aleksey alyosha=aleksey fedya=fyodor vanya=ivan vova=vladimir volodya=vladimir "
        "dima=dmitriy mitya=dmitriy kolya=nikolay kostya=konstantin misha=mikhail grisha=grigoriy pasha=pavel petya=pyotr seryozha=sergey "
        "yura=yuriy anya=anna nyura=anna dasha=darya katya=ekaterina lena=elena ksyusha=kseniya masha=mariya natasha=natalya nata=natalya "
        "olya=olga polya=polina sveta=svetlana tanya=tatyana yulya=yuliya zhenya=evgeniy slava=vyacheslav gena=gennadiy tolya=anatoliy "
        "borya=boris vitya=viktor lyuda=lyudmila nadya=nadezhda lyuba=lyubov galya=galina ira=irina nastya=anastasiya vera=vera lida=lidiya "
        "bob=robert rob=robert bobby=robert peggy=margaret maggie=margaret meg=margaret bill=william will=william billy=william "
        "trish=patricia pat=patricia patty=patricia jen=jennifer jenny=jennifer sue=susan susie=susan suzy=susan mike=michael mick=michael "
        "drew=andrew andy=andrew liz=elizabeth beth=elizabeth betty=elizabeth ted=edward ed=edward eddie=edward ned=edward sam=samuel "
        "sammy=samuel tom=thomas tommy=thomas kate=katherine katie=katherine kathy=katherine ben=benjamin benny=benjamin jim=james "
        "jack=john johnny=john dick=richard rick=richard joe=joseph dan=daniel dave=david steve=steven tony=anthony chris=christopher"
    ).split()
)
#: Given names, transliterated.
GIVEN = frozenset(SHORT.values()) | frozenset(
    "artyom vadim valentin valeriy vasiliy vitaliy egor igor ilya kirill maksim matvey nikita oleg roman stepan timur yaroslav "
    "valentina varvara veronika viktoriya elizaveta kristina kseniya margarita marina nina oksana raisa sofiya tamara ulyana yana "
    "mary linda barbara jessica sarah charles karen nancy matthew lisa mark helen donald sandra donna paul carol george ruth".split()
)
_ENDS_GIVEN = ("", "a", "u", "om", "em", "y", "e", "i", "oy", "ey", "yu", "ya")
#: Legal forms and fillers, transliterated.
FORMS = frozenset("ooo oao ao pao zao ip nko ano gup mup tov llc ltd inc gmbh corp co plc ag sa kompaniya firma gruppa_kompaniy gk company the".split())
_MALE = ("ov", "ev", "yov", "in", "yn", "skiy", "tskiy", "sky")
_FEMALE = ("ova", "eva", "yova", "ina", "yna", "skaya", "tskaya")
_SUR_END = re.compile(
    r"(?:(?:[oe]v|yov|in|yn)(?:a|u|ym|e|oy)?|(?:s|ts)k(?:iy|y|aya|ogo|omu|im|om|oy|uyu)|enko|y?uk(?:a|u|om|e)?|son|ley|ford|by|wick)$"
)
_SPLIT = re.compile(r"[\s_,;/()\"'«»“”„‘’`-]+")
_INNER = re.compile(r"(?<=[а-яa-z])(?=[А-ЯЁA-Z])")


def latin(text: str) -> str:
    return "".join(LATIN.get(c, c) for c in text.lower())


def lcs_ratio(a: str, b: str, least: float = 0.8 * LEAST_RATIO) -> float:
    """Twice the longest common subsequence over the summed lengths; 0 where the lengths keep it below ``least``."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = diag + 1 if x == y else max(keep, row[j - 1])
            diag = keep
    return 2 * row[-1] / (len(a) + len(b))


def given_name(word: str) -> str | None:
    """The full given name of a word, through short forms, case endings and one typing slip."""
    if word in SHORT:
        return SHORT[word]
    if word in GIVEN:
        return word
    for end in _ENDS_GIVEN[1:]:
        if word.endswith(end):
            base = word[: -len(end)]
            for add in ("", "a", "ya", "y", "iy", "ey", "ay"):
                if base + add in GIVEN:
                    return base + add
                if base + add in SHORT:
                    return SHORT[base + add]
    if len(word) >= 5:
        near = [g for g in GIVEN if abs(len(g) - len(word)) <= 1 and g[0] == word[0] and _one_slip(word, g)]
        if len(near) == 1:
            return near[0]
        near = [g for g in GIVEN if abs(len(g) - len(word)) <= 1 and g[0] != word[0] and sorted(g) == sorted(word)]
        if len(near) == 1:
            return near[0]
    return None


def _one_slip(a: str, b: str) -> bool:
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def family_stem(word: str) -> tuple[str, str]:
    """(family name without case and gender ending, gender f, m or blank)."""
    for tail, base, sex in (
        ("skaya", "sk", "f"), ("skoy", "sk", "f"), ("skuyu", "sk", "f"), ("skiy", "sk", "m"), ("sky", "sk", "m"), ("skogo", "sk", "m"), ("skomu", "sk", "m"), ("skim", "sk", "m"),
        ("ovoy", "ov", "f"), ("evoy", "ev", "f"), ("inoy", "in", "f"), ("ovym", "ov", "m"), ("evym", "ev", "m"), ("inym", "in", "m"),
        ("ovu", "ov", ""), ("evu", "ev", ""), ("inu", "in", ""), ("ova", "ov", "f"), ("eva", "ev", "f"), ("ina", "in", "f"), ("uku", "uk", ""), ("ukom", "uk", ""), ("uka", "uk", ""),
        ("ov", "ov", "m"), ("ev", "ev", "m"), ("in", "in", "m"),
    ):
        if word.endswith(tail) and len(word) - len(tail) >= 2:
            return word[: -len(tail)] + base, sex
    return word, ""


_PATRON = re.compile(r"(?:ovich|evich|ich|ovna|evna|ichna)(?:a|u|em|e|y|oy)?$")


def parse(display: str) -> dict | None:
    """Parts of a typed name, or None for a subject word."""
    text = re.sub(r"[«»“”„\"']", " ", display).strip()
    legal = False
    dotted = set()
    words: list[str] = []
    raw: list[str] = []
    for part in _SPLIT.split(text):
        pieces = [p for p in re.split(r"(?<=\.)", part) if p]
        for p in pieces:
            for q in _INNER.split(p) if len(p) > 3 and not p.isupper() and not p.islower() else [p]:
                w = latin(q.rstrip("."))
                if not w:
                    continue
                if w in FORMS:
                    legal = True
                    continue
                if q.endswith("."):
                    dotted.add(len(words))
                words.append(w)
                raw.append(q.rstrip("."))
    if not words:
        return None
    initials, fulls, abbrev = [], [], []
    two = [w for i, w in enumerate(words) if len(raw[i]) == 2 and i not in dotted and (not raw[i].isupper() or text.isupper())]
    for i, w in enumerate(words):
        n = len(raw[i])
        if n <= 2 and (i in dotted or n == 1 or len(words) > 1 and n == 2):
            initials += [latin(c) for c in raw[i]]
        elif i in dotted:
            abbrev.append(w)
        else:
            fulls.append(w)
    if not legal:
        second = next((w for w in fulls if len(fulls) > 1 and _PATRON.search(w) and len(w) > 5 and not given_name(w)), None)
        rest = [w for w in fulls if w is not second]
        given = next((g for w in rest if (g := given_name(w)) and not (len(rest) == 1 and _SUR_END.search(w))), None)
        given_word = next((w for w in rest if given and given_name(w) == given), None)
        family = [w for w in rest if w is not given_word]
        if given and not family and not abbrev and len(two) == 1:  # a family name of two letters, not two initials
            family, initials = two, [latin(q) for q in raw if len(q) == 1]
        if len(family) == 1 and len(abbrev) <= 1 and (given or (_SUR_END.search(family[0]) and len(family[0]) >= 5)):
            stem, sex = family_stem(family[0])
            short = abbrev[0] if abbrev else (initials[0] if initials and not given else "")
            later = initials if given or abbrev else initials[1:]
            if given and abbrev:
                later = [abbrev[0][0], *later]
            return {
                "kind": "person", "lead": stem, "sex": sex, "given": given or "", "short": short if not given else "",
                "second": second[0] if second else (later[0] if later else ""), "more": family,
            }
    if len(fulls) == 1 and not abbrev and not legal and raw[0].isupper() and 2 <= len(raw[0]) <= 5 and len(words) == 1:
        return {"kind": "acronym", "lead": "", "sex": "", "given": "", "short": "", "second": "", "more": list(raw[0].lower() and [latin(c) for c in raw[0]])}
    return {"kind": "org" if legal or len(fulls) + len(abbrev) > 1 else "word", "lead": fulls[0] if fulls else "", "sex": "", "given": "", "short": "", "second": "", "more": [*fulls[1:], *(a + "." for a in abbrev)]}


#: Pairs of Latin letters that one letter of another alphabet gives, longest first.
_DIGRAPHS = ("shch", "zh", "kh", "ts", "ch", "sh", "yu", "ya", "yo")


def _compact(word: str) -> str:
    """The word with a letter for each digraph, so that one slip is one letter in either alphabet."""
    for i, d in enumerate(_DIGRAPHS):
        word = word.replace(d, chr(0xE000 + i))
    return word


def block_keys(p: dict) -> list[tuple[str, str]]:
    """(key, refinement) pairs of a parsed name; a refinement is ``PARTS`` parts, split by bars, of values split by commas."""
    keys: list[tuple[str, str]] = []
    if p["kind"] == "acronym":
        return [("a:" + "".join(sorted(x[0] for x in p["more"])), "acronym")]
    # A slip in a family name's ending changes its stem more than the name.
    leads = [p["lead"], *p["more"][:1]]
    if p["kind"] != "person":
        plain = set(p.get("common") or ())
        leads = [w for i, w in enumerate([p["lead"], *p["more"]]) if not w.endswith(".") and (not i or len(w) >= 4) and w not in plain]
        if not leads:  # subject words only
            return []
        leads.append("".join(sorted(w.rstrip(".") for w in [p["lead"], *p["more"]])))
        if len(p["more"]) >= 1:
            keys.append(("a:" + "".join(sorted(w[0] for w in [p["lead"], *p["more"]] if w)), ""))
    for lead in dict.fromkeys(leads):
        if not lead:
            continue
        near = _parts(p, lead)
        for form in dict.fromkeys((lead, _compact(lead))):
            keys.append(("=" + form, near))
            keys += [("s:" + form[-n:], near) for n in range(MIN_SUFFIX, len(form))]
            keys += [("d:" + form[:i] + form[i + 1 :], near) for i in range(len(form)) if len(form) > 1]
            keys.append(("d:" + form, near))
    return list(dict.fromkeys(keys))


def _parts(p: dict, word: str) -> str:
    """The refinement of the keys of ``word``: names that differ in a part both have are not linked by ``same`` through this word."""
    plain = lambda xs: ",".join(sorted({x if x.isalnum() else "_" for x in xs}))
    # A first letter may be wrong, left out or swapped with the second: either of the two is shared then.
    head = plain(word[:2])
    if p["kind"] == "person":
        given = p["given"] or p["short"]
        return "|".join(["p", plain(_initial(given)) if given else "", p["given"], plain(p["second"][:1]), p["sex"], head])
    words = [p["lead"], *p["more"]]
    rest = [w for i, w in enumerate(words) if w and i != words.index(word)] if word in words else []
    return "|".join(["o", plain(c for w in rest for c in w.rstrip(".")[:2]), "", "", "", head])


def same(a: dict, b: dict) -> str | None:
    """``full`` or ``weak`` (something that tells people or companies apart is left out), else None."""
    if a["kind"] == "acronym" or b["kind"] == "acronym":
        x, y = (a, b) if a["kind"] == "acronym" else (b, a)
        if y["kind"] not in ("org", "word") or len(y["more"]) + 1 != len(x["more"]):
            return None
        heads = [w[0] for w in [y["lead"], *y["more"]] if w]
        return "weak" if sorted(c[0] for c in x["more"]) == sorted(heads) else None
    if (a["kind"] == "person") != (b["kind"] == "person"):
        return None
    if a["kind"] == "person":
        if a["sex"] and b["sex"] and a["sex"] != b["sex"]:
            return None
        if max(lcs_ratio(a["lead"], b["lead"]), lcs_ratio(a["more"][0], b["more"][0])) < LEAST_RATIO + 0.03 or a["lead"][0] != b["lead"][0] and lcs_ratio(a["lead"][1:], b["lead"][1:]) < 1 and sorted(a["lead"][:2]) != sorted(b["lead"][:2]):
            return None
        if a["second"] and b["second"] and a["second"][0] != b["second"][0]:
            return None
        if a["given"] and b["given"]:
            return "full" if a["given"] == b["given"] else None
        ga, gb = a["given"] or a["short"], b["given"] or b["short"]
        if not ga or not gb:
            return "weak"
        n = min(len(ga), len(gb))
        if n == 1:
            return "weak" if _initial(ga) == _initial(gb) else None
        return "weak" if ga[:n] == gb[:n] else None
    wa, wb = [w for w in [a["lead"], *a["more"]] if w], [w for w in [b["lead"], *b["more"]] if w]
    plain = {*(a.get("common") or ()), *(b.get("common") or ())}
    if not all(any(w not in plain for w in ws if not w.endswith(".")) for ws in (wa, wb)):
        return None  # subject words only
    if "word" in (a["kind"], b["kind"]) and a["kind"] == b["kind"]:
        return "weak" if min(len(a["lead"]), len(b["lead"])) >= 6 and lcs_ratio(a["lead"], b["lead"]) >= 0.88 else None
    ja, jb = "".join(x.rstrip(".") for x in wa), "".join(x.rstrip(".") for x in wb)
    if len(ja) >= 8 and lcs_ratio(ja, jb) >= 0.93:
        return "full" if len(wa) > 1 and len(wb) > 1 else "weak"
    small, large = (wa, wb) if len(wa) <= len(wb) else (wb, wa)
    left = list(large)
    for w in small:
        hit = next((x for x in left if _like(w, x)), None)
        if hit is None:
            return None
        left.remove(hit)
    if max((len(w) for w in small if not w.endswith(".") and w not in plain), default=0) < 5:
        return None
    return "full" if not left and len(small) > 1 else "weak"


def _initial(g: str) -> str:
    return {"yo": "e"}.get(g[:2], g[0])


def agree(a: dict, b: dict) -> bool:
    """Whether nothing in two names that a third one links speaks against their being one."""
    if (a["kind"] == "person") != (b["kind"] == "person"):
        return False
    if "acronym" in (a["kind"], b["kind"]):
        return a["kind"] != b["kind"] and same(a, b) is not None
    if a["kind"] == "person":
        if a["sex"] and b["sex"] and a["sex"] != b["sex"] or a["second"] and b["second"] and a["second"][0] != b["second"][0]:
            return False
        ga, gb = a["given"] or a["short"], b["given"] or b["short"]
        n = min(len(ga), len(gb))
        told = a["given"] == b["given"] if a["given"] and b["given"] else _initial(ga) == _initial(gb) if n == 1 else ga[:n] == gb[:n]
        return (not n or told) and max(lcs_ratio(a["lead"], b["lead"], CHAINED), lcs_ratio(a["more"][0], b["more"][0], CHAINED)) >= CHAINED
    small, large = sorted(([w for w in [x["lead"], *x["more"]] if w] for x in (a, b)), key=len)
    if lcs_ratio("".join(small), "".join(large), 0.9) >= 0.9:
        return True
    left = list(large)
    for w in small:
        hit = next((x for x in left if _like(w, x, CHAINED)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def _like(a: str, b: str, least: float = 0.0) -> bool:
    if a.endswith(".") or b.endswith("."):
        x, y = a.rstrip("."), b.rstrip(".")
        return x.startswith(y) or y.startswith(x)
    if a[0] != b[0] and sorted(a[:2]) != sorted(b[:2]):
        return False
    return lcs_ratio(a, b) >= (least or (0.85 if min(len(a), len(b)) >= 6 else 0.75))


_FIELDS = ("kind", "lead", "sex", "given", "short", "second")
_PARSED = "user_id string, name string, kind string, lead string, sex string, given string, short string, second string, more array<string>"


@lru_cache(maxsize=100_000)
def _parsed_once(display: str) -> dict | None:
    """``parse``, kept per process, as many tenants use the same words; not to be changed."""
    return parse(display)


def parsed_names(rows: DataFrame) -> DataFrame:
    """Parsed names of ``rows`` (user_id, name, display_name), one per (user_id, name)."""
    keep = F.col("user_id").isNotNull() & F.col("name").isNotNull() & (F.trim("name") != "")
    one = rows.where(keep).groupBy("user_id", "name").agg(F.min("display_name").alias("shown"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = _parsed_once(s if s and s.strip() else n)
                if p and (p["lead"] or p["more"]):
                    out.append({"user_id": u, "name": n, **p})
            kind = pa.schema([(f, pa.string()) for f in ("user_id", "name", *_FIELDS)] + [("more", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(out, kind)

    return one.mapInArrow(scan, _PARSED)


def with_common(p: DataFrame) -> DataFrame:
    """``p`` with ``common``: the words of each organisation that too many tenants use to name one."""
    words = p.where("kind in ('org', 'word')").select("row", "user_id", F.explode(F.array_distinct(F.concat(F.array("lead"), "more"))).alias("word"))
    words = words.where("word <> '' and word not like '%.'")
    tenants = p.agg(F.count_distinct("user_id")).head()[0]
    n = F.count_distinct("user_id")
    many = words.groupBy("word").agg(n.alias("n")).where((F.col("n") > FEW) & (F.col("n") > SHARE * tenants)).select("word")
    mine = words.join(many, "word").groupBy("row").agg(F.sort_array(F.collect_set("word")).alias("common"))
    return p.join(mine, "row", "left")


def _keys(p: DataFrame) -> DataFrame:
    """(user_id, row, k, r): the blocking keys of each name with their refinements."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            user, row, key, near = [], [], [], []
            for u, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, r in block_keys(x):
                    user.append(u), row.append(i), key.append(k), near.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(user, pa.string()), pa.array(row, pa.int64()), pa.array(key, pa.string()), pa.array(near, pa.string())], ["user_id", "row", "k", "r"])

    return p.select("user_id", "row", F.struct(*_FIELDS, "more", "common").alias("x")).mapInArrow(scan, "user_id string, row bigint, k string, r string")


def _compare(pairs: DataFrame, full: DataFrame, test: Callable[[dict, dict], str | None]) -> DataFrame:
    """(a, b, verdict) of the ``pairs`` (a, b) of rows of ``full``; only pairs with a verdict."""
    fields = [*_FIELDS, "more", "common"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            verdict = [test(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(verdict, pa.string())], ["a", "b", "verdict"])

    side = lambda p: F.struct(*[F.col(f"{p}.{f}").alias(f) for f in fields])
    j = pairs.join(full.alias("p"), F.col("a") == F.col("p.row")).join(full.alias("q"), F.col("b") == F.col("q.row"))
    return j.select("a", "b", side("p").alias("x"), side("q").alias("y")).mapInArrow(scan, "a bigint, b bigint, verdict string").where("verdict is not null")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))


def _chained(links: DataFrame, full: DataFrame) -> DataFrame:
    """``links`` (a, b) and the pairs that share a partner and agree: spellings too far apart to be found directly."""
    e = cut(_both_ways(links))
    far = e.select(F.col("x").alias("a"), F.col("y").alias("mid")).join(e.select(F.col("x").alias("mid"), F.col("y").alias("b")), "mid").where("a < b")
    far = far.select("a", "b").distinct().join(links, ["a", "b"], "left_anti")
    more = _compare(far, full, lambda x, y: "full" if agree(x, y) else None)
    return cut(links.unionByName(more.select("a", "b")))


def _refined(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, row, key, side) of the refined blocks of ``many`` up to ``COMMON`` rows, and of those that stay larger.

    A row without a part is put to every value that its block has, with side ``m``, and to a block of its likes.
    """
    cols = ["user_id", "row", "key", "side"]
    rest, done = cut(many), many.select(cols).limit(0)
    for part in range(PARTS):
        if rest.isEmpty():
            break
        values = F.col("r")[part]
        lacks = rest.where(values == "")
        has = rest.where(values != "").withColumn("v", F.explode(F.split(values, ",")))
        known = has.select("user_id", "key", "v").distinct()
        alone = lacks.withColumn("v", F.lit(""))
        guest = lacks.join(known, ["user_id", "key"]).withColumn("side", F.lit("m"))
        split = has.unionByName(alone).unionByName(guest).withColumn("key", F.concat_ws("|", "key", "v")).drop("v")
        split = cut(split)
        size = split.groupBy("user_id", "key").agg(F.count("*").alias("n"))
        split = split.join(size.where("n > 1"), ["user_id", "key"])
        done = done.unionByName(split.where(F.col("n") <= COMMON).select(cols))
        rest = cut(split.where(F.col("n") > COMMON).select(*cols, "r"))
    return done, rest.select(cols)


def linked_names(rows: DataFrame) -> DataFrame:
    """(user_id, name_a, name_b) of names that denote the same person or organisation."""
    p = cut(with_common(cut(parsed_names(rows).withColumn("row", F.monotonically_increasing_id()))))
    keys = cut(_keys(p))
    size = keys.groupBy("user_id", "k").agg(F.count("*").alias("n"))
    k = keys.join(size.where("n > 1"), ["user_id", "k"])
    acronym = F.col("k").startswith("a:")
    easy = k.where(acronym | (F.col("n") <= COMMON)).select("user_id", "row", F.col("k").alias("key"), F.when(acronym, F.col("r")).alias("side"))
    many = k.where(~acronym & (F.col("n") > COMMON)).select("user_id", "row", F.col("k").alias("key"), F.lit(None).cast("string").alias("side"), F.split("r", "[|]").alias("r"))
    small, large = _refined(many)
    blocks = cut(easy.unionByName(small))
    # Rows that lack a part met each other in a block of their own, and acronyms meet full names only.
    meet = "x.row < y.row and not (x.side is not null and x.side <=> y.side)"
    met = blocks.alias("x").join(blocks.alias("y"), ["user_id", "key"]).where(meet)
    salt = large.withColumn("salt", F.pmod("row", F.lit(SALTS)))
    every = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    wide = salt.alias("x").join(every.alias("y"), ["user_id", "key", "salt"]).where(meet)
    both = [m.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")) for m in (met, wide)]
    pair = cut(both[0].unionByName(both[1])).distinct()
    full = p.drop("user_id", "name")
    links = cut(_compare(pair, full, same))
    sure = _chained(links.where("verdict = 'full'").select("a", "b"), full)
    # The least row that sure links lead to from a name, over up to three of them: the person or company it stands for.
    e = cut(_both_ways(sure))
    least = lambda frame: cut(frame.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("row"), F.least("x", "y").alias("who")))
    who = least(e)
    for _ in range(2):
        who = least(e.join(who.withColumnRenamed("row", "y"), "y").select("x", F.col("who").alias("y")))
    # A weak link stays if the partners of its less complete side are one person or company.
    weight = F.when(F.col("given") != "", 4).when(F.col("short") != "", F.least(F.length("short"), F.lit(3))).otherwise(0) + F.size("more")
    complete = F.when(F.col("kind") == "person", F.col("given") != "").otherwise(F.size("more") > 0)
    told = p.select("row", complete.alias("complete"), weight.alias("weight")).join(who, "row", "left")
    told = told.select("row", F.when(F.col("complete"), F.coalesce("who", "row")).alias("tells"), "weight")
    w = links.where("verdict = 'weak'").join(sure, ["a", "b"], "left_anti").join(told.toDF("a", "ta", "wa"), "a").join(told.toDF("b", "tb", "wb"), "b")
    less_a = (F.col("wa") < F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("a") > F.col("b")))
    w = cut(w.select("a", "b", F.when(less_a, F.col("a")).otherwise(F.col("b")).alias("less"), F.when(less_a, F.col("tb")).otherwise(F.col("ta")).alias("tells")))
    votes = w.where("tells is not null").groupBy("less").agg(F.count_distinct("tells").alias("n")).where("n > 1")
    kept = _chained(cut(sure.unionByName(w.join(votes, "less", "left_anti").select("a", "b"))), full)
    names = p.select("row", "user_id", "name")
    out = kept.join(names.toDF("a", "user_id", "x"), "a").join(names.select(F.col("row").alias("b"), F.col("name").alias("y")), "b")
    return out.select("user_id", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_names(table(spark, d, "entity_node", "user_id", "name", "display_name")).distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
