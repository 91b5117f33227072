"""Broken prompt and response pairs: ordered rules for emptiness, breaking off, refusal, copying and language.

``defects`` returns every rule that fires for a pair; ``defect`` keeps the first in ``ORDER`` as the pair's
one defect type. A text breaks off if it ends in an open bracket or quote, a joining mark, an ellipsis, a
bare list marker, a word that no sentence ends in, or inside a word. For the last, a text without a final
stop gives its last word; it is cut if longer words that begin with it are seen ``TIMES`` times as often as
the word itself, counted with Spark over all questions and answers but for the words that end one. A missing
stop after a whole word is no defect. Only words and last words are shuffled; nothing is collected or
sent to the workers.

Defined results: a null or blank question makes no claim about language or copying; a null or blank
answer is ``empty`` and nothing else; a last word that no longer word begins with is whole; repeated rows give repeated results; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import cut
from kgspark.tables import table

#: Salts of rows with the same last word.
SALTS = 16
ORDER = ("empty", "refusal", "copies_question", "wrong_language", "truncated")

_WORD = re.compile(r"[^\W_]+")
#: Answers that say nothing.
_NOTHING = frozenset(
    "null none nan n/a na nil - -- — – . .. ... … ? ?? ??? () [] {} \"\" '' «» undefined empty пусто нет_ответа no_answer keine_antwort "
    "(пусто) (empty) [empty] <empty> <null> <none> no_response нет_данных k.a. ohne_antwort tbd todo".split()
)
_TAGS = re.compile(r"</?\w+/?>")
_BLANK = re.compile(r"[\s​‌‍﻿ ]+")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    t = _BLANK.sub(" ", answer).strip()
    t = _TAGS.sub("", t).strip() if _TAGS.search(t) else t
    return not t or "_".join(t.lower().split()) in _NOTHING or not _WORD.search(t)


#: Phrases by which an answer declines, as patterns.
_REFUSE = re.compile(
    r"не (?:могу|можем|смогу|в состоянии|вправе|имею права|имею возможности|готов\w*|буду|стану)\s(?:\w+\s){0,2}?(?:помочь|ответить|отвечать|обсуждать|сообщить|сказать|комментировать|предоставить|выполнить|дать ответ)|"
    r"(?:отвечать|обсуждать|комментировать|помогать)\s(?:\w+\s){0,3}не (?:стану|буду|могу)|воздерж\w+ от (?:ответа|комментари\w+)|"
    r"(?:запрещено|не разрешено|не положено)\s(?:обсуждать|отвечать|говорить|сообщать)|нет возможности (?:дать ответ|ответить|помочь)|"
    r"ничего (?:сообщить|сказать|ответить)\s(?:\w+\s){0,2}не могу|вынужден\w* отказать|отказываюсь (?:отвечать|от ответа)|"
    r"(?:can(?:no|')t|can ?not|could not|won't|will not|(?:am|are|'m) (?:un|not )able to|unable to|not in a position to)\s(?:\w+\s){0,2}?(?:help|assist|answer|respond|comment|discuss|provide|fulfil|say)|"
    r"(?:must|have to|need to) (?:decline|refuse)|(?:rather|prefer) not (?:to )?(?:respond|answer|say|comment)|"
    r"not (?:allowed|permitted|able) to (?:discuss|answer|say|respond|help)|(?:don't|do not) have anything to say|"
    r"(?:darf|kann|möchte|werde) ich (?:\w+\s){0,4}(?:nichts? (?:sagen|beantworten|helfen|antworten|mitteilen)|nicht beantworten|nicht helfen)|"
    r"(?:diese|die) (?:frage|anfrage) (?:\w+\s){0,3}nicht (?:beantworten|bearbeiten)|muss ich (?:\w+\s){0,2}(?:antwort )?ablehnen|die antwort (?:ablehnen|verweigern)|nicht (?:weiter)?helfen",
    re.I,
)
#: What may stand beside a refusal and says nothing more.
_POLITE = re.compile(
    r"могу (?:ли я )?помочь с чем|чем ещё|чем еще|попробуйте|обратитесь|переформулир|спросите|задайте|простите|извините|сожалени|is there anything|anything else|please (?:rephrase|try|ask|contact)|"
    r"try (?:again|asking)|rephrase|sorry|unfortunately|afraid|as an? (?:ai|assistant)|как (?:ассистент|языковая модель|ии)|bitte (?:anders|formulieren|fragen|wenden)|leider|entschuldigung|als assistent|sonst noch|kann ich (?:sonst|anders)|"
    r"let me know|happy to help|буду рад|спасибо за (?:понимание|вопрос)|thank you|danke",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def is_refusal(answer: str) -> bool:
    if not _REFUSE.search(answer):
        return False
    rest = [s for s in _SENTENCE.split(answer.strip()) if not _REFUSE.search(s) and not _POLITE.search(s)]
    return sum(len(_WORD.findall(s)) for s in rest) < 3


def _words(t: str) -> list[str]:
    return [w.replace("ё", "е") for w in _WORD.findall(t.lower())]


_LEAD = re.compile(r"^\s*(?:вопрос|question|frage|q|в)\s*[:—-]\s*|^\s*(?:ваш вопрос(?: был)?|вы спросили|вы спрашиваете|you asked|you are asking|your question(?: was)?|sie fragten|sie haben gefragt|ihre frage)\s*[:—-]\s*", re.I)


def copies_question(question: str, answer: str) -> bool:
    q, a = _words(question), _words(_LEAD.sub("", answer))
    if len(q) < 3 or len(a) < 3:
        return False
    left = Counter(a)
    known = set(q)
    new = sum(n for w, n in left.items() if w not in known)
    return new <= 0.1 * len(a) and len(a) >= 0.5 * len(q) and len(set(a) & known) >= 0.5 * len(known)


#: Function words that tell English from German.
_EN = frozenset("the of and to in is for that with as by at from it we be are was on an if so not but our my this has have which who what why how did does once until because while before than no first they".split())
_DE = frozenset("der die das und zu den von mit für auf ist wir im des dem nicht ein eine sich bei wird um bis am auch hat warum was wie haben zum zur sonst weil dass nach noch lautet übernimmt müssen sinkt kostet oder aber".split())
_ASKS = re.compile(
    r"по[- ]?(?P<ru>русски|английски|немецки)|на (?P<ru2>русском|английском|немецком)|\bin (?P<en>russian|english|german)\b|auf (?P<de>russisch|englisch|deutsch)\b|"
    r"(?P<rs>translate|переведи|übersetze)",
    re.I,
)
_LANG = {"русск": "ru", "англ": "en", "немец": "de", "russ": "ru", "engl": "en", "germ": "de", "deuts": "de"}


_QUOTED = re.compile(r"«[^»]*»|\"[^\"]*\"|“[^”]*”|„[^“]*“|\([^)]*\)|\S*@\S*")


def language(text: str) -> str | None:
    """ru, en or de by alphabet and function words; None where it can't be told."""
    bare = _QUOTED.sub(" ", text)
    cyr = sum("а" <= c <= "я" or c == "ё" for c in bare.lower())
    lat = sum("a" <= c <= "z" or c in "äöüß" for c in bare.lower())
    if cyr + lat < 6:
        return None
    if cyr > 0.6 * (cyr + lat):
        return "ru"
    if lat > 0.7 * (cyr + lat):
        w = _words(bare)
        en, de = sum(x in _EN for x in w), sum(x in _DE for x in w) + sum(c in "äöüß" for c in bare.lower())
        if en > de:
            return "en"
        if de > en:
            return "de"
        return "latin"
    return None


def wrong_language(question: str, answer: str) -> bool:
    m = _ASKS.search(question)
    want = language(question)
    if m:
        said = (m.group("ru") or m.group("ru2") or m.group("en") or m.group("de") or "").lower()
        asked = next((v for k, v in _LANG.items() if said.startswith(k)), None)
        if asked is None:
            return False
        got = language(answer)
        return got is not None and got not in (asked, want) and not (got == "latin" and "ru" not in (asked,)) if asked else False
    got = language(answer)
    if want is None or got is None or want == got:
        return False
    if "latin" in (want, got):
        return "ru" in (want, got) and len(_words(answer)) >= 3
    return len(_words(answer)) >= 3


# ---------------------------------------------------------------- breaking off

_LETTERS = re.compile(r"[^\W\d_]+")
#: A tail is cut inside a word if longer words that begin with it are seen so many times as often.
TIMES = 100
#: Letters of the longest word of the vocabulary; longer runs are damaged text.
LONGEST = 64

#: Words no sentence ends in.
_HANGING = frozenset(
    "и в во на с со к ко о об от до по за из у не что как а но или же бы если то для при под над без между через после перед про вместо около против насчет насчёт среди чтобы потому поэтому который которая которые пока где когда также это "
    "the of and to in is for that with as by at from an a or if so but our my this has have because while until once before than which who although when about into "
    "der die das und zu den von mit für auf ist im des dem ein eine bei um bis weil dass ob sonst oder aber wir nach".split()
)
_PAIRS = (("(", ")"), ("[", "]"), ("«", "»"), ("{", "}"), ("“", "”"))


def breaks_off(answer: str) -> bool | str:
    """Whether the text breaks off; where only its last word can tell, that word."""
    t = _BLANK.sub(" ", answer.replace("\n", "\ue000")).replace("\ue000", "\n").strip()
    if not t:
        return False
    if re.search(r"\w\s?(?:…|\.\.\.)$", t):
        return True
    if re.search(r"[^\W\d_]-$", t) or t[-1] in ",:;([{«—–-/&+=":
        return True
    last = t.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:\d{1,3}[.)]|[-*•–—]|[a-zа-я][.)])", last, re.I):
        return True
    for a, b in _PAIRS:
        if t.count(a) > t.count(b) and t.rfind(a) > t.rfind(b):
            return True
    if t.count('"') % 2 or t.count("```") % 2:
        return True
    tail = t.rstrip("*")
    if not tail or not tail[-1].isalpha():
        return False
    word = _LETTERS.findall(tail)[-1].lower()
    return word in _HANGING or (word if len(word) <= LONGEST else False)


def is_truncated(answer: str, vocabulary: dict[str, int]) -> bool:
    """The verdict on one text by word counts (``vocabulary``)."""
    found = breaks_off(answer)
    if isinstance(found, bool):
        return found
    longer = sum(n for w, n in vocabulary.items() if len(w) > len(found) and w.startswith(found))
    return longer >= max(1, TIMES * vocabulary.get(found, 0))


def defects(question: str | None, answer: str | None, vocabulary: dict[str, int]) -> list[str]:
    """Every defect type of the pair, in ``ORDER``."""
    out = _local_defects(question, answer)
    return [*out, "truncated"] if out != ["empty"] and is_truncated(answer, vocabulary) else out


def _local_defects(question: str | None, answer: str | None) -> list[str]:
    """The defect types but ``truncated``."""
    if is_empty(answer):
        return ["empty"]
    out = []
    if is_refusal(answer):
        out.append("refusal")
    if question and question.strip():
        if copies_question(question, answer):
            out.append("copies_question")
        if wrong_language(question, answer):
            out.append("wrong_language")
    return out


def word_counts(pairs: DataFrame) -> DataFrame:
    """(word, n) over all questions and answers; a word that ends its text is left out, as it may be cut."""
    texts = pairs.select(F.explode(F.array("question", "answer")).alias("t")).where("t is not null")
    # Whatever follows the last run of letters keeps that run whole; else it is dropped as the last piece.
    words = texts.select(F.split(F.lower("t"), r"[^\p{L}]+").alias("w"))
    words = words.select(F.explode(F.slice("w", F.lit(1), F.size("w") - 1)).alias("word"))
    return words.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def cut_tails(tails: DataFrame, words: DataFrame) -> DataFrame:
    """The ``tails`` (tail) that are a word cut inside, by ``words`` (word, n)."""
    words = cut(words)
    longer = words.where(F.length("word") > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("tail"))
    longer = longer.groupBy("tail").agg(F.sum("n").alias("longer"))
    seen = tails.distinct().join(longer, "tail").join(words.select(F.col("word").alias("tail"), "n"), "tail", "left")
    return seen.where(F.col("longer") >= TIMES * F.coalesce("n", F.lit(0))).select("tail")


def pair_defects(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(src, row_key, defects) of ``pairs`` (src, row_key, question, answer); ``words`` as from ``word_counts``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, tail = [], []
            for q, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out = _local_defects(q, a)
                found = out != ["empty"] and breaks_off(a)
                made.append([*out, "truncated"] if found is True else out)
                tail.append(found or None if isinstance(found, str) else None)
            cols = [pa.array(made, pa.list_(pa.string())), pa.array(tail, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["src", "row_key", "defects", "tail"])

    p = cut(pairs.select("src", "row_key", "question", "answer").mapInArrow(scan, "src string, row_key string, defects array<string>, tail string"))
    open_ = p.where("tail is not null")
    # A common last word is spread by salt.
    off = cut_tails(open_.select("tail"), words).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("off", F.lit(True))
    told = open_.withColumn("salt", F.pmod(F.xxhash64("src", "row_key"), F.lit(SALTS)).cast("int")).join(off, ["tail", "salt"], "left")
    told = told.select("src", "row_key", F.when(F.col("off"), F.concat("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects")).alias("defects"))
    return p.where("tail is null").select("src", "row_key", "defects").unionByName(told)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "history_messages", "id", "message_text", "bot_answer", "message_type").where("message_type = 'search_query'")
    q = table(spark, d, "qa_pair", "qa_id", "question", "reference_answer")
    m = m.select(F.lit("message").alias("src"), F.col("id").cast("string").alias("row_key"), F.col("message_text").alias("question"), F.col("bot_answer").alias("answer"))
    return m.unionByName(q.select(F.lit("qa").alias("src"), F.col("qa_id").alias("row_key"), "question", F.col("reference_answer").alias("answer")))


def _rated(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return pair_defects(p, word_counts(p)).where("size(defects) > 0")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select("src", "row_key", F.col("defects")[0].alias("defect")).distinct()


def p2_all(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select("src", "row_key", F.explode("defects").alias("defect"))


QUERIES = {"p2_found": p2_found, "p2_all": p2_all}
SQL: dict[str, str] = {}
