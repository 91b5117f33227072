"""Evaluation texts leaking into training text.

One Aho-Corasick automaton holds every run of ``width`` consecutive words of every test item
(question, a blank, reference answer). The words that occur in any item get one character each, so
a pattern is ``width`` characters long and a document becomes one character per word, with a
separator for every word no item uses; the automaton scans that string once. Hits carry word
numbers, which are mapped back to character offsets in the original text.

Scale: the automaton grows with the held-out items, not with the corpus. It is built inside each
Python worker from the items, which are sent as one broadcast value; ``max_item_chars`` bounds them,
and a larger test set is cut into blocks of that size which are scanned one after the other. The
corpus is read once, is never shuffled and never collected. Whole texts are scanned.

Defined results: null texts and items with fewer than ``width`` words have no hits; repeated rows
of a document give one result row; overlapping hits of one item in one document are merged into
passages.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.tables import table

WORD = re.compile(r"[^\W_]+")
_BUILT: dict[object, tuple] = {}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("ё", "е"))


def automaton(items: list[tuple[int, str]], width: int):
    """(code of each word, automaton over word codes whose values are lists of item ids)."""
    import ahocorasick

    code: dict[str, str] = {}
    runs: dict[str, set[int]] = {}
    for item, text in items:
        line = "".join(code.setdefault(w, chr(0x4E00 + len(code)) if len(code) < 0x5000 else chr(0x10000 + len(code))) for w in words(text))
        for i in range(len(line) - width + 1):
            runs.setdefault(line[i : i + width], set()).add(item)
    auto = ahocorasick.Automaton()
    for run, ids in runs.items():
        auto.add_word(run, tuple(sorted(ids)))
    if runs:
        auto.make_automaton()
    return code, auto


def _once(key: object, items: list[tuple[int, str]], width: int):
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(items, width)
    return _BUILT[key]


def passages(text: str, code: dict[str, str], auto, width: int) -> list[tuple[int, int, int, int]]:
    """(item, first character, end character, words) of each merged passage."""
    if not len(auto):
        return []
    low = text.lower().replace("ё", "е")
    get = code.get
    line = "".join([get(w, " ") for w in WORD.findall(low)])
    spans: dict[int, list[list[int]]] = {}
    for end, ids in auto.iter(line):
        for item in ids:
            mine = spans.setdefault(item, [])
            if mine and end - width + 1 <= mine[-1][1] + 1:
                mine[-1][1] = end
            else:
                mine.append([end - width + 1, end])
    if not spans:
        return []
    # lower() can lengthen a text (a few letters have two-character lower forms) and so split a word: offsets
    # are taken in the original word by word, or letter by letter where the words differ.
    at = [m.span() for m in WORD.finditer(text)]
    if len(at) != len(line):
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        at = [(origin[a], origin[b - 1] + 1) for a, b in (m.span() for m in WORD.finditer(low))]
    return [(item, at[a][0], at[b][1], b - a + 1) for item, mine in spans.items() for a, b in mine]


SCHEMA = "doc_id bigint, item_id bigint, char_from bigint, char_to bigint, n_words bigint"


def leaks(documents: DataFrame, items: DataFrame, width: int = 10, max_item_chars: int = 8_000_000) -> DataFrame:
    """One row per passage: (doc_id, item_id, char_from, char_to, n_words)."""
    spark = documents.sparkSession
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", F.concat_ws(" ", "question", "reference_answer").alias("t"))
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in rows.toLocalIterator():
        if held + len(r.t) > max_item_chars and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((r.item_id, r.t))
        held += len(r.t)
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    out = None
    for block in blocks:
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex  # names the automaton in a worker

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            code, auto = _once(key, sent.value, width)
            for b in batches:
                found: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found += [(doc, *p) for p in passages(text, code, auto, width)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "char_from", "char_to", "n_words"])

        part = docs.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_item", "item_id", "question", "reference_answer"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents and with how long a passage at most."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


_WORDS = r"string_split(trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
_BASE = f"""WITH i AS (SELECT item_id, {_WORDS.format("question || ' ' || reference_answer")} AS w FROM eval_item),
g AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10))
"""
_ITEMS = """, pos AS (SELECT doc_id, k, array_to_string(w[k : k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
hit AS (SELECT DISTINCT doc_id, item_id, k FROM pos JOIN g USING (g)),
part AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS p FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) <= 10 THEN 0 ELSE 1 END AS fresh FROM hit)),
run AS (SELECT doc_id, item_id, max(k) - min(k) + 10 AS n FROM part GROUP BY doc_id, item_id, p)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n) AS longest FROM run GROUP BY 1"""
SQL = {"p9_found": _BASE + "SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)", "p9_items": _BASE.rstrip() + _ITEMS}
QUERIES = {"p9_found": p9_found, "p9_passages": p9_passages, "p9_items": p9_items}
