"""Seams for models: what a step needs from outside, and stand-ins that are clearly no models.

A provider is a function over Arrow batches or a plain function that is created once per Python worker,
so a real model is loaded once. Failures are values of a ``status`` column, never texts.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Decider(Protocol):
    def __call__(self, card: dict, candidates: list[dict]) -> dict: ...


def hashed_embedder(dim: int = 64) -> Embedder:
    """Stand-in: a unit vector from hashed words, equal for equal texts. No semantics."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / (n or 1.0) for x in v])
        return out

    return embed


def embedded(df: DataFrame, text: str, out: str, make: Callable[[], Embedder], prefix: str = "passage: ", batch: int = 32) -> DataFrame:
    """``df`` with a vector column, computed in batches of ``batch`` texts; null texts give null vectors."""
    made: dict[str, Embedder] = {}

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = made.setdefault("m", make())
        for s in batches:
            vecs: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(at), batch):
                for i, v in zip(at[k : k + batch], model([prefix + s.iloc[i] for i in at[k : k + batch]]), strict=True):
                    vecs[i] = v
            yield pd.Series(vecs)

    return df.withColumn(out, embed(F.col(text)))


def threshold_decider(child_at: float = 0.6, update_at: float = 0.95) -> Decider:
    """Stand-in: decides by the best candidate's score alone."""

    def decide(card: dict, candidates: list[dict]) -> dict:
        if not candidates:
            return {"action": "new_root", "target": None}
        best = max(candidates, key=lambda c: (c["score"], c["zettel_id"]))
        action = "update_of" if best["score"] >= update_at else "child_of" if best["score"] >= child_at else "new_root"
        return {"action": action, "target": None if action == "new_root" else best["zettel_id"]}

    return decide


NO_CONTEXT = "No matching notes were found."


def answers(contexts: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """(query_id, answer, status): an empty context gets the fixed text without a call."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, state = [], []
            for c in b.column(1).to_pylist():
                if not c:
                    said.append(NO_CONTEXT), state.append("empty")
                    continue
                try:
                    said.append(model(c) if model else c.split("\n", 2)[1].removeprefix("- ")), state.append("ok")
                except Exception as e:  # a failed call is a row, not a failed job
                    said.append(None), state.append(f"error: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(state)], ["query_id", "answer", "status"])

    kind = contexts.schema["query_id"].dataType.simpleString()
    return contexts.select("query_id", "context").mapInArrow(scan, f"query_id {kind}, answer string, status string")


def sentence_atoms(notes: DataFrame) -> DataFrame:
    """(note_id, pos, content, thought_type, tags, parent_hint, is_root_topic): stand-in that splits a note into sentences."""
    parts = F.filter(F.split(F.col("text"), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    p = notes.select("note_id", F.posexplode(parts).alias("pos", "content"))
    null = F.lit(None).cast("string")
    return p.select("note_id", "pos", "content", F.lit("fact").alias("thought_type"), F.array().cast("array<string>").alias("tags"), null.alias("parent_hint"), (F.col("pos") == 0).alias("is_root_topic"))


def judged(rows: DataFrame, prompt: str, scores: list[str], make: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """``rows`` with one score column per name in [0, 1] and ``status``; a failed call has null scores.

    Scores out of range are an error of the judge, not a value.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for b in batches:
            out, state = {s: [] for s in scores}, []
            for text in b.column(b.schema.get_field_index(prompt)).to_pylist():
                try:
                    got = judge(text)
                    vals = [float(got[s]) for s in scores]
                    if not all(0 <= v <= 1 for v in vals):
                        raise ValueError("score out of range")
                    state.append("ok")
                except Exception as e:  # a failed call is a row, not a failed job
                    vals = [None] * len(scores)
                    state.append(f"error: {type(e).__name__}")
                for s, v in zip(scores, vals, strict=True):
                    out[s].append(v)
            cols = [*b.columns, *(pa.array(out[s], pa.float64()) for s in scores), pa.array(state, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *scores, "status"])

    from pyspark.sql import types as T

    fields = [*rows.schema.fields, *(T.StructField(s, T.DoubleType()) for s in scores), T.StructField("status", T.StringType())]
    return rows.mapInArrow(scan, T.StructType(fields))


def read_documents(files: DataFrame, readers: dict[str, Callable[[bytes], list[tuple[str, list[str]]]]]) -> DataFrame:
    """(path, page, text, tables, status) of binary files (path, content, reader), e.g. by OCR or speech recognition.

    A reader turns bytes into pages of (text, tables); plain text needs none. Failures are a status.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, kind in zip(*(b.column(c).to_pylist() for c in ("path", "content", "reader")), strict=True):
                try:
                    pages = readers[kind](content) if kind in readers else [(content.decode(), [])] if kind == "txt" else None
                    if pages is None:
                        rows.append({"path": path, "page": 0, "text": None, "tables": [], "status": "unsupported"})
                        continue
                    rows += [{"path": path, "page": i, "text": t, "tables": tables, "status": "ok"} for i, (t, tables) in enumerate(pages, 1)]
                except Exception as e:
                    rows.append({"path": path, "page": 0, "text": None, "tables": [], "status": f"error: {type(e).__name__}"})
            kinds = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("tables", pa.list_(pa.string())), ("status", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "content", "reader").mapInArrow(scan, "path string, page int, text string, tables array<string>, status string")


def annotated(matches: DataFrame, make: Callable[[], Callable[[str, str], bool]], relevant: float, borderline: float) -> DataFrame:
    """(query_id, id, score, relevant, status) of ``matches`` (query_id, id, score, question, content).

    From ``relevant`` on a match counts, below ``borderline`` it does not; in between the verifier is asked, once per
    row. A failed call counts as not relevant and says so in ``status``; scores that are null are not relevant.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verify = None
        for b in batches:
            verdict, state = [], []
            for score, question, content in zip(*(b.column(c).to_pylist() for c in ("score", "question", "content")), strict=True):
                if score is None or score < borderline or score >= relevant:
                    verdict.append(score is not None and score >= relevant), state.append("score")
                    continue
                try:
                    verify = verify or make()
                    verdict.append(bool(verify(question, content))), state.append("verified")
                except Exception as e:  # a failed call is a row, not a failed job
                    verdict.append(False), state.append(f"error: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(verdict, pa.bool_()), pa.array(state, pa.string())], ["query_id", "id", "score", "relevant", "status"])

    kinds = {f.name: f.dataType.simpleString() for f in matches.schema.fields}
    return matches.select("query_id", "id", "score", "question", "content").mapInArrow(scan, f"query_id {kinds['query_id']}, id {kinds['id']}, score {kinds['score']}, relevant boolean, status string")


def batch_run(notes: DataFrame, make: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """A model's cards of every note with the time they took: one row per card.

    (note_id, pos, content, thought_type, tags, parent_hint, is_root_topic, latency_ms_total, latency_ms_per_card, cards_count)
    from ``notes`` (note_id, text). Notes that fail or give no card are left out, as no card can carry their time.
    """
    card = "content string, thought_type string, tags array<string>, parent_hint string, is_root_topic boolean"
    fields = ("content", "thought_type", "tags", "parent_hint", "is_root_topic")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = make()
        for pdf in batches:
            rows = []
            for note, said in zip(pdf["note_id"], pdf["text"], strict=True):
                began = time.perf_counter()
                try:
                    cards = split(said) if said else []
                except Exception:  # a failed note has no rows
                    cards = []
                took = (time.perf_counter() - began) * 1000
                for i, c in enumerate(cards):
                    rows.append((note, i, *(c.get(f) for f in fields), round(took, 2), round(took / len(cards), 2), len(cards)))
            yield pd.DataFrame(rows, columns=["note_id", "pos", *fields, "latency_ms_total", "latency_ms_per_card", "cards_count"])

    kind = notes.schema["note_id"].dataType.simpleString()
    return notes.select("note_id", "text").mapInPandas(scan, f"note_id {kind}, pos int, {card}, latency_ms_total double, latency_ms_per_card double, cards_count int")
