"""From thoughts to cards, and from cards to the graph.

``build_cards`` is relational: quotes of a parent are resolved by a join inside the message. ``fold`` is
what a tenant's cards need in sequence, as a card may attach to the card before it; it runs per tenant
and batch, with the tenant's vectors at hand, and is parallel over tenants.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import params
from kgspark.functions import luhmann, text
from kgspark.session import cut


def validated(thoughts: DataFrame) -> DataFrame:
    """Empty thoughts dropped; hints that equal no cleaned content nulled; the first becomes root if none is.

    ``thoughts``: (note_id, pos, content, thought_type, tags, parent_hint, is_root_topic).
    """
    t = thoughts.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("clean", text.clean_content(F.col("content")))
    known = t.select("note_id", F.col("clean").alias("parent_hint")).distinct().withColumn("there", F.lit(True))
    t = t.join(known, ["note_id", "parent_hint"], "left")
    w = Window.partitionBy("note_id")
    none = F.max(F.coalesce(F.col("is_root_topic"), F.lit(False)).cast("int")).over(w) == 0
    first = F.col("pos") == F.min("pos").over(w)
    return t.withColumn("is_root_topic", F.when(none & first, True).otherwise(F.coalesce("is_root_topic", F.lit(False)))).withColumn(
        "parent_hint", F.when(F.col("there"), F.col("parent_hint"))
    ).drop("there", "clean")


def build_cards(thoughts: DataFrame) -> DataFrame:
    """(note_id, pos, temp_id, parent_temp, luhmann_id, content, thought_type, tags, is_root_topic).

    A quote resolves to the last earlier thought with exactly that content (never to itself); a thought
    whose quote is unknown becomes a root. Ids are composed level by level until no level is left.
    """
    t = thoughts.withColumn("temp_id", F.concat("note_id", F.lit("#"), F.col("pos").cast("string")))
    src = t.select("note_id", F.col("content").alias("parent_hint"), F.col("pos").alias("ppos"), F.col("temp_id").alias("parent_temp"))
    hint = t.where(~F.col("is_root_topic") & F.col("parent_hint").isNotNull()).select("note_id", "pos", "parent_hint")
    up = hint.join(src, ["note_id", "parent_hint"]).where("ppos < pos").groupBy("note_id", "pos").agg(F.max_by("parent_temp", "ppos").alias("parent_temp"))
    c = t.join(up, ["note_id", "pos"], "left")
    w = Window.partitionBy("note_id", "parent_temp").orderBy("pos")
    c = cut(c.withColumn("k", F.row_number().over(w)))
    front = c.where("parent_temp is null").select("temp_id", luhmann.child_id(F.lit(None).cast("string"), F.col("k")).alias("luhmann_id"))
    ids = front
    while True:
        front = cut(c.join(front.select(F.col("temp_id").alias("parent_temp"), F.col("luhmann_id").alias("above")), "parent_temp").select("temp_id", luhmann.child_id(F.col("above"), F.col("k")).alias("luhmann_id")))
        if front.isEmpty():
            break
        ids = ids.unionByName(front)
    root = F.col("parent_temp").isNull()
    return c.join(ids, "temp_id").select("note_id", "pos", "temp_id", "parent_temp", "luhmann_id", text.clean_content(F.col("content")).alias("content"), "thought_type", text.normalize_tags(F.col("tags"), params.MAX_TAGS).alias("tags"), root.alias("is_root_topic"))


FOLDED = "user_id string, seq bigint, zettel_id string, action string, target_id string, luhmann_id string, candidates bigint"


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def next_id(parent: str | None, k: int) -> str:
    """The id of the k-th child."""
    if parent is None:
        return str(k)
    if parent.isdigit():
        return f"{parent}.{k}"
    if parent[-1].isdigit():
        return parent + _letters(k)
    return f"{parent}{k}" if parent[-1].isalpha() else f"{parent}.1"


def fold(cards: DataFrame, make_decider: Callable[[], Callable[[dict, list[dict]], dict]], threshold: float = params.LINK_THRESHOLD, k: int = params.TOP_K) -> DataFrame:
    """Place every card of a tenant, one after the other (user_id, seq, zettel_id, parent_id, note_id, embedding).

    Inner children follow their parent if it was placed in this batch (the remap is keyed by note);
    otherwise a card searches the tenant's earlier cards, and the decision makes it a root, a child or an
    update. A missing target makes a child a root; an update without target writes nothing. A tenant's
    batch is processed by one task, as each step reads the ones before; its vectors are kept as one
    growing matrix.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        decide, rows = make_decider(), []
        pdf = pdf.sort_values(["seq", "zettel_id"])
        placed: dict[str, str] = {}
        kids: dict[str | None, int] = {}
        ids: list[str] = []
        mat: np.ndarray | None = None  # rows in use: as many as ids; doubled when full
        for r in pdf.itertuples(index=False):
            v = None if r.embedding is None else np.asarray(r.embedding, np.float64)
            if v is not None and (not np.isfinite(v).all() or not v.any()):
                v = None
            action, target, n = "new_root", None, 0
            if r.parent_id is not None and r.parent_id in placed:
                action, target = "child_of", r.parent_id
            elif v is not None and mat is not None and mat.shape[1] == len(v):
                s = mat[: len(ids)] @ (v / np.linalg.norm(v))
                best = sorted((-round(float(s[i]), 6), ids[i]) for i in np.flatnonzero(s >= threshold))[:k]
                found = [{"zettel_id": z, "score": -x} for x, z in best]
                n = len(found)
                if found:
                    d = decide({"zettel_id": r.zettel_id}, found)
                    action, target = d["action"], d["target"]
                    if action not in params.ACTIONS or (action == "child_of" and target not in placed):
                        action, target = "new_root", None
            lid = None
            if action == "update_of":
                lid = placed.get(target)
                if lid is None:
                    action, target = "error", None
            else:
                up = placed[target] if action == "child_of" else None
                kids[up] = kids.get(up, 0) + 1
                lid = placed[r.zettel_id] = next_id(up, kids[up])
                if v is not None and (mat is None or mat.shape[1] == len(v)):
                    if mat is None:
                        mat = np.empty((16, len(v)))
                    elif len(ids) == len(mat):
                        mat = np.concatenate([mat, np.empty_like(mat)])
                    mat[len(ids)] = v / np.linalg.norm(v)
                    ids.append(r.zettel_id)
            rows.append((key[0], r.seq, r.zettel_id, action, target, lid, n))
        return pd.DataFrame(rows, columns=["user_id", "seq", "zettel_id", "action", "target_id", "luhmann_id", "candidates"])

    return cards.select("user_id", "seq", "zettel_id", "parent_id", "embedding").groupBy("user_id").applyInPandas(run, FOLDED)
