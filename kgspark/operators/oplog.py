"""Mutable note graph on immutable files: an append-only log of operations and its current view.

Tables on plain files know no update or delete; every mutation appends rows (seq, user_id, op,
zettel_id, parent_id, luhmann_id, content, thought_type, tags). The current view is the latest content
per node without tombstones; entities and mentions are derived. One shuffle on (user_id, zettel_id)
gives the view, so a compaction job can write it out partitioned by tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import graph
from kgspark.operators.hierarchy import descendants, hierarchy
from kgspark.session import cut

CREATED, UPDATED, DELETED = "NODE_CREATED", "CONTENT_UPDATED", "NODE_DELETED"


def created(cards: DataFrame) -> DataFrame:
    """Operations that create roots and children. A child whose parent is unknown is created nowhere."""
    have = cards.select("user_id", F.col("zettel_id").alias("parent_id"))
    roots = cards.where("parent_id is null")
    kids = cards.where("parent_id is not null").join(have, ["user_id", "parent_id"], "left_semi")
    cols = ["seq", "user_id", F.lit(CREATED).alias("op"), "zettel_id", "parent_id", "luhmann_id", "content", "thought_type", "tags"]
    return roots.select(*cols).unionByName(kids.select(*cols))


def updated(changes: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations that replace the content of existing nodes; unknown nodes change nothing."""
    known = ops.where(F.col("op") == CREATED).select("user_id", "zettel_id")
    c = changes.join(known, ["user_id", "zettel_id"], "left_semi")
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    return c.select("seq", "user_id", F.lit(UPDATED).alias("op"), "zettel_id", null("string", "parent_id"), null("string", "luhmann_id"), "content", null("string", "thought_type"), null("array<string>", "tags"))


def current(ops: DataFrame) -> DataFrame:
    """(user_id, zettel_id, parent_id, luhmann_id, content, thought_type, tags, created_seq, updated_seq)."""
    is_new, said = F.col("op") == CREATED, F.col("op").isin(CREATED, UPDATED)
    first = lambda c: F.min_by(F.when(is_new, F.col(c)), F.when(is_new, F.col("seq"))).alias(c)
    g = ops.groupBy("user_id", "zettel_id").agg(
        first("parent_id"), first("luhmann_id"), first("thought_type"), first("tags"),
        F.max_by(F.when(said, F.col("content")), F.when(said, F.col("seq"))).alias("content"),
        F.min(F.when(is_new, F.col("seq"))).alias("created_seq"), F.max(F.when(said, F.col("seq"))).alias("updated_seq"),
        F.max(F.when(F.col("op") == DELETED, F.col("seq"))).alias("gone"),
    )
    return g.where("created_seq is not null and (gone is null or gone < created_seq)").drop("gone")


def cascade(view: DataFrame, targets: DataFrame) -> DataFrame:
    """(user_id, target_id, zettel_id) of each target and everything below it."""
    e = view.select(F.col("zettel_id").alias("id"), F.col("parent_id").alias("parent"), F.lit(False).alias("lost"))
    below = descendants(hierarchy(e)).select(F.col("ancestor").alias("target_id"), F.col("descendant").alias("zettel_id"))
    t = targets.select("user_id", F.col("zettel_id").alias("target_id"))
    known = t.join(view.select("user_id", F.col("zettel_id").alias("target_id")), ["user_id", "target_id"], "left_semi")
    out = known.join(below, "target_id").unionByName(known.withColumn("zettel_id", F.col("target_id")))
    # Written once: reports and tombstones read it again, and an aggregate right on the union of two
    # equally partitioned branches was seen to count some groups twice (Spark 4.1 keeps the partitioning
    # of a union's branches).
    return cut(out.select("user_id", "target_id", "zettel_id"))


def deletion_report(view: DataFrame, gone: DataFrame) -> DataFrame:
    """(target_id, luhmann_id, deleted_count, removed_entities) per target: also entities only its subtree mentioned."""
    m = view.where("tags is not null").select("user_id", "zettel_id", F.explode(text.normalize_tags(F.col("tags"))).alias("name"))
    total = m.groupBy("user_id", "name").agg(F.count("*").alias("n"))
    mine = gone.join(m, ["user_id", "zettel_id"]).groupBy("user_id", "target_id", "name").agg(F.count("*").alias("k"))
    lone = mine.join(total, ["user_id", "name"]).where("k = n").groupBy("user_id", "target_id").agg(F.count("*").alias("removed_entities"))
    per = gone.groupBy("user_id", "target_id").agg(F.count("*").alias("deleted_count"))
    head = view.select("user_id", F.col("zettel_id").alias("target_id"), "luhmann_id")
    return per.join(head, ["user_id", "target_id"]).join(lone, ["user_id", "target_id"], "left").fillna(0, ["removed_entities"])


def tombstones(gone: DataFrame, seq: int) -> DataFrame:
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    g = gone.select("user_id", "zettel_id").distinct()
    return g.select(F.lit(seq).cast("bigint").alias("seq"), "user_id", F.lit(DELETED).alias("op"), "zettel_id", null("string", "parent_id"), null("string", "luhmann_id"), null("string", "content"), null("string", "thought_type"), null("array<string>", "tags"))


def without_foreign_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """The edges whose ends share a tenant: what remains after the start-up purge."""
    bad = graph.foreign_edges(edges, owner).select("from_id", "to_id")
    return edges.join(bad, ["from_id", "to_id"], "left_anti")


def drop_tenant(rows: DataFrame, user_id: str) -> DataFrame:
    """All rows but the tenant's; written back as an overwrite of its partition."""
    return rows.where(F.col("user_id") != user_id)
