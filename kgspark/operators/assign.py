"""Hierarchical ids for whole batches: siblings are numbered by window, ids composed level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import luhmann
from kgspark.operators.ranking import row_numbers
from kgspark.session import cut


def ordinals(nodes: DataFrame) -> DataFrame:
    """``k``: place among the siblings by (length, id); roots are siblings of each other."""
    return row_numbers(nodes, ["parent"], [F.length("id"), F.col("id")], "k")


def luhmann_ids(nodes: DataFrame) -> DataFrame:
    """(id, luhmann_id) of a forest (id, parent) of any depth, level by level until none is left.

    Nodes on or below a cycle have no root and get no id.
    """
    n = cut(ordinals(nodes))
    front = n.where("parent is null").select("id", luhmann.child_id(F.lit(None).cast("string"), F.col("k")).alias("luhmann_id"))
    out = front
    while True:
        up = front.select(F.col("id").alias("parent"), F.col("luhmann_id").alias("above"))
        front = cut(n.join(up, "parent").select("id", luhmann.child_id(F.col("above"), F.col("k")).alias("luhmann_id")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)


def next_children(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Ids for new children: behind the highest existing sibling, in order of arrival.

    ``existing`` (user_id, parent_luhmann, n_last) holds the highest ordinal per parent (not the count, so
    gaps at the end are reused as they are); ``arrivals`` (user_id, parent_luhmann, seq, key).
    """
    w = Window.partitionBy("user_id", "parent_luhmann").orderBy("seq", "key")
    a = arrivals.withColumn("r", F.row_number().over(w))
    j = a.join(existing, ["user_id", "parent_luhmann"], "left")
    k = F.coalesce("n_last", F.lit(0)) + F.col("r")
    return j.select("user_id", "key", "seq", "parent_luhmann", luhmann.child_id(F.col("parent_luhmann"), k).alias("luhmann_id"))
