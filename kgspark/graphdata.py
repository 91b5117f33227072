"""The note graph of a data folder: zettels, edges, mentions; and the same as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.operators import graph
from kgspark.queries_hierarchy import _RESOLVED, CARD_COLS
from kgspark.tables import table


def zettels(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    need = [c for c in cols or ("user_id", "luhmann_id", "content", "thought_type", "is_root_topic", "created_at") if c not in ("zettel_id", "updated_at")]
    return graph.latest(table(spark, d, "zettel_node", "zettel_id", *need, "updated_at"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.child_of(table(spark, d, "zettel_card", *CARD_COLS))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(zettels(spark, d, "user_id", "tags", "created_at"))


def related(spark: SparkSession, d: str) -> DataFrame:
    """Undirected links between the cards of one note, each with the next by id."""
    c = table(spark, d, "zettel_card", "user_id", "note_id", "zettel_id").where("note_id is not null").distinct()
    w = Window.partitionBy("user_id", "note_id").orderBy("zettel_id")
    return c.select("user_id", F.col("zettel_id").alias("a_id"), F.lead("zettel_id").over(w).alias("b_id")).where("b_id is not null")


Z = "z AS (SELECT * FROM zettel_node WHERE zettel_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zettel_id ORDER BY updated_at DESC) = 1)"
E = _RESOLVED.strip() + """,
e AS (SELECT c.user_id, x.id AS child_id, x.parent AS parent_id FROM edge x
  JOIN (SELECT zettel_id, min(user_id) AS user_id FROM zettel_card GROUP BY 1) c ON c.zettel_id = x.id WHERE x.parent IS NOT NULL)"""
M = """mu AS (SELECT user_id, zettel_id, created_at, replace(replace(trim(lower(tags[pos])), ' ', '_'), '-', '_') AS name, pos
  FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS pos FROM z WHERE tags IS NOT NULL)),
m AS (SELECT user_id, zettel_id, name, created_at FROM (
  SELECT user_id, zettel_id, name, created_at, row_number() OVER (PARTITION BY zettel_id ORDER BY min(pos)) AS k
  FROM mu WHERE name <> '' GROUP BY 1, 2, 3, 4) WHERE k <= 5)"""
R = """r AS (SELECT * FROM (SELECT user_id, zettel_id AS a_id, lead(zettel_id) OVER (PARTITION BY user_id, note_id ORDER BY zettel_id) AS b_id
  FROM (SELECT DISTINCT user_id, note_id, zettel_id FROM zettel_card WHERE note_id IS NOT NULL)) WHERE b_id IS NOT NULL)"""
