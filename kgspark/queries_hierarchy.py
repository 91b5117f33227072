"""Queries of problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.hierarchy import descendants, hierarchy, resolve_parents
from kgspark.tables import table

CARD_COLS = ("zettel_id", "user_id", "luhmann_id", "parent_id", "parent_luhmann_id")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve_parents(table(spark, d, "zettel_card", *CARD_COLS))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(_edges(spark, d), with_path=False)
    return t.select(F.col("id").alias("zettel_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth", "status")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy(_edges(spark, d))
    return t.select(F.col("id").alias("zettel_id"), F.array_join("path", "/").alias("path"), "depth", "status")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    t = descendants(hierarchy(_edges(spark, d)))
    return t.select(F.col("ancestor").alias("zettel_id"), F.col("descendant").alias("descendant_id"), "distance")


_RESOLVED = r"""
said AS (
  SELECT zettel_id AS id, coalesce(user_id, '') AS u, nullif(trim(luhmann_id), '') AS l,
    CASE WHEN lower(trim(parent_id)) NOT IN ('', 'null', 'nan', 'none') THEN trim(lower(trim(parent_id)), '{}') END AS p,
    CASE WHEN lower(trim(parent_luhmann_id)) NOT IN ('', 'null', 'nan', 'none') THEN trim(parent_luhmann_id) END AS pl
  FROM (SELECT DISTINCT * FROM zettel_card)),
edge AS (
  SELECT c.id, CASE WHEN c.p IS NOT NULL THEN a.id WHEN c.want IS NOT NULL THEN b.id END AS parent,
    c.p IS NOT NULL OR c.want IS NOT NULL AS says
  FROM (SELECT *, coalesce(pl, CASE WHEN regexp_matches(l, '^[0-9]+(\.[0-9]+[a-z]*|[a-z][0-9]*)+$')
      THEN regexp_replace(l, '([.][0-9]+|[a-z]+|[0-9]+)$', '') END) AS want FROM said) c
  LEFT JOIN said a ON a.u = c.u AND lower(a.id) = c.p
  LEFT JOIN said b ON c.p IS NULL AND b.u = c.u AND b.l = c.want)
"""

_ABOVE = (
    "WITH RECURSIVE "
    + _RESOLVED
    + """, above(id, anc) AS (
  SELECT id, parent FROM edge WHERE parent IS NOT NULL
  UNION SELECT x.id, e.parent FROM above x JOIN edge e ON e.id = x.anc WHERE e.parent IS NOT NULL),
ring AS (SELECT id FROM above WHERE id = anc),
low AS (SELECT DISTINCT id FROM above WHERE anc IN (SELECT id FROM ring))
"""
)

SQL = {
    "p6_found": _ABOVE
    + """SELECT e.id AS zettel_id,
  CASE WHEN low.id IS NOT NULL THEN '' ELSE coalesce(r.anc, e.id) END AS root_id,
  CASE WHEN low.id IS NOT NULL THEN -1 ELSE coalesce(n.n, 0) END::BIGINT AS depth,
  CASE WHEN ring.id IS NOT NULL THEN 'on_cycle' WHEN low.id IS NOT NULL THEN 'below_cycle'
    WHEN t.says THEN 'detached' ELSE 'tree' END AS status
FROM edge e LEFT JOIN low ON low.id = e.id LEFT JOIN ring ON ring.id = e.id
LEFT JOIN (SELECT id, count(*) AS n FROM above GROUP BY id) n ON n.id = e.id
LEFT JOIN (SELECT x.id, x.anc FROM above x JOIN edge a ON a.id = x.anc AND a.parent IS NULL) r ON r.id = e.id
LEFT JOIN edge t ON t.id = coalesce(r.anc, e.id)""",
    "p6_descendants": _ABOVE.rstrip()
    + """, n AS (SELECT id, count(*) AS n FROM above GROUP BY id)
SELECT x.anc AS zettel_id, x.id AS descendant_id, (n.n - coalesce(k.n, 0))::BIGINT AS distance FROM above x JOIN n ON n.id = x.id LEFT JOIN n k ON k.id = x.anc WHERE x.id NOT IN (SELECT id FROM low)""",
    "p6_paths": _ABOVE.rstrip()
    + """, n AS (SELECT e.id, count(x.anc) AS n FROM edge e LEFT JOIN above x ON x.id = e.id GROUP BY 1),
a AS (SELECT x.id, string_agg(x.anc, '/' ORDER BY n.n) AS up, count(*) AS k FROM above x JOIN n ON n.id = x.anc GROUP BY 1),
r AS (SELECT x.id, x.anc FROM above x JOIN edge e ON e.id = x.anc AND e.parent IS NULL)
SELECT e.id AS zettel_id, CASE WHEN low.id IS NULL THEN coalesce(a.up || '/', '') || e.id END AS path, CASE WHEN low.id IS NOT NULL THEN -1 ELSE coalesce(a.k, 0) END::BIGINT AS depth,
  CASE WHEN ring.id IS NOT NULL THEN 'on_cycle' WHEN low.id IS NOT NULL THEN 'below_cycle' WHEN t.says THEN 'detached' ELSE 'tree' END AS status
FROM edge e LEFT JOIN low ON low.id = e.id LEFT JOIN ring ON ring.id = e.id LEFT JOIN a ON a.id = e.id LEFT JOIN r ON r.id = e.id LEFT JOIN edge t ON t.id = coalesce(r.anc, e.id)""",
}

QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}
