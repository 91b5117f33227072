"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import params
from kgspark.graphdata import E, M, R, Z, edges, mentions, related, zettels
from kgspark.operators import graph
from kgspark.operators.hierarchy import hierarchy, resolve_parents
from kgspark.queries_hierarchy import _ABOVE, CARD_COLS
from kgspark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tree(spark: SparkSession, d: str, path: bool = False) -> DataFrame:
    return hierarchy(resolve_parents(table(spark, d, "zettel_card", *CARD_COLS)), with_path=path)


@query(f"""WITH {Z}, {E} SELECT z.zettel_id, e.parent_id, p.luhmann_id AS parent_luhmann FROM z
LEFT JOIN e ON e.user_id = z.user_id AND e.child_id = z.zettel_id LEFT JOIN z p ON p.user_id = e.user_id AND p.zettel_id = e.parent_id""")
def parent_of(spark: SparkSession, d: str) -> DataFrame:
    """Every note with its parent, if any."""
    return graph.parents(zettels(spark, d, "user_id", "luhmann_id"), edges(spark, d)).select("zettel_id", "parent_id", "parent_luhmann")


@query(f"""WITH {Z}, {E} SELECT e.parent_id AS zettel_id, e.child_id, z.luhmann_id AS child_luhmann,
row_number() OVER (PARTITION BY e.user_id, e.parent_id ORDER BY length(z.luhmann_id), z.luhmann_id, e.child_id) AS ord
FROM e JOIN z ON z.user_id = e.user_id AND z.zettel_id = e.child_id""")
def children_of(spark: SparkSession, d: str) -> DataFrame:
    """Children in natural order."""
    return graph.children(zettels(spark, d, "user_id", "luhmann_id"), edges(spark, d)).select("zettel_id", "child_id", "child_luhmann", "ord")


@query(f"""WITH {Z}, {E} SELECT e.user_id, p.luhmann_id AS parent_luhmann, count(*) AS n, max_by(c.luhmann_id, (length(c.luhmann_id), c.luhmann_id)) AS last
FROM e JOIN z c ON c.user_id = e.user_id AND c.zettel_id = e.child_id JOIN z p ON p.user_id = e.user_id AND p.zettel_id = e.parent_id GROUP BY 1, 2""")
def sibling_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.sibling_numbers(zettels(spark, d, "user_id", "luhmann_id"), edges(spark, d))


@query(f"""WITH {R}, b AS (SELECT user_id, a_id AS f, b_id AS t FROM r UNION SELECT user_id, b_id, a_id FROM r),
s AS (SELECT user_id, f, t, 1 AS k FROM b UNION SELECT x.user_id, x.f, y.t, 2 FROM b x JOIN b y ON x.user_id = y.user_id AND x.t = y.f),
g AS (SELECT user_id, f, t, min(k) AS k FROM s WHERE f <> t GROUP BY 1, 2, 3)
SELECT f AS zettel_id, t AS other_id, row_number() OVER (PARTITION BY user_id, f ORDER BY k, t) AS ord FROM g QUALIFY ord <= {params.RELATED_LIMIT}""")
def related_hops(spark: SparkSession, d: str) -> DataFrame:
    """Notes within two undirected steps, the first ten."""
    return graph.related(related(spark, d), 2, params.RELATED_LIMIT).select("zettel_id", "other_id", "ord")


@query(_ABOVE + """SELECT e.id AS zettel_id, CASE WHEN low.id IS NOT NULL THEN -1 ELSE coalesce(n.n, 0) END::BIGINT AS depth
FROM edge e LEFT JOIN low ON low.id = e.id LEFT JOIN (SELECT id, count(*) AS n FROM above GROUP BY id) n ON n.id = e.id""")
def node_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth by the chain of parents; -1 on or below a cycle."""
    return _tree(spark, d).select(F.col("id").alias("zettel_id"), "depth")


@query(_ABOVE + """SELECT e.id AS zettel_id, coalesce(r.anc, e.id) AS root_id FROM edge e
LEFT JOIN (SELECT x.id, x.anc FROM above x JOIN edge a ON a.id = x.anc AND a.parent IS NULL) r ON r.id = e.id
WHERE e.id NOT IN (SELECT id FROM low)""")
def branch_root(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("depth >= 0").select(F.col("id").alias("zettel_id"), F.col("root").alias("root_id"))


_LABEL = r"trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'))"
_VISUAL = (
    _ABOVE.rstrip()
    + f""", {Z}, t AS (SELECT e.id, coalesce(r.anc, e.id) AS root, coalesce(n.n, 0)::BIGINT AS depth FROM edge e
  LEFT JOIN (SELECT x.id, x.anc FROM above x JOIN edge a ON a.id = x.anc AND a.parent IS NULL) r ON r.id = e.id
  LEFT JOIN (SELECT id, count(*) AS n FROM above GROUP BY id) n ON n.id = e.id WHERE e.id NOT IN (SELECT id FROM low)),
c AS (SELECT t.id AS root, (row_number() OVER (PARTITION BY z.user_id ORDER BY coalesce(try_cast(regexp_extract(z.luhmann_id, '^[0-9]+') AS INT), 9999), z.luhmann_id, t.id) - 1) % 10 AS colour
  FROM t JOIN z ON z.zettel_id = t.id WHERE t.id = t.root),
v AS (SELECT t.id AS zettel_id, t.depth, t.root AS root_id, {_LABEL} AS txt, c.colour,
  CASE t.depth WHEN 0 THEN 34 WHEN 1 THEN 16 WHEN 2 THEN 11 WHEN 3 THEN 9 ELSE 7 END AS w FROM t JOIN z ON z.zettel_id = t.id JOIN c ON c.root = t.root)
"""
)


@query(_VISUAL + """SELECT zettel_id, depth, root_id, colour, CASE depth WHEN 0 THEN 62 WHEN 1 THEN 48 WHEN 2 THEN 34 WHEN 3 THEN 28 ELSE 24 END::BIGINT AS size,
CASE depth WHEN 0 THEN 12 WHEN 1 THEN 11 WHEN 2 THEN 10 ELSE 9 END::BIGINT AS font,
CASE WHEN depth = 0 OR txt = '' THEN sh ELSE list_reduce(string_split(sh, ' '), lambda a, w: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= CASE depth WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 4 END THEN a || ' ' || w ELSE a || chr(10) || w END) END AS label
FROM (SELECT *, CASE WHEN length(txt) > w THEN rtrim(left(txt, (w - 1)::INT)) || '…' ELSE txt END AS sh FROM v)""")
def branch_color(spark: SparkSession, d: str) -> DataFrame:
    """Depth, branch colour, size, font and label of every drawn note."""
    return graph.visual_nodes(zettels(spark, d, "user_id", "luhmann_id", "content"), _tree(spark, d))


@query(f"""WITH {Z}, {M} SELECT e.user_id, e.name, coalesce(display_name, e.name) AS display_name, coalesce(entity_type, 'tag') AS entity_type,
coalesce(mention_count, 0) AS mention_count, coalesce(l.n, 0) AS live_mentions
FROM entity_node e LEFT JOIN (SELECT user_id, name, count(*) AS n FROM m GROUP BY 1, 2) l ON l.user_id = e.user_id AND l.name = e.name""")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_counts(mentions(spark, d), table(spark, d, "entity_node"))


@query(f"""WITH {Z}, {M} SELECT user_id, name, zettel_id, row_number() OVER (PARTITION BY user_id, name ORDER BY created_at DESC, zettel_id) AS rank
FROM m QUALIFY rank <= {params.ENTITY_LATEST}""")
def entity_zettels(spark: SparkSession, d: str) -> DataFrame:
    """The newest notes of every entity."""
    return graph.newest(mentions(spark, d), ["user_id", "name"], params.ENTITY_LATEST).select("user_id", "name", "zettel_id", "rank")


@query(f"""WITH {Z} SELECT user_id, thought_type, zettel_id, row_number() OVER (PARTITION BY user_id, thought_type ORDER BY created_at DESC, zettel_id) AS rank
FROM z WHERE thought_type IS NOT NULL QUALIFY rank <= {params.TYPE_LATEST}""")
def type_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest notes of every thought type."""
    z = zettels(spark, d, "user_id", "thought_type", "created_at").where("thought_type is not null")
    return graph.newest(z, ["user_id", "thought_type"], params.TYPE_LATEST).select("user_id", "thought_type", "zettel_id", "rank")


@query(f"WITH {Z}, {M} SELECT user_id, name FROM entity_node e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND m.name = e.name)")
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(table(spark, d, "entity_node", "user_id", "name"), mentions(spark, d))


_CARD_ID = "CASE WHEN lower(trim(parent_id)) NOT IN ('', 'null', 'nan', 'none') THEN trim(lower(trim(parent_id)), '{}') END"


@query(f"""WITH o AS (SELECT zettel_id AS id, min(user_id) AS user_id FROM zettel_card GROUP BY 1)
SELECT DISTINCT c.zettel_id AS from_id, b.id AS to_id, a.user_id AS from_user, b.user_id AS to_user FROM zettel_card c
JOIN o a ON a.id = c.zettel_id JOIN o b ON lower(b.id) = {_CARD_ID} WHERE a.user_id <> b.user_id""")
def cross_tenant_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parent links that lead to another tenant's card."""
    from kgspark.operators.hierarchy import canonical_id

    c = table(spark, d, "zettel_card", "zettel_id", "user_id", "parent_id")
    owner = c.groupBy(F.col("zettel_id").alias("id")).agg(F.min("user_id").alias("user_id"))
    link = c.select(F.col("zettel_id").alias("from_id"), canonical_id(F.col("parent_id")).alias("p")).distinct()
    to = owner.select(F.col("id").alias("to_id"), F.lower("id").alias("p"))
    return graph.foreign_edges(link.join(to, "p").select("from_id", "to_id"), owner).distinct()


@query(f"""WITH {Z}, {E}, {M}, {R} SELECT (SELECT count(*) FROM z) AS zettels, (SELECT count(*) FROM entity_node) AS entities, 0::BIGINT AS sources,
(SELECT count(*) FROM e) + (SELECT count(*) FROM m) + (SELECT count(*) FROM r) AS relationships""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Four independent counts in one row."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    rel = edges(spark, d).select("user_id").unionByName(mentions(spark, d).select("user_id")).unionByName(related(spark, d).select("user_id"))
    out = one(zettels(spark, d, "user_id"), "zettels").crossJoin(one(table(spark, d, "entity_node", "name"), "entities"))
    return out.crossJoin(one(rel, "relationships")).withColumn("sources", F.lit(0).cast("bigint"))


@query(f"""WITH {Z}, {M}, a AS (SELECT user_id, count(*) AS zettels, count(*) FILTER (is_root_topic) AS roots FROM z GROUP BY 1),
b AS (SELECT user_id, count(*) AS entities FROM entity_node GROUP BY 1), c AS (SELECT user_id, count(*) AS mentions FROM m GROUP BY 1)
SELECT user_id, coalesce(zettels, 0) AS zettels, coalesce(roots, 0) AS roots, coalesce(entities, 0) AS entities, coalesce(mentions, 0) AS mentions
FROM a FULL JOIN b USING (user_id) FULL JOIN c USING (user_id)""")
def user_stats(spark: SparkSession, d: str) -> DataFrame:
    z = zettels(spark, d, "user_id", "is_root_topic").groupBy("user_id").agg(F.count("*").alias("zettels"), F.count_if("is_root_topic").alias("roots"))
    e = table(spark, d, "entity_node", "user_id").groupBy("user_id").agg(F.count("*").alias("entities"))
    m = mentions(spark, d).groupBy("user_id").agg(F.count("*").alias("mentions"))
    return z.join(e, "user_id", "full").join(m, "user_id", "full").fillna(0)


@query(f"""WITH {Z}, {E} SELECT z.user_id, z.zettel_id, luhmann_id, coalesce(content, '') AS content, coalesce(thought_type, 'unknown') AS thought_type,
coalesce(is_root_topic, false) AS is_root_topic, e.parent_id FROM z LEFT JOIN e ON e.user_id = z.user_id AND e.child_id = z.zettel_id""")
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All notes with defaults filled in and their parent."""
    e = edges(spark, d).withColumnRenamed("child_id", "zettel_id")
    z = zettels(spark, d).join(e, ["user_id", "zettel_id"], "left")
    return z.select("user_id", "zettel_id", "luhmann_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("thought_type", F.lit("unknown")).alias("thought_type"), F.coalesce("is_root_topic", F.lit(False)).alias("is_root_topic"), "parent_id")


@query(f"""WITH {Z}, {E}, {M}, {R} SELECT user_id, child_id AS from_id, parent_id AS to_id, 'CHILD_OF' AS rel_type FROM e
UNION SELECT user_id, zettel_id, 'entity:' || name, 'MENTIONS' FROM m UNION SELECT user_id, a_id, b_id, 'RELATED_TO' FROM r""")
def export_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.export_edges(edges(spark, d), mentions(spark, d), related(spark, d))


@query(f"""WITH {Z}, {E}, {M}, {R}, x AS (SELECT user_id, child_id AS from_id, parent_id AS to_id, 'CHILD_OF' AS rel_type FROM e
UNION SELECT user_id, zettel_id, 'entity:' || name, 'MENTIONS' FROM m UNION SELECT user_id, a_id, b_id, 'RELATED_TO' FROM r)
SELECT from_id, to_id, rel_type, CASE rel_type WHEN 'RELATED_TO' THEN '#D1D5DB' ELSE '#9CA3AF' END AS colour, CASE rel_type WHEN 'RELATED_TO' THEN '4,4' WHEN 'MENTIONS' THEN '2,4' END AS dashes,
CASE WHEN rel_type IN ('CHILD_OF', 'RELATED_TO') THEN 1.0 ELSE 0.8 END::DOUBLE AS width, CASE rel_type WHEN 'RELATED_TO' THEN 'связана с' ELSE '' END AS label FROM x""")
def edge_styles(spark: SparkSession, d: str) -> DataFrame:
    """Every edge with what a drawing needs."""
    return graph.visual_edges(graph.export_edges(edges(spark, d), mentions(spark, d), related(spark, d))).drop("user_id")


@query(f"""WITH {Z}, {M} SELECT e.user_id, 'entity:' || e.name AS node_id,
CASE WHEN length(coalesce(display_name, e.name)) > 9 THEN rtrim(left(coalesce(display_name, e.name), 8)) || '…' ELSE coalesce(display_name, e.name) END AS label
FROM entity_node e WHERE EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND m.name = e.name)""")
def export_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with at least one mention, with a short label."""
    e = table(spark, d, "entity_node", "user_id", "name", "display_name").join(mentions(spark, d).select("user_id", "name"), ["user_id", "name"], "left_semi")
    t = F.coalesce("display_name", "name")
    return e.select("user_id", F.concat(F.lit("entity:"), "name").alias("node_id"), F.when(F.length(t) > 9, F.concat(F.rtrim(F.left(t, F.lit(8))), F.lit("…"))).otherwise(t).alias("label"))


@query(f"""WITH {Z}, {E}, h AS (SELECT user_id, zettel_id FROM z WHERE contains(lower(content), 'договор')),
a AS (SELECT user_id, zettel_id, 1 AS hit FROM h UNION ALL SELECT e.user_id, e.child_id, 0 FROM e JOIN h ON h.user_id = e.user_id AND h.zettel_id = e.parent_id
UNION ALL SELECT e.user_id, e.parent_id, 0 FROM e JOIN h ON h.user_id = e.user_id AND h.zettel_id = e.child_id)
SELECT zettel_id, max(hit) = 1 AS hit FROM a GROUP BY user_id, zettel_id""")
def neighbourhood_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood_search(zettels(spark, d, "user_id", "content"), edges(spark, d), "договор").select("zettel_id", "hit")


@query(f"""WITH {Z}, {E}, h AS (SELECT user_id, zettel_id FROM z WHERE contains(lower(content), 'договор')),
a AS (SELECT user_id, zettel_id FROM h UNION SELECT e.user_id, e.child_id FROM e JOIN h ON h.user_id = e.user_id AND h.zettel_id = e.parent_id UNION SELECT e.user_id, e.parent_id FROM e JOIN h ON h.user_id = e.user_id AND h.zettel_id = e.child_id)
SELECT e.user_id, e.child_id, e.parent_id FROM e JOIN a x ON x.user_id = e.user_id AND x.zettel_id = e.child_id JOIN a y ON y.user_id = e.user_id AND y.zettel_id = e.parent_id""")
def neighbourhood_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that a search leaves visible."""
    e = edges(spark, d)
    return graph.edges_within(graph.neighbourhood_search(zettels(spark, d, "user_id", "content"), e, "договор"), e).select("user_id", "child_id", "parent_id")


@query(_ABOVE.rstrip() + f""", {Z}, k AS (SELECT zettel_id AS id, lpad(length(coalesce(luhmann_id, ''))::VARCHAR, 4, '0') || ':' || coalesce(luhmann_id, '') || ':' || zettel_id AS k FROM z),
full_ AS (SELECT id, anc FROM above UNION SELECT id, id FROM edge),
dep AS (SELECT e.id, coalesce(n.n, 0)::BIGINT AS depth FROM edge e LEFT JOIN (SELECT id, count(*) AS n FROM above GROUP BY id) n ON n.id = e.id),
ok AS (SELECT e.id FROM edge e LEFT JOIN (SELECT x.id, x.anc FROM above x JOIN edge a ON a.id = x.anc AND a.parent IS NULL) r ON r.id = e.id JOIN edge t ON t.id = coalesce(r.anc, e.id)
  WHERE e.id NOT IN (SELECT id FROM low) AND NOT t.says),
s AS (SELECT f.id, string_agg(k.k, '/' ORDER BY d.depth) AS sort FROM full_ f JOIN ok ON ok.id = f.id JOIN k ON k.id = f.anc JOIN dep d ON d.id = f.anc GROUP BY 1)
SELECT z.user_id, row_number() OVER (PARTITION BY z.user_id ORDER BY s.sort) AS ord, repeat('  ', d.depth) || coalesce(z.luhmann_id, '') || ' ' ||
CASE WHEN length({_LABEL}) > greatest(40, 120 - 4 * d.depth) THEN left({_LABEL}, greatest(40, 120 - 4 * d.depth)) || '...' ELSE {_LABEL} END AS line
FROM s JOIN z ON z.zettel_id = s.id JOIN dep d ON d.id = s.id""")
def graph_text(spark: SparkSession, d: str) -> DataFrame:
    """Each tenant's notes as an indented tree."""
    return graph.tree_lines(zettels(spark, d, "user_id", "luhmann_id", "content"), _tree(spark, d, path=True))


@query("SELECT zettel_id, count(*) AS n FROM zettel_node GROUP BY 1 HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    """Ids that occur more than once: what a constraint would reject."""
    return graph.repeated_keys(table(spark, d, "zettel_node", "zettel_id"), "zettel_id")


@query(f"WITH {Z} SELECT user_id, luhmann_id, count(*) AS n FROM z GROUP BY 1, 2 HAVING count(*) > 1")
def luhmann_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_keys(zettels(spark, d, "user_id", "luhmann_id"), "user_id", "luhmann_id")
