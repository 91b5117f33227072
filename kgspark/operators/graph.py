"""Reads of the note graph: neighbours, closures, entities, exports.

Every join key holds the tenant. Nodes and edges are plain frames: zettels (user_id, zettel_id, ...),
child_of (user_id, child_id, parent_id), mentions (user_id, zettel_id, name, created_at), related_to
(user_id, a_id, b_id), entities (user_id, name, ...). Nothing here collects or broadcasts by hand;
orders always end in an id, so limits are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import luhmann, text
from kgspark.operators.hierarchy import resolve_parents
from kgspark.operators.ranking import row_numbers


def latest(nodes: DataFrame, key: str = "zettel_id", by: str = "updated_at") -> DataFrame:
    """One row per key, the latest."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return nodes.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_id(zettels: DataFrame, user_id: str, zettel_id: str) -> DataFrame:
    """The tenant's node of that id; both tests reach the file scan."""
    return zettels.where((F.col("user_id") == user_id) & (F.col("zettel_id") == zettel_id)).limit(1)


def by_luhmann(zettels: DataFrame, user_id: str, luhmann_id: str) -> DataFrame:
    return zettels.where((F.col("user_id") == user_id) & (F.col("luhmann_id") == luhmann_id)).orderBy("zettel_id").limit(1)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def child_of(cards: DataFrame) -> DataFrame:
    """(user_id, child_id, parent_id) from cards, whichever way a card names its parent."""
    return resolve_parents(cards).where("parent is not null").select("user_id", F.col("id").alias("child_id"), F.col("parent").alias("parent_id"))


def mentions(zettels: DataFrame) -> DataFrame:
    """(user_id, zettel_id, name, created_at): the normalised tags of each zettel."""
    t = zettels.where("tags is not null").select("user_id", "zettel_id", "created_at", text.normalize_tags(F.col("tags")).alias("t"))
    return t.select("user_id", "zettel_id", F.explode("t").alias("name"), "created_at")


def parents(zettels: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its parent, null where it has none (left outer, N:1)."""
    up = zettels.select("user_id", F.col("zettel_id").alias("parent_id"), F.col("luhmann_id").alias("parent_luhmann"))
    e = edges.withColumnRenamed("child_id", "zettel_id")
    return zettels.select("user_id", "zettel_id", "luhmann_id").join(e, ["user_id", "zettel_id"], "left").join(up, ["user_id", "parent_id"], "left")


def children(zettels: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, zettel_id, child_id, child_luhmann, ord): children in natural order."""
    kid = zettels.select("user_id", F.col("zettel_id").alias("child_id"), F.col("luhmann_id").alias("child_luhmann"))
    named = edges.withColumnRenamed("parent_id", "zettel_id").join(kid, ["user_id", "child_id"])
    return row_numbers(named, ["user_id", "zettel_id"], [F.length("child_luhmann"), F.col("child_luhmann"), F.col("child_id")], "ord")


def sibling_numbers(zettels: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, parent_luhmann, n, last): number of siblings under a parent id and the last of them."""
    c = children(zettels, edges)
    p = zettels.select("user_id", "zettel_id", F.col("luhmann_id").alias("parent_luhmann"))
    key = F.struct(F.length("child_luhmann"), F.col("child_luhmann"))
    return c.join(p, ["user_id", "zettel_id"]).groupBy("user_id", "parent_luhmann").agg(F.count("*").alias("n"), F.max(key)["child_luhmann"].alias("last"))


def related(edges: DataFrame, hops: int, limit: int) -> DataFrame:
    """(user_id, zettel_id, other_id, ord): nodes within 1..``hops`` undirected steps, the first ``limit`` by (steps, id).

    ``hops`` = 0 has no related nodes.
    """
    both = edges.select("user_id", F.col("a_id").alias("f"), F.col("b_id").alias("t")).unionByName(edges.select("user_id", F.col("b_id").alias("f"), F.col("a_id").alias("t"))).distinct()
    step = both.select("user_id", F.col("f").alias("zettel_id"), F.col("t").alias("other_id"), F.lit(1).alias("steps"))
    if hops < 1:
        return step.limit(0).select("user_id", "zettel_id", "other_id", F.lit(1).cast("bigint").alias("ord"))
    found, front = step, step
    for k in range(2, hops + 1):
        nxt = both.withColumnRenamed("f", "other_id")
        front = front.join(nxt, ["user_id", "other_id"]).select("user_id", "zettel_id", F.col("t").alias("other_id"), F.lit(k).alias("steps")).distinct()
        found = found.unionByName(front)
    best = found.where("zettel_id <> other_id").groupBy("user_id", "zettel_id", "other_id").agg(F.min("steps").alias("steps"))
    w = Window.partitionBy("user_id", "zettel_id").orderBy("steps", "other_id")
    return best.withColumn("ord", F.row_number().over(w).cast("bigint")).where(F.col("ord") <= limit).select("user_id", "zettel_id", "other_id", "ord")


def entity_counts(m: DataFrame, entities: DataFrame) -> DataFrame:
    """Stored and live mention counts of every entity."""
    live = m.groupBy("user_id", "name").agg(F.count("*").alias("live_mentions"))
    return entities.select("user_id", "name", F.coalesce("display_name", "name").alias("display_name"), F.coalesce("entity_type", F.lit("tag")).alias("entity_type"), F.coalesce("mention_count", F.lit(0)).alias("mention_count")).join(live, ["user_id", "name"], "left").withColumn("live_mentions", F.coalesce("live_mentions", F.lit(0)))


def orphans(entities: DataFrame, m: DataFrame) -> DataFrame:
    """Entities that nothing mentions."""
    return entities.select("user_id", "name").join(m.select("user_id", "name"), ["user_id", "name"], "left_anti")


def newest(rows: DataFrame, by: list[str], limit: int, at: str = "created_at", key: str = "zettel_id") -> DataFrame:
    """The newest ``limit`` rows per group, newest first, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), key)
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)


def foreign_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) whose ends belong to different tenants; ``owner`` is (id, user_id)."""
    a = owner.select(F.col("id").alias("from_id"), F.col("user_id").alias("from_user"))
    b = owner.select(F.col("id").alias("to_id"), F.col("user_id").alias("to_user"))
    return edges.join(a, "from_id").join(b, "to_id").where("from_user <> to_user")


def export_edges(edges: DataFrame, m: DataFrame, rel: DataFrame) -> DataFrame:
    """(user_id, from_id, to_id, rel_type) of all edge kinds, each once; entities as ``entity:`` and name."""
    a = edges.select("user_id", F.col("child_id").alias("from_id"), F.col("parent_id").alias("to_id"), F.lit("CHILD_OF").alias("rel_type"))
    b = m.select("user_id", F.col("zettel_id").alias("from_id"), F.concat(F.lit("entity:"), "name").alias("to_id"), F.lit("MENTIONS").alias("rel_type"))
    c = rel.select("user_id", F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), F.lit("RELATED_TO").alias("rel_type"))
    return a.unionByName(b).unionByName(c).distinct()


def by_depth(depth: Column, values: tuple) -> Column:
    """The value of a depth: the last one for all deeper levels."""
    out = F.lit(values[-1])
    for d in range(len(values) - 2, -1, -1):
        out = F.when(depth == d, F.lit(values[d])).otherwise(out)
    return out


#: Node sizes, font sizes and label widths by depth.
SIZES, FONTS, LABELS = (62, 48, 34, 28, 24), (12, 11, 10, 9), (34, 16, 11, 9, 7)
#: Line widths of wrapped labels by depth, from depth 1 on.
LINES = (6, 5, 4)
COLOURS = 10


def visual_nodes(zettels: DataFrame, tree: DataFrame) -> DataFrame:
    """(zettel_id, depth, root_id, size, font, label, colour): what a drawing of the graph needs."""
    roots = tree.where("id = root").join(zettels.select(F.col("zettel_id").alias("id"), "user_id", "luhmann_id"), "id")
    order = [luhmann.root_number(F.col("luhmann_id")), F.col("luhmann_id"), F.col("id")]
    colour = row_numbers(roots.select("user_id", "luhmann_id", "id"), ["user_id"], order, "k").select(F.col("id").alias("root"), ((F.col("k") - 1) % COLOURS).alias("colour"))
    n = zettels.select(F.col("zettel_id").alias("id"), "content").join(tree.where("depth >= 0").select("id", "root", "depth"), "id").join(colour, "root")
    d = F.col("depth")
    width = by_depth(d, LABELS)
    t = text.collapse(F.coalesce("content", F.lit("")))
    short = F.when(F.length(t) > width, F.concat(F.rtrim(F.left(t, width - 1)), F.lit("…"))).otherwise(t)
    label = F.when(d == 0, short).otherwise(text.wrap(short, by_depth(d - 1, LINES)))
    return n.select(F.col("id").alias("zettel_id"), "depth", F.col("root").alias("root_id"), by_depth(d, SIZES).cast("bigint").alias("size"), by_depth(d, FONTS).cast("bigint").alias("font"), label.alias("label"), "colour")


#: Fixed values: (relation, colour, dashes, width) of drawn edges, and what other relations get.
EDGE_STYLES = (("CHILD_OF", "#9CA3AF", None, 1.0), ("RELATED_TO", "#D1D5DB", "4,4", 1.0), ("MENTIONS", "#9CA3AF", "2,4", 0.8))
OTHER_EDGE = ("#9CA3AF", None, 0.8)
#: Labels of drawn edges; other relations show their name, hierarchy and mentions nothing.
EDGE_LABELS = {"RELATED_TO": "связана с", "CHILD_OF": "", "MENTIONS": ""}


def visual_edges(edges: DataFrame) -> DataFrame:
    """``edges`` (..., rel_type) with colour, dashes, width and label: what a drawing of the graph needs, each edge once."""
    rel = F.col("rel_type")

    def pick(at: int, kind: str) -> Column:
        out = F.lit(OTHER_EDGE[at - 1]).cast(kind)
        for style in EDGE_STYLES:
            out = F.when(rel == style[0], F.lit(style[at]).cast(kind)).otherwise(out)
        return out

    label = F.lower(rel)
    for name, said in EDGE_LABELS.items():
        label = F.when(rel == name, said).otherwise(label)
    return edges.distinct().withColumns({"colour": pick(1, "string"), "dashes": pick(2, "string"), "width": pick(3, "double"), "label": label})


def neighbourhood_search(zettels: DataFrame, edges: DataFrame, needle: str) -> DataFrame:
    """(user_id, zettel_id, hit): nodes whose text holds ``needle`` and their direct neighbours."""
    hit = zettels.where(F.lower("content").contains(needle.lower())).select("user_id", "zettel_id")
    down = edges.join(hit.withColumnRenamed("zettel_id", "parent_id"), ["user_id", "parent_id"]).select("user_id", F.col("child_id").alias("zettel_id"))
    up = edges.join(hit.withColumnRenamed("zettel_id", "child_id"), ["user_id", "child_id"]).select("user_id", F.col("parent_id").alias("zettel_id"))
    all_ = hit.withColumn("hit", F.lit(1)).unionByName(down.unionByName(up).withColumn("hit", F.lit(0)))
    return all_.groupBy("user_id", "zettel_id").agg(F.max("hit").cast("boolean").alias("hit"))


def edges_within(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of which both ends are shown; ``found`` (user_id, zettel_id)."""
    f = found.select("user_id", "zettel_id")
    e = edges.join(f.withColumnRenamed("zettel_id", "child_id"), ["user_id", "child_id"], "left_semi")
    return e.join(f.withColumnRenamed("zettel_id", "parent_id"), ["user_id", "parent_id"], "left_semi")


def tree_lines(zettels: DataFrame, tree: DataFrame) -> DataFrame:
    """(user_id, ord, line): the tenant's notes as an indented tree in natural order.

    ``tree`` is the result of ``hierarchy`` with paths. Nodes that no root reaches are left out.
    """
    key = zettels.select(F.col("zettel_id").alias("id"), F.concat(F.lpad(F.length(F.coalesce("luhmann_id", F.lit(""))).cast("string"), 4, "0"), F.lit(":"), F.coalesce("luhmann_id", F.lit("")), F.lit(":"), "zettel_id").alias("k"))
    step = tree.where("status = 'tree'").select("id", "depth", F.posexplode("path").alias("at", "a"))
    keyed = step.join(key.withColumnRenamed("id", "a"), "a")
    sort = keyed.groupBy("id", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "k"))), lambda x: x["k"]), "/").alias("sort"))
    n = zettels.select(F.col("zettel_id").alias("id"), "user_id", "luhmann_id", "content").join(sort, "id")
    body = text.tree_preview(F.coalesce("content", F.lit("")), F.col("depth").cast("int"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.coalesce("luhmann_id", F.lit("")), F.lit(" "), body)
    lines = n.select("user_id", "sort", line.alias("line"))
    return row_numbers(lines, ["user_id"], [F.col("sort")], "ord").select("user_id", "ord", "line")
