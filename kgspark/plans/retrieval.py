"""From entry points to a context: one plan for all queries instead of five lookups per node.

Branches (the entry itself, parent, children, related) are tagged with a role and unioned; the first
occurrence of each node per query wins, in order of entry rank, role and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import params
from kgspark.operators import graph
from kgspark.session import cut

ROLES = {"entry": 0, "parent": 1, "child": 2, "related": 3}


def expand(entries: DataFrame, zettels: DataFrame, edges: DataFrame, related: DataFrame, hops: int) -> DataFrame:
    """(query_id, zettel_id, role, place): entries (query_id, user_id, zettel_id, entry_rank) and their surroundings."""
    e = cut(entries)
    up = edges.select("user_id", F.col("child_id").alias("zettel_id"), F.col("parent_id").alias("other"), F.lit(1).cast("bigint").alias("ord"))
    down = graph.children(zettels, edges).select("user_id", "zettel_id", F.col("child_id").alias("other"), "ord")
    near = graph.related(related, hops, params.RELATED_LIMIT).select("user_id", "zettel_id", F.col("other_id").alias("other"), "ord")
    out = e.select("query_id", "user_id", F.col("zettel_id").alias("other"), "entry_rank", F.lit(ROLES["entry"]).alias("role"), F.lit(0).cast("bigint").alias("ord"))
    for role, branch in (("parent", up), ("child", down), ("related", near)):
        x = e.join(branch, ["user_id", "zettel_id"]).select("query_id", "user_id", "other", "entry_rank", F.lit(ROLES[role]).alias("role"), "ord")
        out = out.unionByName(x)
    # Entries are known before any expansion, so they never come up again as a neighbour.
    first = Window.partitionBy("query_id", "other").orderBy(F.when(F.col("role") == 0, 0).otherwise(1), "entry_rank", "role", "ord")
    best = out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("role") == 0, 0).otherwise(1), "entry_rank", "role", "ord", "other")
    name = F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in (v, k)])[F.col("role")]
    return best.select("query_id", "user_id", F.col("other").alias("zettel_id"), name.alias("role"), F.row_number().over(order).cast("bigint").alias("place"))


def entities_of(context: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, name, ord): entities of the context's nodes, each once, at its first node."""
    j = context.join(mentions.select("user_id", "zettel_id", "name"), ["user_id", "zettel_id"]).groupBy("query_id", "name").agg(F.min("place").alias("place"))
    w = Window.partitionBy("query_id").orderBy("place", "name")
    return j.select("query_id", "name", F.row_number().over(w).cast("bigint").alias("ord"))


def context_text(context: DataFrame, zettels: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, context): nodes grouped by type in upper case, types in order, then up to ten entities.

    A context is bounded by the entries and their limits, so gathering it per query is bounded too,
    except for a parent's children, which the reader of such a context wants whole.
    """
    z = zettels.select("user_id", "zettel_id", F.coalesce("thought_type", F.lit("unknown")).alias("type"), F.coalesce("content", F.lit("")).alias("content"))
    n = context.join(z, ["user_id", "zettel_id"])
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    per = n.groupBy("query_id", "type").agg(ordered("place", "content").alias("rows"))
    block = F.concat(F.upper("type"), F.lit(":\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["content"])), "\n"))
    body = per.select("query_id", "type", block.alias("block")).groupBy("query_id").agg(ordered("type", "block").alias("b"))
    names = entities.where(F.col("ord") <= params.CONTEXT_ENTITIES).groupBy("query_id").agg(ordered("ord", "name").alias("e"))
    j = body.join(names, "query_id", "left")
    listed = F.array_join(F.transform("e", lambda r: r["name"]), ", ")
    tail = F.when(F.col("e").isNotNull(), F.concat(F.lit("\n\nENTITIES: "), listed)).otherwise("")
    return j.select("query_id", F.concat(F.array_join(F.transform("b", lambda r: r["block"]), "\n\n"), tail).alias("context"))


def paths(context: DataFrame, zettels: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, path, ord): the first five ``parent -> child`` lines of the context."""
    z = zettels.select("user_id", "zettel_id", "luhmann_id")
    c = context.join(edges.withColumnRenamed("child_id", "zettel_id"), ["user_id", "zettel_id"]).join(z, ["user_id", "zettel_id"])
    c = c.join(z.toDF("user_id", "parent_id", "up"), ["user_id", "parent_id"])
    w = Window.partitionBy("query_id").orderBy("place")
    x = c.select("query_id", F.concat("up", F.lit(" -> "), "luhmann_id").alias("path"), F.row_number().over(w).cast("bigint").alias("ord"))
    return x.where(F.col("ord") <= params.CONTEXT_PATHS)


def candidate_block(context: DataFrame, zettels: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, block): the text a link decision sees: score, parent text, up to 3 children and 5 entities per candidate.

    ``context`` (query_id, user_id, zettel_id, rank, score).
    """
    z = zettels.select("user_id", "zettel_id", "luhmann_id", F.coalesce("content", F.lit("")).alias("content"))
    up = edges.join(z.select("user_id", F.col("zettel_id").alias("parent_id"), F.left("content", F.lit(40)).alias("parent_text")), ["user_id", "parent_id"])
    kids = graph.children(zettels, edges).where("ord <= 3").groupBy("user_id", "zettel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "child_luhmann"))), lambda r: r["child_luhmann"]), ", ").alias("kids"))
    w = Window.partitionBy("user_id", "zettel_id").orderBy("name")
    ents = mentions.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("user_id", "zettel_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("ents"))
    key = ["user_id", "zettel_id"]
    j = context.join(z, key).join(up.select("user_id", F.col("child_id").alias("zettel_id"), "parent_text"), key, "left").join(kids, key, "left").join(ents, key, "left")
    line = F.format_string("[%d] %s (%s) %s | parent: %s | children: %s | entities: %s", F.col("rank").cast("int"), F.coalesce("luhmann_id", F.lit("")), F.format_string("%.3f", "score"), "content", F.coalesce("parent_text", F.lit("-")), F.coalesce("kids", F.lit("-")), F.coalesce("ents", F.lit("-")))
    b = j.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return b.select("query_id", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("block"))
