"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles.

``resolve_parents`` turns the three ways a card can name its parent into one edge per card.
``hierarchy`` then advances a frontier from the roots, extending root, depth and (optionally) path. Step
0 reaches level 1 over the edges themselves; links of 1, 2, 4, ... levels, doubled in the same join, let the
next steps reach levels 2 to 3, 4 to 7, and so on. Nodes that a step leaves unreached go on with
a link twice as long; when a step reaches no node, what is left hangs on a cycle. Among
it, the nodes still in the image of an ever longer link are the cycles themselves.

Scale: a step is one job with one join on the upper end of the link; steps are log2 of the depth, so a chain
of 100,000 takes 17. Reached and open rows are written to separate folders, so a step reads what it
joins and no more. Lower ends of an end that more than ``hot_children`` of them share are spread by
salt, and that end's row is repeated as often. No id list or edge is ever collected, nothing is
cached on an executor, and nothing is broadcast by hand.

Defined results: repeated rows of a node count once; a null id is dropped; a null tenant is its own
tenant (the empty string); an unparsable own id has no parent by id; a node that names itself is on
a cycle; a parent that is no row of ``edges`` (``resolve_parents`` gives none) counts as a cycle above;
empty input gives an empty result. Other columns of the input are ignored, so names that
clash with the working columns do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kgspark.session import cut, own, shared_dir

#: Spellings that mean "no parent".
NOTHING = ("", "null", "nan", "none")


def said(c: Column) -> Column:
    """The trimmed text of a reference, or null where it says nothing."""
    t = F.regexp_replace(c, r"^[\s ​]+|[\s ​]+$", "")
    return F.when(~F.lower(t).isin(*NOTHING), t)


def canonical_id(c: Column) -> Column:
    """One spelling of an id: lower case, without braces, ``urn:uuid:`` and surrounding blanks."""
    return F.regexp_replace(F.lower(said(c)), r"^(?:urn:uuid:)?\{?\s*|\s*\}$", "")


def own_parent(luhmann: Column) -> Column:
    """The hierarchical id without its last level; null for a bare number or a foreign format."""
    ok = luhmann.rlike(r"(?i)^\d+([a-z]\d*|\.\d+[a-z]*)*$")
    up = F.regexp_replace(luhmann, r"(?i)(\.\d+|(?<=[a-z])\d+|(?<=\d)[a-z]+)$", "")
    return F.when(ok & (up != luhmann), up)


def resolve_parents(cards: DataFrame) -> DataFrame:
    """(id, parent, lost, user_id) per distinct ``zettel_id``; ``parent`` null and not lost means a root."""
    c = (
        cards.where(F.col("zettel_id").isNotNull())
        .groupBy("zettel_id")
        .agg(F.min(F.struct(F.coalesce("user_id", F.lit("")).alias("u"), said(F.col("luhmann_id")).alias("l"), canonical_id(F.col("parent_id")).alias("p"), said(F.col("parent_luhmann_id")).alias("pl"))).alias("s"))
        .select(F.col("zettel_id").alias("id"), "s.*")
    )
    by_id = F.concat(F.lit("z:"), "p")
    by_luhmann = F.concat(F.lit("l:"), F.coalesce(F.col("pl"), own_parent(F.col("l"))))
    child = c.select("id", "u", F.coalesce(F.when(F.col("p").isNotNull(), by_id), by_luhmann).alias("wanted"))
    names = c.select("u", "id", F.explode(F.array(F.concat(F.lit("z:"), canonical_id(F.col("id"))), F.concat(F.lit("l:"), "l"))).alias("wanted"))
    named = names.where("wanted is not null").groupBy("u", "wanted").agg(F.min("id").alias("parent"))
    return child.join(named, ["u", "wanted"], "left").select(
        "id", "parent", (F.col("wanted").isNotNull() & F.col("parent").isNull()).alias("lost"), F.nullif(F.col("u"), F.lit("")).alias("user_id")
    )


def _rings(rest: DataFrame) -> DataFrame:
    """Ids of ``rest`` (id, up) that lie on a cycle; ``up`` is the ancestor some number of levels above.

    The link is squared until its image stops shrinking; an image that a further squaring leaves as
    large is mapped onto itself, so it consists of cycles only.
    """
    jump, size = rest, None
    while True:
        image = jump.select("up").distinct()
        now = image.count()
        if now == size or not now:
            return image.select(F.col("up").alias("id"))
        size = now
        to = jump.select(F.col("id").alias("mid"), F.col("up").alias("far"))
        jump = cut(jump.join(to, jump["up"] == to["mid"]).select("id", F.col("far").alias("up")))


def _joined(low: DataFrame, high: DataFrame, crowded: bool, hot_children: int, splits: int) -> DataFrame:
    """``low`` left joined with ``high`` (columns prefixed x_) on ``up``; the rows of a common ``up`` are spread by salt."""
    if crowded:
        hot = cut(low.groupBy("up").count().where(F.col("count") > hot_children).select(F.col("up").alias("x_id"), F.lit(splits).alias("n")))
        if not hot.isEmpty():
            low = low.join(hot.withColumnRenamed("x_id", "up"), "up", "left").withColumn("at", F.coalesce(F.pmod(F.xxhash64("id"), F.col("n")), F.lit(0)).cast("int")).drop("n")
            high = high.join(hot, "x_id", "left").withColumn("x_at", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
            return low.join(high, (low["up"] == high["x_id"]) & (low["at"] == high["x_at"]), "left")
    return low.join(high, low["up"] == high["x_id"], "left")


def hierarchy(edges: DataFrame, with_path: bool = True, hot_children: int = 100_000, splits: int = 32) -> DataFrame:
    """(id, root, depth, status[, path]) from ``edges`` (id, parent, lost), one row per id.

    status: ``tree``, ``detached`` (the chain ends at a node whose parent is lost), ``on_cycle``,
    ``below_cycle``. For the cycle states root and path are null and depth is -1.
    """
    spark = edges.sparkSession
    kept = ["id", "root", "depth", "status"] + ["path"] * with_path
    home = f"{shared_dir(spark)}/kgspark-levels-{uuid.uuid4().hex}"
    own(spark, home)

    def written(rows: DataFrame, step: int) -> tuple[int, int]:
        """Reached and open rows of a step. Of open rows ``depth`` counts the levels to ``up`` and ``path`` those below it."""
        seen = Observation()
        rows.observe(seen, F.count_if(~F.col("open")).alias("reached"), F.count_if("open").alias("open")).write.option("compression", "zstd").partitionBy("open").parquet(f"{home}/step={step}")
        return seen.get["reached"], seen.get["open"]

    is_root = F.col("parent").isNull()
    start = edges.select(
        "id", F.when(is_root, F.col("id")).alias("root"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("depth"),
        F.when(is_root, F.when(F.col("lost"), "detached").otherwise("tree")).alias("status"), *([F.array("id").alias("path")] if with_path else []),
        F.col("parent").alias("up"), (~is_root).alias("open"),
    )
    shape = StructType([*start.drop("open").schema.fields, *start.select("open").schema.fields, StructField("step", IntegerType())])
    reached, left = written(start, 0)
    step = 0
    while reached and left:
        all_ = spark.read.schema(shape).parquet(home)
        step += 1
        low = all_.where((F.col("step") == step - 1) & F.col("open")).select("id", "depth", "up", *(["path"] * with_path))
        high = all_.where(~F.col("open") | (F.col("step") == step - 1)).select([F.col(c).alias(f"x_{c}") for c in [*kept, "up", "open"]])
        hit = F.coalesce(~F.col("x_open"), F.lit(False))
        grown = _joined(low, high, left > hot_children, hot_children, splits).select(
            "id", F.when(hit, F.col("x_root")).alias("root"), (F.col("depth") + F.coalesce("x_depth", F.lit(0))).alias("depth"), F.when(hit, F.col("x_status")).alias("status"),
            # An upper end that the way up from the node has passed before is on a cycle: the way is kept no longer.
            *([F.when(~F.array_contains("path", F.col("up")), F.concat("x_path", "path")).alias("path")] if with_path else []),
            F.when(hit, None).otherwise(F.coalesce("x_up", "up")).alias("up"), (~hit).alias("open"),
        )
        reached, left = written(grown, step)
    all_ = spark.read.schema(shape).parquet(home)
    done = all_.where(~F.col("open")).select(*kept)
    if not left:
        return done

    rest = all_.where((F.col("step") == step) & F.col("open")).select("id", "up")
    ring = _rings(rest).select("id", F.lit(True).alias("on"))
    nowhere = rest.join(ring, "id", "left").select(
        "id", F.lit(None).cast("string").alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.when(F.col("on"), "on_cycle").otherwise("below_cycle").alias("status"),
        *([F.lit(None).cast("array<string>").alias("path")] if with_path else []),
    )
    return done.unionByName(nowhere)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair on a path of ``hierarchy``'s result."""
    up = tree.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
