"""Items that appear together: pair counts, lift and pointwise mutual information.

Each basket is first reduced to its distinct items; its ordered pairs (smaller item first, by code
points) are emitted by two streaming generators, so a long basket is never held as a pair list, and
counted with map-side partial aggregation before the shuffle. A hot item therefore arrives at a
reducer as at most one partial count per map task and partner, whatever share of baskets holds it.
Marginals come from the same deduplicated baskets.

Defined results: null or blank items are dropped; a basket without items does not count in N; a
repeated basket id is one basket (its latest row); an empty table gives no rows. Clashing columns in
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import cut
from kgspark.tables import table


def item_name(c: Column) -> Column:
    """Trimmed, lower-cased, blanks and hyphens turned to ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]", "_")


def baskets(rows: DataFrame, key: str, items: str, latest: str) -> DataFrame:
    """(items) sorted distinct item names, one row per distinct ``key`` with at least one item."""
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(latest, items)).alias("s"))
    names = F.filter(F.transform(F.filter(F.col(f"s.{items}"), lambda x: x.isNotNull()), item_name), lambda x: x != "")
    return one.select(F.array_sort(F.array_distinct(names)).alias("items")).where(F.size("items") > 0)


def pair_counts(b: DataFrame) -> DataFrame:
    """(a, b, n_ab) over all baskets."""
    first = b.select("items", F.posexplode("items").alias("i", "a"))
    return (
        first.select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n_ab"))
    )


def associations(b: DataFrame, min_pairs: int = 1, min_share: float = 0.0) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift, pmi) for pairs in at least ``min_pairs`` baskets and ``min_share`` of them."""
    b = cut(b)
    n = b.count()
    single = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    pairs = pair_counts(b).where((F.col("n_ab") >= min_pairs) & (F.col("n_ab") >= min_share * n))
    out = pairs.join(single.select(F.col("item").alias("a"), F.col("c").alias("n_a")), "a").join(
        single.select(F.col("item").alias("b"), F.col("c").alias("n_b")), "b"
    )
    lift = F.col("n_ab").cast("double") * n / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("a", "b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return baskets(table(spark, d, "zettel_node", "zettel_id", "tags", "updated_at"), "zettel_id", "tags", "updated_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    x = associations(_tags(spark, d), min_pairs=5, min_share=0.002)
    standing = F.col("n_ab") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b")
    return x.where(standing).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = associations(_tags(spark, d))
    return x.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 8).alias("lift"), F.round("pmi", 8).alias("pmi"))


_BASE = r"""WITH one AS (SELECT zettel_id, max_by(tags, updated_at) AS tags FROM zettel_node WHERE zettel_id IS NOT NULL GROUP BY zettel_id),
item AS (SELECT DISTINCT zettel_id, regexp_replace(lower(trim(t)), '[\s-]', '_', 'g') AS t
  FROM (SELECT zettel_id, unnest(tags) AS t FROM one) WHERE t IS NOT NULL AND trim(t) <> ''),
tot AS (SELECT count(DISTINCT zettel_id) AS n FROM item),
m AS (SELECT t, count(*) AS c FROM item GROUP BY t),
p AS (SELECT x.t AS tag_a, y.t AS tag_b, count(*) AS n_ab FROM item x JOIN item y ON x.zettel_id = y.zettel_id AND x.t < y.t GROUP BY 1, 2),
s AS (SELECT tag_a, tag_b, n_ab, a.c AS n_a, b.c AS n_b, n FROM p JOIN m a ON a.t = tag_a JOIN m b ON b.t = tag_b, tot)
"""
SQL = {
    "p4_found": _BASE + "SELECT tag_a, tag_b FROM s WHERE n_ab >= 5 AND n_ab >= 0.002 * n AND n_ab * n >= 3 * n_a * n_b",
    "p4_pairs": _BASE
    + """SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 8) AS lift,
  round(log2(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b)), 8) AS pmi FROM s""",
}
QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
