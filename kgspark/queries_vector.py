"""Vector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import params
from kgspark.functions import vectors
from kgspark.graphdata import Z, zettels
from kgspark.operators import vector
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


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND round({_COS}, 6) >= 0.1 QUALIFY rank <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Tenant-wise search: queries are the rows whose id is divisible by 50, against all rows of their label."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return vector.search(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), params.TOP_K, 0.1, ["label"]).select("query_id", "id", "score", "rank")


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10""")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same query set against all rows, whatever the label, first n and no threshold."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector.search(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10, -1.0, []).select("query_id", "id", "score", "rank")


_BAND = "CASE WHEN score >= 0.6 THEN 'relevant' WHEN score >= 0.45 THEN 'borderline' ELSE 'drop' END"


@query(f"""WITH s AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS r
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT a_id, b_id, score, {_BAND} AS band FROM s WHERE r = 1""")
def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    """The rows whose id is divisible by 50, each with the best other row of its label and the relevance band of the score."""
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), "label")
    m = vector.best_match(a, e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"), "label"), ["label"])
    return m.withColumn("band", F.when(F.col("score") >= params.RELEVANT, "relevant").when(F.col("score") >= params.BORDERLINE, "borderline").otherwise("drop"))


@query(f"""WITH s AS (SELECT a.label, a.vec_id AS a_id, b.vec_id AS b_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT label, round(avg(best), 4) AS mean, round(stddev_pop(best), 4) AS std, round(avg((best >= 0.2)::INT), 4) AS coverage FROM (SELECT label, a_id, max(score) AS best FROM s GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT label, round(avg((best < 0.2)::INT), 4) AS hallucination FROM (SELECT label, b_id, max(score) AS best FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT label, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std, coalesce(coverage, 0) AS coverage, coalesce(hallucination, 0) AS hallucination
FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN r USING (label) LEFT JOIN p USING (label)""")
def semantic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Reference (even ids) and predicted (odd ids) rows matched within each label."""
    e = table(spark, d, "embeddings")
    ref = e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    pred = e.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return vector.semantic_scores(ref, pred, ["label"], 0.2)


@query(f"""WITH s AS (SELECT a.label, a.vec_id::VARCHAR AS id, round(max({_COS}), 6) AS best FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY 1, 2)
SELECT DISTINCT label, first_value(id) OVER (PARTITION BY label ORDER BY best, id) AS worst_id, first_value(id) OVER (PARTITION BY label ORDER BY best DESC, id) AS best_id FROM s""")
def covered_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The worst and the best covered reference row of each label."""
    e = table(spark, d, "embeddings")
    ref = e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    pred = e.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return vector.covered_extremes(ref, pred, ["label"])


_OK = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0"


@query(f"""WITH {Z} SELECT user_id, count(*) AS zettels, count(*) FILTER ({_OK}) AS searchable FROM z GROUP BY 1""")
def searchable_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Notes per tenant that vector search can find."""
    z = zettels(spark, d, "user_id", "embedding")
    return z.groupBy("user_id").agg(F.count("*").alias("zettels"), F.count_if(F.coalesce(vectors.is_usable(F.col("embedding"), 64), F.lit(False))).alias("searchable"))


@query(f"""SELECT a.vec_id, round(1 - (1 - {_COS.replace('b.embedding', 'c.embedding')}) / 2, 4) AS similarity FROM embeddings a JOIN
(SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) c USING (label)""")
def legacy_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The older score 1 - distance / 2 of every vector to its label's first one."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(first, "label").select("vec_id", vectors.legacy_similarity(1 - vectors.cosine(F.col("embedding"), F.col("c"))).alias("similarity"))


@query(f"""SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS number
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND round({_COS}, 6) >= 0.35 QUALIFY number <= 5""")
def delete_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Numbered rows to choose from before a deletion, by the higher of the two thresholds."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return vector.delete_candidates(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), ["label"], 0.2).select("query_id", "id", "score", "number")


@query(f"""WITH t AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rank <= 3) SELECT * FROM t WHERE score >= 0.15""")
def legacy_search(spark: SparkSession, d: str) -> DataFrame:
    """The best three first, the threshold after."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return vector.first_then_threshold(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), 3, 0.15, ["label"])


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-10), 6) AS first FROM embeddings""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.unit(v)[0], 6).alias("first"))
