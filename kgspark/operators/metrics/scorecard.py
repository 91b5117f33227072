"""Scorecards of models: normalised metrics, category scores, cost blends, rankings and their text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import scores

#: Metric, category, direction (up, down, target), bounds, target.
METRICS = (
    ("latency_ms_total", "Производительность", "down", 0.0, 30000.0, None),
    ("count_ratio", "Декомпозиция", "target", 0.0, 2.0, 1.0),
    ("count_mae", "Декомпозиция", "down", 0.0, 10.0, None),
    ("pred_hierarchy_valid_ratio", "Иерархия", "up", 0.0, 1.0, None),
    ("root_count_delta", "Иерархия", "down", 0.0, 10.0, None),
    ("depth_mae", "Иерархия", "down", 0.0, 5.0, None),
    ("tag_f1", "Теги", "up", 0.0, 1.0, None),
    ("tag_precision", "Теги", "up", 0.0, 1.0, None),
    ("tag_recall", "Теги", "up", 0.0, 1.0, None),
    ("semantic_similarity_mean", "Семантика", "up", 0.0, 1.0, None),
    ("semantic_coverage_ratio", "Семантика", "up", 0.0, 1.0, None),
    ("hallucination_ratio", "Семантика", "down", 0.0, 1.0, None),
    ("faithfulness_score", "Качество", "up", 0.0, 1.0, None),
    ("hallucination_score", "Качество", "down", 0.0, 1.0, None),
    ("thought_type_distribution_overlap", "Типы мыслей", "up", 0.0, 1.0, None),
)


def config(spark) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in METRICS], "metric string, category string, direction string, lo double, hi double, target double")


def normalised(means: DataFrame, cfg: DataFrame) -> DataFrame:
    """(model, metric, category, score): ``means`` (model, metric, value) brought to [0, 1]; the config is a few rows."""
    x = means.join(cfg, "metric")
    s = (
        F.when(F.col("direction") == "up", scores.bounded(F.col("value"), F.col("lo"), F.col("hi")))
        .when(F.col("direction") == "down", scores.inverted(F.col("value"), F.col("lo"), F.col("hi")))
        .otherwise(scores.on_target(scores.clip(F.col("value"), F.col("lo"), F.col("hi")), F.col("target"), F.greatest(F.abs(F.col("lo") - F.col("target")), F.abs(F.col("hi") - F.col("target")))))
    )
    return x.select("model", "metric", "category", s.alias("score"))


def category_scores(norm: DataFrame) -> DataFrame:
    """Mean score per model and category, and ``overall`` as the mean of all its metrics."""
    g = norm.groupBy("model", "category").agg(F.sum("score").alias("t"), F.count("score").alias("n"))
    o = g.groupBy("model").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).withColumn("category", F.lit("overall"))
    return g.unionByName(o).select("model", "category", F.round(F.col("t") / F.col("n"), 6).alias("score"))


def cost_blend(rows: DataFrame, weight: float = 0.15) -> DataFrame:
    """(model, quality, cost) -> final = (1 - weight) * quality + weight * inverted min-max cost; an unknown cost scores 0.5."""
    w = Window.partitionBy()
    lo, hi = F.min("cost").over(w), F.max("cost").over(w)
    c = F.when(F.col("cost").isNull(), 0.5).otherwise(scores.inverted(F.col("cost"), lo, hi))
    return rows.withColumn("cost_score", F.round(c, 6)).withColumn("final", F.round((1 - weight) * F.col("quality") + weight * F.col("cost_score"), 4))


def efficiency(rows: DataFrame, value: str, price: str, out: str) -> DataFrame:
    """``out`` = value / (price / least price)."""
    least = F.min(price).over(Window.partitionBy())
    return rows.withColumn(out, F.round(F.col(value) / F.nullif(F.col(price) / F.nullif(least, F.lit(0.0)), F.lit(0.0)), 6))


def linker_overall(row: DataFrame, weights: dict[str, float], kl_cap: float = 0.1) -> DataFrame:
    """Weighted sum of the linking metrics; the divergence is inverted and capped."""
    kl = 1 - scores.clip(F.col("action_kl") / kl_cap)
    parts = [w * (kl if m == "action_kl" else F.col(m)) for m, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return row.withColumn("overall", F.round(total, 6))


def ranking(rows: DataFrame, score: str) -> DataFrame:
    """(model, rank, medal, percent, bar): competition order; percents are cut, not rounded."""
    r = F.row_number().over(Window.orderBy(F.desc(score), "model"))
    medal = F.when(r == 1, "gold").when(r == 2, "silver").when(r == 3, "bronze").otherwise("")
    pct = F.floor(F.col(score) * 100)
    return rows.select("model", r.cast("bigint").alias("rank"), medal.alias("medal"), pct.cast("bigint").alias("percent"), F.concat(F.repeat(F.lit("█"), F.floor(pct / 5).cast("int")), F.repeat(F.lit("░"), F.floor((100 - pct) / 5).cast("int"))).alias("bar"))


def extremes(means: DataFrame, cfg: DataFrame) -> DataFrame:
    """Best and worst model of every metric; ties go to the first name.

    As in the reports these rows must match, a metric with a target counts as better the lower it is.
    """
    x = means.join(cfg, "metric").withColumn("good", F.when(F.col("direction") == "up", F.col("value")).otherwise(-F.col("value")))
    b, w = Window.partitionBy("metric").orderBy(F.desc("good"), "model"), Window.partitionBy("metric").orderBy("good", "model")
    y = x.select("metric", F.first("model").over(b).alias("best"), F.first("model").over(w).alias("worst"))
    return y.distinct()


def strong_and_weak(categories: DataFrame, finals: DataFrame, strong: float = 0.75, weak: float = 0.6) -> DataFrame:
    """The categories above ``strong`` and below ``weak`` of the winner by ``finals`` (model, final)."""
    winner = finals.agg(F.min_by("model", F.struct(-F.col("final"), "model")).alias("model"))
    x = categories.where("category <> 'overall'").join(winner, "model")
    mark = F.when(F.col("score") > strong, "strong").when(F.col("score") < weak, "weak")
    return x.select("model", "category", "score", mark.alias("mark")).where("mark is not null")
