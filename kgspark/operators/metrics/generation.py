"""Answer quality per model, and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = ("faithfulness", "relevance", "completeness", "correctness", "clarity")


def overall(prefix: str = "") -> Column:
    """0.85 of the mean of the five positive scores and 0.15 of the share without hallucination."""
    total = F.col(f"{prefix}{POSITIVE[0]}")
    for p in POSITIVE[1:]:
        total = total + F.col(f"{prefix}{p}")
    return 0.85 * total / len(POSITIVE) + 0.15 * (1 - F.col(f"{prefix}hallucination"))


def summary(rows: DataFrame) -> DataFrame:
    """Means and spreads of the six scores, count, latency percentile and overall score per model."""
    aggs = [F.count("*").alias("n"), F.round(F.percentile("latency_ms", F.lit(0.95)), 4).alias("latency_p95"), F.round(F.avg("latency_ms"), 4).alias("latency_mean")]
    for m in (*POSITIVE, "hallucination"):
        aggs += [F.avg(m).alias(m), F.round(F.stddev_samp(m), 4).alias(f"{m}_std")]
    s = rows.groupBy("model").agg(*aggs).withColumn("overall", F.round(overall(), 4))
    return s.select("model", "n", "latency_mean", "latency_p95", *[F.round(m, 4).alias(m) for m in (*POSITIVE, "hallucination")], *[f"{m}_std" for m in (*POSITIVE, "hallucination")], "overall")


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model", "question_type").agg(F.count("*").alias("n"), F.round(F.avg(overall()), 4).alias("overall"))
