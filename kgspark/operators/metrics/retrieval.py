"""Ranked retrieval metrics: precision, recall, F1, hit rate, nDCG at several k; reciprocal rank over the whole list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import scores


def first_seen(ranked: DataFrame) -> DataFrame:
    """Order-preserving dedupe: (qid, id, rank) with each id once, at its first rank, ranks closed up."""
    from pyspark.sql import Window

    first = ranked.groupBy("qid", "id").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("qid").orderBy("at", "id")
    return first.select("qid", "id", F.row_number().over(w).cast("bigint").alias("rank"))


def at_k(ranked: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per (qid, k) for every question of ``truth`` (qid, id); ``ranked`` is (qid, id, rank).

    Precision divides by k even if fewer were retrieved; the reciprocal rank is not cut at k. All k come
    from one pass: conditional sums over the joined list.
    """
    hit = ranked.join(truth.distinct().withColumn("rel", F.lit(1)), ["qid", "id"], "left").select("qid", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    need = truth.distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    aggs = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        inside = (F.col("rank") <= k) & (F.col("rel") == 1)
        aggs += [F.sum(inside.cast("int")).alias(f"hits_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    per = need.join(hit.groupBy("qid").agg(*aggs), "qid", "left").fillna(0, [f"hits_{k}" for k in ks]).fillna(0.0, [f"dcg_{k}" for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"hits_{k}").alias("hits"), F.col(f"dcg_{k}").alias("dcg")) for k in ks]))
    x = per.select("qid", "n_rel", "first", rows.alias("x")).select("qid", "n_rel", "first", "x.*")
    p, r = F.col("hits") / F.col("k"), scores.ratio(F.col("hits"), F.col("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("k", "n_rel"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return x.select(
        "qid", "k", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(scores.f1(p, r), 6).alias("f1"), (F.col("hits") > 0).cast("double").alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def summary(rows: DataFrame, by: Sequence[str] = ("k",)) -> DataFrame:
    """Mean, median and spread of every metric per group, to four places."""
    aggs = []
    for m in ("precision", "recall", "f1", "hit", "mrr", "ndcg"):
        aggs += [F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.median(m), 4).alias(f"{m}_median"), F.round(F.stddev_samp(m), 4).alias(f"{m}_std")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def best_k(rows: DataFrame) -> DataFrame:
    """The k of the highest mean F1; the smallest of equals."""
    m = rows.groupBy("k").agg(F.round(F.avg("f1"), 6).alias("f1"))
    return m.agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("best_k"), F.max("f1").alias("f1"))


def histogram(rows: DataFrame, metric: str, bins: int = 15) -> DataFrame:
    """Counts per bin of [0, 1]."""
    b = F.least(F.floor(F.col(metric) * bins) + 1, F.lit(bins)).cast("bigint")
    return rows.groupBy("k", b.alias("bin")).agg(F.count("*").alias("n"))


def qa_dataset(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """(qa_id, note_id, all_zettel_ids, relevant_zettel_ids, n_total_zettels, n_relevant_zettels): generated questions with valid ids only.

    ``questions`` (qa_id, note_id, relevant array<string>), ``cards`` (note_id, zettel_id). Ids that are no card of
    the question's note are dropped and the rest keeps its order; a question whose note has no card is left out. A note's
    cards are bounded by its text.
    """
    c = cards.where("note_id is not null and zettel_id is not null").distinct()
    whole = c.groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_list("zettel_id")), "|").alias("all_zettel_ids"), F.count("*").alias("n_total_zettels"))
    said = questions.select("qa_id", "note_id", F.posexplode("relevant").alias("at", "zettel_id"))
    kept = said.join(c, ["note_id", "zettel_id"], "left_semi").groupBy("qa_id").agg(F.sort_array(F.collect_list(F.struct("at", "zettel_id"))).alias("r"))
    ids = F.coalesce(F.transform("r", lambda x: x["zettel_id"]), F.array().cast("array<string>"))
    j = questions.select("qa_id", "note_id").join(whole, "note_id").join(kept, "qa_id", "left")
    return j.select("qa_id", "note_id", "all_zettel_ids", F.array_join(ids, "|").alias("relevant_zettel_ids"), "n_total_zettels", F.size(ids).cast("bigint").alias("n_relevant_zettels"))
