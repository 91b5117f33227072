"""How well notes were split into cards: counts, hierarchy, tags, types; per note, then per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import luhmann, scores, text


def counts(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """(note_id, ref_count, pred_count, count_ratio, count_mae, no_output); a missing note counts 0 cards."""
    r = ref.groupBy("note_id").agg(F.count("*").alias("ref_count"))
    p = pred.groupBy("note_id").agg(F.count("*").alias("pred_count"))
    j = r.join(p, "note_id", "left").withColumn("no_output", F.col("pred_count").isNull()).fillna(0, ["pred_count"])
    return j.withColumns({"count_ratio": F.round(scores.ratio(F.col("pred_count"), F.col("ref_count")), 3), "count_mae": F.abs(F.col("pred_count") - F.col("ref_count")).cast("double")})


def hierarchy(cards: DataFrame) -> DataFrame:
    """Per note: share of valid ids, share of distinct ids, parent consistency, greatest and mean depth, roots.

    Consistency is the share of cards with an expected parent whose parent id exists in the note; 1 where
    no card has one.
    """
    c = cards.select("note_id", F.lower("luhmann_id").alias("l"))
    ids = c.distinct().withColumn("there", F.lit(1)).withColumnRenamed("l", "p")
    x = c.withColumns({"p": luhmann.parent(F.col("l")), "valid": luhmann.is_valid(F.col("l")).cast("double"), "depth": luhmann.valid_depth(F.col("l"))}).join(ids, ["note_id", "p"], "left")
    has = F.col("p").isNotNull()
    return x.groupBy("note_id").agg(
        F.round(F.avg(F.coalesce("valid", F.lit(0.0))), 3).alias("valid_share"),
        F.round(F.count_distinct("l") / F.count("*"), 3).alias("unique_ratio"),
        F.round(F.coalesce(F.count_if(has & F.col("there").isNotNull()) / F.nullif(F.count_if(has), F.lit(0)), F.lit(1.0)), 3).alias("parent_consistency"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.round(F.coalesce(F.avg("depth"), F.lit(0.0)), 2).alias("mean_depth"),
        F.count_if(F.col("depth") == 1).alias("roots"),
    )


def compare_hierarchy(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Differences of roots, greatest and mean depth per note; null where the note has no output."""
    a, b = hierarchy(ref), hierarchy(pred)
    j = a.alias("a").join(b.alias("b"), "note_id", "left")
    d = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    return j.select("note_id", d("roots").alias("root_count_delta"), d("max_depth").cast("double").alias("depth_mae"), F.round(d("mean_depth"), 2).alias("mean_depth_mae"))


def tags(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the union of tags per note; both sides empty score 1."""
    def own(df: DataFrame) -> DataFrame:
        t = df.where("tags is not null").select("note_id", F.explode("tags").alias("t"))
        return t.select("note_id", text.eval_tag(F.col("t")).alias("t")).where("t <> ''").distinct()

    r, p = own(ref), own(pred)
    both = r.join(p, ["note_id", "t"]).groupBy("note_id").agg(F.count("*").alias("both"))
    n = ref.select("note_id").distinct()
    n = n.join(r.groupBy("note_id").agg(F.count("*").alias("nr")), "note_id", "left").join(p.groupBy("note_id").agg(F.count("*").alias("np")), "note_id", "left").join(both, "note_id", "left").fillna(0)
    none = (F.col("nr") == 0) & (F.col("np") == 0)
    pr, re = scores.ratio(F.col("both"), F.col("np")), scores.ratio(F.col("both"), F.col("nr"))
    one = F.lit(1.0)
    return n.select(
        "note_id", F.when(none, one).otherwise(F.round(pr, 3)).alias("tag_precision"), F.when(none, one).otherwise(F.round(re, 3)).alias("tag_recall"),
        F.when(none, one).otherwise(F.round(scores.f1(pr, re), 3)).alias("tag_f1"), (F.col("nr") - F.col("both")).alias("missed"), (F.col("np") - F.col("both")).alias("extra"),
    )


def type_overlap(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Sum over types of the smaller share, per note; a null type is ``unknown``."""
    def share(df: DataFrame, name: str) -> DataFrame:
        t = df.groupBy("note_id", F.coalesce("thought_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("c"))
        n = df.groupBy("note_id").agg(F.count("*").alias("n"))
        return t.join(n, "note_id").select("note_id", "t", (F.col("c") / F.col("n")).alias(name))

    j = share(ref, "r").join(share(pred, "p"), ["note_id", "t"], "full").fillna(0.0)
    return j.groupBy("note_id").agg(F.round(F.sum(F.least("r", "p")), 3).alias("type_overlap"), F.round(F.sum(F.abs(F.col("r") - F.col("p"))), 3).alias("type_delta"))


def model_summary(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, metric, mean, median, std, p05, p95) of every metric column."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")
    x = rows.select(by, stack).select(by, "x.*")
    return x.groupBy(by, "metric").agg(
        F.round(F.avg("v"), 4).alias("mean"), F.round(F.median("v"), 4).alias("median"), F.round(F.stddev_samp("v"), 4).alias("std"),
        F.round(F.percentile("v", F.lit(0.05)), 4).alias("p05"), F.round(F.percentile("v", F.lit(0.95)), 4).alias("p95"),
    )


def cards_per_sentence(cards: DataFrame, notes: DataFrame) -> DataFrame:
    """(num_sentences, notes, mean_cards): distinct cards per note, averaged over notes of equal length (full outer join)."""
    c = cards.groupBy("note_id").agg(F.count_distinct("zettel_id").alias("cards"))
    j = c.join(notes.select("note_id", "num_sentences"), "note_id", "full").where("num_sentences is not null")
    return j.groupBy("num_sentences").agg(F.count("*").alias("notes"), F.round(F.avg(F.coalesce("cards", F.lit(0))), 4).alias("mean_cards"))
