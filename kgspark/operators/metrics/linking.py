"""How well cards were linked: reference and tested rows are compared by their explicit position.

The positional inner join cuts both sides to the shorter one. Rows are (seq, action, luhmann_id, latency_sec).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import luhmann
from kgspark.params import ACTIONS


def zipped(ref: DataFrame, test: DataFrame) -> DataFrame:
    # Only what a report shows and both sides may have is carried along.
    shown = [F.concat(F.left(F.coalesce("content", F.lit("")), F.lit(60)), F.lit("...")).alias("content_snippet")] if "content" in ref.columns else []
    r = ref.select("seq", *shown, F.col("action").alias("ra"), F.col("luhmann_id").alias("rl"), luhmann.depth(F.col("luhmann_id")).alias("rd"))
    t = test.select("seq", F.col("action").alias("ta"), F.col("luhmann_id").alias("tl"), luhmann.depth(F.col("luhmann_id")).alias("td"))
    return r.join(t, "seq")


def row_diff(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Per position: both actions and ids, whether actions and (for two children) parent prefixes agree, and the distance of the depths.

    With ``content`` in ``ref`` also its first 60 characters.
    """
    z = zipped(ref, test)
    child = (F.col("ra") == "child_of") & (F.col("ta") == "child_of")
    same = F.when(child, luhmann.parent(F.col("rl")).eqNullSafe(luhmann.parent(F.col("tl"))))
    sides = [F.col(a).alias(b) for a, b in (("ra", "action_ref"), ("ta", "action_test"), ("rl", "luhmann_ref"), ("tl", "luhmann_test"))]
    shown = ["content_snippet"] if "content_snippet" in z.columns else []
    return z.select("seq", *shown, *sides, (F.col("ra") == F.col("ta")).alias("action_match"), F.abs(F.col("td") - F.col("rd")).alias("depth_diff"), same.alias("prefix_match"))


def positional(ref: DataFrame, test: DataFrame) -> DataFrame:
    """action_accuracy, depth_consistency, child_precision in one row."""
    child = (F.col("ra") == "child_of") & (F.col("ta") == "child_of")
    near = F.avg(F.abs(F.col("rd") - F.col("td"))) / F.greatest(F.max("rd"), F.lit(1))
    return zipped(ref, test).agg(
        F.round(F.avg((F.col("ra") == F.col("ta")).cast("double")), 6).alias("action_accuracy"),
        F.round(F.greatest(F.lit(0.0), 1 - near), 6).alias("depth_consistency"),
        F.round(F.coalesce(F.avg(F.when(child, (F.col("rd") == F.col("td")).cast("double"))), F.lit(1.0)), 6).alias("child_precision"),
    )


def root_rate_delta(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Difference of the shares of new roots, over the whole tables."""
    rate = lambda df, n: df.agg(F.avg((F.col("action") == "new_root").cast("double")).alias(n))
    return rate(ref, "r").crossJoin(rate(test, "t")).select(F.round(F.abs(F.col("r") - F.col("t")), 6).alias("root_rate_delta"))


def action_kl(ref: DataFrame, test: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Kullback-Leibler divergence of the action shares over the three fixed actions, both smoothed and renormalised."""
    def share(df: DataFrame, name: str) -> DataFrame:
        n = F.count_if(F.col("action").isin(*ACTIONS))
        cols = [(F.coalesce(F.count_if(F.col("action") == a) / F.nullif(n, F.lit(0)), F.lit(0.0)) + eps).alias(f"{name}{i}") for i, a in enumerate(ACTIONS)]
        return df.agg(*cols)

    x = share(ref, "p").crossJoin(share(test, "q"))
    sp, sq = sum((F.col(f"p{i}") for i in range(3)), F.lit(0.0)), sum((F.col(f"q{i}") for i in range(3)), F.lit(0.0))
    kl = sum(((F.col(f"p{i}") / sp) * F.ln((F.col(f"p{i}") / sp) / (F.col(f"q{i}") / sq)) for i in range(3)), F.lit(0.0))
    return x.select(F.round(kl, 6).alias("action_kl"))


def structure_similarity(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Spearman correlation of the two depth histograms over 1..greatest depth; 0 where a histogram is constant or empty."""
    def hist(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(luhmann.depth(F.col("luhmann_id")).alias("d")).agg(F.count("*").alias(name))

    h = hist(ref, "r").join(hist(test, "t"), "d", "full").where("d > 0")
    top = h.agg(F.coalesce(F.max("d"), F.lit(0)).alias("m"))
    axis = top.where("m > 0").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("d"))
    x = axis.join(h, "d", "left").fillna(0)
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    y = x.select(rank("r").alias("a"), rank("t").alias("b"))
    cov = F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))
    return y.agg(F.round(F.coalesce(cov, F.lit(0.0)), 6).alias("structure_similarity"))


def latency_per_card(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.min_by("latency_sec", "seq") / F.nullif(F.count("*"), F.lit(0)), 6).alias("latency_per_card"))


def all_metrics(ref: DataFrame, test: DataFrame) -> DataFrame:
    """All linking metrics in one row; each input is one row, so the joins are of single rows."""
    out = positional(ref, test)
    for part in (root_rate_delta(ref, test), action_kl(ref, test), structure_similarity(ref, test), latency_per_card(test)):
        out = out.crossJoin(part)
    return out
