"""Tenant-isolated exact vector search for a stated query set.

Queries are compared with all rows of their tenant in blocks: an equi-join of blocks on the tenant, a
matrix product, a threshold, and a top-k per block before the shuffle. For every vector against every
vector use an index instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import params
from kgspark.functions import vectors


#: Keys that the blocks of one tenant's rows are spread over.
SALTS = 32


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every block of ``a`` (t, qi, qv) with every block of ``b`` (t, bi, bv) of the same ``t``."""
    salted = b.withColumn("salt", F.pmod(F.xxhash64(F.col("bi")[0]), F.lit(SALTS)).cast("int"))
    return a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, ["t", "salt"])


def search(queries: DataFrame, rows: DataFrame, k: int, threshold: float, on: list[str]) -> DataFrame:
    """(query_id, id, score, rank): the k best rows per query with score >= ``threshold``.

    ``queries`` (query_id, q, *on), ``rows`` (id, v, *on), at most one tenant column in ``on``. Both sides are
    packed into blocks of one tenant; each pair of blocks is one matrix product that returns k rows per
    query. The blocks of rows of a tenant (or of all rows, without one) are spread over ``SALTS`` keys and the blocks
    of queries repeated for each, so a tenant with a third of all rows is no single task.
    """
    met = _met(_blocks(queries, "query_id", "q", on, 1024).toDF("t", "qi", "qv"), _blocks(rows, "id", "v", on, 4096).toDF("t", "bi", "bv"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, bi, bv in zip(*(batch.column(c).to_pylist() for c in ("qi", "qv", "bi", "bv")), strict=True):
                dim = len(qv) // 8 // len(qi)
                if len(bv) != dim * 8 * len(bi):
                    continue
                sim = np.round(np.frombuffer(qv).reshape(-1, dim) @ np.frombuffer(bv).reshape(-1, dim).T, 6)
                q, c = np.array(qi, dtype=object), np.array(bi, dtype=object)
                sim[q[:, None] == c[None, :]] = -2.0
                if sim.shape[1] > k:  # all that tie with the k-th stay, so ids can decide
                    floor = np.partition(sim, -k, axis=1)[:, -k]
                    sim[sim < floor[:, None]] = -2.0
                r, j = np.nonzero(sim >= max(threshold, -1.5))
                yield pa.RecordBatch.from_arrays([pa.array(q[r].tolist(), kinds[0]), pa.array(c[j].tolist(), kinds[1]), pa.array(sim[r, j])], ["query_id", "id", "score"])

    names = (queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString())
    kinds = [pa.string() if n == "string" else pa.int64() for n in names]
    scored = met.select("qi", "qv", "bi", "bv").mapInArrow(scan, f"query_id {names[0]}, id {names[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def first_then_threshold(queries: DataFrame, rows: DataFrame, n: int, threshold: float, on: list[str]) -> DataFrame:
    """The older order of operators: the best ``n`` first, the threshold after."""
    return search(queries, rows, n, -1.0, on).where(F.col("score") >= threshold)


def delete_candidates(queries: DataFrame, rows: DataFrame, on: list[str], link_threshold: float) -> DataFrame:
    """At most five numbered candidates for a deletion."""
    return search(queries, rows, params.TOP_K, max(params.DELETE_THRESHOLD, link_threshold), on).withColumnRenamed("rank", "number")


def _blocks(df: DataFrame, key: str, vector: str, on: list[str], size: int) -> DataFrame:
    """(tenant, ids, unit vectors as bytes): blocks of at most ``size`` rows of one tenant and one length."""
    kind = df.schema[key].dataType.simpleString()
    tenant = df.schema[on[0]].dataType.simpleString() if on else "int"
    arrow = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64()), {"string": pa.string(), "int": pa.int32()}.get(tenant, pa.int64())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, tuple[list, list]] = {}
            for t, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i is None or v is None or not v or (on and t is None):
                    continue
                x = np.asarray(v, np.float64)
                n = np.sqrt((x * x).sum())
                if np.isfinite(n) and n >= vectors.GUARD:
                    g = groups.setdefault((t, len(v)), ([], []))
                    g[0].append(i), g[1].append(x / n)
            out = [(t, g[0][s : s + size], np.concatenate(g[1][s : s + size]).tobytes()) for (t, _), g in groups.items() for s in range(0, len(g[0]), size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], arrow[1]), pa.array([o[1] for o in out], pa.list_(arrow[0])), pa.array([o[2] for o in out], pa.binary())], ["t", "ids", "vecs"])

    cols = [F.col(on[0]) if on else F.lit(0).alias("t"), F.col(key), F.col(vector)]
    return df.select(*cols).mapInArrow(pack, f"t {tenant}, ids array<{kind}>, vecs binary")


def best_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(a_id, b_id, score): the most similar right row (b_id, b) of every left row (a_id, a) that shares ``on``."""
    q = left.select(F.col("a_id").alias("query_id"), F.col("a").alias("q"), *on)
    r = right.select(F.col("b_id").alias("id"), F.col("b").alias("v"), *on)
    return search(q, r, 1, -1.0, on).select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), "score")


def best_scores(ref: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """(*on, ref, id, best): the best cosine of every row of either side (``ref`` tells which) to the other side's rows of its group.

    ``ref`` (*on, a_id, a) and ``pred`` (*on, b_id, b), one column in ``on``; blocks meet as in ``search``, and each product
    returns one row per row of its sides. Ids are compared as text.
    """
    a = _blocks(ref.withColumn("a_id", F.col("a_id").cast("string")), "a_id", "a", on, 2048).toDF("t", "qi", "qv")
    b = _blocks(pred.withColumn("b_id", F.col("b_id").cast("string")), "b_id", "b", on, 2048).toDF("t", "bi", "bv")
    kind = ref.schema[on[0]].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (qi, qv, bi, bv) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("qi", "qv", "bi", "bv")), strict=True)):
                dim = len(qv) // 8 // len(qi)
                if len(bv) != dim * 8 * len(bi):
                    continue
                sim = np.frombuffer(qv).reshape(-1, dim) @ np.frombuffer(bv).reshape(-1, dim).T
                t = batch.column(0).take(pa.array([i] * (len(qi) + len(bi))))
                side = pa.array([True] * len(qi) + [False] * len(bi))
                yield pa.RecordBatch.from_arrays([t, side, pa.array([*qi, *bi]), pa.array(np.concatenate([sim.max(axis=1), sim.max(axis=0)]))], ["t", "ref", "id", "best"])

    rows = _met(a, b).select("t", "qi", "qv", "bi", "bv").mapInArrow(scan, f"t {kind}, ref boolean, id string, best double")
    return rows.groupBy(F.col("t").alias(on[0]), "ref", "id").agg(F.max("best").alias("best"))


def semantic_scores(ref: DataFrame, pred: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """Mean, spread, coverage and hallucination of best matches per group; zeros where a side is empty."""
    s = best_scores(ref, pred, on)
    mine, theirs = F.when(F.col("ref"), F.col("best")), F.when(~F.col("ref"), F.col("best"))
    got = s.groupBy(*on).agg(
        F.round(F.avg(mine), 4).alias("mean"), F.round(F.stddev_pop(mine), 4).alias("std"), F.round(F.avg((mine >= threshold).cast("double")), 4).alias("coverage"),
        F.round(F.avg((theirs < threshold).cast("double")), 4).alias("hallucination"),
    )
    groups = ref.select(*on).unionByName(pred.select(*on)).distinct()
    return groups.join(got, on, "left").fillna(0.0)


def covered_extremes(ref: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """(*on, worst_id, best_id): the worst and the best covered reference row of each group; ties go to the first id."""
    s = best_scores(ref, pred, on).where("ref").withColumn("best", F.round("best", 6))
    return s.groupBy(*on).agg(F.min_by("id", F.struct("best", "id")).alias("worst_id"), F.min_by("id", F.struct(-F.col("best"), "id")).alias("best_id"))
