"""Most similar vectors for every vector: a hierarchical k-means tree whose leaves are joined with themselves.

The tree is fitted on a bounded sample (``SAMPLE`` rows by hash of the id, at most); every vector is
indexed. A vector is a member of the few leaves with the nearest centroids, found exactly, and is compared
with the other members of these: two vectors meet if any of their leaves are the same. How many leaves that takes is
calibrated: the true neighbours of ``CALIBRATION`` sample queries are found by brute force over all vectors, and
the number of leaves is widened until ``target`` of them share one.

Leaves next to each other in the tree form cells. A vector is shuffled once to each cell (of some ``CELL`` points)
that holds leaves of it, as 16-bit fixed-point values with all its leaves; each cell multiplies members leaf by leaf and
returns k rows per vector. A pair counts in the first leaf that both are members of, so no pair is returned twice.
The sample bounds the number of leaves,
so leaves grow with the data; a leaf of more than ``SPLIT`` members is not multiplied whole but gets a tree of its own
where it is read, again with leaves of ``LEAF`` points and visits calibrated on ``PROBES`` of its points. Cells that the
sample shows to hold very many members are split by salt, with their points repeated.

Scale: the sample, the tree and the calibration rows are bounded by parameters; nothing else reaches
the driver. Equal vectors are reduced to their first k + 1 ids before indexing (with a map-side
limit), so a vector that a third of all rows share is no hot leaf; the remaining copies take those
ids as neighbours by a salted equi-join. With 9,700 leaves, 5 of them a vector's, the members of a leaf come to some 76 MB in one task at a billion vectors (calculated).

Defined results: a vector is usable with ``dim`` finite values that are not all zero; others, null vectors
and null ids are left out; repeated ids count once (their latest row); fewer than k other vectors
give fewer neighbours; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.session import cut
from kgspark.tables import table

#: Most vectors the tree is fitted on, and sample queries whose true neighbours are found.
SAMPLE, CALIBRATION = 50_000, 400
#: Points per leaf aimed at, least sample rows per leaf, most children per node, points per cell.
LEAF, LEAST_SAMPLE, BRANCH, CELL = 300, 8, 16, 24_000
#: Members per cell from which the cell is split, and sample rows they are counted on.
CELL_QUERIES, MEMBERS = 200_000, 10_000
#: Similarities computed at once.
BLOCK = 1_000_000
#: Columns of a similarity matrix whose maximum is taken first.
GROUP = 16
#: Members of a leaf from which it gets a tree of its own (below, multiplying them all is as fast), points that tree is
#: fitted on, points it is calibrated on, and their least recall.
SPLIT, FIT, PROBES, WITHIN = 40_000, 20_000, 64, 0.995
#: Salts of further copies of one vector.
SALTS = 32
#: Fixed-point scale of a unit vector's components.
SCALE = 32_767


def usable(rows: DataFrame, key: str, vector: str, latest: str, dim: int) -> DataFrame:
    """(id, vec): unit vectors as 16-bit fixed-point bytes, one per distinct id."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            lengths = np.diff(col.offsets.to_numpy())
            mask = (lengths == dim) & ~col.is_null().to_numpy(zero_copy_only=False)
            kept = col.filter(pa.array(mask))
            flat = kept.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            ok = np.isfinite(x).all(axis=1)
            where = pa.array(np.flatnonzero(mask)[ok])
            data = [r.tobytes() for r in np.round(x[ok] * SCALE).astype(np.int16)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(data, pa.binary())], ["id", "at", "vec"])

    at = rows.schema[latest].dataType.simpleString()
    src = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, latest, F.col(vector).cast("array<float>"))
    made = src.mapInArrow(norm, f"id string, at {at}, vec binary")
    return made.groupBy("id").agg(F.max(F.struct("at", "vec")).alias("s")).select("id", "s.vec")


class Tree:
    """Leaves of a k-means tree, numbered in tree order."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        todo, held = [np.arange(len(x))], []
        while todo:
            own = todo.pop()
            label = self._split(x[own], rng, max(2, min(BRANCH, -(-len(own) // leaf)))) if len(own) > leaf else None
            if label is None:
                held.append(own)
            else:
                todo += [own[label == k] for k in np.unique(label)][::-1]
        self.leaves = len(held)
        self.cent = np.array([x[own].mean(axis=0) for own in held], np.float32)
        self.half = (self.cent**2).sum(axis=1) / 2
        self.share = np.array([len(own) for own in held]) / len(x)  # of the sample, by leaf

    @staticmethod
    def _split(x: np.ndarray, rng, k: int) -> np.ndarray | None:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        label = None
        for _ in range(8):
            label = np.argmax(x @ c.T - (c**2).sum(axis=1) / 2, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, label, x)
            n = np.bincount(label, minlength=k)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        return label if len(np.unique(label)) > 1 else None

    def visit(self, q: np.ndarray, visits: int) -> np.ndarray:
        """The leaves of each query with the nearest centroids, nearest first."""
        out = np.empty((len(q), min(visits, self.leaves)), np.int32)
        step = max(1, BLOCK // self.leaves)
        for a in range(0, len(q), step):
            near = q[a : a + step] @ self.cent.T - self.half
            top = _top(near, out.shape[1])
            order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
            out[a : a + step] = np.take_along_axis(top, order, axis=1)
        return out


def _floats(vectors: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.int16).reshape(-1, dim).astype(np.float32) / np.float32(SCALE)


def _matrix(col, dim: int) -> np.ndarray:
    return _floats(col.to_pylist(), dim)


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row. They lie in the k groups of columns with the largest maxima, or in the rest."""
    n = sim.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), sim.shape)
    groups = n // GROUP
    if groups <= 2 * k:
        return np.argpartition(-sim, k - 1, axis=1)[:, :k]
    most = sim[:, : groups * GROUP].reshape(len(sim), GROUP, groups).max(axis=1)
    best = np.argpartition(-most, k - 1, axis=1)[:, :k]
    cols = (best[:, None, :] + np.arange(0, groups * GROUP, groups)[:, None]).reshape(len(sim), -1)
    cols = np.hstack([cols, np.broadcast_to(np.arange(groups * GROUP, n), (len(sim), n - groups * GROUP))])
    return np.take_along_axis(cols, np.argpartition(-np.take_along_axis(sim, cols, axis=1), k - 1, axis=1)[:, :k], axis=1)


def brute_force(vectors: DataFrame, queries: list[tuple[str, bytes]], dim: int, k: int) -> list[tuple[int, bytes, str, float]]:
    """(query, vector, id, similarity) of the k nearest others of a bounded set of queries, over all vectors in blocks."""
    q = _floats([v for _, v in queries], dim)
    own = [i for i, _ in queries]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sim = b.column(0).to_pylist(), q @ _matrix(b.column(1), dim).T
            best = _top(sim, k + 1)
            r, c = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
            keep = np.array([own[i] != ids[j] for i, j in zip(r, c, strict=True)], bool)
            r, c = r[keep], c[keep]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), b.column(1).take(pa.array(c)), b.column(0).take(pa.array(c)), pa.array(sim[r, c])], ["q", "vec", "id", "sim"])

    rows = vectors.select("id", "vec").mapInArrow(scan, "q int, vec binary, id string, sim float")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return [tuple(r) for r in rows.withColumn("r", rank).where(F.col("r") <= k).drop("r").collect()]


def calibrate(tree: Tree, queries: list[tuple[str, bytes]], truth: list[tuple], dim: int, target: float) -> int:
    """Leaves of each vector with which ``target`` of the true pairs share one."""
    q = _floats([v for _, v in queries], dim)[np.array([t[0] for t in truth], np.int64)]
    near = _floats([t[1] for t in truth], dim)
    visits = min(3, tree.leaves)
    while visits < tree.leaves and len(truth):
        mine, theirs = tree.visit(q, visits), tree.visit(near, visits)
        if np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(mine, theirs, strict=True)]) >= target:
            break
        visits = min(tree.leaves, max(visits + 1, int(visits * 1.15)))
    return visits


_ROWS = "cell int, salt int, ask boolean, row bigint, data binary"


def _spread(vectors: DataFrame, tree: Tree, visits: int, cell_of: np.ndarray, salts: np.ndarray, dim: int) -> DataFrame:
    """A row for each cell (and salt) that holds leaves of a vector; ``data``: the vector and its leaves in order."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                leaves = np.sort(tree.visit(_matrix(b.column(1), dim), visits), axis=1)
                data = np.hstack([np.frombuffer(b"".join(b.column(1).to_pylist()), np.int16).reshape(-1, dim), leaves.view(np.int16)])
                cells = cell_of[leaves]
                new = np.ones(cells.shape, bool)
                new[:, 1:] = cells[:, 1:] != cells[:, :-1]
                who, col = np.nonzero(new)
                cell = cells[who, col]
                reps = salts[cell]
                take = np.repeat(np.arange(len(who)), reps)
                salt = np.arange(len(take)) - np.repeat(np.cumsum(reps) - reps, reps)
                who, cell = who[take], cell[take]
                ask = salt == (who + at) % salts[cell]
                ends = np.arange(len(who) + 1, dtype=np.int32) * np.int32(data.shape[1] * 2)
                packed = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[who]))])
                cols = [pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(ask), b.column(0).take(pa.array(who)), packed]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "salt", "ask", "row", "data"])

    return vectors.select("row", "vec").mapInArrow(spread, _ROWS)


def _pieces(points: np.ndarray, asks: np.ndarray, k: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, points) of a leaf to be multiplied: all by all, or by the leaves of its own tree."""
    if len(points) <= split:
        yield np.arange(len(asks)), np.arange(len(points))
        return
    fit = points[:: -(-len(points) // FIT)]
    tree = Tree(fit, max(LEAST_SAMPLE, round(LEAF * len(fit) / len(points))))
    home = tree.visit(points, 1)[:, 0]
    probes = points[:: -(-len(points) // PROBES)]
    wanted = home[_top(probes @ points.T, k)]
    visits = 2
    while True:
        seen = tree.visit(probes, visits)
        if visits >= tree.leaves or (wanted[:, :, None] == seen[:, None, :]).any(axis=2).mean() >= WITHIN:
            break
        visits = max(visits + 1, int(visits * 1.3))
    seen = tree.visit(asks, visits)
    row, leaf = np.repeat(np.arange(len(asks)), seen.shape[1]), seen.ravel()
    by_leaf, by_home = np.argsort(leaf, kind="stable"), np.argsort(home, kind="stable")
    edges = np.searchsorted(leaf[by_leaf], np.arange(tree.leaves + 1))
    homes = np.searchsorted(home[by_home], np.arange(tree.leaves + 1))
    for i in range(tree.leaves):
        if edges[i] < edges[i + 1] and homes[i] < homes[i + 1]:
            yield row[by_leaf[edges[i] : edges[i + 1]]], by_home[homes[i] : homes[i + 1]]


def _scan_cells(rows: DataFrame, cell_of: np.ndarray, dim: int, k: int, split: int) -> DataFrame:
    def scan(t: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(t.column("data").to_pylist()), np.int16).reshape(t.num_rows, -1)
        x = raw[:, :dim].astype(np.float32) / np.float32(SCALE)
        leaves = np.ascontiguousarray(raw[:, dim:]).view(np.int32)
        ids, asking = t.column("row").to_numpy(), t.column("ask").to_numpy()
        best, who = np.full((len(x), k), -2, np.float32), np.full((len(x), k), -1, np.int64)
        member, col = np.nonzero(cell_of[leaves] == t.column("cell")[0].as_py())
        leaf = leaves[member, col]
        order = np.argsort(leaf, kind="stable")
        member, leaf = member[order], leaf[order]
        numbers, starts = np.unique(leaf, return_index=True)
        for number, mine in zip(numbers, np.split(member, starts[1:]), strict=True):
            ask = mine[asking[mine]]
            for asks, points in _pieces(x[mine], x[ask], k + 1, split):
                near = mine[points]
                y = np.ascontiguousarray(x[near].T)
                step = max(1, BLOCK // len(near))
                for a in range(0, len(asks), step):
                    q = ask[asks[a : a + step]]
                    sim = x[q] @ y
                    top = _top(sim, k + 1)
                    s, w = np.take_along_axis(sim, top, axis=1), near[top]
                    drop, theirs = w == q[:, None], leaves[w]
                    for own in leaves[q].T:  # a pair counts in its first leaf
                        if (earlier := own < number).any():
                            drop |= (theirs == own[:, None, None]).any(axis=2) & earlier[:, None]
                    s = np.where(drop, np.float32(-2), s)
                    s, w = np.hstack([best[q], s]), np.hstack([who[q], w])
                    o = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    best[q], who[q] = np.take_along_axis(s, o, axis=1), np.take_along_axis(w, o, axis=1)
        r, c = np.nonzero(best > -2)
        return pa.table({"row": pa.array(ids[r]), "other": pa.array(ids[who[r, c]]), "sim": pa.array(best[r, c])})

    return rows.groupBy("cell", "salt").applyInArrow(scan, "row bigint, other bigint, sim float")


def nearest(vectors: DataFrame, k: int = 3, dim: int = 64, target: float = 0.997, most: int = SAMPLE, split: int = SPLIT) -> DataFrame:
    """(id, other, rank, sim): the k most similar others of every vector of ``vectors`` (id, vec).

    ``most``: rows that the tree is fitted on; ``split``: points of a leaf from which it gets a tree of its own.
    """
    spark = vectors.sparkSession
    same = Window.partitionBy("vec").orderBy("id")
    first = cut(vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).withColumn("row", F.monotonically_increasing_id()))
    total, n = vectors.count(), first.count()
    if n < 2:
        return spark.createDataFrame([], "id string, other string, rank int, sim float")
    part = int(min(1.0, (most + CALIBRATION) / n) * 1_000_000) or 1
    pick = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < part
    sample = [(r.id, bytes(r.vec)) for r in first.where(pick).select("id", "vec").limit(2 * most).collect()]
    if len(sample) < 2:
        sample = [(r.id, bytes(r.vec)) for r in first.select("id", "vec").limit(1000).collect()]
    sample, step = sorted(sample), max(2, len(sample) // CALIBRATION)
    queries = sample[::step][:CALIBRATION]  # not fitted on: a small leaf lies nearer to the rows it was made of
    x = _floats([v for i, (_, v) in enumerate(sample) if i % step], dim)
    tree = Tree(x, max(LEAST_SAMPLE, round(LEAF * len(x) / n)))
    truth = brute_force(first, queries, dim, k)
    visits = calibrate(tree, queries, truth, dim, target)
    cell_of = ((np.cumsum(tree.share) - tree.share) * n / CELL).astype(np.int64)
    seen = np.sort(cell_of[tree.visit(x[:: max(1, len(x) // MEMBERS)], visits)], axis=1)
    new = np.ones(seen.shape, bool)
    new[:, 1:] = seen[:, 1:] != seen[:, :-1]
    held = np.bincount(seen[new], minlength=cell_of[-1] + 1)
    salts = np.maximum(1, np.ceil(held / len(seen) * n / CELL_QUERIES)).astype(np.int64)
    found = _scan_cells(_spread(first, tree, visits, cell_of, salts, dim), cell_of, dim, k, split)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("sim"), "other"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = first.select("row", "id")
    out = best.join(names, "row").join(names.toDF("other_row", "other_id"), F.col("other") == F.col("other_row"))
    out = out.select("id", F.col("other_id").alias("other"), "rank", "sim")
    if total > n:
        rest = vectors.join(first.select("id"), "id", "left_anti")
        rest = rest.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        twins = first.where(F.col("r") <= k).join(first.where(F.col("r") == k + 1).select("vec"), "vec", "left_semi")  # vectors with further copies
        twins = twins.select("vec", F.col("id").alias("other"), F.col("r").alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        out = out.unionByName(rest.join(twins, ["vec", "salt"]).select("id", "other", "rank", F.lit(1.0).cast("float").alias("sim")))
    return out


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return cut(usable(table(spark, d, "zettel_node", "zettel_id", "embedding", "updated_at"), "zettel_id", "embedding", "updated_at", 64))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    x = nearest(_vectors(spark, d))
    return x.select(F.least("id", "other").alias("zettel_id_a"), F.greatest("id", "other").alias("zettel_id_b")).distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    x = nearest(_vectors(spark, d))
    return x.select(F.col("id").alias("zettel_id"), F.col("other").alias("neighbour_id"), "rank", F.round("sim", 4).alias("similarity"))


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
SQL: dict[str, str] = {}
