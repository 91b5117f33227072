"""Near-duplicate records with small edits: a chosen-path set similarity join.

Records are reduced to their sets of distinct words (64-bit hashes). Equal sets form one class with
one representative, so copies cost nothing further. Each of ``trees`` independent trees branches a
representative by the words whose hash, seeded by the path so far, falls under 1 / (path_rate * set
size): similar sets choose common words and so meet in common nodes. Paths start ``DEPTH`` words long;
nodes with more than ``leaf`` members branch again, word by word; small nodes are compared
exhaustively. Inside a node a 256-bit one-bit minwise sketch rejects dissimilar pairs, and the
remaining candidates are checked exactly on their word sets.

A pair with similarity t survives one level with an expected t / path_rate common paths or more, so
every tree finds it with a probability that falls only slowly with depth; ``trees`` is set for a recall
above 0.99 at the threshold itself and at six words of depth, even where one set holds the other (the
worst shape). The sketch is one for all trees, so what it rejects is lost: its bound, 3.7 standard
deviations, drops 2 in 10,000 pairs at the threshold.

Scale: each level is one shuffle of a fixed number of rows per representative (trees x paths, 52 bytes
each). Small nodes are compared while the sorted rows stream by; large nodes pass through unheld.
Nodes that a bounded sample shows to be large branch on at once in the first pass, where the words
are at hand, and never meet in one task. A node that still is large after ``MAX_DEPTH`` words, whose members then are nearly equal and
thus results, is compared by a join that splits it by salt. Nothing is broadcast; the driver only
sees the sample and whether a level is empty.

Defined results: null, blank and short records (under ``min_words`` words) have no partners; repeated
rows of an id count once (its latest row); an empty table gives no pairs; similarity equal to the
threshold counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.session import cut
from kgspark.tables import table

DEPTH, MAX_DEPTH = 2, 8
#: Most sets that the sample for finding large nodes aims at, and its least members in such a node.
SAMPLE, LEAST_SAMPLE = 20_000, 30
#: Bits of a set's sketch, 128 to a seed. Few bits tell unlike sets from like ones only by dropping true pairs.
BITS, _SKETCH_SEEDS = 256, (20, 21)
_U = np.uint64


def word_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the distinct words (runs of letters or digits, lower case, ё as е)."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}]+", " "))
    return F.sort_array(F.transform(F.array_distinct(F.split(plain, " ")), lambda x: F.xxhash64(x)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(_U), off - off[0]


def sketches(values: np.ndarray, off: np.ndarray, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of one-bit minwise hashes per set."""
    rng = np.random.default_rng(seed)
    out = np.zeros((2, len(off) - 1), _U)
    for k in range(128):
        a, m = rng.integers(1, 2**63, 2, dtype=np.uint64)
        h = (values ^ a) * (m | _U(1))
        h ^= h >> _U(32)
        low = np.minimum.reduceat(h, off[:-1])
        out[k // 64] |= ((low * _U(0x9E3779B97F4A7C15)) >> _U(63)) << _U(k % 64)
    return out[0], out[1]


def _branch(path: np.ndarray, own: np.ndarray, values: np.ndarray, off: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(new path, set) for every word chosen by each (path, set)."""
    n = np.diff(off)
    length = n[own]
    rows = np.repeat(np.arange(len(own)), length)
    start = np.repeat(np.cumsum(length) - length, length)
    words = values[np.repeat(off[:-1][own], length) + (np.arange(len(rows)) - start)]
    h = _mix(words ^ path[rows])
    limit = np.minimum(1.0 / (rate * n), 1.0)[own][rows] * 2.0**64
    # A word is chosen once per path: the new path mixes the old one and the word, and a repeated
    # choice of the same word gives the same hash as before only with another path, so skip none.
    take = h.astype(np.float64) < limit
    return _mix(path[rows[take]] + words[take] * _U(3)), own[rows[take]]


_COLS = ["node", "id", "n", *(f"s{i}" for i in range(BITS // 64))]
_NODE = ", ".join(f"{c} {'int' if c == 'n' else 'bigint'}" for c in _COLS)


def _seeds(trees: int) -> np.ndarray:
    return _mix(np.arange(1, trees + 1, dtype=_U) * _U(0x2545F4914F6CDD1D))


def _descend(seed: np.ndarray, values: np.ndarray, off: np.ndarray, rate: float, large: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(path, set) of one tree at the first node below ``DEPTH`` words that is not among the ``large`` ones."""
    path, own = np.full(len(off) - 1, seed, _U), np.arange(len(off) - 1)
    for depth in range(1, MAX_DEPTH + 1):
        path, own = _branch(path, own, values, off, rate)
        if depth < DEPTH:
            continue
        at = np.minimum(np.searchsorted(large, path), max(0, len(large) - 1))
        more = large[at] == path if len(large) and depth < MAX_DEPTH else np.zeros(len(path), bool)
        yield path[~more], own[~more]
        path, own = path[more], own[more]
        if not len(path):
            return


def _start(sets: DataFrame, trees: int, rate: float, large: np.ndarray) -> DataFrame:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                values, off = _lists(b.column(1))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                n = np.diff(off).astype(np.int32)
                sketch = [w.view(np.int64) for seed in _SKETCH_SEEDS for w in sketches(values, off, seed)]
                for seed in _seeds(trees):
                    for path, own in _descend(seed, values, off, rate, large):
                        cols = [path.view(np.int64), ids[own], n[own], *(w[own] for w in sketch)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _COLS)

    return sets.select("id", "words").mapInArrow(grow, _NODE)


def _deeper(rows: DataFrame, sets: DataFrame, rate: float) -> DataFrame:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, off = _lists(b.column(b.schema.get_field_index("words")))
            path, own = _branch(b.column(0).to_numpy().view(_U), np.arange(b.num_rows), values, off, rate)
            rest = [b.column(i).to_numpy()[own] for i in range(1, len(_COLS))]
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *map(pa.array, rest)], _COLS)

    full = rows.join(sets.select("id", "words"), "id").select(*_COLS, "words")
    return full.mapInArrow(grow, _NODE)


def _limits(least: float) -> tuple[float, int]:
    """(least ratio of sizes, most differing sketch bits) of a pair that may reach ``least``."""
    p = (1 - least) / 2
    return least, int(BITS * p + 3.7 * (BITS * p * (1 - p)) ** 0.5)


_SEEN = f"{_NODE}, a bigint, b bigint"


def _compare(rows: DataFrame, least: float, leaf: int) -> DataFrame:
    """Candidate pairs (a, b) of the small nodes, and the rows of the large nodes (a null) as they are.

    Rows arrive sorted by node. Members of a small node are compared by shifting the whole batch
    against itself by 1, 2, ... rows, so the work is the number of pairs inside small nodes. A large
    node streams through and is never held.
    """
    ratio, most = _limits(least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        big_node = None  # a node known to be large, whose rows pass through

        def emit(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            node, ids, n = part[:3]
            sketch = [w.view(_U) for w in part[3:]]
            edges = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(edges, len(node)))
            left = np.repeat(size, size) - (np.arange(len(node)) - np.repeat(edges, size)) - 1  # members behind a row
            large = np.repeat(size > leaf, size)
            if big_node is not None:
                large |= node == big_node
            if large.any():
                none = pa.nulls(int(large.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c[large]) for c in part), none, none], [*_COLS, "a", "b"])
            behind = np.where(large, 0, left)
            at = np.flatnonzero(behind > 0)
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            d = 1
            while len(at):
                to = at + d
                ok = sum(np.bitwise_count(w[at] ^ w[to]).astype(np.int32) for w in sketch) <= most
                i, j = at[ok], to[ok]
                fit = (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
                if fit.any():
                    pairs.append((ids[i[fit]], ids[j[fit]]))
                d += 1
                at = at[behind[at] >= d]
            if pairs:
                x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                none = [pa.nulls(len(both), pa.int32() if c == "n" else pa.int64()) for c in _COLS]
                yield pa.RecordBatch.from_arrays([*none, pa.array(both[:, 0]), pa.array(both[:, 1])], [*_COLS, "a", "b"])

        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(_COLS))]
            if not len(now[0]):
                continue
            part = [np.concatenate([h, c]) for h, c in zip(held, now, strict=True)] if held else now
            last = part[0][-1]
            cut_at = int(np.searchsorted(part[0], last))
            tail = len(part[0]) - cut_at
            if tail > leaf or last == big_node:  # the open node is large already: let it pass
                yield from emit(part)
                big_node = last
                held = []
            elif len(part[0]) - tail >= 200_000:
                yield from emit([c[:cut_at] for c in part])
                held = [c[cut_at:] for c in part]
            else:
                held = part
        if held:
            yield from emit(held)

    return rows.select(*_COLS).repartition("node").sortWithinPartitions("node").mapInArrow(scan, _SEEN)


def _large_nodes(sets: DataFrame, trees: int, rate: float, leaf: int) -> np.ndarray:
    """Nodes that by a bounded sample hold more than ``leaf`` sets, at any depth; sorted.

    At most rows of the sample / ``LEAST_SAMPLE`` of them, whatever the number of sets.
    """
    total = sets.count()
    part = min(1.0, SAMPLE / max(1, total))
    pick = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(part * 1_000_000)
    t = sets.where(pick).select("words").limit(2 * SAMPLE).toArrow().column("words").combine_chunks()
    if not len(t):
        return np.zeros(0, _U)
    values, off = _lists(t if isinstance(t, pa.ListArray) else t.chunk(0))
    least, found = max(LEAST_SAMPLE, leaf * part), []
    for seed in _seeds(trees):
        path, own = np.full(len(off) - 1, seed, _U), np.arange(len(off) - 1)
        for depth in range(1, MAX_DEPTH):
            path, own = _branch(path, own, values, off, rate)
            if depth < DEPTH:
                continue
            node, back, size = np.unique(path, return_inverse=True, return_counts=True)
            found.append(node[size > least])
            keep = (size > least)[back]
            path, own = path[keep], own[keep]
            if not len(path):
                break
    return np.unique(np.concatenate(found))


def candidate_pairs(sets: DataFrame, least: float, trees: int, leaf: int, path_rate: float, salts: int = 32) -> DataFrame:
    """(a, b) ids of sets that met in a node and may reach ``least``; ids ascending, each pair once."""
    rows = _start(sets, trees, path_rate, _large_nodes(sets, trees, path_rate, leaf))
    found = None
    for depth in range(DEPTH, MAX_DEPTH + 1):
        seen = cut(_compare(rows, least, leaf))
        part = seen.where("a is not null").select("a", "b")
        found = part if found is None else found.unionByName(part)
        big = seen.where("a is null").select(*_COLS)
        if big.isEmpty():
            break
        if depth == MAX_DEPTH:
            ratio, most = _limits(least)
            left = big.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
            right = big.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
            x = left.alias("x").join(right.alias("y"), ["node", "salt"]).where("x.id < y.id")
            differ = reduce(add, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _COLS[3:]))
            fit = (F.least("x.n", "y.n") >= ratio * F.greatest("x.n", "y.n")) & (differ <= most)
            found = found.unionByName(x.where(fit).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
            break
        rows = _deeper(big, sets, path_rate)
    return found.distinct()


def set_classes(records: DataFrame, key: str, text: str, latest: str, min_words: int) -> DataFrame:
    """(key, at, id, id2, words) per row: ``id`` and ``id2`` are two hashes of the word set, equal for equal sets.

    They are null where the text has fewer than ``min_words`` distinct words.
    """
    w = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(latest).alias("at"), word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    w = w.select("key", "at", F.when(F.size("w") >= min_words, F.col("w")).alias("words"))
    has = F.col("words").isNotNull()
    return w.select("key", "at", F.when(has, F.xxhash64("words")).alias("id"), F.when(has, F.xxhash64(F.reverse("words"), F.lit(5))).alias("id2"), "words")


def members(rows: DataFrame) -> DataFrame:
    """(key, id, id2): the class of each key's latest row. Only hashes are shuffled, no texts or words."""
    one = rows.groupBy("key").agg(F.max(F.struct("at", "id", "id2")).alias("s"))
    return one.select("key", "s.id", "s.id2").where("id is not null")


def similar_classes(rows: DataFrame, least: float, trees: int = 14, leaf: int = 2000, path_rate: float | None = None) -> DataFrame:
    """(a, a2, b, b2) class pairs whose word sets share at least ``least`` of their union."""
    share = Fraction(least).limit_denominator(1000)
    sets = cut(rows.where("id is not null").groupBy("id", "id2").agg(F.first("words").alias("words")))
    pairs = candidate_pairs(sets, least, trees, leaf, path_rate or least * 0.94)
    a = sets.select(F.col("id").alias("a"), F.col("id2").alias("a2"), F.col("words").alias("wa"))
    b = sets.select(F.col("id").alias("b"), F.col("id2").alias("b2"), F.col("words").alias("wb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    enough = F.col("shared") * (share.denominator + share.numerator) >= share.numerator * (F.size("wa") + F.size("wb"))
    return both.where(enough).select("a", "a2", "b", "b2")


#: Members of a class from which they are spread by salt.
MANY = 2_000


def _spread(rows: DataFrame, hot: DataFrame | None, id_: str, id2: str) -> DataFrame:
    """``rows`` once for every salt of its class."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    j = rows.join(hot.select(F.col("id").alias(id_), F.col("id2").alias(id2), "salts"), [id_, id2], "left")
    return j.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def similar_pairs(rows: DataFrame, classes: DataFrame, many: int = MANY) -> DataFrame:
    """(key_a, key_b): all pairs of keys of equal or similar classes, the smaller key first.

    The members of a class of more than ``many`` are dealt to salts of some ``many`` members each, and what joins them
    is repeated for each salt: a text that a third of all records share makes many tasks.
    """
    m = cut(members(rows))
    hot = cut(m.groupBy("id", "id2").agg(F.count("*").alias("n")).where(F.col("n") > many).select("id", "id2", F.ceil(F.col("n") / many).cast("int").alias("salts")))
    if hot.isEmpty():
        hot, dealt = None, m.withColumn("salt", F.lit(0))
    else:
        dealt = m.join(hot, ["id", "id2"], "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    same = dealt.alias("x").join(_spread(m, hot, "id", "id2").alias("y"), ["id", "id2", "salt"]).where("x.key < y.key").select(F.col("x.key").alias("p"), F.col("y.key").alias("q"))
    left = dealt.select(F.col("key").alias("p"), F.col("id").alias("a"), F.col("id2").alias("a2"), "salt")
    right = dealt.select(F.col("key").alias("q"), F.col("id").alias("b"), F.col("id2").alias("b2"), "salt")
    one = _spread(classes, hot, "a", "a2").join(left, ["a", "a2", "salt"]).select("p", "b", "b2")
    other = _spread(one, hot, "b", "b2").join(right, ["b", "b2", "salt"]).select("p", "q")
    return same.unionByName(other).select(F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root): smallest vertex of the connected component of every vertex of ``edges`` (u, v).

    Alternates large-star and small-star steps until nothing changes; each step is one shuffle with
    map-side minima, so a vertex with very many neighbours is never gathered.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return cut(set_classes(table(spark, d, "zettel_node", "zettel_id", "content", "updated_at"), "zettel_id", "content", "updated_at", 8))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return similar_pairs(rows, similar_classes(rows, 0.7)).select(F.col("key_a").alias("zettel_id_a"), F.col("key_b").alias("zettel_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with a partner: its class, the smallest class id of its group, and its number of linked classes."""
    rows = _rows(spark, d)
    m = cut(members(rows))
    c = cut(similar_classes(rows, 0.7))
    rep = m.groupBy("id", "id2").agg(F.min("key").alias("class_id"), F.count("*").alias("n_copies"))
    r = rep.select("id", "id2", "class_id")
    named = c.join(r.toDF("a", "a2", "u"), ["a", "a2"]).join(r.toDF("b", "b2", "v"), ["b", "b2"]).select("u", "v")
    links = named.select("u").unionByName(named.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
    group = components(named).toDF("class_id", "group_id")
    out = rep.join(links.withColumnRenamed("u", "class_id"), "class_id", "left").join(group, "class_id", "left")
    out = out.where("n_links is not null or n_copies > 1")
    named_out = m.select("key", "id", "id2").join(out, ["id", "id2"])
    return named_out.select(F.col("key").alias("zettel_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
_SETS = r"""WITH one AS (SELECT zettel_id, max_by(content, updated_at) AS c FROM zettel_node WHERE zettel_id IS NOT NULL GROUP BY zettel_id),
w AS (SELECT DISTINCT zettel_id, unnest(string_split(trim(regexp_replace(replace(lower(coalesce(c, '')), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS w FROM one),
n AS (SELECT zettel_id, count(*) AS n FROM w GROUP BY zettel_id HAVING count(*) >= 8)
"""
SQL = {
    "p3_found": _SETS
    + """SELECT x.zettel_id AS zettel_id_a, y.zettel_id AS zettel_id_b
FROM w x JOIN n a ON a.zettel_id = x.zettel_id JOIN w y ON x.w = y.w AND x.zettel_id < y.zettel_id JOIN n b ON b.zettel_id = y.zettel_id
GROUP BY 1, 2, a.n, b.n HAVING count(*) * 17 >= 7 * (a.n + b.n)""",
    "p3_groups": _SETS.replace("WITH one", "WITH RECURSIVE one").rstrip()
    + """, k AS (SELECT zettel_id, string_agg(w, ' ' ORDER BY w) AS k FROM w WHERE zettel_id IN (SELECT zettel_id FROM n) GROUP BY 1),
c AS (SELECT k, min(zettel_id) AS class_id, count(*) AS n_copies, any_value(len(string_split(k, ' '))) AS n FROM k GROUP BY 1),
cw AS (SELECT class_id, n, unnest(string_split(k, ' ')) AS w FROM c),
p AS (SELECT x.class_id AS u, y.class_id AS v FROM cw x JOIN cw y ON x.w = y.w AND x.class_id < y.class_id GROUP BY 1, 2, x.n, y.n HAVING count(*) * 17 >= 7 * (x.n + y.n)),
b AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
re(u, v) AS (SELECT u, v FROM b UNION SELECT re.u, b.v FROM re JOIN b ON b.u = re.v),
g AS (SELECT u AS class_id, least(u, min(v)) AS group_id FROM re GROUP BY 1),
l AS (SELECT u AS class_id, count(*) AS n_links FROM b GROUP BY 1)
SELECT k.zettel_id, c.class_id, coalesce(group_id, c.class_id) AS group_id, coalesce(n_links, 0) AS n_links, n_copies
FROM k JOIN c USING (k) LEFT JOIN g ON g.class_id = c.class_id LEFT JOIN l ON l.class_id = c.class_id WHERE n_links IS NOT NULL OR n_copies > 1""",
}
