"""Filling fixed-capacity containers with items: bound-certified repacking.

Token counts come from a public tokenizer (path and file are parameters). An item longer than the
capacity is cut into full containers and one remainder; nothing else is split. Items are dealt to
partitions by hash, so no partition is hot; each partition is packed by best-fit decreasing and its
number of containers is held against a lower bound from dual feasible functions. Where the two
agree the partition is certified. Otherwise the containers with gaps of the uncertified partitions
give up their items, which are dealt anew and packed again, round after round while that saves
containers.

Scale: one shuffle of (item, size) rows per round, of which only the first holds all items; a
partition holds about ``per_partition`` items, whatever the total. Partitions pack one by one in
Python workers; the driver sees one row per partition and container kind.

Defined results: null or blank texts have 0 tokens and still get a container; repeated rows of an id
count once with their largest size; an empty table gives no rows; a size of exactly the capacity
fills one container.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.session import cut
from kgspark.tables import table

#: The folder of public vocabularies, and the file and split pattern used by default.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(texts: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, n_tokens) per row of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(key).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(count, f"id {kind}, n_tokens bigint")


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Containers that any packing needs: the best of two families of dual feasible functions.

    ``times``: how often each size occurs, if not once.
    """
    n = np.ones(len(sizes), np.int64) if times is None else np.asarray(times, np.int64)
    if not (sizes > 0).any():
        return 1 if len(sizes) else 0
    s, at = np.unique(sizes[sizes > 0], return_inverse=True)
    n = np.bincount(at, weights=n[sizes > 0]).astype(np.int64)
    best = -(-int((s * n).sum()) // capacity)
    total, many = np.concatenate([[0], np.cumsum(s * n)]), np.concatenate([[0], np.cumsum(n)])
    # Sizes above capacity - t count as a whole container, sizes below t as nothing.
    for t in np.unique(np.concatenate([s[s <= capacity // 2], capacity - s[s > capacity // 2] + 1, [1]])):
        low, high = np.searchsorted(s, t), np.searchsorted(s, capacity - t, side="right")
        best = max(best, int(many[-1] - many[high]) - (-(int(total[high] - total[low])) // capacity))
    # Rounding down to multiples of 1/k, unless the size is such a multiple already.
    for k in range(2, 21):
        x = (k + 1) * s
        u = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)
        best = max(best, -(-int((u * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, free space of each container)."""
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(sizes), np.int64)
    free: list[int] = []
    gaps: list[int] = []  # distinct free spaces, ascending
    by_gap: dict[int, list[int]] = {}
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps[at]
            mine = by_gap[gap]
            c = mine.pop()
            if not mine:
                del by_gap[gap], gaps[at]
            free[c] = gap - size
        else:
            c = len(free)
            free.append(capacity - size)
        place[i] = c
        left = free[c]
        if left in by_gap:
            by_gap[left].append(c)
        else:
            by_gap[left] = [c]
            insort(gaps, left)
    return place, np.array(free, np.int64)


_PACKED = "kind int, part int, id {key}, piece int, size bigint, bin int, gap bigint, bins int, bound int"


def _pack_parts(items: DataFrame, key: str, capacities: dict[int, int]) -> DataFrame:
    def pack(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        sizes = t.column("size").to_numpy().astype(np.int64)
        place, free = best_fit_decreasing(sizes, capacities[kind])
        n = len(sizes)
        full = lambda v: pa.array(np.full(n, v, np.int32))
        return pa.table(
            {"kind": t.column("kind"), "part": t.column("part"), "id": t.column("id"), "piece": t.column("piece"), "size": t.column("size"), "bin": pa.array(place.astype(np.int32)), "gap": pa.array(free[place]), "bins": full(len(free)), "bound": full(lower_bound(sizes, capacities[kind]))}
        )

    return items.groupBy("kind", "part").applyInArrow(pack, _PACKED.format(key=key))


def _deal(items: DataFrame, parts: dict[int, int], seed: int) -> DataFrame:
    """``part`` by hash among the number of partitions of the item's kind."""
    n = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("kind")]
    return items.withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), n).cast("int"))


def pack(sizes: DataFrame, capacities: dict[int, int], per_partition: int = 40_000, seed: int = 1) -> DataFrame:
    """(kind, id, piece, size, part, bin) for ``sizes`` (id, n_tokens) and capacity per kind.

    A container is a (kind, part, bin); full pieces of long items have parts of their own.
    """
    key = sizes.schema["id"].dataType.simpleString()
    one = cut(sizes.groupBy("id").agg(F.max("n_tokens").alias("n")))
    kinds = F.explode(F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])).alias("kind", "cap")
    all_items = one.select("id", "n", kinds)
    over = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / F.col("cap"))
    whole = all_items.where("n > cap").select("kind", "id", F.posexplode(F.array_repeat("cap", over.cast("int"))).alias("piece", "size"))
    rest = all_items.select("kind", "id", over.cast("int").alias("piece"), (F.col("n") - over * F.col("cap")).cast("bigint").alias("size"))
    total = one.count()
    if not total:
        return one.sparkSession.createDataFrame([], f"kind int, id {key}, piece int, size bigint, part int, bin int")
    parts = dict.fromkeys(capacities, max(1, -(-total // per_partition)))
    kept = cut(_pack_parts(_deal(rest, parts, seed), key, capacities))
    base = 0  # partitions of a later round are numbered behind those of the rounds before
    settled: list[DataFrame] = []
    for r in count():
        per = kept.groupBy("kind", "part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        open_parts = per.where("bins > bound").groupBy("kind").agg(F.count("*").alias("n")).collect()
        if not open_parts:
            break
        loose = (F.col("bins") > F.col("bound")) & (F.col("gap") > 0)
        given = cut(kept.where(loose).select("kind", "id", "piece", "size", "part", "bin"))
        before = {x.kind: (x.n, x.items) for x in given.groupBy("kind").agg(F.count_distinct("part", "bin").alias("n"), F.count("*").alias("items")).collect()}
        parts = {k: max(1, -(-v[1] // per_partition)) for k, v in before.items()}
        again = cut(_pack_parts(_deal(given.select("kind", "id", "piece", "size"), parts, seed + r + 1), key, capacities))
        after = {x.kind: x.n for x in again.groupBy("kind").agg(F.count_distinct("part", "bin").alias("n")).collect()}
        better = [k for k in before if after[k] < before[k][0]]
        if not better:
            break
        base += 1_000_000
        chosen = F.col("kind").isin(*better)
        settled.append(kept.where(~(loose & chosen)).withColumn("part", F.col("part") + (base - 1_000_000)))
        kept = again.where(chosen)
    settled.append(kept.withColumn("part", F.col("part") + base))
    packed = settled[0]
    for x in settled[1:]:
        packed = packed.unionByName(x)
    own_part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // per_partition)))).cast("int") - 1_000_000
    full = whole.select("kind", "id", "piece", F.col("size").cast("bigint").alias("size"), own_part.alias("part"))
    full = full.withColumn("bin", F.row_number().over(Window.partitionBy("kind", "part").orderBy("id", "piece")) - 1)
    return packed.select("kind", "id", "piece", "size", "part", "bin").unionByName(full)


def number(packed: DataFrame) -> DataFrame:
    """``container``: one number per kind for each (part, bin), without a global sort.

    Each partition gets a block of numbers as long as its highest bin; only the partitions' block
    lengths, one row each, are summed up in order.
    """
    last = packed.groupBy("kind", "part").agg((F.max("bin") + 1).cast("bigint").alias("len"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = last.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0))).drop("len")
    return packed.join(start, ["kind", "part"]).withColumn("container", F.col("start") + F.col("bin")).drop("start")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, tuple[str, int]]]:
    specs = {i: (r.container_name, r.capacity_tokens) for i, r in enumerate(table(spark, d, "container_spec").orderBy("container_name").collect())}
    sizes = token_counts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return pack(sizes, {k: v[1] for k, v in specs.items()}), specs


def _named(df: DataFrame, specs: dict[int, tuple[str, int]]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for k, v in specs.items() for x in (k, v[0])])
    return df.withColumn("container_name", names[F.col("kind")])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    packed, specs = _packed(spark, d)
    return _named(number(packed), specs).select("container_name", F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def certificates(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(kind, bound): containers that any packing of all pieces needs.

    Sizes are whole numbers up to the capacity, so the counts by size are a table of at most that many rows.
    """
    rows = packed.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
    bounds = [(k, lower_bound(np.array([r["size"] for r in rows if r.kind == k], np.int64), cap, np.array([r.n for r in rows if r.kind == k], np.int64))) for k, cap in capacities.items()]
    return packed.sparkSession.createDataFrame(bounds, "kind int, bound bigint")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: containers used, the least any packing needs (by dual feasible functions), whether these meet, and the share of space filled."""
    packed, specs = _packed(spark, d)
    packed = cut(packed)
    caps = F.create_map(*[F.lit(x) for k, v in specs.items() for x in (k, v[1])])
    per = number(packed).groupBy("kind", "container").agg(F.sum("size").alias("used"))
    out = per.groupBy("kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    out = out.withColumn("capacity", caps[F.col("kind")]).join(F.broadcast(certificates(packed, {k: v[1] for k, v in specs.items()})), "kind")  # one row a kind
    return _named(out, specs).select(
        "container_name", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_by_volume"), F.col("bound").alias("least_by_functions"),
        (F.col("n_containers") == F.col("bound")).alias("certified"), F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("filled"), "fullest",
    )


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
