"""Row numbers within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.session import cut


def row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each ``group`` by ``order`` (which must be total).

    Rows are range-partitioned by group and order, numbered inside each partition, and shifted by the
    rows of the same group in the partitions before, of which there is one row per group and partition.
    A group that holds a third of all rows is thus spread over a third of the partitions.
    """
    place = cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    local = place.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    size = place.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = size.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    j = local.join(shift, same, "left")
    return j.withColumn(name, (F.col("_k") + F.col("_before")).cast("bigint")).select(*df.columns, name)
