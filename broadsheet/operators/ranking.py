"""Ranking helpers that stay safe when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.session import cut_lineage


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per group.

    ``row_number() <= k`` lets Spark cut every group to k rows before the
    shuffle, so a hot group never travels whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers 1.. within each group, without one task per group.

    Rows are range-partitioned by (keys, order), so a hot group spreads over
    many partitions; each partition numbers its own rows and adds the group's
    row count in the partitions before it.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    placed = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = placed.withColumn("_local", F.row_number().over(local)).join(sizes, [*keys, "_part"])
    return numbered.withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")
