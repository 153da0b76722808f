"""Row positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.session import checkpointed

GROUP_BOUND = 1_000_000


def rank_sliced(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position per key without ever sorting one key in one task.

    Rows are range-partitioned on key and order, so a large key spans many partitions; each slice
    is numbered locally and shifted by the sizes of the key's earlier slices.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(parts, *keys, *order).withColumn("_slice", F.spark_partition_id())
    # the slices must not change between the two reads below, whatever is lost or retried
    sliced = checkpointed(sliced)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    return (
        sliced.withColumn(name, local).join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col(name).cast("bigint") + F.col("_offset")).drop("_slice", "_offset")
    )


def rank_in_group(df: DataFrame, keys: list[str], order: list[str], name: str, large: DataFrame) -> DataFrame:
    """0-based position per key; `large` names the keys too big for one window."""
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    if large.isEmpty():
        return df.withColumn(name, local.cast("bigint"))
    small = df.join(large.select(*keys), keys, "left_anti").withColumn(name, local.cast("bigint"))
    big = rank_sliced(df.join(large.select(*keys), keys, "left_semi"), keys, order, name)
    return small.unionByName(big)
