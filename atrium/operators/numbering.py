"""Running totals and numbers within groups of any size: no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.storage import stored


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` (whole numbers) over the rows before in order, within groups of ``keys``.

    Rows are put into ranges by keys and order, so a large group is spread over many partitions. Each partition sums up its
    own part of a group, and what the parts before have together is added: one row a partition and group. Rows that are
    equal in ``order`` come in any order.
    """
    parts = stored(df.withColumn("_value", value.cast("long")).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_own", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    out = local.join(sums, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_own"))
    return out.select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the number of each row in its group from 0."""
    return running(df, keys, order, F.lit(1), name)
