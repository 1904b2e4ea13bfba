"""Running sums that never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str,
                block: int = 4096) -> DataFrame:
    """``df`` with ``out`` = sum of ``value`` over the rows of the same group
    that come earlier by the integer column ``order``.

    A group is cut into blocks of ``block`` consecutive order numbers: sums
    run inside blocks, and over the block totals, so that a group of any size
    is spread over tasks. ``df`` is a small table of totals, read twice.
    """
    keyed = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    before = (Window.partitionBy(*group, "_block").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    over = (Window.partitionBy(*group).orderBy("_block")
            .rowsBetween(Window.unboundedPreceding, -1))
    blocks = (keyed.groupBy(*group, "_block").agg(F.sum(value).alias("_v"))
              .withColumn("_base", F.coalesce(F.sum("_v").over(over), F.lit(0))).drop("_v"))
    inner = keyed.withColumn("_in", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return (inner.join(blocks, [*group, "_block"])
            .withColumn(out, (F.col("_in") + F.col("_base")).cast("long"))
            .drop("_in", "_base", "_block"))
