"""Running values over groups of any size: windows inside blocks of the order, and a small window over the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, keys: list[str], order: str, value: Column, tie: str, name: str, size: int = 4096) -> DataFrame:
    """Rows with the last value that is not null of the rows before each, in (order, tie); order is a number and not null.

    A window never holds more of a group than one block of the order, however many rows a key has; what stands before a block comes
    from the table of blocks, which holds one row for each.
    """
    blocked = rows.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / size))
    end = F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(order), F.col(tie), F.col("_value").alias("v"))))
    ends = blocked.groupBy(*keys, "_block").agg(end.alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(over)["v"].alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(carried, [*keys, "_block"])
    return joined.withColumn(name, F.coalesce("_inside", "_carried")).select(*rows.columns, name)
