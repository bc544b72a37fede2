"""Ordered operators that never hold one key's whole history in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str, current: bool = True) -> DataFrame:
    """``df`` with the column ``name``: the last non-null ``value`` of the key at or before each row (before it, if not
    ``current``).

    ``block`` cuts each key's order into runs of bounded length (an hour, say). Windows run within a block; between blocks
    only one row a block is carried on. ``order`` must be total within a block for a defined result.
    """
    rows = df.withColumn("__v", value)
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    last = F.expr(f"max_by(__v, struct({', '.join(order)})) filter (where __v is not null)")
    blocks = rows.groupBy(*keys, block).agg(last.alias("__end"))
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__carried", F.last("__end", ignorenulls=True).over(across)).where("__carried is not null").select(*keys, block, "__carried")
    rows = rows.withColumn("__inside", F.last("__v", ignorenulls=True).over(inside)).join(carried, [*keys, block], "left")
    return rows.withColumn(name, F.coalesce("__inside", "__carried")).drop("__v", "__inside", "__carried")
