"""Running sums of which no key has to fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Blocks into which the span of the leading order column is cut.
BLOCKS = 1024


def running_before(df: DataFrame, keys: list[str], order: list[str], value: Column, blocks: int = BLOCKS) -> DataFrame:
    """df with ``before``: the sum of value over the earlier rows of the same keys, 0 where there is none.

    Two levels: the span of the first order column, a number, is cut into equal
    blocks; only a block's sum per key meets the sums of the other blocks, and the
    rows of a block have a window of their own.  Null values add nothing, rows with
    a null first order column come first.  order must tell all rows of a key apart.
    """
    lead = order[0]
    low, high = df.agg(F.min(lead), F.max(lead)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // blocks))
    rows = df.withColumns({"__v": F.coalesce(value, F.lit(0)), "__block": F.coalesce(F.floor((F.col(lead) - F.lit(low or 0)) / width), F.lit(-1))})
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__v").alias("__sum"))
    start = sums.select(*keys, "__block", (F.sum("__sum").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__start"))
    inner = rows.withColumn("__inner", F.sum("__v").over(W.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("__v"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*keys, "__block")]
    return inner.alias("x").join(start.alias("y"), same).select(*(F.col(f"x.{c}") for c in df.columns), (F.col("x.__inner") + F.col("y.__start")).alias("before"))
