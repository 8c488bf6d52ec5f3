"""Joins that must match row for row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_zip(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys side by side; the job fails where a side has a key that the other lacks.

    Keys must not be null.  Two empty sides give an empty result.
    """
    a, b = left.withColumn("__left", F.lit(True)), right.withColumn("__right", F.lit(True))
    both = a.join(b, keys, "full_outer")
    whole = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    checked = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.to_json(F.struct(*keys)))))
    return both.where(checked).drop("__left", "__right")
