"""Samples that come out the same each time, and weights that make their sums unbiased."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's random number.
BITS = 52


def uniform(key: Sequence[str], seed: str) -> Column:
    """A number above 0 and up to 1 that hangs on the key's values and the seed alone: the first bits of their MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *key)), 1, BITS // 4), 16, 10).cast("double") + 1) / float(1 << BITS)


def prioritised(df: DataFrame, by: Sequence[str], k: int, size: str, key: Sequence[str], seed: str = "") -> DataFrame:
    """Priority sample (Duffield, Lund and Thorup, 2007): of each stratum the k rows with the largest size / random number,
    or all if it has no more, with their `weight`.

    The weight is the row's size, or the k+1-th largest priority if that is more. The sum of the weights of any part of a
    stratum is then an unbiased estimate of that part's sizes, with a standard error of at most its stratum's total / sqrt(k - 1).
    Rows of size 0 or less, or null, are never drawn. The key must tell rows apart: rows alike in it are drawn together, in no
    certain order. Each task passes on k + 1 rows of a stratum at most.
    """
    priority = F.col(size) / uniform(key, seed)
    order = Window.partitionBy(*by).orderBy(F.desc("_priority"), *key)
    top = df.where(F.col(size) > 0).withColumn("_priority", priority).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    cut = F.max(F.when(F.col("_rank") == k + 1, F.col("_priority"))).over(Window.partitionBy(*by))
    return top.withColumn("weight", F.greatest(F.col(size).cast("double"), cut)).where(F.col("_rank") <= k).drop("_priority", "_rank")
