"""What needs a global order within groups: ranks, exact quantiles, and inequality joins by counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurix.sources import formats


def cumulative(df: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, Column]) -> DataFrame:
    """One row for each value (other than null) of each group, with each of `sums` over the rows that have it, under its
    `name`; over those of the group with smaller values, `name_below`; and over the whole group, `name_all`.

    Rows with the same value are added up before they move. The values are then dealt out by ranges of group and value and
    written to the shared folder; the sums of the ranges, one row for each group and range, give each range what lies below
    it. So no task gets more of a group than a range, and a window over a group has no more rows than there are ranges.
    Null groups are a group.
    """
    added = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ranged = formats.kept(added.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    every = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = every.select(*by, "_range", *[F.sum(n).over(before).alias(n) for n in sums], *[F.sum(n).over(group).alias(f"{n}_all") for n in sums], F.lit(0).alias("_side"))
    rows = ranged.withColumn("_side", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_range").orderBy("_side", value)
    below = [F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_below") for n in sums]
    total = [F.first(f"{n}_all").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{n}_all") for n in sums]
    return rows.select(*by, value, *sums, *below, *total, "_side").where("_side = 1").drop("_side")


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """Exact quantiles by group, interpolated between the two values around the position q (n - 1); with the number `n` of
    values. Nulls are left out."""
    rows = cumulative(df, by, value, {"n": F.lit(1)})
    n, below = F.col("n_all"), F.col("n_below")
    place = {name: (n - 1) * F.lit(q) for name, q in at.items()}
    has = lambda rank: F.max(F.when((below <= rank) & (rank < below + F.col("n")), F.col(value)))
    ends = rows.groupBy(*by).agg(
        F.max("n_all").alias("n"), *[has(F.floor(p)).alias(f"_lo_{name}") for name, p in place.items()], *[has(F.ceil(p)).alias(f"_hi_{name}") for name, p in place.items()]
    )
    part = {name: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)) for name, q in at.items()}
    lo, hi = (lambda name: F.col(f"_lo_{name}").cast("double")), (lambda name: F.col(f"_hi_{name}").cast("double"))
    return ends.select(*by, "n", *[F.when(x == 0, lo(name)).otherwise(lo(name) * (1 - x) + hi(name) * x).alias(name) for name, x in part.items()])


def count_above(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, right_value: str, name: str) -> DataFrame:
    """`left` with the column `name`: how many rows of `right` with the same keys have a larger value. Rows whose keys or value are null
    have none. Both sides' values are ranked under one another, so nothing is done for a pair."""
    values = lambda df, v, n: df.select(*keys, F.col(v).alias("_v"), F.lit(n).alias("_n"))
    ranked = cumulative(values(left, value, 0).unionByName(values(right, right_value, 1)), keys, "_v", {"n": F.col("_n")})
    above = ranked.select(*keys, F.col("_v").alias(value), (F.col("n_all") - F.col("n_below") - F.col("n")).alias(name))
    return left.join(above, [*keys, value], "left").fillna(0, [name])
