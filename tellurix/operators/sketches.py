"""Sketches that are stored by period, and merged for any range of periods without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** REGISTERS registers of a distinct count, whose standard error is 1.04 / sqrt of that, 0.8 %; KEPT items a level of a quantile sketch.
REGISTERS, KEPT = 14, 400
#: What results are held to: relative error of distinct counts, error of a quantile's rank as a share of the rows.
DISTINCT_ERROR, RANK_ERROR = 0.03, 0.02


def stored(df: DataFrame, by: Sequence[str | Column], distinct: str, value: str) -> DataFrame:
    """One row for each group: the number `n` of rows, a sketch `distinct_sketch` of one column's different values, and one of
    the other's distribution, `value_sketch`. Nulls are in neither. Sketches have a bounded size, and are made before the shuffle."""
    sketch = F.hll_sketch_agg(distinct, REGISTERS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KEPT).alias("value_sketch")
    return df.groupBy(*by).agg(F.count("*").alias("n"), *sketch)


def merged(sketches: DataFrame, by: Sequence[str | Column], at: Sequence[float] = (0.5,)) -> DataFrame:
    """Groups of stored rows put together: `n`, `about_distinct`, and `about_q50` and the like."""
    both = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("value_sketch").alias("_v"))
    names = [c for c in both.columns if c not in ("_d", "_v")]
    return both.select(*names, F.hll_sketch_estimate("_d").alias("about_distinct"), *[F.kll_sketch_get_quantile_double("_v", F.lit(q)).alias(f"about_q{round(q * 100)}") for q in at])
