"""Bringing a forecast and an observation onto one row.

What follows a key through time is cut into buckets of time, so that a key with a third of all rows is many groups and not
one. What a bucket needs from before it, the last value of an earlier one, is found from a table of one row for each key and
bucket and put in front of the bucket's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

#: Buckets are put together 2 ** FAN at a time, so a group of the table of buckets has so many rows at most.
FAN = 12
#: Times from year 1 to 9999 are less than 2 ** TIME_BITS seconds from 1970; whole numbers are less than 2 ** NUMBER_BITS.
TIME_BITS, NUMBER_BITS = 38, 63


def bucket_of(df: DataFrame, time: str, length: int) -> tuple[Column, int]:
    """The number of the bucket of `length` seconds (or units of a whole number) that a row's time lies in, never negative,
    and how many levels of FAN bits it has. Rows without a time sort first, so theirs is the first bucket. A time without
    zone is read as it is written: hours that a zone leaves out or repeats would change the order."""
    kind, c = df.schema[time].dataType, F.col(time)
    if isinstance(kind, IntegralType):
        number, bits = c.cast("long"), NUMBER_BITS
    elif isinstance(kind, TimestampType):
        number, bits = F.unix_seconds(c), TIME_BITS
    elif isinstance(kind, TimestampNTZType):
        number, bits = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c), TIME_BITS
    elif isinstance(kind, DateType):
        number, bits = F.unix_date(c).cast("long") * 86400, TIME_BITS
    else:
        raise ValueError(f"{time}: {kind.simpleString()} is neither a time nor a whole number")
    bits -= max(length, 4).bit_length() - 1
    return F.coalesce(F.floor(number / F.lit(max(length, 4))) + (1 << bits), F.lit(0)).cast("long"), -(-(bits + 1) // FAN)


def carried(last: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """`keys, _bucket, _before` from `keys, _bucket, _last`: the `_last` of the key's nearest earlier bucket that has one,
    where there is such. Buckets are put under their nodes, nodes under theirs and so on; each takes the last value among its
    elder siblings, or else what its parent takes. No window has more rows than a node has children, and one."""
    parent = F.shiftright("_bucket", FAN)
    rows = last.select(*keys, parent.alias("_parent"), "_bucket", "_last")
    if levels > 1:
        newest = F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_bucket")))
        above = carried(last.groupBy(*keys, parent.alias("_bucket")).agg(newest.alias("_last")), keys, levels - 1)
        rows = rows.unionByName(above.select(*keys, F.col("_bucket").alias("_parent"), F.lit(-1).cast("long").alias("_bucket"), F.col("_before").alias("_last")))
    w = Window.partitionBy(*keys, "_parent").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(w).alias("_before")).where("_bucket >= 0 and _before is not null")


def persistence(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, keep: Sequence[str] = (), length: int = 86400) -> DataFrame:
    """Forecast `f`: the key's value before this one in `order`; observation `o`: this one; with the columns `keep`. The first
    column of `order` is a time or a whole number, by which rows are dealt out in buckets of `length` (4 at least)."""
    bucket, levels = bucket_of(df, order[0], length)
    rows = df.withColumn("_bucket", bucket)
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    heads = carried(last, keys, levels).select(*keys, "_bucket", F.lit(0).alias("_side"), F.col("_before.v").alias(value))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_side", *order)
    both = rows.select(*dict.fromkeys([*keys, "_bucket", *order, value, *keep]), F.lit(1).alias("_side")).unionByName(heads, allowMissingColumns=True)
    return both.select(*dict.fromkeys([*keys, *keep]), "_side", F.lag(value).over(w).alias("f"), F.col(value).alias("o")).where("_side = 1").drop("_side")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, name: str, length: int = 86400) -> DataFrame:
    """`left` with the column `name`: the `value` of the key's last row of `right` at or before the left row's `time`.

    Both sides are put under one another and sorted once by key, bucket of `length` and time, so a key costs its rows and
    not its pairs, and no task gets more of it than a bucket. A right row at the same instant counts; of several, the one
    with the largest value. Left rows without any get null; null keys are a key.
    """
    bucket, levels = bucket_of(left, time, length)
    values = right.select(*keys, time, F.lit(1).alias("_side"), F.col(value).alias("_v"), bucket.alias("_bucket"))
    tagged = left.withColumns({"_side": F.lit(2), "_v": F.lit(None).cast(right.schema[value].dataType), "_bucket": bucket})
    asked = tagged.select(*keys, "_bucket").distinct().withColumn("_last", F.lit(None).cast(right.schema[value].dataType))
    newest = F.max_by("_v", F.struct(time, "_v"))
    last = values.where("_v is not null").groupBy(*keys, "_bucket").agg(newest.alias("_last")).unionByName(asked).groupBy(*keys, "_bucket").agg(F.first("_last", ignorenulls=True).alias("_last"))
    heads = carried(last, keys, levels).select(*keys, "_bucket", F.lit(0).alias("_side"), F.col("_before").alias("_v"))
    tagged = tagged.unionByName(values, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    first = F.when(F.col("_side") > 0, F.lit(1)).otherwise(0)
    w = Window.partitionBy(*keys, "_bucket").orderBy(first, time, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 2").drop("_side", "_v", "_bucket")


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of rows with equal keys in which the right time is at most `seconds` before the left one, and not after it.

    Time is cut into buckets of that length; a right row can only match in its own bucket and the next one, so it is
    listed in both and the join is an equi-join on key and bucket. A busy key is dealt out by its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", bucket(time))
    b = right.withColumn("_bucket", F.explode(F.array(bucket(right_time), bucket(right_time) + 1)))
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp"))
    return a.join(b, [*keys, "_bucket"]).where(gap.between(0, seconds * 1_000_000)).drop("_bucket")


def stratified(df: DataFrame, by: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """The aggregates for every combination of strata, with their totals; `level` tells which strata are summed over."""
    return df.cube(*by).agg(F.grouping_id().cast("int").alias("level"), *columns)
