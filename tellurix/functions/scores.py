"""Verification scores: each is an expression over sums, so Spark aggregates it partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurix.operators.ranks import cumulative, quantiles

#: Sums of doubles depend on their order in the last bits; results are given to so many places.
DIGITS = 6


def rounded(c: Column, name: str, digits: int = DIGITS) -> Column:
    return F.round(c, digits).alias(name)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null: the session may run in ANSI mode, where a division by 0 fails."""
    return a / F.nullif(b, F.lit(0))


def complete(pairs: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or NaN; NaN is a missing value too, and would spoil every sum."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return pairs.where(ok)


def deterministic(pairs: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """n, bias, mae, rmse and correlation of the columns `f` (forecast) and `o` (observation) by stratum. The correlation
    of a stratum without spread is null."""
    e = F.col("f") - F.col("o")
    return complete(pairs, "f", "o").groupBy(*by).agg(*deterministic_columns(e))


def deterministic_columns(e: Column, digits: int = DIGITS) -> list[Column]:
    """corr() itself fails in ANSI mode where a stratum has no spread."""
    own = {"bias": F.avg(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r": F.try_divide(F.covar_pop("f", "o"), F.stddev_pop("f") * F.stddev_pop("o"))}
    return [F.count("*").alias("n"), *[rounded(c, name, digits) for name, c in own.items()]]


def skill(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean-square-error skill of `f` against the reference forecast `c` (Murphy, 1988): 1 is perfect, 0 no better."""
    of = lambda x: F.sum((F.col(x) - F.col("o")) * (F.col(x) - F.col("o")))
    return complete(pairs, "f", "o", "c").groupBy(*by).agg(F.count("*").alias("n"), rounded(1 - ratio(of("f"), of("c")), "skill"))


def contingency(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hits, false alarms, misses and correct negatives of the booleans `f` and `o`, with precision, recall and F1."""
    when = lambda c: F.sum(F.when(c, 1).otherwise(0))
    f, o = F.col("f"), F.col("o")
    t = pairs.where(f.isNotNull() & o.isNotNull()).groupBy(*by).agg(
        when(f & o).alias("hits"), when(f & ~o).alias("false_alarms"), when(~f & o).alias("misses"), when(~f & ~o).alias("correct_negatives")
    )
    h, a, m = F.col("hits"), F.col("false_alarms"), F.col("misses")
    return t.select("*", rounded(ratio(h, h + a), "precision"), rounded(ratio(h, h + m), "recall"), rounded(ratio(2 * h, 2 * h + a + m), "f1"))


def brier(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Brier score of the probability `p` for the event `y` (0 or 1)."""
    return complete(pairs, "p", "y").groupBy(*by).agg(F.count("*").alias("n"), rounded(F.avg((F.col("p") - F.col("y")) ** 2), "brier"))


def reliability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """By bin of the forecast probability: number, mean probability, and how often the event came."""
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return complete(pairs, "p", "y").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), rounded(F.avg("p"), "mean_p"), rounded(F.avg("y"), "observed"))


def weighted_mean(df: DataFrame, value: str, weight: Column, by: Sequence[str]) -> DataFrame:
    """Weighted mean, such as one by the cosine of latitude."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), rounded(ratio(F.sum(F.col(value) * weight), F.sum(weight)), "mean"))


def auc(pairs: DataFrame) -> DataFrame:
    """Area under the ROC curve of the score `p` for the event `y` (0 or 1): the rank sum with ties at their mean rank, over
    the exact scores."""
    ranked = cumulative(complete(pairs, "p", "y"), [], "p", {"pos": F.col("y").cast("long"), "neg": (1 - F.col("y")).cast("long")})
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    total = ranked.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("w"))
    return total.select("n_pos", "n_neg", rounded(ratio(F.col("w"), F.col("n_pos") * F.col("n_neg")), "auc"))


def quantile_error(pairs: DataFrame, by: Sequence[str], at: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Difference of the exact quantiles of `f` and `o`, by stratum."""
    names = {f"q{round(q * 100)}": q for q in at}
    rows = complete(pairs, "f", "o").select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).cast("double").alias("_v")) for c in ("f", "o")])))
    each = quantiles(rows, [*by, "_of"], "_v", names)
    of = lambda c, q: F.max(F.when(F.col("_of") == c, F.col(q)))
    return each.groupBy(*by).agg(F.max("n").alias("n"), *[rounded(of("f", q) - of("o", q), q) for q in names])
