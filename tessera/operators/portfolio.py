"""Overlapping-sleeve portfolios in closed form.

A signal of day s (every `every`-th) trades on s + 1 and earns from s + 2; each of `sleeves` sleeves holds
1 / sleeves of the book for every * sleeves days.  So the book of a day is a sum over the signals that are alive, and no day-by-day loop is
needed: each signal's target is repeated over the days that it is held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def holdings(targets: DataFrame, n_days: int, every: int = 5, sleeves: int = 4) -> DataFrame:
    """t, a, weight of each held name; targets: t, a, target."""
    alive = targets.where((F.col("t") % every == 0) & (F.col("t") + 2 < n_days) & (F.col("target") != 0))
    held = F.sequence(F.col("t") + 2, F.least(F.col("t") + 1 + every * sleeves, F.lit(n_days - 1)))
    return alive.select("a", (F.col("target") / sleeves).alias("w"), F.explode(held).alias("t")).groupBy("t", "a").agg(F.sum("w").alias("weight"))


def turnover(targets: DataFrame, n_days: int, every: int = 5, sleeves: int = 4) -> DataFrame:
    """t, turnover booked on the day after each signal, against the sleeve's target of every * sleeves days before."""
    own = targets.where((F.col("t") % every == 0) & (F.col("t") + 2 < n_days)).select("t", "a", "target")
    old = own.select((F.col("t") + every * sleeves).alias("t"), "a", F.col("target").alias("before"))
    last = own.select("t").distinct()
    both = own.join(old.join(last, "t", "left_semi"), ["t", "a"], "full")
    moved = F.abs(F.coalesce("target", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))) / sleeves
    return both.groupBy((F.col("t") + 1).alias("t")).agg(F.sum(moved).alias("turnover"))


def returns(held: DataFrame, panel: DataFrame, r: str = "return") -> DataFrame:
    """Daily return, gross weight and coverage; a missing return counts as 0 and lowers the coverage."""
    own = held.join(panel.select("t", "a", F.col(r).alias("_r")), ["t", "a"], "left")
    size = F.abs("weight")
    return own.groupBy("t").agg(F.sum(F.col("weight") * F.coalesce("_r", F.lit(0.0))).alias("ret"), F.sum(size).alias("gross"), F.try_divide(F.sum(F.when(F.col("_r").isNotNull(), size)), F.sum(size)).alias("coverage"))


def liquidation(held: DataFrame, last: int) -> DataFrame:
    """t, turnover of closing the net holdings after the last day's return, once."""
    return held.where(F.col("t") == last).groupBy("t").agg(F.sum(F.abs("weight")).alias("turnover"))


def net_returns(path: DataFrame, moved: DataFrame, cost_bps: float) -> DataFrame:
    """The path with its turnover (0 on days without) and the return after costs."""
    cost = moved.groupBy("t").agg(F.sum("turnover").alias("turnover"))
    both = path.join(cost, "t", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return both.withColumn("net", F.col("ret") - F.lit(cost_bps / 10000.0) * F.col("turnover"))


def metrics(path: DataFrame, r: str = "ret", year: float = 252.0) -> DataFrame:
    """One row: days, total return, growth a year, mean and volatility a year, Sharpe ratio, maximum drawdown, invalid.

    Wealth is kept in logarithms. A path without days, with a missing return or with one under -1 is invalid: all but days is null.
    """
    so_far = W.partitionBy(F.lit(0)).orderBy("t").rowsBetween(W.unboundedPreceding, 0)  # one row for each date
    x = F.col(r)
    p = path.withColumn("_l", F.sum(F.log1p(F.when(x > -1, x))).over(so_far))
    p = p.withColumn("_dd", F.expm1(F.col("_l") - F.greatest(F.lit(0.0), F.max("_l").over(so_far))))
    one = p.agg(F.count("*").alias("days"), F.sum(F.log1p(F.when(x > -1, x))).alias("_log"), (F.avg(x) * year).alias("mean"), (F.coalesce(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.lit(year))).alias("vol"), F.least(F.lit(0.0), F.min("_dd")).alias("drawdown"), (F.count_if(x.isNull() | F.isnan(x) | (x < -1)) > 0).alias("_bad"), (F.count_if(x == -1) > 0).alias("_ruin"))
    one = one.withColumn("invalid", F.col("_bad") | (F.col("days") == 0))
    wealth = F.when(F.col("_ruin"), 0.0).otherwise(F.exp("_log"))
    one = one.withColumns({"total": wealth - 1, "cagr": F.pow(wealth, F.lit(year) / F.col("days")) - 1, "drawdown": F.when(F.col("_ruin"), -1.0).otherwise(F.col("drawdown")), "sharpe": F.when(F.col("vol") > 0, F.col("mean") / F.col("vol"))})
    names = ["total", "cagr", "mean", "vol", "sharpe", "drawdown"]
    return one.select("days", *[F.when(~F.col("invalid"), F.col(c)).alias(c) for c in names], "invalid")


def coverage(path: DataFrame) -> DataFrame:
    """One row: mean gross weight, days with a missing held return, and the share of held weight with a return."""
    missing = F.col("gross") * (1 - F.coalesce("coverage", F.lit(1.0)))
    return path.agg(F.avg("gross").alias("average_gross"), F.count_if(missing > 1e-12).alias("missing_days"), F.coalesce(1 - F.sum(missing) / F.when(F.sum("gross") > 0, F.sum("gross")), F.lit(1.0)).alias("held_coverage"))


def exposures(held: DataFrame, panel: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of weight times exposure of each day; missing when a held exposure is."""
    own = held.join(panel.select("t", "a", *columns), ["t", "a"], "left")
    return own.groupBy("t").agg(*[F.when(F.count(c) == F.count("*"), F.sum(F.col("weight") * F.col(c))).alias(c) for c in columns])
