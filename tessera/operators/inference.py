"""Inference on daily series: summaries, paired differences, block bootstrap, significance of many series."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import benjamini_hochberg, hac

# Chebyshev fit of erfc, relative error under 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_p(t: Column) -> Column:
    """Probability of a standard normal number beyond |t| on either side."""
    x = F.abs(t) / F.sqrt(F.lit(2.0))
    u = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        poly = poly * u + c
    return u * F.exp(-x * x + poly)


def summary(series: DataFrame, x: str, lags: int, keys: list[str] | None = None, order: str = "t") -> DataFrame:
    """For each series: n, mean, sd, gap-aware se, t and two-sided p; the rows are the whole calendar, gaps as null."""
    keys = keys or []
    spread = series.groupBy(*keys).agg(F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0).alias("sd"))
    both = hac(series, x, lags, order, keys)
    both = both.join(spread, keys) if keys else both.join(F.broadcast(spread))
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se"))
    return both.select(*keys, "n", "mean", "sd", "se", t.alias("t_value"), two_sided_p(t).alias("p_value"))


def paired(a: DataFrame, b: DataFrame, x: str, lags: int, order: str = "t") -> DataFrame:
    """The summary of a - b on the days of both calendars; a difference needs both values."""
    both = a.select(order, F.col(x).alias("_a")).join(b.select(order, F.col(x).alias("_b")), order)
    return summary(both.select(order, (F.col("_a") - F.col("_b")).alias("_x")), "_x", lags, order=order)


def t_quantile(p: Column, nu: Column) -> Column:
    """Quantile of Student's t for a whole number `nu` of degrees, p in (0, 1).

    With t = sqrt(nu) tan(a), the probability of |t| or less is a finite sum in sin a and cos a: its inverse, that of the
    incomplete beta function, is found by halving the interval of a.  Missing for nu under 1.
    """
    nu, level = nu.cast("long"), F.abs(2 * p - 1)
    odd = nu % 2 == 1
    # cos, cos^3 2/3, ... for odd nu; 1, cos^2 1/2, ... for even nu
    terms = F.when(odd, F.floor((nu - 1) / 2)).otherwise(F.floor(nu / 2)).cast("int")

    def inside(a: Column) -> Column:
        c2 = F.cos(a) * F.cos(a)
        first = F.when(odd, F.cos(a)).otherwise(F.lit(1.0))

        def step(acc: Column, k: Column) -> Column:
            grown = F.when(odd, acc["term"] * c2 * (2.0 * k) / (2.0 * k + 1.0)).otherwise(acc["term"] * c2 * (2.0 * k - 1.0) / (2.0 * k))
            return F.struct((acc["sum"] + acc["term"]).alias("sum"), grown.alias("term"))

        places = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
        total = F.aggregate(places, F.struct(F.lit(0.0).alias("sum"), first.alias("term")), step)["sum"]
        return F.when(odd, 2 / F.pi() * (a + F.sin(a) * total)).otherwise(F.sin(a) * total)

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        under = inside(mid) < level
        return F.struct(F.when(under, mid).otherwise(acc["low"]).alias("low"), F.when(under, acc["high"]).otherwise(mid).alias("high"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(0.0).alias("low"), (F.pi() / 2).alias("high")), halve)
    t = F.sqrt(nu.cast("double")) * F.tan((ends["low"] + ends["high"]) / 2)
    return F.when((nu >= 1) & (p > 0) & (p < 1), F.signum(2 * p - 1) * t)


def seed_interval(df: DataFrame, x: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """keys, seeds, mean, low, high: Student's interval of the mean over seeds; one seed gives its own value, none gives nulls."""
    found = df.groupBy(*keys).agg(F.count(x).alias("seeds"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_sd"))
    half = F.when(F.col("seeds") > 1, t_quantile(F.lit((1 + level) / 2), F.col("seeds") - 1) * F.col("_sd") / F.sqrt("seeds")).when(F.col("seeds") == 1, 0.0)
    return found.select(*keys, "seeds", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def strict_seed_mean(df: DataFrame, x: str, keys: list[str], seeds: int) -> DataFrame:
    """keys and the mean of x over seeds; missing unless all declared seeds have a value."""
    return df.groupBy(*keys).agg(F.when(F.count(x) == seeds, F.avg(x)).alias(x))


def significance(series: DataFrame, x: str, name: str, lags: int, fewest: int = 30, order: str = "t") -> DataFrame:
    """For each named series: days, mean, median, sd, share of positive days, se, t, p, status and q (Benjamini-Hochberg over the p that are there)."""
    facts = series.groupBy(name).agg(F.median(x).alias("median"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))
    out = summary(series, x, lags, [name], order).join(facts, name)
    enough = (F.col("n") >= max(fewest, 2)) & (F.col("sd") > 1e-15) & (F.col("se") > 0)
    out = out.withColumn("status", F.when(enough, "ok").otherwise("insufficient_data")).withColumns({c: F.when(enough, F.col(c)) for c in ("t_value", "p_value")})
    return benjamini_hochberg(out, "p_value", "q_value", name)


def block_starts(days: dict[int, int], block: int, samples: int, seed: int) -> list[tuple[int, int, int, int, int, int]]:
    """(sample, year, days of the year, block, width, first day in the year) of every block of every sample.

    The draws depend on the calendar alone, so all series share them. Their number is bounded by samples * days / block.
    """
    if block < 1 or samples < 1:
        raise ValueError("block and samples must be positive")
    rng, out = np.random.default_rng(seed), []
    for year, n in sorted(days.items()):
        width = min(block, n)
        drawn = rng.integers(0, n - width + 1, size=(samples, -(-n // width)))
        out += [(s, year, n, b, width, int(v)) for s, row in enumerate(drawn.tolist()) for b, v in enumerate(row)]
    return out


@lru_cache(maxsize=2)
def multiplicities(days: tuple[tuple[int, int], ...], block: int, samples: int, seed: int) -> dict[int, np.ndarray]:
    """For each year a matrix, samples x days of the year: how often a sample draws the day.

    The draws depend on the calendar alone, so all series share them; a worker makes them once.
    """
    out = {year: np.zeros((samples, n), np.float32) for year, n in days}
    for s, year, n, b, width, first in block_starts(dict(days), block, samples, seed):
        out[year][s, first : first + min(width, n - b * width)] += 1
    return out


def _calendar(series: DataFrame, date: str) -> dict[int, list]:
    """The distinct dates by year, in order: as many as the calendar has, whatever the number of series."""
    rows = series.select(date).distinct().groupBy(F.year(date).alias("y")).agg(F.array_sort(F.collect_list(date)).alias("dates")).collect()
    return {r.y: r.dates for r in sorted(rows, key=lambda r: r.y)}


def _by_year(dates: dict[int, list], days, values: np.ndarray) -> dict[int, np.ndarray]:
    """Rows of `values` (one or more columns) put at their place in each year; missing where a date has no row."""
    place = {d: (y, k) for y, own in dates.items() for k, d in enumerate(own)}
    out = {y: np.full((len(own), values.shape[1]), np.nan) for y, own in dates.items()}
    for d, v in zip(days, values, strict=True):
        y, k = place[d]
        out[y][k] = v
    return out


def _interval(found: np.ndarray, level: float) -> tuple[float | None, float | None]:
    found = found[np.isfinite(found)]
    tail = (1 - level) / 2
    return tuple(map(float, np.quantile(found, [tail, 1 - tail]))) if len(found) else (None, None)


def full_summary(series: DataFrame, x: str, lags: int, keys: list[str], block: int = 20, samples: int = 2000, seed: int = 0, order: str = "t", date: str = "d") -> DataFrame:
    """The summary of each series with the interval of its mean; rows are the whole calendar, gaps as null."""
    return summary(series, x, lags, keys, order).join(bootstrap(series, x, block, samples, seed, keys, date), keys, "left")


def sharpe_difference(series: DataFrame, a: str, b: str, block: int = 20, samples: int = 2000, seed: int = 0, date: str = "d", year: float = 252.0, level: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """For each of `keys` (one row without): the difference of two Sharpe ratios over the days that have both, and its interval under shared blocks within years.

    Sums and sums of squares of all samples are products of the samples' multiplicities with the days.
    """
    keys = keys or []
    both = series.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, date, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    dates = _calendar(both, date)
    sizes = tuple((y, len(own)) for y, own in dates.items())

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[["_a", "_b"]].to_numpy(float)
        mid = x.mean(axis=0)  # taken out for exactness, and put back where the mean counts
        placed = _by_year(dates, rows[date], x - mid)
        n, s, ss = 0.0, 0.0, 0.0
        for y, m in multiplicities(sizes, block, samples, seed).items():
            v, here = np.nan_to_num(placed[y]), np.isfinite(placed[y][:, 0]).astype(float)
            n, s, ss = n + m @ here, s + m @ v, ss + m @ (v * v)
        n = np.asarray(n)[:, None]
        with np.errstate(all="ignore"):
            var = np.maximum(ss - s * s / n, 0.0) / (n - 1)
            r = np.where(var > 0, (s / n + mid) / np.sqrt(np.where(var > 0, var, 1.0)), np.nan) * np.sqrt(year)
            spread = x.std(axis=0, ddof=1) if len(x) > 1 else np.full(2, np.nan)
            own = np.where(spread > 0, mid / spread, np.nan) * np.sqrt(year)
        low, high = _interval(r[:, 0] - r[:, 1], level)
        value = float(own[0] - own[1])
        return pd.DataFrame({**{k: rows[k].iloc[:1].to_numpy() for k in keys}, "difference": pd.array([None if np.isnan(value) else value], "Float64"), "low": pd.array([low], "Float64"), "high": pd.array([high], "Float64")})

    schema = "".join(f"{k} {both.schema[k].dataType.simpleString()}, " for k in keys) + "difference double, low double, high double"
    return both.groupBy(*keys).applyInPandas(one, schema)


def bootstrap(series: DataFrame, x: str, block: int = 20, samples: int = 2000, seed: int = 0, keys: list[str] | None = None, date: str = "d", level: float = 0.95) -> DataFrame:
    """For each series, the interval of its mean under moving blocks within years; the years keep their shares of present days.

    A sample without any present day of a year that has some is left out.  A series is a vector of days, and all its samples are
    one product of the samples' multiplicities with it; no row is made for a day of a sample.
    """
    keys = keys or []
    dates = _calendar(series, date)
    sizes = tuple((y, len(own)) for y, own in dates.items())
    narrow = series.select(*keys, date, F.col(x).cast("double").alias("_x"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        placed = _by_year(dates, rows[date], rows[["_x"]].to_numpy(float))
        total = sum(int(np.isfinite(v).sum()) for v in placed.values())
        means = np.zeros(samples) if total else np.full(samples, np.nan)
        for y, m in multiplicities(sizes, block, samples, seed).items():
            v = placed[y][:, 0]
            here = np.isfinite(v)
            if here.any():
                with np.errstate(all="ignore"):
                    means += (m @ np.where(here, v, 0.0)) / (m @ here.astype(float)) * (here.sum() / total)
        low, high = _interval(means, level)
        return pd.DataFrame({**{k: rows[k].iloc[:1].to_numpy() for k in keys}, "low": pd.array([low], "Float64"), "high": pd.array([high], "Float64")})

    schema = "".join(f"{k} {narrow.schema[k].dataType.simpleString()}, " for k in keys) + "low double, high double"
    return narrow.groupBy(*keys).applyInPandas(one, schema)
