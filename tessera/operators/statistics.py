"""Daily correlations, ranks, errors of means and false-discovery rates."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NO_SPREAD = 1e-24


def _moments(x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Count and centred sums of squares and products over joint rows."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    return n, F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n


def pearson(x: Column, y: Column, fewest: int = 3, constant_is_zero: bool = False) -> Column:
    """Correlation of joint rows as an aggregate; missing with too few rows or no spread.

    With `constant_is_zero`, a constant x against a varying y counts as 0.
    """
    n, sx, sy, sxy = _moments(x, y)
    out = F.when((n >= fewest) & (sx > NO_SPREAD) & (sy > NO_SPREAD), F.try_divide(sxy, F.sqrt(sx * sy)))
    return F.when((n >= fewest) & (sx <= NO_SPREAD) & (sy > NO_SPREAD), F.lit(0.0)).otherwise(out) if constant_is_zero else out


def pooled_corr(x: Column, y: Column, tiny: float = 1e-12) -> Column:
    """Correlation over all days together; missing when a deviation is at most `tiny`."""
    n, sx, sy, sxy = _moments(x, y)
    return F.when((n > 0) & (F.sqrt(sx / n) > tiny) & (F.sqrt(sy / n) > tiny), F.try_divide(sxy, F.sqrt(sx * sy)))


def average_rank(df: DataFrame, x: str, out: str, keys: list[str]) -> DataFrame:
    """Ranks with average ties within keys."""
    rank = F.rank().over(W.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, x)) - 1) / F.lit(2.0)
    return df.withColumn(out, rank)


def daily_spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation of each day (or of each of `keys`) on the pair's joint rows."""
    keys = keys or ["t"]
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    own = average_rank(average_rank(own, x, "_rx", keys), y, "_ry", keys)
    return own.groupBy(*keys).agg(pearson(F.col("_rx"), F.col("_ry")).alias("rank_ic"))


# --- quantiles of many values ---------------------------------------------------------------

#: the bits of a value's place in order that a pass over the values settles
_BITS = 16


def _places(x: np.ndarray) -> np.ndarray:
    """Numbers in the values' order: the doubles' bits, those of negative ones turned round; NaN is largest, and -0 is 0."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _value(place: int) -> float:
    bits = np.array([place], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def quantiles(df: DataFrame, x: str, at: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated as F.percentile does, in bounded memory: no task holds more than counts, however many values differ.

    The values are made once and kept on the executors' disks. A pass counts them by the first bits of their place in order; the next ones count
    what shares these bits with a wanted rank by the bits that follow, until all 64 are known. A pass gives the driver 2**16 counts at most for each rank.
    """
    own = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x")).persist(StorageLevel.DISK_ONLY)
    try:
        found: dict[int, tuple[int, int]] = {}  # wanted rank -> its place's first bits, and the rank among those that share them
        total, shift = None, 64
        while shift:
            above, shift = shift, shift - _BITS
            known = np.unique(np.array([p for p, _ in found.values()], np.int64))

            def partial(batches, above=above, shift=shift, known=known):
                held: Counter[int] = Counter()
                for b in batches:
                    place = _places(b.column("x").to_numpy())
                    if above < 64:
                        place = place[np.isin(place >> above, known)]
                    held.update(dict(zip(*(v.tolist() for v in np.unique(place >> shift, return_counts=True)), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["place", "n"])

            counts = own.mapInArrow(partial, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
            place, n = (counts.column(k).to_numpy() for k in ("place", "n"))
            order = np.argsort(place)
            place, n = place[order], n[order]
            if total is None:
                total = int(n.sum())
                if not total:
                    return [None] * len(at)
                found = {r: (0, r) for q in at for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))}
            for r, (prefix, rank) in found.items():
                same = slice(None) if above == 64 else place >> _BITS == prefix
                ends = np.cumsum(n[same])
                k = int(np.searchsorted(ends, rank, side="right"))
                found[r] = (int(place[same][k]), rank - (int(ends[k - 1]) if k else 0))
    finally:
        own.unpersist()
    out = []
    for q in at:
        where = q * (total - 1)
        low, high = math.floor(where), math.ceil(where)
        a, b = _value(found[low][0]), _value(found[high][0])
        out.append(a if low == high or a == b else (high - where) * a + (where - low) * b)
    return out


# --- inference on daily series ------------------------------------------------------------


def hac(series: DataFrame, x: str, lags: int, order: str = "t", keys: list[str] | None = None) -> DataFrame:
    """n, mean and gap-aware standard error of each series: missing days keep their place and count as 0 deviation, but not in n.

    Lags end at the series' length less one; fewer than two values have no error. A series has as many rows as the calendar.
    """
    keys = keys or []
    mean = series.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n"), F.least(F.lit(lags), F.count("*") - 1).alias("_m"))
    c = (series.join(mean, keys) if keys else series.join(F.broadcast(mean))).withColumn("_c", F.coalesce(F.col(x) - F.col("mean"), F.lit(0.0)))
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    terms = F.col("_c") * F.col("_c")
    for k in range(1, lags + 1):
        terms = terms + F.when(F.col("_m") >= k, 2 * (1 - k / (F.col("_m") + 1)) * F.col("_c") * F.coalesce(F.lag("_c", k).over(w), F.lit(0.0))).otherwise(0.0)
    c = c.withColumn("_s", terms)
    return c.groupBy(*keys, "n", "mean").agg(F.sum("_s").alias("_s")).select(*keys, "n", "mean", F.when(F.col("n") >= 2, F.sqrt(F.greatest("_s", F.lit(0.0))) / F.col("n")).alias("se"))


def newey_west(series: DataFrame, x: str, lags: int, order: str = "t") -> DataFrame:
    """The same on the present values alone, closed up."""
    w = W.partitionBy(F.lit(0)).orderBy(order)
    own = series.where(F.col(x).isNotNull()).select(F.row_number().over(w).alias(order), x)
    return hac(own, x, lags, order)


def benjamini_hochberg(df: DataFrame, p: str, out: str, name: str) -> DataFrame:
    """q-values of p-values; missing stay missing. Hypotheses are few."""
    own = df.where(F.col(p).isNotNull())
    up = W.partitionBy(F.lit(0)).orderBy(p, name)
    ranked = own.withColumns({"_r": F.row_number().over(up), "_m": F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))})
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(up.rowsBetween(0, W.unboundedFollowing)))
    return ranked.withColumn(out, q).drop("_r", "_m").unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
