"""Rolling operators: Columns over ordered frames of a dense panel.

A panel has one row for each asset `a` and each date number `t`, without gaps.  A frame of w rows
needs ceil(0.8 w) present values (pairs: at least 2); missing is null.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import finite

FLAT = 1e-12
#: deviations that are this small beside the mean are rounding: a constant has none
NOISE = 1e-14


def frame(w: int, a: str = "a", t: str = "t"):
    return W.partitionBy(a).orderBy(t).rowsBetween(-(w - 1), 0)


def ordered(a: str = "a", t: str = "t"):
    return W.partitionBy(a).orderBy(t)


def least(w: int) -> int:
    return max(1, math.ceil(0.8 * w - 1e-9))


def gated(value: Column, x: Column, w: int) -> Column:
    return F.when(F.count(x).over(frame(w)) >= least(w), value)


def _of(f: Callable[[Column], Column]) -> Callable[[Column, int], Column]:
    return lambda x, w: gated(f(x).over(frame(w)), x, w)


def wma(x: Column, w: int) -> Column:
    """Weights w (now) to 1 (oldest), over present values alone."""
    t, here = F.col("t"), x.isNotNull().cast("double")
    s = lambda c: F.sum(c).over(frame(w))
    top = (w - t) * s(F.coalesce(x, F.lit(0.0))) + s(F.coalesce(x * t, F.lit(0.0)))
    return gated(F.try_divide(top, (w - t) * s(here) + s(here * t)), x, w)


def _jointly(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


ROLLING: dict[str, Callable[[Column, int], Column]] = {
    "Ref": lambda x, w: F.lag(x, w).over(ordered()),
    "Delta": lambda x, w: x - F.lag(x, w).over(ordered()),
    "Mean": _of(F.avg),
    "Sum": _of(F.sum),
    "Max": _of(F.max),
    "Min": _of(F.min),
    "Med": _of(lambda x: F.percentile(x, F.lit(0.5))),
    "WMA": wma,
}


# --- moments in time that does not depend on w ---------------------------------------------


def with_window_moments(panel: DataFrame, columns: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds for each {name: (x, y, w)} the joint moments of the last w rows: {name}_n, _vx, _vy, _c, centred sums, by rows where both are present.

    An asset's rows are cut into blocks of w.  Any frame is the end of one block and the beginning of the next, so it
    joins a running sum from its block's start with one, lagged, to its block's end: each row is added twice and never taken away,
    which keeps the sums as exact as a sum over the frame would be.  All windows are of one asset, so one shuffle serves them.
    """
    spans = sorted({w for _, _, w in columns.values()})
    place = F.row_number().over(ordered()) - 1
    panel = panel.withColumns({f"_block{w}": F.floor(place / w) for w in spans})
    inner, lagged, out, drop = {}, {}, {}, [f"_block{w}" for w in spans]
    for name, (x, y, w) in columns.items():
        a, b = _jointly(F.col(x).cast("double"), F.col(y).cast("double"))
        ways = {"p": W.partitionBy("a", f"_block{w}").orderBy("t"), "s": W.partitionBy("a", f"_block{w}").orderBy(F.desc("t"))}
        for way, window in ways.items():
            fr = window.rowsBetween(W.unboundedPreceding, 0)
            n = F.count(a).over(fr)
            made = {"n": n, "x": F.avg(a).over(fr), "vx": F.var_pop(a).over(fr) * n}
            if x != y:
                made |= {"y": F.avg(b).over(fr), "vy": F.var_pop(b).over(fr) * n, "c": F.covar_pop(a, b).over(fr) * n}
            inner |= {f"_{name}_{way}_{k}": F.coalesce(v, F.lit(0.0)) for k, v in made.items()}
        keys = ["n", "x", "vx"] + (["y", "vy", "c"] if x != y else [])
        # a frame that is its own block needs no end of another
        other = F.lag(f"_block{w}", w - 1).over(ordered()) < F.col(f"_block{w}")
        lagged |= {f"_{name}_l_{k}": F.coalesce(F.when(other, F.lag(f"_{name}_s_{k}", w - 1).over(ordered())), F.lit(0.0)) for k in keys}
        p, q = (lambda k, name=name, way=way: F.col(f"_{name}_{way}_{k}") for way in ("p", "l"))
        n = p("n") + q("n")
        weight = F.coalesce(F.try_divide(p("n") * q("n"), n), F.lit(0.0))
        dx = p("x") - q("x")

        def spread(v: str, m: str, d: Column) -> Column:
            """Both sums of squares and what lies between the means; what is less than rounding of the mean leaves is none."""
            total = p(v) + q(v) + d * d * weight  # noqa: B023
            noise = F.greatest(F.abs(p(m)), F.abs(q(m))) * NOISE  # noqa: B023
            return F.when(total > n * noise * noise, total).otherwise(0.0)  # noqa: B023

        out[f"{name}_n"] = n
        out[f"{name}_vx"] = spread("vx", "x", dx)
        if x != y:
            dy = p("y") - q("y")
            out[f"{name}_vy"] = spread("vy", "y", dy)
            out[f"{name}_c"] = p("c") + q("c") + dx * dy * weight
        drop += [f"_{name}_{way}_{k}" for way in ("p", "s", "l") for k in keys]
    return panel.withColumns(inner).withColumns(lagged).withColumns(out).drop(*drop)


def _enough_pairs(name: str, w: int) -> Column:
    return F.col(f"{name}_n") >= max(2, least(w))


def _spread(root: bool) -> Callable[[str, int], Column]:
    def op(name: str, w: int) -> Column:
        v = F.try_divide(F.col(f"{name}_vx"), F.col(f"{name}_n") - 1)
        v = F.sqrt(v) if root else v
        return F.when(_enough_pairs(name, w) & (F.abs(v) >= FLAT), v)

    return op


#: operators on the moments of a frame, by the moments' name and w; a correlation with a constant is missing
MOMENTS: dict[str, Callable[[str, int], Column]] = {
    "Var": _spread(False),
    "Std": _spread(True),
    "Cov": lambda name, w: F.when(_enough_pairs(name, w), F.try_divide(F.col(f"{name}_c"), F.col(f"{name}_n") - 1)),
    "Corr": lambda name, w: F.when(_enough_pairs(name, w), F.try_divide(F.col(f"{name}_c"), F.sqrt(F.col(f"{name}_vx")) * F.sqrt(F.col(f"{name}_vy")))),
}


def with_moments(panel: DataFrame, columns: dict[str, tuple[str, str, str, int]]) -> DataFrame:
    """Adds {name: (operator, x, y, w)} of MOMENTS (y = x for those of one input); equal inputs and frames share their moments."""
    shared: dict[tuple[str, str, int], str] = {}
    for _, x, y, w in columns.values():
        shared.setdefault((x, y, w), f"_m{len(shared)}")
    # a correlation of a column with itself needs both sides: as a copy
    own = {name: (x, y, w) for (x, y, w), name in shared.items()}
    panel = with_window_moments(panel, own)
    made = {}
    for name, (op, x, y, w) in columns.items():
        m = shared[x, y, w]
        if x == y and op in ("Cov", "Corr"):
            panel = panel.withColumns({f"{m}_vy": F.col(f"{m}_vx"), f"{m}_c": F.col(f"{m}_vx")})
        made[name] = MOMENTS[op](m, w)
    return panel.withColumns(made).drop(*[f"{m}_{k}" for m in shared.values() for k in ("n", "vx", "vy", "c")])


def _frames(x: np.ndarray, w: int) -> np.ndarray:
    """The w values up to each place, missing before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(w - 1, np.nan), x]), w)


def _enough(x: np.ndarray, w: int, out: np.ndarray) -> np.ndarray:
    return np.where((~np.isnan(_frames(x, w))).sum(1) >= least(w), out, np.nan)


def ema(x: np.ndarray, w: int) -> np.ndarray:
    """Exponential mean, recursive from the first value, decaying over gaps."""
    return pd.Series(x).ewm(span=w, adjust=False, min_periods=least(w)).mean().to_numpy()


def mad(x: np.ndarray, w: int) -> np.ndarray:
    """Median of the absolute deviations from the frame's median."""
    f = _frames(x, w)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # frames without any value
        return _enough(x, w, np.nanmedian(np.abs(f - np.nanmedian(f, axis=1)[:, None]), axis=1))


def ts_rank(x: np.ndarray, w: int) -> np.ndarray:
    """Average rank of the current value in its frame, over the present values' number; missing where the value is."""
    f, now = _frames(x, w), x[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        rank = ((f < now).sum(1) + ((f == now).sum(1) + 1) / 2) / (~np.isnan(f)).sum(1)
    return np.where(np.isnan(x), np.nan, _enough(x, w, rank))


#: operators that frames of Spark would compute by building a list for each row: vectorised over one asset's series instead
SERIES: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"EMA": ema, "Mad": mad, "TSRank": ts_rank}


def with_series(panel: DataFrame, columns: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds {name: (operator, input, w)}; one grouped call for each asset on (a, t, inputs) alone, whose rows are bounded by the calendar."""
    inputs = list(dict.fromkeys(x for _, x, _ in columns.values()))
    schema = StructType([panel.schema["a"], panel.schema["t"], *(StructField(name, DoubleType()) for name in columns)])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        x = {c: rows[c].to_numpy(float) for c in inputs}
        return pd.DataFrame({"a": rows["a"], "t": rows["t"]} | {name: SERIES[op](x[c], w) for name, (op, c, w) in columns.items()})

    narrow = panel.select("a", "t", *[F.col(x).cast("double").alias(x) for x in inputs])
    return panel.join(narrow.groupBy("a").applyInPandas(one, schema), ["a", "t"], "left")


# --- derived series --------------------------------------------------------------------


def forward_return(r: Column, first: int = 2, last: int = 21) -> Column:
    """Compounded return of rows t + first to t + last; missing unless all are present."""
    fr = ordered().rowsBetween(first, last)
    return F.when(F.count(r).over(fr) == last - first + 1, F.product(1 + r).over(fr) - 1)


def compounded(r: Column, first: int, last: int) -> Column:
    """expm1 of the summed log1p over rows t + first to t + last, all required."""
    fr = ordered().rowsBetween(first, last)
    return F.when(F.count(r).over(fr) == last - first + 1, F.expm1(F.sum(F.when(r > -1, F.log1p(r))).over(fr)))


def amihud(r: Column, close: Column, volume: Column, w: int = 20, needed: int = 15) -> Column:
    x = F.abs(r) / (F.abs(close * volume) + 1e-12)
    return F.when(F.count(x).over(frame(w)) >= needed, F.log(F.avg(x).over(frame(w))))


def with_market_model(panel: DataFrame, r: str, m: str, w: int, needed: int, slope: str = "slope", spread: str = "spread") -> DataFrame:
    """Adds slope and residual deviation (ddof 1) of one regression of r on m with intercept over the last w rows, where at least `needed` have both."""
    panel = with_window_moments(panel, {"_mm": (m, r, w)})
    n, vx, vy, c = (F.col(f"_mm_{k}") for k in ("n", "vx", "vy", "c"))
    b = F.when((n >= needed) & (vx > FLAT), F.try_divide(c, vx))
    rest = F.when(b.isNotNull(), F.sqrt(F.greatest(F.try_divide(vy - b * c, n - 1), F.lit(0.0))))
    return panel.withColumns({slope: b, spread: rest}).drop("_mm_n", "_mm_vx", "_mm_vy", "_mm_c")


def drawdown(df: DataFrame, r: str, out: str) -> DataFrame:
    """Adds wealth relative to its highest value so far, the start (1) included, minus 1; all in logarithms, so long paths keep their precision.

    Missing returns count as 0; a path ends in null where a return is under -1.
    """
    so_far = ordered().rowsBetween(W.unboundedPreceding, 0)
    x = F.coalesce(F.col(r), F.lit(0.0))
    df = df.withColumn("_w", F.when(F.min(x).over(so_far) > -1, F.sum(F.log1p(F.when(x > -1, x))).over(so_far)))
    return df.withColumn(out, F.expm1(F.col("_w") - F.greatest(F.lit(0.0), F.max("_w").over(so_far)))).drop("_w")


def growth(x: Column, key: str, order: str) -> Column:
    """x over its previous value in its key, minus 1; both must be positive."""
    before = F.lag(x).over(W.partitionBy(key).orderBy(order))
    return F.when((x > 0) & (before > 0), x / before - 1)


__all__ = ["MOMENTS", "ROLLING", "SERIES", "amihud", "compounded", "drawdown", "finite", "forward_return", "frame", "growth", "least", "ordered", "with_market_model", "with_moments", "with_series", "with_window_moments"]
