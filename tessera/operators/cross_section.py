"""Cross-sectional operators: Columns over the rows of one date."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions import clip

FLAT = 1e-12


def day(*more: str):
    return W.partitionBy("t", *more)


def cs_rank(x: Column, mask: Column) -> Column:
    """Average rank over the number of eligible present values of the date."""
    own = F.when(mask, x)
    rank = F.rank().over(W.partitionBy("t").orderBy(own.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(W.partitionBy("t", own))
    return F.when(own.isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(own).over(day()))


def cs_zscore(x: Column, mask: Column, tiny: float = 0.0) -> Column:
    """(x - mean) / deviation (ddof 0) of the date's eligible values."""
    own = F.when(mask, x)
    sd = F.stddev_pop(own).over(day())
    return F.when(sd > tiny, (own - F.avg(own).over(day())) / sd)


def winsor(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """x within two linearly interpolated quantiles of its date."""
    q = lambda p: F.percentile(x, F.lit(p)).over(day())
    return clip(x, q(low), q(high))


def standardize(df: DataFrame, x: str, out: str, mask: Column) -> DataFrame:
    """Winsorised at 1 and 99 %, then z-scored (ddof 0)."""
    return df.withColumn(out, winsor(F.when(mask, F.col(x)))).withColumn(out, cs_zscore(F.col(out), F.lit(True), FLAT))


def prepare_exposure(df: DataFrame, x: str, out: str, mask: Column) -> DataFrame:
    """Winsorised, missing set to the median, z-scored; all zeros on dates with too few values or no spread."""
    n, members = F.count(F.when(mask, F.col(x))).over(day()), F.count_if(mask).over(day())
    enough = n >= F.greatest(F.lit(3), F.least(F.lit(30), F.floor(members / 4)))
    df = df.withColumns({"_w": winsor(F.when(mask, F.col(x))), "_ok": enough})
    df = df.withColumn("_f", F.when(mask, F.coalesce("_w", F.percentile("_w", F.lit(0.5)).over(day()))))
    sd = F.stddev_pop("_f").over(day())
    z = F.when(mask, F.when(F.col("_ok") & (sd > FLAT), (F.col("_f") - F.avg("_f").over(day())) / sd).otherwise(0.0))
    return df.withColumn(out, z).drop("_w", "_f", "_ok")


#: what a date's solve was like: rows, rank and condition of the exposures with intercept, and the largest mean product of an exposure with a residual
SOLVED = ("solve_rows", "solve_rank", "solve_condition", "solve_worst")


def solved_day(risk: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Residuals of the columns of y on those of risk and a constant, NaN where either is missing, and the worst of what SOLVED names."""
    there = ~np.isnan(y) & ~np.isnan(risk).any(axis=1)[:, None]
    out = np.full(y.shape, np.nan)
    supports: dict[bytes, list[int]] = {}
    seen = [np.nan] * 4
    for k in range(y.shape[1]):
        supports.setdefault(there[:, k].tobytes(), []).append(k)
    for own in supports.values():
        use = there[:, own[0]]
        design = np.column_stack([np.ones(int(use.sum())), risk[use]])
        if len(design) <= design.shape[1]:
            continue
        q, r = np.linalg.qr(design)
        b = y[np.ix_(use, own)]
        s = np.linalg.svd(r, compute_uv=False)
        bad = s[-1] <= s[0] * max(design.shape) * np.finfo(float).eps or s[0] > 1e12 * s[-1]
        beta = np.linalg.solve(design.T @ design + 1e-10 * np.eye(design.shape[1]), design.T @ b) if bad else np.linalg.solve(r, q.T @ b)
        out[np.ix_(use, own)] = b - design @ beta
        worst = float(np.abs(design.T @ (b - design @ beta)).max() / len(design))
        found = (len(design), int((s > s[0] * max(design.shape) * np.finfo(float).eps).sum()), float(s[0] / s[-1]) if s[-1] > 0 else np.inf, worst)
        seen = [pick((x, v)) if not np.isnan(x) else v for pick, x, v in zip((min, min, max, max), seen, found, strict=True)]
    return out, seen


def residuals(df: DataFrame, targets: list[str], exposures: list[str], mask: Column, diagnose: bool = False) -> DataFrame:
    """OLS residuals `<target>_res` of all targets on the exposures (with intercept), date by date.

    One grouped call for each date, on the columns that it needs; targets that are present on the same rows share one factorisation.
    A ridge of 1e-10 steps in when the exposures are
    rank-deficient or their condition exceeds 1e12; dates with no more rows than columns get nulls.
    With `diagnose`, the same pass adds the columns SOLVED, equal on all rows of a date (the worst of its solves).
    """
    more = SOLVED if diagnose else ()
    schema = StructType([df.schema["a"], df.schema["t"], *(StructField(f"{x}_res", DoubleType()) for x in targets), *(StructField(x, DoubleType()) for x in more)])
    rows = df.where(F.coalesce(mask, F.lit(False))).select("a", "t", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*targets, *exposures])])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        out, seen = solved_day(part[exposures].to_numpy(float), part[targets].to_numpy(float))
        return pd.DataFrame({"a": part["a"], "t": part["t"]} | {f"{x}_res": out[:, k] for k, x in enumerate(targets)} | dict(zip(more, seen, strict=False)))

    solved = rows.groupBy("t").applyInPandas(one, schema)
    solved = solved.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (*(f"{x}_res" for x in targets), *more)})
    return df.join(solved, ["a", "t"], "left")


def solve_diagnostics(solved: DataFrame) -> DataFrame:
    """One row for each date of what residuals(diagnose=True) gave: t and SOLVED."""
    return solved.where(F.col(SOLVED[0]).isNotNull()).groupBy("t").agg(*[F.max(c).alias(c) for c in SOLVED])


def neutral_violations(diagnostics: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Dates on which a residual is still exposed."""
    return diagnostics.where(F.col("solve_worst") >= tolerance)


def assert_neutral(diagnostics: DataFrame, tolerance: float = 1e-8) -> None:
    """Raises with the first few dates on which a residual is still exposed."""
    if bad := neutral_violations(diagnostics, tolerance).orderBy("t").take(3):
        raise ValueError(f"exposures of {tolerance} or more remain: {[(r.t, r.solve_worst) for r in bad]}")


def risk_gates(df: DataFrame, diagnostics: DataFrame, exposures: list[str], member: Column, formal: Column, most: float = 1e8, cover: float = 0.999) -> DataFrame:
    """One row for each hard gate of a risk model: gate, failures, value, passed.

    On the formal dates every solve has full rank and a condition of at most `most`, and members have all exposures at the rate `cover`.
    """
    days = df.where(formal).select("t").distinct().join(diagnostics, "t")
    full = len(exposures) + 1
    worst = days.agg(F.count_if(F.col("solve_rank") < full).alias("rank"), F.count_if(~(F.col("solve_condition") <= most)).alias("condition"), F.max("solve_condition").alias("top"), F.min("solve_rank").alias("low"))
    whole = F.lit(True)
    for e in exposures:
        whole = whole & F.col(e).isNotNull()
    share = df.where(formal & member).agg(F.avg(whole.cast("double")).alias("rate"), F.count_if(~whole).alias("missing"))
    cells = (("rank", F.col("rank"), F.col("low"), F.col("rank") == 0), ("condition", F.col("condition"), F.col("top"), F.col("condition") == 0), ("coverage", F.col("missing"), F.col("rate"), F.coalesce(F.col("rate") >= cover, F.lit(False))))
    return worst.join(F.broadcast(share)).select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), n.cast("long").alias("failures"), v.cast("double").alias("value"), ok.alias("passed")) for g, n, v, ok in cells])))


def combine(columns: dict[str, float]) -> tuple[Column, Column]:
    """Weighted sum with missing as 0, never renormalised; and whether any weighted value is present."""
    total, here = F.lit(0.0), F.lit(False)
    for name, w in columns.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
        here = here | (F.col(name).isNotNull() & F.lit(w != 0))
    return total, here


def buckets(score: Column, share: float = 0.2, fewest: int = 10) -> Column:
    """Dollar-neutral weights: +0.5/k for the top k and -0.5/k for the bottom k of a date; flat under 10 names."""
    n = F.count(score).over(day())
    k = F.greatest(F.lit(1), F.floor(n * share))
    rn = F.row_number().over(W.partitionBy("t").orderBy(score.asc_nulls_last(), F.col("a")))
    return F.when(score.isNotNull(), F.when((n >= fewest) & (rn > n - k), F.lit(0.5) / k).when((n >= fewest) & (rn <= k), F.lit(-0.5) / k).otherwise(0.0))


# --- transforms of factors for the pool -------------------------------------------------------


def _zscore_day(x: np.ndarray, tiny: float = FLAT) -> np.ndarray:
    """The columns' z-scores (ddof 0) over present values; missing throughout where the deviation is no more than `tiny`."""
    out = np.full(x.shape, np.nan)
    for k, v in enumerate(x.T):
        own = v[~np.isnan(v)]
        if len(own) and (sd := own.std()) > tiny:
            out[:, k] = (v - own.mean()) / sd
    return out


def _standardize_day(x: np.ndarray, low: float = 0.01, high: float = 0.99) -> np.ndarray:
    """The columns winsorised, then z-scored."""
    x = x.copy()
    for v in x.T:
        if len(own := v[~np.isnan(v)]):
            np.clip(v, *np.quantile(own, [low, high]), out=v)
    return _zscore_day(x)


def own_day(x: np.ndarray, base: np.ndarray, risk: np.ndarray | None, restandardize: bool = True) -> np.ndarray:
    """own_transform() of one date: factors (columns of x, NaN where missing), base rows and exposures."""
    base = base if risk is None else base & ~np.isnan(risk).any(axis=1)
    x = _standardize_day(np.where(base[:, None], x, np.nan))
    if risk is not None:
        x = solved_day(risk, x)[0]
        x = _zscore_day(x) if restandardize else x
    return x


def universe_day(x: np.ndarray, y: np.ndarray, base: np.ndarray, risk: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fixed_universe() of one date: factors, label and the universe."""
    rows = base & ~np.isnan(y)
    rows = rows if risk is None else rows & ~np.isnan(risk).any(axis=1)
    y = _standardize_day(np.where(rows, y, np.nan)[:, None])[:, 0]
    metric = rows & ~np.isnan(y)
    x = np.where(metric[:, None], np.where(np.isnan(x), 0.0, x), np.nan)
    if risk is not None:
        solved = solved_day(risk, np.column_stack([x, y]))[0]
        x, y = solved[:, :-1], solved[:, -1]
        metric = metric & ~np.isnan(y)
    return np.where(metric[:, None], x, np.nan), np.where(metric, y, np.nan), metric


def matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    """Columns of an Arrow table as doubles; NaN where missing."""
    return np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in names]) if names else np.zeros((table.num_rows, 0))


def _by_day(df: DataFrame, base: Column, reads: list[str], writes: dict[str, pa.DataType], one: Callable[[pa.Table, np.ndarray], list[np.ndarray]], keep: list[str] | None = None) -> DataFrame:
    """Every row with the columns `writes` set by a call for each date, which gets the date's table and its base rows.

    The rows pass through that call as they are, so a frame is made and shuffled once, and never joined with what was found for it.
    With `keep`, rows come back with these columns and `writes` alone, and what the call reads besides them is shuffled for base rows only.
    """
    base = F.coalesce(base, F.lit(False))
    kept = [c for c in (df.columns if keep is None else keep) if c not in writes]
    more = [c for c in dict.fromkeys(reads) if c not in kept]
    own = df.select(*kept, *[(F.col(c) if keep is None else F.when(base, F.col(c))).cast("double").alias(c) for c in more], base.alias("_in_base"), *([] if "t" in kept else ["t"]))
    kinds = {f.name: f for f in df.schema}
    schema = StructType([kinds[c] if c in kept else StructField(c, DoubleType() if pa.types.is_floating(writes[c]) else BooleanType()) for c in dict.fromkeys([*(df.columns if keep is None else keep), *writes])])

    def day(keys, table):
        made = one(table, table.column("_in_base").to_numpy(zero_copy_only=False).astype(bool))
        found = {c: pa.array(v, kind, mask=np.isnan(v)) if pa.types.is_floating(kind) else pa.array(v, kind) for (c, kind), v in zip(writes.items(), made, strict=True)}
        return pa.table({f.name: found[f.name] if f.name in found else table.column(f.name) for f in schema})

    return own.groupBy("t").applyInArrow(day, schema)


def own_transform(df: DataFrame, factors: list[str], base: Column, exposures: list[str] | None = None, restandardize: bool = True) -> DataFrame:
    """Each factor on its own rows: standardised where it and the base (with present exposures) are there, residualised on the exposures, z-scored again.

    A factor that is missing or constant on a date is missing there and takes nothing from the others. Results replace the columns.
    """

    def one(table, rows):
        return list(own_day(matrix(table, factors), rows, matrix(table, exposures) if exposures else None, restandardize).T)

    return _by_day(df, base, [*factors, *(exposures or [])], dict.fromkeys(factors, pa.float64()), one)


def own_combined(df: DataFrame, weights: dict[str, float], base: Column, exposures: list[str] | None, out: str, keep: list[str] | None = None) -> DataFrame:
    """Adds the weighted sum of the factors as own_transform() gives them: base rows with a weighted factor, on which missing ones count as 0."""
    factors, w = list(weights), list(weights.values())

    def one(table, rows):
        x = own_day(matrix(table, factors), rows, matrix(table, exposures) if exposures else None)
        total, here = np.zeros(len(x)), np.zeros(len(x), bool)
        for v, weight in zip(x.T, w, strict=True):
            total = total + np.where(np.isnan(v), 0.0, v) * weight
            here |= ~np.isnan(v) & (weight != 0)
        return [np.where(rows & here, total, np.nan)]

    return _by_day(df, base, [*factors, *(exposures or [])], {out: pa.float64()}, one, keep)


def fixed_universe(df: DataFrame, factors: list[str], label: str, base: Column, exposures: list[str] | None = None, metric: str = "metric") -> DataFrame:
    """Factors and label on one universe: base rows with a label (and exposures), standardised label, missing factors as 0, all residualised together.

    Adds the universe as `metric`; outside it factors and label are null. Dates with no more rows than exposure columns drop out.
    """

    def one(table, rows):
        x, y, here = universe_day(matrix(table, factors), matrix(table, [label])[:, 0], rows, matrix(table, exposures) if exposures else None)
        return [*x.T, y, here]

    return _by_day(df, base, [*factors, label, *(exposures or [])], dict.fromkeys([*factors, label], pa.float64()) | {metric: pa.bool_()}, one)


def neutral_day(x: np.ndarray, y: np.ndarray, base: np.ndarray, risk: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both one after the other on one date."""
    return universe_day(own_day(x, base, risk), y, base, risk)


def neutral_inputs(df: DataFrame, factors: list[str], label: str, base: Column, exposures: list[str] | None = None, metric: str = "metric") -> DataFrame:
    """own_transform() and fixed_universe() in one call for each date."""

    def one(table, rows):
        x, y, here = neutral_day(matrix(table, factors), matrix(table, [label])[:, 0], rows, matrix(table, exposures) if exposures else None)
        return [*x.T, y, here]

    return _by_day(df, base, [*factors, label, *(exposures or [])], dict.fromkeys([*factors, label], pa.float64()) | {metric: pa.bool_()}, one)


def joint_transform(df: DataFrame, factors: list[str], label: str, mask: Column) -> DataFrame:
    """The older form: only rows where all factors and the label are there, each standardised on them."""
    rows = F.coalesce(mask, F.lit(False)) & F.col(label).isNotNull()
    for f in factors:
        rows = rows & F.col(f).isNotNull()
    df = df.withColumn("_rows", rows)
    for c in [*factors, label]:
        df = standardize(df, c, c, F.col("_rows"))
    return df.drop("_rows")
