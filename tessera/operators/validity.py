"""Gates for candidate signals: coverage, valid days, variability, near-duplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import NO_SPREAD

#: deviation of all days together up to which a column is constant
POOLED_FLAT = 1e-12


def gates(panel: DataFrame, signals: list[str], member: Column, min_assets: int = 100, min_days: int = 252, coverage: float = 0.8, variable: float = 0.8, flat: float = 1e-12) -> DataFrame:
    """signal, coverage, valid_days, variable_rate, status of a whole batch: two aggregations."""
    own = panel.where(member)
    by = own.groupBy("t").agg(F.count("*").alias("n"), *[x for s in signals for x in (F.count(s).alias(f"n_{s}"), F.var_pop(s).alias(f"v_{s}"))])
    valid = lambda s: F.col(f"n_{s}") >= min_assets
    one = by.agg(*[F.struct(F.lit(s).alias("signal"), (F.sum(f"n_{s}") / F.sum("n")).alias("coverage"), F.count_if(valid(s)).alias("valid_days"), F.try_divide(F.count_if(valid(s) & (F.col(f"v_{s}") > flat)), F.count_if(valid(s))).alias("variable_rate")).alias(f"s{k}") for k, s in enumerate(signals)])
    rows = one.select(F.inline(F.array(*[f"s{k}" for k in range(len(signals))])))
    return rows.withColumn("status", _status(min_days, coverage, variable))


def _status(min_days: int, coverage: float, variable: float) -> Column:
    return F.when(F.col("coverage") < coverage, "coverage_failure").when(F.col("valid_days") < min_days, "insufficient_valid_days").when(F.coalesce("variable_rate", F.lit(0.0)) < variable, "near_constant").otherwise("valid")


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties share their mean."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(x) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (sizes + 1) / 2, sizes)
    return out


def _correlate(left: np.ndarray, right: np.ndarray, fewest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Correlations of columns with columns without gaps, and centred sums: vx, vy, c."""
    a, b = left - left.mean(axis=0), right - right.mean(axis=0)
    vx, vy, c = (a * a).sum(axis=0)[:, None] + np.zeros(b.shape[1]), (b * b).sum(axis=0)[None, :] + np.zeros((a.shape[1], 1)), a.T @ b
    ok = (len(left) >= fewest) & (vx > NO_SPREAD) & (vy > NO_SPREAD)
    return np.where(ok, c / np.sqrt(np.where(ok, vx * vy, 1.0)), np.nan), vx, vy, c


def day_pairs(x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """All pairs of signals (columns of x) and pool members (of y) on one day, each on the names that both have, and how often a column was ranked.

    Pairs fall into groups by the names that they share.  Within a group each column is ranked once, and the pairs are
    matrix products; without gaps there is one group, and as many rankings as columns.
    """
    has_x, has_y = np.isfinite(x), np.isfinite(y)
    shape = (x.shape[1], y.shape[1])
    out = {k: np.full(shape, np.nan) for k in ("corr", "ranked")} | {k: np.zeros(shape) for k in ("n", "mx", "my", "vx", "vy", "c")}
    packed_x, packed_y = np.packbits(has_x.T, axis=1), np.packbits(has_y.T, axis=1)
    groups: dict[bytes, list[tuple[int, int]]] = {}
    for i in range(shape[0]):
        for j in range(shape[1]):
            groups.setdefault((packed_x[i] & packed_y[j]).tobytes(), []).append((i, j))
    ranked = 0
    for support, pairs in groups.items():
        rows = np.unpackbits(np.frombuffer(support, np.uint8))[: len(x)].astype(bool)
        n = int(rows.sum())
        if not n:
            continue
        i, j = (np.array(sorted({p[k] for p in pairs})) for k in (0, 1))
        left, right = x[np.ix_(rows, i)], y[np.ix_(rows, j)]
        corr, vx, vy, c = _correlate(left, right)
        ranks, *_ = _correlate(np.column_stack([average_ranks(v) for v in left.T]), np.column_stack([average_ranks(v) for v in right.T]))
        ranked += len(i) + len(j)
        at_i, at_j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        from_i, from_j = np.searchsorted(i, at_i), np.searchsorted(j, at_j)
        for k, v in (("corr", corr), ("ranked", ranks), ("vx", vx), ("vy", vy), ("c", c)):
            out[k][at_i, at_j] = v[from_i, from_j]
        out["n"][at_i, at_j] = n
        out["mx"][at_i, at_j], out["my"][at_i, at_j] = left.mean(axis=0)[from_i], right.mean(axis=0)[from_j]
    return out, ranked


_DAY = "t int, k int, enough boolean, n double, mx double, my double, vx double, vy double, c double, corr double, ranked double"
_PAIR = "k int, daily double, pooled double, ranked double, corr_coverage double"


_PAIRED = ("n", "mx", "my", "vx", "vy", "c", "corr", "ranked")


def _pair_row(v: dict[str, np.ndarray]) -> tuple[float, float, float, float]:
    """daily, pooled, ranked and corr_coverage of a pair from its days."""
    enough, (n, mx, my, vx, vy, c, corr, ranked) = v["enough"].astype(bool), (v[k] for k in _PAIRED)
    mean = lambda v: float(np.nanmean(np.abs(v[enough]))) if np.isfinite(v[enough]).any() else 0.0
    total, pooled = n.sum(), 0.0
    if total:
        dx, dy = mx - n @ mx / total, my - n @ my / total
        sx, sy, sxy = float(vx.sum() + n @ (dx * dx)), float(vy.sum() + n @ (dy * dy)), float(c.sum() + n @ (dx * dy))
        if (sx / total) ** 0.5 > POOLED_FLAT and (sy / total) ** 0.5 > POOLED_FLAT:
            pooled = abs(sxy / (sx * sy) ** 0.5)
    return mean(corr), pooled, mean(ranked), float(np.isfinite(corr[enough]).sum() / max(1, enough.sum()))


def redundancy(panel: DataFrame, signals: list[str], pool: list[str], member: Column, min_assets: int = 100) -> DataFrame:
    """For each signal and pool member: mean absolute daily correlation, absolute pooled correlation, mean absolute daily rank correlation,
    the largest of them, and the share of the signal's valid days that have a daily correlation. Missing ones count as 0.

    A day's cross-section gives all its pairs at once (day_pairs), then a pair's days, as many as the calendar has, give its row: the
    panel is shuffled once and no row of it is repeated for a pair.  Days of fewer than `min_assets` present values of the signal
    count for the pooled correlation alone.
    """
    names = list(dict.fromkeys([*signals, *pool]))
    own = panel.where(member).select(F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in names])
    pairs = [(s, m) for s in signals for m in pool]

    def day(keys, table):
        x, y = (np.column_stack([table.column(c).to_numpy() for c in cols]) for cols in (signals, pool))
        found, _ = day_pairs(x, y)
        enough = np.repeat(np.isfinite(x).sum(axis=0) >= min_assets, len(pool))
        cols = [pa.array(np.full(len(pairs), keys[0].as_py(), np.int32)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(enough)]
        cols += [pa.array(found[k].ravel(), mask=np.isnan(found[k].ravel())) for k in _PAIRED]
        return pa.Table.from_arrays(cols, names=[f.split()[0] for f in _DAY.split(", ")])

    def pair(keys, table):
        found = _pair_row({k: table.column(k).to_numpy(zero_copy_only=False) for k in ("enough", *_PAIRED)})
        return pa.table({"k": pa.array([keys[0].as_py()], pa.int32())} | {k: [v] for k, v in zip(("daily", "pooled", "ranked", "corr_coverage"), found, strict=True)})

    rows = own.groupBy("t").applyInArrow(day, _DAY).groupBy("k").applyInArrow(pair, _PAIR)
    named = F.element_at(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(m).alias("member")) for s, m in pairs]), F.col("k") + 1)
    return rows.withColumn("n", named).select("n.*", "daily", "pooled", "corr_coverage", "ranked", F.greatest("daily", "pooled", "ranked").alias("strongest"))


def _variance(x: np.ndarray) -> float | None:
    return float(x.var()) if len(x) else None


def scores(panel: DataFrame, signals: list[str], pool: list[str], label: str, member: Column, min_assets: int = 100, min_days: int = 252, coverage: float = 0.8, variable: float = 0.8, flat: float = 1e-12) -> DataFrame:
    """What daily_spearman() with the label, redundancy() and gates() say of each signal: ic and ir of its daily rank correlations, corr, the
    strongest of its correlations with the pool, coverage, valid_days, variable_rate and status.

    A date's rows give all of it in one call, and a signal's days, as many as the calendar has, its row: member rows are shuffled once.
    """
    names = list(dict.fromkeys([*signals, *pool, label]))
    own = panel.where(member).select("t", *[F.col(c).cast("double").alias(c) for c in names])
    paired = ", ".join(f"{k} array<double>" for k in _PAIRED)
    daily = f"k int, rows long, present long, spread double, rank_ic double, {paired}"
    lists = pa.list_(pa.float64())

    def day(keys, table):
        has = {c: table.column(c).is_valid().to_numpy(zero_copy_only=False) for c in names}
        col = {c: table.column(c).to_numpy() for c in names}
        found, _ = day_pairs(np.column_stack([col[c] for c in signals]), np.column_stack([col[c] for c in pool])) if pool else ({k: np.zeros((len(signals), 0)) for k in _PAIRED}, 0)
        rank_ic = []
        for s in signals:
            both = has[s] & has[label]
            value = float(_correlate(average_ranks(col[s][both])[:, None], average_ranks(col[label][both])[:, None])[0][0, 0]) if both.any() else np.nan
            rank_ic.append(None if np.isnan(value) else value)
        cols = [pa.array(np.arange(len(signals), dtype=np.int32)), pa.array([table.num_rows] * len(signals), pa.int64()), pa.array([int(has[s].sum()) for s in signals], pa.int64()), pa.array([_variance(col[s][has[s]]) for s in signals], pa.float64()), pa.array(rank_ic, pa.float64())]
        return pa.Table.from_arrays([*cols, *[pa.array(list(found[k]), lists) for k in _PAIRED]], names=[f.split()[0] for f in daily.split(", ")])

    def signal(keys, table):
        rows, present, spread, rank_ic = (table.column(c).to_numpy().astype(float) for c in ("rows", "present", "spread", "rank_ic"))
        valid, ic = present >= min_assets, rank_ic[~np.isnan(rank_ic)]
        by = {k: np.array(table.column(k).to_pylist(), float).reshape(table.num_rows, len(pool)) for k in _PAIRED}
        strongest = max((max(_pair_row({k: v[:, j] for k, v in by.items()} | {"enough": valid})[:3]) for j in range(len(pool))), default=None)
        ir = float(ic.mean() / ic.std()) if len(ic) and ic.std() else None
        one = {"k": keys[0].as_py(), "ic": float(ic.mean()) if len(ic) else None, "ir": ir, "corr": strongest, "coverage": float(present.sum() / rows.sum()), "valid_days": int(valid.sum()), "variable_rate": float((~(spread[valid] <= flat)).mean()) if valid.any() else None}
        return pa.Table.from_pylist([one], schema=final)

    final = pa.schema([("k", pa.int32()), ("ic", pa.float64()), ("ir", pa.float64()), ("corr", pa.float64()), ("coverage", pa.float64()), ("valid_days", pa.int64()), ("variable_rate", pa.float64())])
    found = own.groupBy("t").applyInArrow(day, daily).groupBy("k").applyInArrow(signal, "k int, ic double, ir double, corr double, coverage double, valid_days long, variable_rate double")
    named = F.element_at(F.array(*map(F.lit, signals)), F.col("k") + 1)
    return found.select(named.alias("signal"), "ic", "ir", "corr", "coverage", "valid_days", "variable_rate").withColumn("status", _status(min_days, coverage, variable))


def validate(panel: DataFrame, signals: list[str], pool: list[str], member: Column, most: float = 0.95, min_assets: int = 100, **limits) -> DataFrame:
    """The gates of every signal; those that pass them, and only those, are compared with the pool.

    Adds the strongest pool member with its correlations; above `most` the status is near_duplicate_signal.
    """
    first = gates(panel, signals, member, min_assets=min_assets, **limits)
    passed = [r.signal for r in first.where("status = 'valid'").select("signal").collect()]  # one row for each signal
    empty = "signal string, member string, daily double, pooled double, corr_coverage double, ranked double, strongest double"
    found = redundancy(panel, passed, pool, member, min_assets) if passed and pool else panel.sparkSession.createDataFrame([], empty)
    best = found.groupBy("signal").agg(F.max_by(F.struct("member", "daily", "pooled", "ranked", "strongest"), F.struct("strongest", *[(-F.when(F.col("member") == m, k).otherwise(0)) for k, m in enumerate(pool)])).alias("b")).select("signal", "b.*")
    out = first.join(best, "signal", "left")
    return out.withColumn("status", F.when(F.col("strongest") > most, "near_duplicate_signal").otherwise(F.col("status")))
