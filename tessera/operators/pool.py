"""Pools of factors scored from daily sufficient statistics.

One aggregation of the panel gives, for each day, the means of the factors, of their products and of
their products with the label on the fixed universe (missing factors count as 0, rows are never dropped).  A ridge
composite's weights, its daily correlation with the label, walk-forward folds, additions and deletions of factors all
follow from these few numbers for each day, so the panel is read once however many pools are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEWEST, NO_SPREAD = 3, 1e-24
#: a composite whose variance is this small a share of its mean square is constant
FLAT_SHARE = 1e-12


def daily_statistics(df: DataFrame, factors: list[str], label: str, universe: Column, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """One row for each day: n, the label's mean y and variance vy, and for factors i <= j means s{i}, means of products p{i} (label) and g{i}_{j},
    and covariances with the label c{i}.  Variances and covariances of the label are centred, so a constant label has none."""
    z = [F.coalesce(F.col(f), F.lit(0.0)) for f in factors]
    y = F.col(label)
    own = df.where(F.coalesce(universe, F.lit(False)) & y.isNotNull())
    sums = [F.count("*").alias("n"), F.avg(y).alias("y"), F.var_pop(y).alias("vy")]
    for i, a in enumerate(z):
        sums += [F.avg(a).alias(f"s{i}"), F.avg(a * y).alias(f"p{i}"), F.covar_pop(a, y).alias(f"c{i}")]
        sums += [F.avg(a * b).alias(f"g{i}_{j}") for j, b in enumerate(z) if j >= i]
    return own.groupBy(*keys).agg(*sums)


def composite_ic(weights: list[float]) -> Column:
    """Daily correlation of the weighted sum with the label, from daily_statistics(); a constant sum against a varying label counts as 0."""
    w = [float(x) for x in weights]
    total = lambda terms: sum(terms, F.lit(0.0))
    mean = total(F.lit(a) * F.col(f"s{i}") for i, a in enumerate(w))
    square = total(F.lit(a * b * (1 if i == j else 2)) * F.col(f"g{i}_{j}") for i, a in enumerate(w) for j, b in enumerate(w) if j >= i)
    vx, vy = square - mean * mean, F.col("vy")
    cov = total(F.lit(a) * F.col(f"c{i}") for i, a in enumerate(w))
    flat = (vx * F.col("n") <= NO_SPREAD) | (vx <= FLAT_SHARE * square)
    return F.when((F.col("n") >= FEWEST) & (vy * F.col("n") > NO_SPREAD), F.when(flat, 0.0).otherwise(F.try_divide(cov, F.sqrt(F.when(~flat, vx) * vy))))


@dataclass(frozen=True)
class Moments:
    """Day-equal means over days with enough rows."""

    gram: np.ndarray
    predictive: np.ndarray
    days: int

    def part(self, own: list[int]) -> Moments:
        return Moments(self.gram[np.ix_(own, own)], self.predictive[own], self.days)

    def spectrum(self) -> tuple[float, float]:
        """Smallest eigenvalue, and the condition of the positive part; the matrix must be positive semidefinite."""
        e = np.linalg.eigvalsh(self.gram)
        bound = max(1.0, float(np.abs(e).max()))
        if e[0] < -1e-10 * bound:
            raise ValueError("the moments are not positive semidefinite")
        up = e[e > 1e-12 * bound]
        return float(e[0]), float(up[-1] / up[0]) if len(up) else float("inf")

    def ridge(self, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights of (G + penalty I) w = p, and the inverse."""
        if not penalty > 0:
            raise ValueError("the ridge must be positive")
        system = (self.gram + self.gram.T) / 2 + penalty * np.eye(len(self.predictive))
        np.linalg.cholesky(system)
        return np.linalg.solve(system, self.predictive), np.linalg.inv(system)


def moments(stats: DataFrame, k: int, parts: dict[str, Column] | None = None) -> dict[str, Moments]:
    """Moments of each named part of the days (all of them by default), fetched as one row of numbers."""
    parts = parts or {"all": F.lit(True)}
    names = [f"p{i}" for i in range(k)] + [f"g{i}_{j}" for i in range(k) for j in range(i, k)]
    ok = {name: c & (F.col("n") >= FEWEST) for name, c in parts.items()}
    row = stats.agg(*[x for name, c in ok.items() for x in (F.count_if(c).alias(f"{name} days"), *[F.avg(F.when(c, F.col(m))).alias(f"{name} {m}") for m in names])]).first()
    out = {}
    for name in parts:
        if not row[f"{name} days"]:
            raise ValueError(f"no day of {name} has {FEWEST} rows")
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = row[f"{name} g{i}_{j}"]
        out[name] = Moments(g, np.array([row[f"{name} p{i}"] for i in range(k)]), row[f"{name} days"])
    return out


def scored(stats: DataFrame, alternatives: dict[str, list[float]], keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Daily correlations of several composites, one column each."""
    return stats.select(*keys, *[composite_ic(w).alias(name) for name, w in alternatives.items()])


def subsets(k: int, moments_of: Moments, chosen: dict[str, list[int]], penalty: float) -> dict[str, list[float]]:
    """Ridge weights of several subsets of the factors, as full vectors with zeros."""
    out = {}
    for name, own in chosen.items():
        w = np.zeros(k)
        if own:
            w[own] = moments_of.part(own).ridge(penalty)[0]
        out[name] = w.tolist()
    return out


def saliency(fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean over the fits of squared weights over the inverse's diagonal; where that is no number, infinity."""
    with np.errstate(all="ignore"):
        s = np.mean([w * w / np.diag(inv) for w, inv in fits], axis=0)
    return np.where(np.isfinite(s), s, np.inf)


@dataclass(frozen=True)
class Fold:
    """Years whose days the weights are fitted on, and years that they are scored on, both ends included."""

    fit: tuple[int, int]
    score: tuple[int, int]


def in_part(years: tuple[int, int]) -> Column:
    """Days of the years whose label ends in them too; needs columns d and exit."""
    return F.year("d").between(*years) & F.coalesce(F.year("exit") <= years[1], F.lit(False))


def with_exit(stats: DataFrame, calendar: DataFrame, offset: int) -> DataFrame:
    """Adds each day's date and the date `offset` days on. calendar: one row with the sorted dates."""
    days = calendar.select(F.posexplode("dates").alias("t", "d"), "dates")
    days = days.select("t", "d", F.try_element_at("dates", F.col("t") + 1 + offset).alias("exit"))
    return stats.join(days, "t")


def walk_forward(stats: DataFrame, k: int, folds: list[Fold], penalty: float, chosen: list[int] | None = None) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray]]]:
    """t, fold, ic of the score days, each under its fold's weights; and the fits. stats must have d and exit (with_exit)."""
    chosen = list(range(k)) if chosen is None else chosen
    fitted = moments(stats, k, {f"f{n}": in_part(f.fit) for n, f in enumerate(folds)})
    fits = [fitted[f"f{n}"].part(chosen).ridge(penalty) if chosen else (np.zeros(0), np.zeros((0, 0))) for n in range(len(folds))]
    fold, ic = F.lit(None).cast("int"), F.lit(None).cast("double")
    for n, (f, (w, _)) in enumerate(zip(folds, fits, strict=True)):
        full = np.zeros(k)
        full[chosen] = w
        fold = F.when(in_part(f.score), n).otherwise(fold)
        ic = F.when(in_part(f.score), composite_ic(full.tolist())).otherwise(ic)
    return stats.select("t", fold.alias("fold"), ic.alias("ic")).where("fold is not null"), fits


# --- rewards of candidates -----------------------------------------------------------------


def shape_rewards(df: DataFrame, group: str, delta: str, valid: Column, key: str, least: float) -> DataFrame:
    """Adds scale and reward: 0 up to `least`, then delta / (scale + delta) below 1, and -1 for invalid candidates.

    The scale is the median of a group's deltas above `least`, each key once; no less than `least` and 1e-5.
    """
    ok = F.coalesce(valid, F.lit(False)) & F.col(delta).isNotNull()
    floor = max(least, 1e-5)
    one = df.where(ok).groupBy(group, key).agg(F.min(delta).alias("_d"))
    scale = one.groupBy(group).agg(F.greatest(F.coalesce(F.median(F.when(F.col("_d") > least, F.col("_d"))), F.lit(floor)), F.lit(floor)).alias("scale"))
    reward = F.when(~ok, -1.0).when(F.col(delta) <= least, 0.0).otherwise(F.least(F.col(delta) / (F.col("scale") + F.col(delta)), F.lit(float(np.nextafter(1.0, 0.0)))))
    return df.join(scale, group, "left").withColumn("reward", reward)


def admit(df: DataFrame, group: str, delta: str, admissible: Column, order: list[str], least: float) -> DataFrame:
    """One row for each group: the best admissible candidate, whether it is admitted, and why not."""
    w = W.partitionBy(group).orderBy(F.when(admissible, F.col(delta)).desc_nulls_last(), *order)
    best = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    reason = F.when(~F.coalesce(admissible & F.col(delta).isNotNull(), F.lit(False)), "no_finite_candidate").when(F.col(delta) <= least, "delta_below_threshold").otherwise("admitted")
    return best.withColumn("reason", reason).withColumn("admitted", F.col("reason") == "admitted")


#: fixed values of the baseline's reward
NATIVE = {"exact_repeat": 0.1, "family_free": 8, "family_low": 0.08, "family_repeat": 0.02, "family_good": 0.1, "family_new": 0.02, "behaviour_good": 0.12, "behaviour_corr": 0.85, "behaviour_penalty": 0.08, "behaviour_low": 0.5, "behaviour_bonus": 0.02}


def mined(ic: Column, coverage: Column, seen: Column, least_ic: float, least_coverage: float) -> Column:
    """Whether a candidate is good and covered enough, and new, to be kept."""
    return F.coalesce((ic >= least_ic) & (coverage >= least_coverage) & ~seen, F.lit(False))


def native_reward(ic: Column, ir: Column, seen: Column, family: Column, behaviour: Column, spec: dict | None = None, has_pool: bool = True) -> Column:
    """Clipped rank correlation with bonuses for new families and behaviour and penalties for repeats; behaviour counts beside a pool alone."""
    s = NATIVE | (spec or {})
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    raw = clip(ic * 5.0 + 0.02 * F.tanh(ir))
    bonus = F.when((family == 0) & (raw >= s["family_good"]), s["family_new"]).otherwise(0.0)
    repeat = F.when((family > s["family_free"]) & (raw < s["family_low"]), s["family_repeat"]).otherwise(0.0)
    close = F.when(behaviour > s["behaviour_corr"], -s["behaviour_penalty"] * (behaviour - s["behaviour_corr"])).when(behaviour < s["behaviour_low"], s["behaviour_bonus"]).otherwise(0.0)
    return clip(raw - F.when(seen, s["exact_repeat"]).otherwise(0.0) - repeat + bonus + (F.when(raw >= s["behaviour_good"], close).otherwise(0.0) if has_pool else F.lit(0.0)))


def decorrelated(order: list[str], corr: dict[frozenset, float], limit: float = 0.7, most: int = 20) -> list[str]:
    """Of names in order, those whose absolute correlation with each one taken before is under the limit. The matrix is small."""
    taken: list[str] = []
    for name in order:
        if len(taken) < most and all(abs(corr.get(frozenset((name, x)), 0.0)) < limit for x in taken):
            taken.append(name)
    return taken
