"""Objectives of a pool on neutralised inputs: walk-forward scores with support gates, errors by fold and paired increments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settled import settle
from . import cross_section as CS
from .gram import block_moments, composites, daily_blocks, neutral_blocks
from .pool import FEWEST, NO_SPREAD, Fold, in_part, with_exit
from .statistics import hac


@dataclass(frozen=True)
class Support:
    """What a fold's parts need: valid days, and shares of the days and rows that the base universe has."""

    days: int = 252
    day_rate: float = 0.8
    row_rate: float = 0.8


class InsufficientSupport(ValueError):
    """A fold has too few days or rows to be fitted or scored on."""


def neutral_inputs(df: DataFrame, factors: list[str], label: str, base: Column, exposures: list[str]) -> DataFrame:
    """Each factor residualised on its own rows, then factors and label together on one universe, `metric`."""
    return CS.neutral_inputs(df, factors, label, base, exposures)


def support(df: DataFrame, label: str, base: Column, metric: Column, folds: list[Fold], calendar: DataFrame, offset: int, need: Support) -> DataFrame:
    """One row for each fold and part: expected and valid days, base and valid rows, required days, rates and whether they suffice."""
    y = F.when(metric, F.col(label))
    days = df.groupBy("t").agg(F.count_if(base).alias("base"), F.count(y).alias("rows"), (F.var_pop(y) * F.count(y)).alias("spread"))
    days = with_exit(days, calendar, offset)
    valid = (F.col("rows") >= FEWEST) & (F.col("spread") > NO_SPREAD)
    cells = []
    for k, fold in enumerate(folds):
        for name, years in (("fit", fold.fit), ("score", fold.score)):
            own = in_part(years)
            cells.append((f"{name}{k}", F.struct(F.lit(k).alias("fold"), F.lit(name).alias("part"), F.count_if(own & (F.col("base") >= FEWEST)).alias("expected_days"), F.count_if(own & valid).alias("valid_days"), F.coalesce(F.sum(F.when(own, F.col("base"))), F.lit(0)).alias("base_rows"), F.coalesce(F.sum(F.when(own, F.col("rows"))), F.lit(0)).alias("valid_rows"))))
    rows = days.agg(*[c.alias(n) for n, c in cells]).select(F.inline(F.array(*[n for n, _ in cells])))
    rows = rows.withColumns({"required_days": F.greatest(F.lit(need.days), F.ceil(need.day_rate * F.col("expected_days"))).cast("long"), "day_rate": F.col("valid_days") / F.greatest(F.lit(1), F.col("expected_days")), "row_rate": F.col("valid_rows") / F.greatest(F.lit(1), F.col("base_rows"))})
    return rows.withColumn("enough", (F.col("valid_days") >= F.col("required_days")) & (F.col("row_rate") >= need.row_rate))


def require_support(found: DataFrame) -> None:
    """Raises with the fold and part that lack days or rows; there is one row for each."""
    if lacking := found.where(~F.col("enough")).orderBy("fold", "part").collect():
        raise InsufficientSupport("; ".join(f"{r.part} of fold {r.fold}: {r.valid_days} of {r.required_days} days, {r.row_rate:.3f} of the rows" for r in lacking))


@dataclass
class Scored:
    """Daily correlations of alternatives out of sample (t, part, ic), their names, and weights by name: {"full": .., "f0": ..}."""

    daily: DataFrame
    names: list[str]
    weights: dict[str, dict[str, np.ndarray]]
    calendar: DataFrame
    blocks: DataFrame


def walk_forward(inputs: DataFrame, factors: list[str], label: str, alternatives: dict[str, list[str]], folds: list[Fold], penalty: float, calendar: DataFrame, offset: int, metric: str = "metric", parts: int = 1) -> Scored:
    """Each alternative (some of the factors; none is the zero signal) fitted on every fold and scored on the fold's score days.

    The weights named full are fitted on all days and are the ones to deploy, never a mean of the folds'.
    """
    return scored_blocks(daily_blocks(inputs, factors, label, F.col(metric), parts=parts), factors, alternatives, folds, penalty, calendar, offset)


def neutral_walk_forward(df: DataFrame, factors: list[str], label: str, base: Column, exposures: list[str], alternatives: dict[str, list[str]], folds: list[Fold], penalty: float, calendar: DataFrame, offset: int) -> Scored:
    """walk_forward() of neutral_inputs(), from the raw rows to the moments in one call for each date."""
    return scored_blocks(neutral_blocks(df, factors, label, base, exposures), factors, alternatives, folds, penalty, calendar, offset)


def scored_blocks(blocks: DataFrame, factors: list[str], alternatives: dict[str, list[str]], folds: list[Fold], penalty: float, calendar: DataFrame, offset: int) -> Scored:
    """walk_forward() from the moments of the days, which are few and are kept: weights and scores read them, and the panel is read once."""
    blocks = settle(with_exit(blocks, calendar, offset))
    k = len(factors)
    fits = block_moments(blocks, k, {"full": F.lit(True)} | {f"f{n}": in_part(f.fit) for n, f in enumerate(folds)})
    weights: dict[str, dict[str, np.ndarray]] = {}
    for name, own in alternatives.items():
        at = [factors.index(f) for f in own]
        weights[name] = {}
        for part, m in fits.items():
            w = np.zeros(k)
            if at:
                w[at] = m.part(at).ridge(penalty)[0]
            weights[name][part] = w
    part = F.lit(None).cast("string")
    for n, f in enumerate(folds):
        part = F.when(in_part(f.score), F.lit(f"f{n}")).otherwise(part)
    stacked = {f"f{n}": np.array([weights[a][f"f{n}"] for a in alternatives]) for n in range(len(folds))}
    return Scored(composites(blocks, stacked, part), list(alternatives), weights, calendar, blocks)


def summaries(scored: Scored, lags: int, against: str | None = None, critical: float = 0.0) -> DataFrame:
    """name, scope (all, or a fold), n, mean, se and lower = mean - critical * se, of the daily correlations or of their differences to `against`.

    Errors keep the gaps of the whole calendar; a fold's error sees the days of other folds as gaps.
    """
    base = None if against is None else scored.names.index(against) + 1
    value = (lambda x: x) if base is None else (lambda x: x - F.try_element_at("ic", F.lit(base)))
    cells = scored.daily.select("t", "part", F.posexplode(F.transform("ic", value)).alias("j", "x")).select("t", "j", "x", F.explode(F.array(F.lit("all"), F.col("part"))).alias("scope"))
    spark = scored.calendar.sparkSession
    scopes = ["all", *next(iter(scored.weights.values())).keys() - {"full"}]
    wanted = spark.createDataFrame([(j, n, s) for j, n in enumerate(scored.names) for s in sorted(scopes)], "j int, name string, scope string")
    days = scored.calendar.select(F.posexplode("dates").alias("t", "_d")).select("t")
    grid = days.join(F.broadcast(wanted.select("j", "scope")))
    found = hac(grid.join(cells, ["t", "j", "scope"], "left"), "x", lags, "t", ["j", "scope"])
    return found.join(F.broadcast(wanted), ["j", "scope"]).select("name", "scope", "n", "mean", "se", (F.col("mean") - critical * F.coalesce("se", F.lit(0.0))).alias("lower"))


def weight_table(scored: Scored, factors: list[str]) -> DataFrame:
    """name, part (full or a fold), factor, weight, and its share of the absolute weights of the part."""
    rows = [(name, part, f, float(x), float(x / max(np.abs(w).sum(), 1e-30))) for name, by in scored.weights.items() for part, w in by.items() for f, x in zip(factors, w, strict=True)]
    return scored.calendar.sparkSession.createDataFrame(rows, "name string, part string, factor string, weight double, share double")
