"""Neutral portfolios: for each date, the weights nearest to a target under linear constraints and bounds.

Names whose score is at least the date's median may be held long and the rest short, each side adding up to half,
no weight beyond `largest`, and no exposure of the whole to any risk factor.  As every name has one side, this is a
projection onto {A w = b, low <= w <= high}.  Its dual has one number for each row of A, so a date is solved by a
damped Newton method on a few tens of unknowns, whatever the number of names, and its result is then held against
the same limits with tolerances of its own: a portfolio that breaks one is refused and said to be so.

A group is one date's cross-section, which the universe bounds and not the length of the history.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: weight of the pull to zero beside the distance to the target
PULL = 1e-4


@dataclass(frozen=True)
class Limits:
    largest: float = 0.02
    net: float = 1e-8
    exposure: float = 1e-6
    gross: float = 1e-6
    weight: float = 1e-6
    turnover: float | None = None


@dataclass
class Audit:
    """What a date's solution was found to be; numbers are missing where there is none."""

    status: str
    accepted: bool = False
    names: int = 0
    iterations: int = 0
    net: float | None = None
    gross: float | None = None
    max_weight: float | None = None
    max_exposure: float | None = None
    turnover: float | None = None
    violations: str = ""


AUDIT = "status string, accepted boolean, names long, iterations long, net double, gross double, max_weight double, max_exposure double, turnover double, violations string"


def nearest(c: np.ndarray, rows: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, close: float = 1e-13) -> tuple[np.ndarray, int, float]:
    """argmin |w - c|^2 with rows @ w = b and low <= w <= high; the number of steps and the largest residual.

    w is c + rows' m held to the bounds, for the m that minimises a convex function with gradient rows @ w - b.
    """
    scale = np.sqrt((rows * rows).sum(axis=1))
    scale[scale == 0] = 1.0
    rows, b = rows / scale[:, None], b / scale
    m = np.zeros(len(b))

    def value(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        v = c + at @ rows
        w = np.clip(v, low, high)
        return float((w * v - w * w / 2).sum() - b @ at), w, rows @ w - b

    here, w, slope = value(m)
    damp, step = 1e-10, 0
    for step in range(1, rounds + 1):
        if np.abs(slope).max(initial=0.0) < close:
            break
        v = c + m @ rows
        free = (v >= low) & (v <= high)
        curve = rows[:, free] @ rows[:, free].T
        # where all names of a row are at their bounds, a step as if a thousandth of them were not
        curve[np.diag_indices(len(b))] += np.where(np.diag(curve) < 1e-12, 1e-3, 0.0)
        moved = False
        for _ in range(30):
            way = -np.linalg.solve(curve + damp * np.eye(len(b)), slope)
            size = 1.0
            while size > 1e-6:
                there, w2, slope2 = value(m + size * way)
                if there <= here + 1e-4 * size * float(slope @ way) or np.abs(slope2).max() < 0.5 * np.abs(slope).max():
                    moved = True
                    break
                size /= 2
            if moved:
                m, here, w, slope = m + size * way, there, w2, slope2
                damp = max(1e-12, damp / 10)
                break
            damp *= 10
        if not moved:
            break
    return w, step, float(np.abs(slope * scale).max(initial=0.0))


def project_date(target: np.ndarray, score: np.ndarray, exposures: np.ndarray, eligible: np.ndarray, limits: Limits, before: np.ndarray | None = None) -> tuple[np.ndarray | None, Audit]:
    """Weights of one date, or None and why not."""
    valid = eligible & np.isfinite(score) & np.isfinite(exposures).all(axis=1)
    own = np.flatnonzero(valid)
    if len(own) < math.ceil(1 / limits.largest):
        return None, Audit("insufficient_eligible", names=len(own))
    s, x = score[own], exposures[own]
    long = s >= np.median(s)
    low, high = np.where(long, 0.0, -limits.largest), np.where(long, limits.largest, 0.0)
    rows = np.vstack([long.astype(float), (~long).astype(float), x.T])
    b = np.concatenate([[0.5, -0.5], np.zeros(x.shape[1])])
    w, steps, off = nearest(target[own] / (1 + PULL), rows, b, low, high)
    if not np.isfinite(w).all() or off > 1e-4:
        return None, Audit("infeasible", names=len(own), iterations=steps)
    out = np.zeros(len(target))
    out[own] = w
    turnover = None if before is None else float(np.abs(out - before).sum())
    audit = Audit("optimal", names=len(own), iterations=steps, net=float(out.sum()), gross=float(np.abs(out).sum()), max_weight=float(np.abs(out).max(initial=0)), max_exposure=float(np.abs(x.T @ w).max(initial=0)), turnover=turnover)
    broken = {
        "net": abs(audit.net) > limits.net,
        "risk_exposure": audit.max_exposure > limits.exposure,
        "gross": abs(audit.gross - 1) > limits.gross,
        "max_weight": audit.max_weight > limits.largest + limits.weight,
        "turnover": limits.turnover is not None and not (turnover is not None and turnover <= limits.turnover + limits.weight),
    }
    audit.violations = ",".join(k for k, v in broken.items() if v)
    audit.accepted = not audit.violations
    return (out if audit.accepted else None), audit


def neutral_weights(df: DataFrame, target: str, score: str, exposures: list[str], eligible: str, limits: Limits | None = None, before: str | None = None, key: str = "t", name: str = "a") -> DataFrame:
    """key, name, weight and the date's audit; the weight is missing on dates whose solution is refused, 0 for names that can't be held."""
    limits = limits or Limits()
    schema = df.select(key, name).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    needed = list(dict.fromkeys([key, name, target, score, eligible, *exposures, *([before] if before else [])]))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(name, kind="stable")
        number = lambda c: rows[c].to_numpy(float, na_value=np.nan)
        x = np.column_stack([number(c) for c in exposures]) if exposures else np.zeros((len(rows), 0))
        able = rows[eligible].fillna(False).to_numpy(bool)
        w, audit = project_date(np.nan_to_num(number(target)), number(score), x, able, limits, np.nan_to_num(number(before)) if before else None)
        out = pd.DataFrame({key: rows[key], name: rows[name], "weight": np.full(len(rows), np.nan) if w is None else w})
        for k, v in asdict(audit).items():
            out[k] = pd.array([v] * len(rows), dtype={"status": "string", "violations": "string", "accepted": "boolean", "names": "Int64", "iterations": "Int64"}.get(k, "Float64"))
        out["weight"] = out["weight"].astype("Float64").mask(out["weight"].isna())
        return out

    return df.select(*needed).groupBy(key).applyInPandas(one, f"{schema}, weight double, {AUDIT}")


def audits(weights: DataFrame, key: str = "t") -> DataFrame:
    """One row for each date: what neutral_weights() found."""
    fields = [f.split()[0] for f in AUDIT.split(", ")]
    return weights.groupBy(key).agg(*[F.any_value(F.col(f)).alias(f) for f in fields])
