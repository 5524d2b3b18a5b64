"""Candidates against a full pool: what each adds, which member it would replace, and whether that holds up.

Everything follows from daily blocks of moments of the pool and all candidates (operators.gram), read once for the
fits, once for all composites and once more for the few that are checked again.  A candidate's fit borders the
pool's inverse, and a fit without one factor takes its row back out of it, so no subset is solved anew.  Daily
correlations, their differences and errors stay in Spark; the driver sees numbers for each candidate alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import block_moments, composites
from .pool import Fold, Moments, in_part, saliency
from .statistics import hac


@dataclass(frozen=True)
class Rules:
    penalty: float = 0.01
    lags: int = 20
    #: errors that an increment is docked
    critical: float = 0.0
    #: members of the lowest saliency that are tried for deletion, and candidates that are checked again
    tried: int = 3
    rechecked: int = 3
    least: float = 0.0


def bordered(w: np.ndarray, inverse: np.ndarray, u: np.ndarray, d: float, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and inverse after one factor joins: u and d are its column of the system, p its moment with the label."""
    v = inverse @ u
    s = d - u @ v
    e = (p - u @ w) / s
    grown = np.block([[inverse + np.outer(v, v) / s, -v[:, None] / s], [-v[None, :] / s, np.array([[1 / s]])]])
    return np.append(w - v * e, e), grown


def without(w: np.ndarray, inverse: np.ndarray, i: int) -> np.ndarray:
    """Weights after factor i leaves, as a vector with 0 in its place."""
    out = w - inverse[:, i] * (w[i] / inverse[i, i])
    out[i] = 0.0
    return out


def increments(days: DataFrame, rows: int, base: int, rules: Rules, calendar: DataFrame, key: str = "t") -> list[dict]:
    """For each of `rows` composites in `days` (key, part, ic): days, mean, error and docked mean of its difference to composite `base`.

    The error keeps the gaps of the calendar, a table with every day's `key`.
    """
    cells = days.select(key, F.posexplode(F.transform("ic", lambda x: x - F.try_element_at("ic", F.lit(base + 1)))).alias("j", "x"))
    grid = calendar.select(key).join(F.broadcast(calendar.sparkSession.range(rows).select(F.col("id").cast("int").alias("j"))))
    found = hac(grid.join(cells, [key, "j"], "left"), "x", rules.lags, key, ["j"])
    out: list[dict] = [{"n": 0, "mean": None, "se": None, "reward": None} for _ in range(rows)]
    for r in found.collect():  # one row for each composite
        out[r.j] = {"n": r.n, "mean": r.mean, "se": r.se, "reward": None if r.mean is None else r.mean - rules.critical * (r.se or 0.0)}
    return out


def score_candidates(blocks: DataFrame, pool: list[str], candidates: list[str], folds: list[Fold], capacity: int, calendar: DataFrame, rules: Rules | None = None, same: dict[str, str] | None = None, width: int = 64, key: str = "t") -> DataFrame:
    """One row for each candidate, in order.

    `blocks` are the daily blocks of pool + candidates, in this order, with d and exit (pool.with_exit); `same` names for a
    candidate the pool member that is the same expression.  Columns: candidate, delta_add and se_add (out of sample, against the
    pool), days, saliency (of the pool and, last, the candidate), tried (names tried for deletion), replaced (null where the pool
    has room or the candidate would leave itself), post_delta, self_evicted, rechecked, valid and reason.
    """
    rules, same = rules or Rules(), same or {}
    k, m = len(pool), len(candidates)
    fitted = block_moments(blocks, k + m, {f"f{n}": in_part(f.fit) for n, f in enumerate(folds)}, width)
    part = F.lit(None).cast("string")
    for n, f in enumerate(folds):
        part = F.when(in_part(f.score), F.lit(f"f{n}")).otherwise(part)
    fits = {name: _union_fits(f, k, m, rules.penalty) for name, f in fitted.items()}
    salient = [saliency([fits[name][1][c] for name in fits]) for c in range(m)]
    full = k >= capacity
    tried = [np.argsort(s, kind="stable")[: min(rules.tried, k + 1)].tolist() if full else [] for s in salient]
    weights = {}
    for name, (base, unions) in fits.items():
        rows = [_spread_out(base, k, m, None)]
        for c, (w, inverse) in enumerate(unions):
            rows += [_spread_out(x, k, m, c) for x in (w, *(without(w, inverse, i) for i in tried[c]))]
        weights[name] = np.array(rows)
    found = increments(composites(blocks, weights, part, key, width), 1 + sum(1 + len(x) for x in tried), 0, rules, calendar, key)
    expected = found[0]["n"]
    out, at = [], 1
    for c, name in enumerate(candidates):
        add, alternatives = found[at], found[at + 1 : at + 1 + len(tried[c])]
        at += 1 + len(tried[c])
        out.append(_plan(name, same, pool, tried[c], salient[c], add, alternatives, expected, full))
    if full:
        _check_again(out, blocks, fitted, pool, candidates, part, rules, calendar, key, width)
    schema = "candidate string, delta_add double, se_add double, days long, saliency array<double>, tried array<string>, replaced string, post_delta double, self_evicted boolean, rechecked boolean, valid boolean, reason string"
    return blocks.sparkSession.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in out], schema)


def _union_fits(f: Moments, k: int, m: int, penalty: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The pool's weights, and for each candidate weights and inverse of the pool with it."""
    base, inverse = f.part(list(range(k))).ridge(penalty) if k else (np.zeros(0), np.zeros((0, 0)))
    return base, [bordered(base, inverse, f.gram[:k, k + c], f.gram[k + c, k + c] + penalty, f.predictive[k + c]) for c in range(m)]


def _spread_out(w: np.ndarray, k: int, m: int, c: int | None) -> np.ndarray:
    out = np.zeros(k + m)
    out[:k] = w[:k]
    if c is not None:
        out[k + c] = w[k]
    return out


def _plan(name: str, same: dict, pool: list[str], tried: list[int], salient: np.ndarray, add: dict, alternatives: list[dict], expected: int, full: bool) -> dict:
    labels = [*pool, name]
    row = {"candidate": name, "delta_add": add["reward"], "se_add": add["se"], "days": add["n"], "saliency": salient.tolist(), "tried": [labels[i] for i in tried], "replaced": None, "post_delta": add["reward"], "self_evicted": False, "rechecked": not full, "valid": True, "reason": "ok"}
    if name in same:
        return row | {"delta_add": None, "post_delta": None, "valid": False, "reason": "exact_duplicate", "rechecked": False}
    if add["reward"] is None or add["n"] != expected:
        return row | {"post_delta": None, "valid": False, "reason": "insufficient_pool_support" if add["reward"] is not None else "non_finite_delta", "rechecked": False}
    if not full:
        return row
    usable = [(a["reward"], -i, d) for i, (a, d) in enumerate(zip(alternatives, tried, strict=True)) if a["reward"] is not None]
    if not usable:
        return row | {"post_delta": None, "valid": False, "reason": "non_finite_prune_objective"}
    best, _, gone = max(usable)
    evicted = gone == len(pool)
    return row | {"replaced": None if evicted else pool[gone], "post_delta": best, "self_evicted": evicted, "reason": "self_evicted" if evicted else "ok"}


def _check_again(out: list[dict], blocks, fitted: dict[str, Moments], pool: list[str], candidates: list[str], part, rules: Rules, calendar, key: str, width: int) -> None:
    """The best candidates' new pools are solved for themselves and scored on their own days; one that leaves itself changes nothing."""
    k, m = len(pool), len(candidates)
    best = sorted((r for r in out if r["valid"]), key=lambda r: -r["post_delta"])[: rules.rechecked]
    swaps = []
    for r in best:
        r["rechecked"] = True
        if r["self_evicted"]:
            r["post_delta"] = 0.0
        else:
            swaps.append((r, [i for i in range(k) if pool[i] != r["replaced"]] + [k + candidates.index(r["candidate"])]))
    if not swaps:
        return
    weights = {}
    for name, f in fitted.items():
        rows = np.zeros((1 + len(swaps), k + m))
        rows[0, :k] = f.part(list(range(k))).ridge(rules.penalty)[0]
        for j, (_, own) in enumerate(swaps):
            rows[j + 1, own] = f.part(own).ridge(rules.penalty)[0]
        weights[name] = rows
    found = increments(composites(blocks, weights, part, key, width), 1 + len(swaps), 0, rules, calendar, key)
    for (r, _), x in zip(swaps, found[1:], strict=True):
        if x["reward"] is None or x["n"] != found[0]["n"]:
            r.update(post_delta=None, valid=False, reason="insufficient_pool_support")
        else:
            r["post_delta"] = x["reward"]
