"""Pools of an exact size from stored moments: forward and backward selection and swaps, then branch and bound, without new solves."""

from __future__ import annotations

import numpy as np

from .pool import Moments
from .replacement import bordered, without


def _explained(predictive: np.ndarray, own: list[int], w: np.ndarray) -> float:
    """p' (G + penalty I)^-1 p of the subset: what its ridge fit explains."""
    return float(predictive[own] @ w)


def _grow(m: Moments, penalty: float, own: list[int], w: np.ndarray, inverse: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    return bordered(w, inverse, m.gram[own, new], m.gram[new, new] + penalty, m.predictive[new])


def _shrink(w: np.ndarray, inverse: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.arange(len(w)) != i
    return without(w, inverse, i)[keep], (inverse - np.outer(inverse[:, i], inverse[i]) / inverse[i, i])[np.ix_(keep, keep)]


def select_exact(m: Moments, size: int, penalty: float, allowed: list[int] | None = None, proven: bool = True) -> tuple[list[int], float]:
    """`size` factors whose ridge fit explains most.

    The better of growing and shrinking is improved by swaps until none helps; a step costs the square of the pool's size for each
    factor tried, as weights and inverse are bordered or reduced.  With `proven`, factors are then taken away from all of them in
    every order that can still beat it: a fit never explains more with fewer factors, so a set that explains less is left at once.
    That is quick for pools of tens of factors; for hundreds, use proven=False.
    """
    allowed = list(range(len(m.predictive))) if allowed is None else allowed
    if not 0 <= size <= len(allowed):
        raise ValueError("the size must be between 0 and the number of factors")
    found = [_swapped(m, penalty, allowed, start) for start in (_forward(m, penalty, allowed, size), _backward(m, penalty, allowed, size))]
    own, value = max(found, key=lambda f: (f[1], [-i for i in f[0]]))
    return _bounded(m, penalty, allowed, size, sorted(own), value) if proven else (sorted(own), value)


def _bounded(m: Moments, penalty: float, allowed: list[int], size: int, best: list[int], value: float) -> tuple[list[int], float]:
    w, inverse = m.part(allowed).ridge(penalty) if allowed else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(w * w / np.diag(inverse), kind="stable") if allowed else []
    # the factors that matter least are taken away first; `at` is the first place that may still go
    own = [allowed[i] for i in order]
    w, inverse = (w[order], inverse[np.ix_(order, order)]) if allowed else (w, inverse)
    stack = [(own, w, inverse, 0)]
    while stack:
        own, w, inverse, at = stack.pop()
        here = _explained(m.predictive, own, w)
        if here <= value * (1 + 1e-12):
            continue
        if len(own) == size:
            best, value = sorted(own), here
            continue
        # places before `at` stay, so the last one to go must leave enough behind it
        for k in range(at, len(own)):
            if len(own) - 1 >= size and len(own) - k >= len(own) - size:
                stack.append((own[:k] + own[k + 1 :], *_shrink(w, inverse, k), k))
    return best, value


def _forward(m: Moments, penalty: float, allowed: list[int], size: int) -> list[int]:
    own: list[int] = []
    w, inverse = np.zeros(0), np.zeros((0, 0))
    while len(own) < size:
        tries = [(_explained(m.predictive, [*own, i], _grow(m, penalty, own, w, inverse, i)[0]), -i) for i in allowed if i not in own]
        new = -max(tries)[1]
        w, inverse = _grow(m, penalty, own, w, inverse, new)
        own = [*own, new]
    return own


def _backward(m: Moments, penalty: float, allowed: list[int], size: int) -> list[int]:
    own = list(allowed)
    w, inverse = m.part(own).ridge(penalty) if own else (np.zeros(0), np.zeros((0, 0)))
    while len(own) > size:
        loss = w * w / np.diag(inverse)  # what the fit loses without each
        k = int(np.argmin(loss))
        w, inverse = _shrink(w, inverse, k)
        own.pop(k)
    return own


def _swapped(m: Moments, penalty: float, allowed: list[int], own: list[int]) -> tuple[list[int], float]:
    own = list(own)
    w, inverse = m.part(own).ridge(penalty) if own else (np.zeros(0), np.zeros((0, 0)))
    value = _explained(m.predictive, own, w)
    while True:
        best = (value * (1 + 1e-12) + 1e-300, None)
        for k in range(len(own)):
            rest = own[:k] + own[k + 1 :]
            w1, inverse1 = _shrink(w, inverse, k)
            for i in allowed:
                if i not in own:
                    w2, inverse2 = _grow(m, penalty, rest, w1, inverse1, i)
                    v = _explained(m.predictive, [*rest, i], w2)
                    if v > best[0]:
                        best = (v, ([*rest, i], w2, inverse2))
        if best[1] is None:
            return own, value
        value, (own, w, inverse) = best
