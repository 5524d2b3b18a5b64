"""Random expressions."""

from __future__ import annotations

import random

from . import vocabulary as V
from .ast import Call, Constant, ExpressionError, Feature, Window, check_limits

LEAF, TRIES = 0.22, 100
#: a family is drawn first, then one of its operators
FAMILIES = (V.UNARY, V.BINARY, V.ROLLING, V.PAIR_ROLLING, V.CROSS_SECTION)


def sample(rng: random.Random, max_depth: int = V.MAX_DEPTH):
    """A random expression within the limits; the close if none is found in 100 tries."""

    def grow(depth: int):
        if depth <= 1 or rng.random() < LEAF:
            return Feature(rng.choice(V.FEATURES))
        op = rng.choice(rng.choice(FAMILIES))
        n, windowed = V.OPERATORS[op]
        args = [grow(depth - 1) for _ in range(n)]
        if n == 2 and not windowed and rng.random() < 0.2:
            args[1] = Constant(rng.choice(V.CONSTANTS))
        return Call(op, (*args, *([Window(rng.choice(V.WINDOWS))] if windowed else [])))

    for _ in range(TRIES):
        try:
            tree = grow(max_depth)
            check_limits(tree)
            return tree
        except ExpressionError:
            continue
    return Feature("close")
