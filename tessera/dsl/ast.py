"""Syntax tree of factor expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from . import vocabulary as V


class ExpressionError(ValueError):
    """The expression isn't in the language."""


@dataclass(frozen=True)
class Feature:
    name: str

    def __post_init__(self):
        if self.name not in V.FEATURES:
            raise ExpressionError(f"no feature ${self.name}")


@dataclass(frozen=True)
class Constant:
    value: float

    def __post_init__(self):
        if self.value not in V.CONSTANTS:
            raise ExpressionError(f"{self.value} is not an allowed constant")


@dataclass(frozen=True)
class Window:
    size: int

    def __post_init__(self):
        if self.size not in V.WINDOWS:
            raise ExpressionError(f"{self.size} is not an allowed window")


Node = "Feature | Constant | Window | Call"


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple

    def __post_init__(self):
        if self.op not in V.OPERATORS:
            raise ExpressionError(f"no operator {self.op}")
        n, windowed = V.OPERATORS[self.op]
        if len(self.args) != n + windowed:
            raise ExpressionError(f"{self.op} takes {n + windowed} arguments")
        if any(isinstance(x, Window) for x in self.args[:n]) or windowed != isinstance(self.args[-1], Window):
            raise ExpressionError(f"{self.op} takes a window {'last' if windowed else 'nowhere'}")
        if not any(True for x in walk(self) if isinstance(x, Feature)):
            raise ExpressionError(f"{self.op} needs a feature")

    @property
    def inputs(self) -> tuple:
        return tuple(x for x in self.args if not isinstance(x, Window))

    @property
    def window(self) -> int | None:
        return self.args[-1].size if isinstance(self.args[-1], Window) else None


def walk(node):
    yield node
    for x in getattr(node, "args", ()):
        yield from walk(x)


def canonical(node) -> str:
    """One text for an expression; arguments of Add and Mul in order of their texts."""
    if isinstance(node, Feature):
        return f"${node.name}"
    if isinstance(node, Constant):
        return f"{node.value:g}"
    if isinstance(node, Window):
        return str(node.size)
    parts = [canonical(x) for x in node.args]
    return f"{node.op}({','.join(sorted(parts) if node.op in V.COMMUTATIVE else parts)})"


def expression_hash(node) -> str:
    return hashlib.sha256(canonical(node).encode()).hexdigest()


def family(node) -> str:
    """Identity up to windows and constants."""

    def text(x) -> str:
        if isinstance(x, Window):
            return "W"
        if isinstance(x, Constant):
            return "C"
        return canonical(x) if isinstance(x, Feature) else f"{x.op}({','.join(sorted(map(text, x.args)) if x.op in V.COMMUTATIVE else map(text, x.args))})"

    return hashlib.sha256(text(node).encode()).hexdigest()


def measure(node) -> tuple[int, int]:
    """Depth and nodes; windows count for neither."""
    if isinstance(node, Window):
        return 0, 0
    below = [measure(x) for x in getattr(node, "args", ())]
    return 1 + max((d for d, _ in below), default=0), 1 + sum(n for _, n in below)


def lookback(node) -> int:
    """Earlier rows that the value of one row needs (EMA: nominally)."""
    below = max((lookback(x) for x in getattr(node, "args", ())), default=0)
    w = node.window if isinstance(node, Call) else None
    return below + (0 if w is None else w if node.op in ("Ref", "Delta") else w - 1)


def check_limits(node) -> None:
    depth, nodes = measure(node)
    for what, is_, most in (("depth", depth, V.MAX_DEPTH), ("nodes", nodes, V.MAX_NODES), ("lookback", lookback(node), V.MAX_LOOKBACK)):
        if is_ > most:
            raise ExpressionError(f"{what} {is_} exceeds {most}")
