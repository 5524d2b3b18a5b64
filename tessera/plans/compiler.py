"""Compiles batches of expressions into staged window plans.

Spark can't nest window functions, so the batch's distinct operators are cut into levels: a
level's windows read only columns of earlier levels.  Equal sub-expressions of the whole batch are one
column; windows of one level share their partitioning, so the number of shuffles is the number of
changes between series and cross sections on the deepest path, whatever the batch's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dsl import Call, Constant, Feature, canonical, expression_hash, lookback, parse
from ..functions import SCALAR, finite
from ..operators.cross_section import cs_rank, cs_zscore
from ..operators.rolling import MOMENTS, ROLLING, SERIES, with_moments, with_series


def signal_name(tree) -> str:
    return f"sig_{expression_hash(tree)[:12]}"


def _windowed(tree) -> bool:
    return isinstance(tree, Call) and tree.op not in SCALAR


def compile_batch(panel: DataFrame, expressions: dict[str, str], mask: str = "mask", start: int | None = None) -> DataFrame:
    """`panel` (a, t, features, mask) with one column for each named expression.

    With `start`, only rows from that date on are returned, and only the history that the
    batch needs is read (an EMA starts at that history's first row).
    """
    trees = {name: parse(text) for name, text in expressions.items()}
    if start is not None:
        panel = panel.where(F.col("t") >= start - max(map(lookback, trees.values()), default=0))
    levels: dict[str, int] = {}
    nodes: dict[str, Call] = {}

    def level(tree) -> int:
        key = canonical(tree)
        if key not in levels:
            below = max((level(x) for x in getattr(tree, "inputs", ())), default=0)
            levels[key] = below + _windowed(tree)
            if _windowed(tree):
                nodes[key] = tree
        return levels[key]

    def column(tree) -> Column:
        if isinstance(tree, Feature):
            return F.col(tree.name)
        if isinstance(tree, Constant):
            return F.lit(tree.value)
        if _windowed(tree):
            return F.col(signal_name(tree))
        return finite(SCALAR[tree.op](*map(column, tree.inputs)))

    def input_name(tree) -> str:
        return tree.name if isinstance(tree, Feature) else signal_name(tree)

    deepest = max((level(t) for t in trees.values()), default=0)
    known = set(panel.columns)
    for n in range(1, deepest + 1):
        own = [x for k, x in nodes.items() if levels[k] == n]
        inner = {signal_name(i): column(i) for x in own for i in x.inputs if not isinstance(i, Feature)}
        inner = {k: v for k, v in inner.items() if k not in known}
        panel = panel.withColumns(inner) if inner else panel
        known |= set(inner)
        made: dict[str, Column] = {}
        for x in own:
            args = [F.col(input_name(i)) for i in x.inputs]
            if x.op in ROLLING:
                made[signal_name(x)] = ROLLING[x.op](args[0], x.window)
            elif x.op in ("CSRank", "CSZScore"):
                made[signal_name(x)] = (cs_rank if x.op == "CSRank" else cs_zscore)(args[0], F.col(mask))
        panel = panel.withColumns({k: finite(v) for k, v in made.items()}) if made else panel
        frames = {signal_name(x): (x.op, input_name(x.inputs[0]), input_name(x.inputs[-1]), x.window) for x in own if x.op in MOMENTS}
        panel = with_moments(panel, frames).withColumns({k: finite(F.col(k)) for k in frames}) if frames else panel
        series = {signal_name(x): (x.op, input_name(x.inputs[0]), x.window) for x in own if x.op in SERIES}
        panel = with_series(panel, series).withColumns({k: finite(F.col(k)) for k in series}) if series else panel
        known |= set(made) | set(frames) | set(series)
    return panel.withColumns({name: column(t) for name, t in trees.items()}) if start is None else panel.withColumns({name: column(t) for name, t in trees.items()}).where(F.col("t") >= start)
