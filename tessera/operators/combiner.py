"""A fitted combination of factors: ridge weights on the fixed universe, a label-free signal from them, and its stored form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settled import settle
from . import cross_section as CS
from .gram import block_moments, neutral_blocks


@dataclass(frozen=True)
class Combiner:
    factors: list[str]
    exposures: list[str] = field(default_factory=list)
    penalty: float = 0.01
    weights: list[float] | None = None
    days: int = 0
    least_eigenvalue: float | None = None
    condition: float | None = None

    def fit(self, df: DataFrame, label: str, base: Column) -> Combiner:
        """The combiner with weights; factors are standardised (and residualised on the exposures) each on its own rows first."""
        blocks = settle(neutral_blocks(df, self.factors, label, base, self.exposures))
        m = block_moments(blocks, len(self.factors))["all"]
        low, condition = m.spectrum()
        w, _ = m.ridge(self.penalty)
        return Combiner(self.factors, self.exposures, self.penalty, [float(x) for x in w], m.days, low, condition)

    def transform(self, df: DataFrame, base: Column, out: str = "signal", keep: list[str] | None = None) -> DataFrame:
        """Adds the combined signal, which no label enters: missing factors count as 0, rows without any weighted factor are missing.

        With `keep`, rows come with these columns and the signal alone.
        """
        if self.weights is None:
            raise ValueError("fit the combiner first")
        return CS.own_combined(df, dict(zip(self.factors, self.weights, strict=True)), base, self.exposures, out, keep)

    def metric(self, df: DataFrame, label: str, base: Column) -> DataFrame:
        """The combined signal, made without the label, and then both on their common universe: a, t, metric, signal and label."""
        made = self.transform(df, base)
        return CS.fixed_universe(made.withColumn("_rows", base & F.col("signal").isNotNull()), ["signal"], label, F.col("_rows"), self.exposures).select("a", "t", "metric", "signal", label)

    def to_json(self) -> str:
        if self.weights is None:
            raise ValueError("fit the combiner first")
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Combiner:
        return cls(**json.loads(text))
