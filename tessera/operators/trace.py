"""Audit of stored rows: a seeded, stratified sample whose values are computed again from raw rows by another path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sampled(df: DataFrame, strata: list[Column], keys: list[str], each: int, seed: int = 0) -> DataFrame:
    """`each` rows of every stratum, by a hash of their keys and the seed: the same rows however the table is stored."""
    named = [c.alias(f"_s{k}") for k, c in enumerate(strata)]
    own = df.select("*", *named, F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])).alias("_h"))
    order = W.partitionBy(*[f"_s{k}" for k in range(len(strata))]).orderBy("_h", *keys)
    return own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n", "_h", *[f"_s{k}" for k in range(len(strata))])


def compared(stored: DataFrame, again: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, stored, again, difference: one row for each value; a row that is found on one side alone shows null on the other."""
    both = stored.select(*keys, *[F.col(f).cast("double").alias(f"_s_{f}") for f in fields]).join(again.select(*keys, *[F.col(f).cast("double").alias(f"_r_{f}") for f in fields]), keys, "full")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_s_{f}").alias("stored"), F.col(f"_r_{f}").alias("again"), F.abs(F.col(f"_s_{f}") - F.col(f"_r_{f}")).alias("difference")) for f in fields])
    return both.select(*keys, F.inline(cells))


def disagreements(found: DataFrame, tolerance: float) -> DataFrame:
    """Values that differ by more than `tolerance`, or are there on one side alone."""
    one = F.col("stored").isNull() != F.col("again").isNull()
    return found.where(one | (F.col("difference") > tolerance))
