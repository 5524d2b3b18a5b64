"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(folds: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the folds; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % folds


def held_out(folds: int, fold: int, col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(folds, col) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int | tuple[int, int]) -> DataFrame:
    """doc_id, text, label of at most `per_class` rows of each label, outside the held-out fold.

    The ids are the first in the order of a hash, so the sample is the same at each run.
    Only ids are broadcast, at most twice `per_class`.  Null labels and ids don't count;
    an id with several labels takes the smallest, an id with several texts the smallest text.
    """
    counts = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).where(~held_out(folds, fold))
    ids = reduce(DataFrame.unionByName, [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in enumerate(counts)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "label")
