"""Relational preparation: conditional fills, interval and as-of joins, priority dedup, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A lookup has several rows for one key."""


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, whose keys must be unique; the check is one aggregation."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise DuplicateKeys(f"duplicate {keys}")
    return df


def fill_missing(facts: DataFrame, lookup: DataFrame, keys: list[str], column: str, value: str, when: Column) -> DataFrame:
    """Where `when` holds and `column` is missing, takes `value` of the lookup; present values never change."""
    found = require_unique(lookup.select(*keys, F.col(value).alias("_fill")), keys)
    filled = F.when(when & F.col(column).isNull(), F.col("_fill")).otherwise(F.col(column))
    return facts.join(found, keys, "left").withColumn(column, filled).drop("_fill")


def in_interval(facts: DataFrame, intervals: DataFrame, key: str = "a", date: str = "d", start: str = "start", end: str = "end", open_end: bool = False) -> DataFrame:
    """Rows whose date lies in a closed interval of their key; a null end is no end that a date could lie before, unless `open_end`."""
    i = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    return facts.join(i, (F.col(key) == F.col("_k")) & (F.col(date) >= F.col("_s")) & ((F.lit(open_end) & F.col("_e").isNull()) | (F.col(date) <= F.col("_e"))), "left_semi")


def linked_records(records: DataFrame, links: DataFrame, key: str, date: str, start: str, end: str) -> DataFrame:
    """Records joined with the links of their key that hold at the record's date; a link without an end is still open."""
    valid = (F.col(start) <= F.col(date)) & (F.col(end).isNull() | (F.col(date) <= F.col(end)))
    return records.join(links, key).where(valid)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in a total order."""
    return first_by(df, keys, [c.desc() for c in order])


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join whose keys must be unique on both sides."""
    return require_unique(a, keys).join(require_unique(b, keys), keys)


def look_up(facts: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """The table's columns for each row, or their defaults where it has no such key; its keys must be unique."""
    out = facts.join(require_unique(table, keys).withColumn("_found", F.lit(True)), keys, "left")
    return out.withColumns({c: F.when(F.col("_found"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("_found")


def unsorted_keys(df: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """Keys whose rows, in the order of `position`, go back in `order` anywhere."""
    before = F.lag(order).over(W.partitionBy(key).orderBy(position))
    return df.withColumn("_b", before).where(F.col(order) < F.col("_b")).select(key).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def as_of(facts: DataFrame, records: DataFrame, columns: list[str], months: int, key: str = "a", date: str = "d", available: str = "available") -> DataFrame:
    """Adds each key's latest record available at the date, dropped when older than `months` months.

    Records and facts are united and carried forward in one pass over the key: no range join.
    Of records available on the same day the one given last by first_by() must be the only one.
    """
    rec = records.select(F.col(key), F.col(available).alias(date), F.struct(F.col(available).alias("at"), *columns).alias("_r"), F.lit(0).alias("_o"))
    both = facts.withColumn("_o", F.lit(1)).unionByName(rec, allowMissingColumns=True)
    last = F.last("_r", ignorenulls=True).over(W.partitionBy(key).orderBy(date, "_o").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_r", last).where("_o = 1")
    fresh = F.col(date) <= F.add_months(F.col("_r.at"), months)
    return out.withColumns({c: F.when(fresh, F.col(f"_r.{c}")) for c in columns} | {"available_at": F.when(fresh, F.col("_r.at"))}).drop("_r", "_o")


def axis_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has; empty when the axes are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def overlaps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that begin no later than the one before in their key ends."""
    before = F.lag(end).over(W.partitionBy(key).orderBy(start, end))
    return intervals.withColumn("previous_end", before).where(F.col(start) <= F.col("previous_end"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls and non-finite numbers of each column, in one scan, as rows."""
    kind = dict(df.dtypes)
    odd = lambda c: F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) if kind[c] in ("double", "float") else F.lit(0).cast("long")
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("nulls"), odd(c).alias("non_finite")).alias(c) for c in columns])
    return one.select(F.inline(F.array(*columns)))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
