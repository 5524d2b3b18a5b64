"""Reading and writing tables: contracts by columns, lenient dates, layers by year, checked replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class ContractError(ValueError):
    """A contract has no table, or several."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def tables_in(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Tables of a folder, in any store that Spark reads, by name."""
    p, fs = _path(spark, folder)
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix))


def discover(spark: SparkSession, folder: str, contracts: dict[str, set[str]], strict: bool = True) -> dict[str, str]:
    """The table of the folder that holds all columns of each contract; unreadable ones are passed over.

    With `strict`, a contract without a table, or with several, is an error; else it is left out.
    """
    columns = {}
    for path in tables_in(spark, folder):
        try:
            columns[path] = set(spark.read.parquet(path).columns)
        except AnalysisException:
            continue
    out = {}
    for name, wanted in contracts.items():
        found = [p for p, have in columns.items() if wanted <= have]
        if len(found) == 1:
            out[name] = found[0]
        elif strict:
            raise ContractError(f"{name}: {len(found)} tables")
    return out


def with_dates(df: DataFrame, suffix: str = "dt", names: tuple[str, ...] = ()) -> DataFrame:
    """Columns whose name ends in `suffix`, or that are named, as timestamps; what can't be read becomes null."""
    own = [c for c in df.columns if c.lower().endswith(suffix) or c in names]
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in own})


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; lines that don't fit give nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_years(df: DataFrame, path: str, date: str, order: list[str]) -> None:
    """One folder for each year, zstd, rows in order within files; a year is dealt to several tasks by its sort keys."""
    rows = df.withColumn("year", F.year(date))
    rows.repartitionByRange("year", *order).sortWithinPartitions("year", *order).write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(path)


def read_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The years from first to last; other folders are not read."""
    return spark.read.parquet(path).where(F.col("year").between(first, last))


def store_panel(panel: DataFrame, name: str, buckets: int, date: str = "d", path: str | None = None) -> None:
    """The panel as a table of the warehouse (or of the folder `path`), written once: a folder for each year, and in it `buckets` files by asset, each in the order of asset and date.

    Series windows on what read_panel() gives need no shuffle, as all rows of an asset are in one bucket, and ranges of dates
    read their years alone.
    """
    rows = panel.withColumn("year", F.year(date))
    writer = rows.repartition(buckets, "a").sortWithinPartitions("year", "a", "t").write
    writer = writer if path is None else writer.option("path", path)
    writer.mode("overwrite").format("parquet").option("compression", "zstd").partitionBy("year").bucketBy(buckets, "a").sortBy("a", "t").saveAsTable(name)


def read_panel(spark: SparkSession, name: str, first: str | None = None, last: str | None = None, date: str = "d") -> DataFrame:
    """Rows of the stored panel from `first` to `last`, both included; folders of other years are not read."""
    rows = spark.table(name)
    for day, keep in ((first, lambda c, v: c >= v), (last, lambda c, v: c <= v)):
        if day is not None:
            limit = F.lit(day).cast("date")
            rows = rows.where(keep(F.col("year"), int(day[:4])) & keep(F.col(date).cast("date"), limit))
    return rows.drop("year")


def write_checked(df: DataFrame, path: str, gate: Callable[[DataFrame], list[str]]) -> None:
    """Writes beside `path`, checks what was written, and only then takes the place of what was there, which stays if a gate fails."""
    spark = df.sparkSession
    recover(spark, path)
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    if failures := gate(spark.read.parquet(new)):
        raise ValueError("; ".join(failures))
    target, fs = _path(spark, path)
    backup, fresh = _path(spark, old)[0], _path(spark, new)[0]
    fs.delete(backup, True)
    had = fs.exists(target)
    if had:
        fs.rename(target, backup)
    if not fs.rename(fresh, target):
        if had:
            fs.rename(backup, target)
        raise OSError(f"can't replace {path}")
    fs.delete(backup, True)


def recover(spark: SparkSession, path: str) -> None:
    """If a writer ended between its two renames, what it had set aside is the table again."""
    target, fs = _path(spark, path)
    backup = _path(spark, f"{path}.old")[0]
    if not fs.exists(target) and fs.exists(backup):
        fs.rename(backup, target)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as Parquet and as CSV with a header beside it."""
    df.write.mode("overwrite").parquet(path)
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}_csv")
