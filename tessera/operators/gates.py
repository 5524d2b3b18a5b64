"""Hard gates of a bundle of raw tables: each table is read for few aggregations, and every measure has limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INF = float("inf")
#: fixed values: membership flags that count as active
ACTIVE = ("Y", "NORM", "1", "TRUE")

#: columns that each table of a bundle must have
BUNDLE = {
    "daily": ("a", "company", "d", "open", "high", "low", "close", "ret", "volume", "price_factor", "share_factor", "cap", "shares"),
    "membership": ("a", "start", "end", "flag"),
    "market": ("d", "ret"),
    "delistings": ("a", "d"),
    "links": ("gvkey", "a", "start", "end", "kind", "primary"),
    "fundamentals": ("gvkey", "d"),
}
DATES = {"daily": ("d",), "membership": ("start", "end"), "market": ("d",), "delistings": ("d",), "links": ("start", "end"), "fundamentals": ("d",)}


class GateFailure(ValueError):
    """A gate of a bundle does not hold."""


def not_integral(x: str) -> Column:
    """True where the value is no whole finite number, missing ones included."""
    v = F.col(x).cast("string").try_cast("double")
    return ~F.coalesce((F.abs(v) < INF) & (v % 1 == 0), F.lit(False))


def not_digits(x: str) -> Column:
    return ~F.coalesce(F.col(x).cast("string").rlike("^[0-9]+$"), F.lit(False))


def present(x: str) -> Column:
    """Finite."""
    v = F.col(x).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INF)


def _odd(x: str) -> Column:
    """There, but no finite number."""
    return F.col(x).isNotNull() & ~present(x)


def _many(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False))).cast("double")


def _share(c: Column) -> Column:
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def _duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, counted from partial counts, so that no hot key meets in one task."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("v"))


def _daily(daily: DataFrame) -> list[tuple[DataFrame, dict[str, tuple[str, float, float]]]]:
    good = lambda x: present(x) & (F.col(x) > 0)
    adjusted = {c: F.when(good("price_factor"), F.col(c) / F.col("price_factor")) for c in ("open", "high", "low", "close")}
    whole = F.lit(True)
    for v in adjusted.values():
        whole = whole & v.isNotNull()
    high = whole & (adjusted["high"] < F.greatest(adjusted["open"], adjusted["close"]))
    low = whole & (adjusted["low"] > F.least(adjusted["open"], adjusted["close"]))
    ratio = F.try_divide(F.col("cap"), F.abs("close") * F.col("shares"))
    measures = {
        "daily_dates": (_many(F.col("d").isNull()), 0, 0),
        "daily_ids": (_many(not_integral("a")), 0, 0),
        "daily_company_ids": (_many(not_integral("company")), 0, 0),
        "return_below_minus_one": (_many(F.col("ret") < -1), 0, 0),
        "return_not_finite": (_many(_odd("ret")), 0, 0),
        "close_not_positive": (_many(present("close") & (F.col("close") <= 0)), 0, 0),
        "close_not_finite": (_many(_odd("close")), 0, 0),
        "volume_negative": (_many(present("volume") & (F.col("volume") < 0)), 0, 0),
        "volume_not_finite": (_many(_odd("volume")), 0, 0),
        "ohlc_violation_rate": ((_many(high) + _many(low)) / F.greatest(F.lit(1), 2 * F.count_if(whole)), 0, 1e-5),
        "price_factor_rate": (_share(~good("price_factor")), 0, 0.001),
        "share_factor_rate": (_share(~good("share_factor")), 0, 0.001),
        "cap_identity": (F.median(F.when(present("cap") & (ratio > 0), ratio)), 0.9, 1.1),
        "coverage_close": (_share(F.col("close").isNotNull()), 0.8, 1),
        "coverage_return": (_share(F.col("ret").isNotNull()), 0.8, 1),
        "coverage_volume": (_share(F.col("volume").isNotNull()), 0.8, 1),
    }
    one = daily.agg(*[m.alias(g) for g, (m, _, _) in measures.items()])
    return [(one, {g: (g, lo, hi) for g, (_, lo, hi) in measures.items()}), (_duplicates(daily, ["a", "d"]), {"daily_keys": ("v", 0, 0)})]


def unsorted_histories(daily: DataFrame, key: str = "a", date: str = "d", place: str = "place") -> DataFrame:
    """Assets whose rows, in the order of `place`, are not sorted by date; a window for each asset."""
    before = F.lag(date).over(W.partitionBy(key).orderBy(place))
    return daily.withColumn("_b", before).groupBy(key).agg(F.max(F.col("_b") > F.col(date)).alias("_u")).agg(_many(F.col("_u")).alias("v"))


def active(membership: DataFrame) -> DataFrame:
    return membership.where(F.upper(F.col("flag").cast("string")).isin(*ACTIVE))


def _membership(m: DataFrame, days: list[str], bounds: tuple[int, int]) -> list[tuple[DataFrame, dict[str, tuple[str, float, float]]]]:
    on = lambda day: _many(F.upper(F.col("flag").cast("string")).isin(*ACTIVE) & F.lit(day).cast("date").between(F.col("start"), F.col("end")))
    measures = {"membership_ids": (_many(not_integral("a")), 0, 0), "membership_intervals": (_many(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))), 0, 0)}
    measures |= {f"members_{day}": (on(day), *bounds) for day in days}
    one = m.agg(*[c.alias(g) for g, (c, _, _) in measures.items()])
    before = F.lag("end").over(W.partitionBy("a").orderBy("start", "end"))
    overlap = active(m).withColumn("_b", before).agg(_many(F.col("start") <= F.col("_b")).alias("v"))
    return [(one, {g: (g, lo, hi) for g, (_, lo, hi) in measures.items()}), (overlap, {"membership_overlaps": ("v", 0, 0)})]


def bundle_report(tables: dict[str, DataFrame], days: list[str], members: tuple[int, int] = (450, 550), place: str | None = None) -> DataFrame:
    """One row for each gate: gate, value, low, high and whether it holds.

    `tables` has the tables of BUNDLE under their columns; `days` are the dates whose member count must be within `members`.
    Histories are checked for order where the daily table has a column `place`.
    """
    for name, columns in BUNDLE.items():
        if missing := set(columns) - set(tables[name].columns):
            raise GateFailure(f"{name}: no {sorted(missing)}")
    found = _daily(tables["daily"]) + _membership(tables["membership"], days, members)
    if place:
        found.append((unsorted_histories(tables["daily"], place=place), {"daily_order": ("v", 0, 0)}))
    for name, keys in (("market", ["d"]), ("delistings", ["a", "d"]), ("links", ["gvkey", "a", "start", "kind", "primary"]), ("fundamentals", ["gvkey", "d"])):
        found.append((_duplicates(tables[name], keys), {f"{name}_keys": ("v", 0, 0)}))
    for name, measures in (("market", {"dates": F.col("d").isNull()}), ("delistings", {"dates": F.col("d").isNull(), "ids": not_integral("a")}), ("links", {"ids": not_integral("a"), "gvkeys": not_digits("gvkey")}), ("fundamentals", {"gvkeys": not_digits("gvkey")})):
        one = tables[name].agg(*[_many(c).alias(f"{name}_{g}") for g, c in measures.items()])
        found.append((one, {f"{name}_{g}": (f"{name}_{g}", 0, 0) for g in measures}))
    wrong = sum(tables[n].schema[c].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz") for n, cs in DATES.items() for c in cs)
    found.append((tables["market"].sparkSession.range(1).select(F.lit(float(wrong)).alias("v")), {"date_types": ("v", 0, 0)}))
    out = None
    for df, gates in found:
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"`{c}`").cast("double").alias("value"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for g, (c, lo, hi) in gates.items()])))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("ok", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))


def require_gates(report: DataFrame) -> None:
    """Raises with the gates that do not hold; a report has one row for each."""
    if bad := report.where(~F.col("ok")).orderBy("gate").collect():
        raise GateFailure("; ".join(f"{r.gate} is {r.value}, not {r.low} to {r.high}" for r in bad))


# --- eligibility and standard records ------------------------------------------------------------------

#: fixed values: the categories of common equity that trade
ELIGIBLE = {"security": ("EQTY",), "subtype": ("COM",), "share": ("NS",), "exchange": ("A", "N", "Q"), "status": ("A",)}


def tradable(categories: dict[str, str], sets: dict[str, tuple[str, ...]] | None = None, close: str = "close", volume: str = "volume", ret: str = "ret") -> Column:
    """Whether a row can be traded: every category, trimmed and in capitals, is in its set, close and volume are above 0 and the return is a number."""
    sets = sets or ELIGIBLE
    if missing := sets.keys() - categories.keys():
        raise GateFailure(f"no columns for {sorted(missing)}")
    out = present(close) & (F.col(close) > 0) & present(volume) & (F.col(volume) > 0) & present(ret)
    for name, allowed in sets.items():
        out = out & F.upper(F.trim(F.col(categories[name]).cast("string"))).isin(*allowed)
    return F.coalesce(out, F.lit(False))


def standard_records(df: DataFrame, wanted: dict[str, str], keys: list[str], date: str, months: int = 6) -> DataFrame:
    """Rows whose columns are as wanted, equal ones once, with the date from which each is available; raises where a key has rows that differ."""
    for column, value in wanted.items():
        df = df.where(F.col(column) == value)
    own = df.dropDuplicates()
    if clash := own.groupBy(*keys).count().where("count > 1").take(3):
        raise GateFailure(f"conflicting records for {[tuple(r)[:-1] for r in clash]}")
    return own.withColumn("available", F.add_months(F.col(date).cast("date"), months))
