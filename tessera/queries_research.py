"""Queries of the pool, inference, portfolio costs, gates, transforms, joins and sources."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources as SRC
from .functions import rounded
from .operators import cross_section as CS
from .operators import inference as INF
from .operators import pool as PO
from .operators import portfolio as PF
from .operators import relational as RL
from .operators import rolling as TS
from .operators import statistics as ST
from .operators import validity as VAL
from .plans.panel import bars, calendar, densify, table, weekly_panel, with_return
from .queries import QUERIES, _days, _factors, _held, _labelled, _market, _revenue, _targets, panel_query, query

__all__ = ["QUERIES"]
FOLDS = [PO.Fold((1995, 1997), (1998, 1998)), PO.Fold((1995, 1998), (1999, 1999)), PO.Fold((1995, 1999), (2000, 2000))]
RIDGE, LAGS, EXIT = 0.01, 4, 5
r6 = lambda *names: [rounded(F.col(n)).alias(n) for n in names]


# --- pool ---------------------------------------------------------------------------------


def _stats(p: DataFrame) -> DataFrame:
    """Daily statistics of two factors with dates and label ends; few rows, read several times."""
    stats = PO.daily_statistics(_factors(p), ["z1", "z2"], "y", F.col("mask"))
    return PO.with_exit(stats, calendar(p), EXIT).persist()


@panel_query
def po_moments(p):
    m = PO.moments(_stats(p), 2)["all"]
    low, condition = m.spectrum()
    w, inv = m.ridge(RIDGE)
    rows = [(i, *m.gram[i].tolist(), float(m.predictive[i]), float(w[i]), float(PO.saliency([(w, inv)])[i]), m.days, low, condition) for i in range(2)]
    out = p.sparkSession.createDataFrame(rows, "i int, g0 double, g1 double, p double, w double, saliency double, days int, low double, condition double")
    return out.select("i", "days", *r6("g0", "g1", "p", "w", "saliency", "low", "condition"))


@panel_query
def po_subsets(p):
    """Mean daily correlation of the pool, of the pool without each factor, and of none."""
    s = _stats(p)
    chosen = {"both": [0, 1], "first": [0], "second": [1], "none": []}
    ics = PO.scored(s, PO.subsets(2, PO.moments(s, 2)["all"], chosen, RIDGE))
    one = ics.agg(*[F.struct(F.lit(n).alias("pool"), F.avg(n).alias("ic"), F.count(n).alias("days")).alias(n) for n in chosen])
    return one.select(F.inline(F.array(*chosen))).select("pool", "days", *r6("ic"))


@panel_query
def po_add_many(p):
    """What each of two candidates adds to the pool of one, from one set of statistics: mean of the daily correlations and the difference."""
    f = _factors(p).withColumn("z3", CS.cs_zscore(F.col("high") - F.col("low"), F.col("mask")))
    s = PO.daily_statistics(f, ["z1", "z2", "z3"], "y", F.col("mask")).persist()
    chosen = {"base": [0], "second": [0, 1], "third": [0, 2]}
    ics = PO.scored(s, PO.subsets(3, PO.moments(s, 3)["all"], chosen, RIDGE))
    one = ics.agg(*[F.struct(F.lit(n).alias("candidate"), F.avg(n).alias("ic"), F.avg(F.col(n) - F.col("base")).alias("delta")).alias(n) for n in ("second", "third")])
    return one.select(F.inline(F.array("second", "third"))).select("candidate", *r6("ic", "delta"))


@panel_query
def po_walk_forward(p):
    return PO.walk_forward(_stats(p), 2, FOLDS, RIDGE)[0].select("t", "fold", *r6("ic"))


@panel_query
def po_increment(p):
    """What the second factor adds to the first out of sample: mean daily difference, its error, the penalised bound, and by fold."""
    s = _stats(p)
    new, old = PO.walk_forward(s, 2, FOLDS, RIDGE)[0], PO.walk_forward(s, 2, FOLDS, RIDGE, [0])[0].select("t", F.col("ic").alias("before"))
    both = new.join(old, "t").select("t", "fold", (F.col("ic") - F.col("before")).alias("x"))
    grid = p.select("t").distinct().join(both, "t", "left")
    folds = both.groupBy().agg(*[F.avg(F.when(F.col("fold") == k, F.col("x"))).alias(f"fold{k}") for k in range(3)])
    out = ST.hac(grid, "x", LAGS).join(F.broadcast(folds)).withColumn("lower", F.col("mean") - 0.5 * F.col("se"))
    return out.select("n", *r6("mean", "se", "lower", "fold0", "fold1", "fold2"))


@panel_query
def po_lower_bound(p):
    """Mean of the pool's daily correlations less half its Newey-West error."""
    s = _stats(p)
    ic = PO.scored(s, PO.subsets(2, PO.moments(s, 2)["all"], {"x": [0, 1]}, RIDGE))
    return ST.newey_west(ic, "x", LAGS).withColumn("lower", F.col("mean") - 0.5 * F.col("se")).select("n", *r6("mean", "se", "lower"))


@panel_query
def po_support(p):
    """Valid days and rows of each fold's parts, against those without a label."""
    f = _factors(p)
    base = f.where("mask").groupBy("t").agg(F.count("*").alias("base"), F.count("y").alias("rows"))
    days = PO.with_exit(base, calendar(p), EXIT)
    parts = [(k, name, PO.in_part(y)) for k, fold in enumerate(FOLDS) for name, y in (("fit", fold.fit), ("score", fold.score))]
    cells = [F.struct(F.lit(k).alias("fold"), F.lit(name).alias("part"), F.count_if(c & (F.col("base") >= 3)).alias("expected_days"), F.count_if(c & (F.col("rows") >= 3)).alias("valid_days"), F.sum(F.when(c, F.col("base"))).alias("base_rows"), F.sum(F.when(c, F.col("rows"))).alias("valid_rows")).alias(f"{name}{k}") for k, name, c in parts]
    return days.agg(*cells).select(F.inline(F.array(*[f"{name}{k}" for k, name, _ in parts])))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with gains, made from the parts: a group for each brand."""
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), k.alias("id"), F.concat("p_brand", F.lit(":"), (k % 40).cast("string")).alias("key"), ((s - 25) / 1000).alias("delta"), (k % 7 != 0).alias("valid"), ((s - 25) / 1000 - (k % 5) / 1000).alias("post"), (k % 11 == 0).alias("evicted"))


@query
def po_rewards(spark, sf_dir):
    return PO.shape_rewards(_candidates(spark, sf_dir), "grp", "delta", F.col("valid"), "key", 0.001).select("id", "grp", *r6("scale", "reward"))


@query
def po_admission(spark, sf_dir):
    out = PO.admit(_candidates(spark, sf_dir), "grp", "post", F.col("valid") & ~F.col("evicted"), ["id"], 0.001)
    return out.select("grp", F.when(F.col("reason") != "no_finite_candidate", F.col("id")).alias("id"), "reason", "admitted")


@query
def po_native_reward(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    ic, ir, corr = (s - 20) / 100, F.col("p_retailprice") / 1000 - 1, (k % 10) / F.lit(10.0)
    return table(spark, sf_dir, "part").select("p_partkey", rounded(PO.native_reward(ic, ir, k % 3 == 0, k % 12, corr)).alias("reward"))


@panel_query
def so_greedy(p):
    """Features in order of coverage, each taken if its pooled correlation with those before is under 0.7."""
    names = ["close", "high", "volume", "open", "low"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    row = p.where("mask").agg(*[ST.pooled_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    taken = PO.decorrelated(names, {frozenset((a, b)): row[f"{a}|{b}"] or 0.0 for a, b in pairs})
    return p.sparkSession.createDataFrame(list(enumerate(taken)), "place int, name string")


# --- inference -----------------------------------------------------------------------------


def _ics(p: DataFrame, names: list[str]) -> DataFrame:
    """Daily correlations of several features with the label, over the whole calendar."""
    ic = _labelled(p).where("mask").groupBy("t").agg(*[ST.pearson(F.col(n), F.col("y")).alias(n) for n in names])
    return p.select("t", "d").distinct().join(ic, "t", "left")


@panel_query
def st_summary(p):
    return INF.summary(_ics(p, ["close"]), "close", LAGS).select("n", *r6("mean", "sd", "se", "t_value", "p_value"))


@panel_query
def st_paired(p):
    s = _ics(p, ["close", "volume"])
    a, b = s.select("t", F.col("close").alias("x")), s.select("t", F.col("volume").alias("x"))
    return INF.paired(a, b, "x", LAGS).select("n", *r6("mean", "sd", "se", "t_value", "p_value"))


def _long(p: DataFrame) -> DataFrame:
    names = ["close", "volume", "open", "return"]
    return _ics(p, names).select("t", "d", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("x")) for n in names])).alias("s")).select("t", "d", "s.*")


@panel_query
def st_significance(p):
    return INF.significance(_long(p), "x", "name", LAGS, fewest=30).select("name", "n", "status", *r6("mean", "median", "sd", "positive", "se", "t_value", "p_value", "q_value"))


@panel_query
def st_bootstrap(p):
    return INF.bootstrap(_long(p), "x", block=20, samples=400, keys=["name"]).select("name", *r6("low", "high"))


@panel_query
def st_sharpe(p):
    """The difference of the Sharpe ratios of two markets, by the median and the mean return of the members."""
    m = p.where("member").groupBy("d").agg(F.median("return").alias("x"), F.avg("return").alias("y"))
    return INF.sharpe_difference(m, "x", "y", samples=400, year=52.0).select(*r6("difference", "low", "high"))


# --- portfolio -------------------------------------------------------------------------------


@panel_query
def pf_liquidation(p):
    return PF.liquidation(_held(p), _days(p) - 1).select("t", *r6("turnover"))


@panel_query
def pf_costs(p):
    """Net returns at 10 basis points, with the last day's liquidation."""
    n = _days(p)
    moved = PF.turnover(_targets(p).select("t", "a", "target"), n).unionByName(PF.liquidation(_held(p), n - 1))
    return PF.net_returns(PF.returns(_held(p), p), moved, 10.0).select("t", *r6("turnover", "net"))


@panel_query
def pf_coverage(p):
    return PF.coverage(PF.returns(_held(p), p)).select("missing_days", *r6("average_gross", "held_coverage"))


@query
def pf_metrics_sales(spark, sf_dir):
    """Metrics of the monthly growth of all sales, the first and last months left out as they are not whole."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("d")).agg(F.sum("l_extendedprice").alias("v"))
    days = m.agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("x")).select(F.posexplode(F.expr("slice(x, 2, greatest(size(x) - 2, 0))")).alias("t", "x"), F.expr("slice(x, 2, greatest(size(x) - 2, 0))").alias("all"))
    path = days.where("t > 0").select("t", (F.col("x.v") / F.element_at("all", F.col("t"))["v"] - 1).alias("ret"))
    return PF.metrics(path, year=12.0).select("days", *r6("total", "cagr", "mean", "vol", "drawdown", "sharpe"), "invalid")


# --- transforms -------------------------------------------------------------------------------


def _risky(p: DataFrame) -> DataFrame:
    return _labelled(p).withColumn("size", F.log("volume"))


@panel_query
def cs_fixed_universe(p):
    """Two factors and the label on one universe, residualised on size."""
    f = _risky(p).select("a", "t", "mask", F.col("close").alias("f1"), (F.col("high") - F.col("low")).alias("f2"), "y", "size")
    return CS.fixed_universe(f, ["f1", "f2"], "y", F.col("mask"), ["size"]).select("a", "t", F.col("metric"), *r6("f1", "f2", "y"))


@panel_query
def cs_own_transform(p):
    f = p.select("a", "t", "mask", F.col("close").alias("f1"), F.when(F.col("a") % 3 != 0, F.col("volume")).alias("f2"))
    return CS.own_transform(f, ["f1", "f2"], F.col("mask")).select("a", "t", *r6("f1", "f2"))


@panel_query
def cs_joint_transform(p):
    f = _labelled(p).select("a", "t", "mask", F.col("close").alias("f1"), F.col("volume").alias("f2"), "y")
    return CS.joint_transform(f, ["f1", "f2"], "y", F.col("mask")).select("a", "t", *r6("f1", "f2", "y"))


@panel_query
def cs_residual_22(p):
    """Residuals on 21 exposures: 11 industries and powers and lags of the features."""
    from .functions import INDUSTRIES, industry

    f = _risky(p).withColumn("ind", industry(F.col("a") * 137 % 10000))
    made = {f"e{k}": (F.col("ind") == n).cast("double") for k, (n, _) in enumerate(INDUSTRIES)}
    made |= {f"s{k}": CS.cs_zscore(F.lag("close", k).over(TS.ordered()), F.col("mask")) for k in range(5)} | {f"v{k}": CS.cs_zscore(F.lag("volume", k).over(TS.ordered()), F.col("mask")) for k in range(5)}
    f = f.withColumns({k: F.lag("close", int(k[1:])).over(TS.ordered()) if k[0] == "s" else F.lag("volume", int(k[1:])).over(TS.ordered()) for k in made if k[0] in "sv"})
    f = f.withColumns({k: CS.cs_zscore(F.col(k), F.col("mask")) if k[0] in "sv" else c for k, c in made.items()})
    f = f.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in made})
    return CS.residuals(f.select("a", "t", "mask", "y", *made), ["y"], list(made), F.col("mask")).select("a", "t", rounded(F.col("y_res"), 4).alias("v"))


@query
def ts_long_horizons(spark, sf_dir):
    """Label, reversal, momentum and the market model over their full horizons, on weekly bars of nations."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    li = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").withColumn("l_suppkey", F.col("s_nationkey").cast("long"))
    p = with_return(densify(bars(li)))
    r = F.col("return")
    p = p.join(p.groupBy("t").agg(F.avg("return").alias("mret")), "t")
    p = TS.with_market_model(p, "return", "mret", 252, 126)
    made = {"label": TS.forward_return(r), "reversal": TS.compounded(r, -20, 0), "momentum": TS.compounded(r, -252, -21), "slope": F.col("slope"), "spread": F.col("spread")}
    # long products of weekly returns are compared in logarithms
    made |= {k: F.log1p(made[k]) for k in ("label", "reversal", "momentum")}
    return p.withColumns(made).select("a", "t", *r6(*made))


# --- aggregations ------------------------------------------------------------------------------


@panel_query
def ag_corr_batch(p):
    """Every left against every right column, each pair on its own rows, in one aggregation."""
    pairs = [(x, y) for x in ("close", "volume") for y in ("y", "return", "open")]
    return _labelled(p).where("mask").groupBy("t").agg(*[rounded(ST.pearson(F.col(x), F.col(y))).alias(f"{x}_{y}") for x, y in pairs])


@query
def ag_dynamic(spark, sf_dir):
    """Mean and deviation of every numeric column, whichever there are."""
    p = table(spark, sf_dir, "part").drop("p_partkey")
    own = [n for n, kind in p.dtypes if kind in ("int", "bigint", "double", "float")]
    return p.groupBy("p_brand").agg(*[x for n in own for x in (rounded(F.avg(n)).alias(f"{n}_mean"), rounded(F.stddev_samp(n)).alias(f"{n}_sd"))])


@query
def ag_families(spark, sf_dir):
    """How often each family (the type without its numbers) stands among the parts."""
    return table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_type", "[0-9]+", "#").alias("family")).agg(F.count("*").alias("n"))


@panel_query
def ag_pair_corr(p):
    names = ["close", "volume", "return"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    one = p.where("mask").agg(*[F.abs(ST.pooled_corr(F.col(a), F.col(b))).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(rounded(F.expr("aggregate(array(c0, c1, c2), cast(0 as double), (s, x) -> s + coalesce(x, 0)) / 3")).alias("r"))


# --- joins, filters, scalars ----------------------------------------------------------------------


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    end = F.when(s % 5 != 0, F.add_months(F.lit("2001-12-31").cast("date"), -(s % 40).cast("int")))
    return table(spark, sf_dir, "supplier").select(s.alias("a"), "s_nationkey", F.add_months(F.lit("1995-01-01").cast("date"), (s % 24).cast("int")).alias("linkdt"), end.alias("linkend"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revenue(spark, sf_dir).select("a", "y", F.make_date("y", F.lit(12), F.lit(31)).alias("datadate"), "rev")


@query
def jn_linked(spark, sf_dir):
    out = RL.linked_records(_records(spark, sf_dir), _links(spark, sf_dir), "a", "datadate", "linkdt", "linkend")
    return out.select("a", "y", "s_nationkey", *r6("rev"))


@query
def jn_use_date(spark, sf_dir):
    """The latest record, whose link must also hold on the day that it is used."""
    rec = RL.linked_records(_records(spark, sf_dir), _links(spark, sf_dir), "a", "datadate", "linkdt", "linkend").withColumn("available", F.add_months("datadate", 6))
    out = RL.as_of(weekly_panel(spark, sf_dir), rec.select("a", "available", "rev", "linkdt", "linkend"), ["rev", "linkdt", "linkend"], 18)
    holds = (F.col("d") >= F.col("linkdt")) & (F.col("linkend").isNull() | (F.col("d") <= F.col("linkend")))
    return out.select("a", "t", rounded(F.when(holds, F.col("rev")), 4).alias("v"))


@query
def jn_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "ts")
    return RL.last_by(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")]).select("user_id", "day", "event_id")


@query
def jn_one_to_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("orders_n"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("lines_n"))
    return RL.one_to_one(o, s, ["d"])


@query
def jn_lookup(spark, sf_dir):
    """Orders of each customer's nation by a lookup; unknown nations get a default."""
    names = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("nation"), "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return RL.look_up(c, names, ["nation"], {"n_name": "unknown"}).select("c_custkey", "n_name")


@panel_query
def fl_regime(p):
    """Cells of days on which the market rose."""
    return _market(p).where("mret > 0").groupBy("t").agg(F.count_if("mask").alias("n"))


@query
def fl_accounting(spark, sf_dir):
    """Ratios that need a positive denominator, by customer."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("sales"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("costs"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    equity = F.col("c_acctbal") - F.coalesce("costs", F.lit(0.0)) / 1000
    profit = F.when((equity > 0) & F.col("sales").isNotNull(), (F.col("sales") - F.coalesce("costs", F.lit(0.0))) / equity)
    return c.select("c_custkey", rounded(profit, 4).alias("profitability"), rounded(F.when(equity > 0, F.coalesce("costs", F.lit(0.0)) / equity), 4).alias("leverage"))


@query
def fl_adjust_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_if(~(F.col("l_discount") > 0)).alias("bad_price"), F.count_if(~(F.col("l_tax") > 0)).alias("bad_share"))


@query
def sc_integral(spark, sf_dir):
    v = F.col("o_totalprice").cast("string").try_cast("double")
    ok = F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v % 1 == 0), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("ok"))


@query
def sc_dates(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a day")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("orderdt"))
    return SRC.with_dates(df).select("o_orderkey", F.to_date("orderdt").alias("d"))


@query
def sc_json_round(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("e"))).alias("j"))


@query
def ts_unsorted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return RL.unsorted_keys(o, "o_custkey", "o_orderdate", "o_orderkey")


# --- validity, gates, reports ----------------------------------------------------------------------


@panel_query
def val_status(p):
    """Four candidates against a pool: one passes, one is a near copy, one is sparse, one is flat."""
    p = p.withColumns({"copy": F.col("high") * 2 + 0.001, "sparse": F.when(F.col("a") % 3 == 0, F.col("close")), "flat": F.when(F.col("close").isNotNull(), F.lit(1.0))})
    out = VAL.validate(p, ["return", "copy", "sparse", "flat"], ["high", "volume"], F.col("mask"), min_assets=3, min_days=30)
    return out.select("signal", "status", "valid_days", *r6("coverage", "variable_rate", "strongest"), "member")


@query
def dv_gates(spark, sf_dir):
    """Hard checks of the tables and the bars: what was measured, between which limits, and whether it holds."""
    li, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    p = weekly_panel(spark, sf_dir)
    day = F.col("o_orderdate").cast("date")
    overlap = RL.overlaps(o.select(F.col("o_custkey").alias("k"), day.alias("s"), F.date_add(day, 90).alias("e")), "k", "s", "e")
    bad = lambda c: F.count_if(c).cast("double")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    ohlc = F.col("close").isNotNull()
    own = [
        (li.groupBy("l_orderkey", "l_linenumber").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("double").alias("v")), [("duplicate_keys", "v", 0, 0)]),
        (c.agg(bad(~F.col("c_name").rlike("#[0-9]+$")).alias("v")), [("invalid_ids", "v", 0, 0)]),
        (overlap.agg(F.count("*").cast("double").alias("v")), [("overlapping_intervals", "v", 0, 0)]),
        (li.agg(share(~(F.col("l_tax") > 0)).alias("f"), bad(F.col("l_quantity") < 0).alias("v")), [("invalid_factor_rate", "f", 0, 0.001), ("negative_volume", "v", 0, 0)]),
        (p.agg(F.try_divide(bad(ohlc & ((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")))), F.count_if(ohlc)).alias("o"), bad(F.col("close") <= 0).alias("z"), bad(F.col("return") < -1).alias("r"), *[F.avg(F.col(x).isNotNull().cast("double")).alias(f"c_{x}") for x in ("close", "return", "volume")]), [("ohlc_violation_rate", "o", 0, 1e-5), ("nonpositive_close", "z", 0, 0), ("return_below_minus_one", "r", 0, 0), ("coverage_close", "c_close", 0.8, 1), ("coverage_return", "c_return", 0.8, 1), ("coverage_volume", "c_volume", 0.8, 1)]),
        (p.groupBy("t").agg(F.count_if("member").alias("m"), F.count_if("mask").alias("e"), F.count("*").alias("n")).agg(F.min(F.col("m") / F.col("n")).alias("m"), F.avg(F.try_divide("e", "m")).alias("e")), [("least_member_share", "m", 0.4, 1), ("eligible_share", "e", 0.9, 1)]),
    ]
    out = None
    for df, gates in own:
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(x).alias("value"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for g, x, lo, hi in gates])))
        out = rows if out is None else out.unionByName(rows)
    ok = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("gate", *r6("value", "low", "high"), ok.alias("ok"))


@panel_query
def rp_paired(p):
    """The two features' yearly mean correlations and their paired difference."""
    s = _ics(p, ["close", "volume"]).where("close is not null and volume is not null")
    return s.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n"), rounded(F.avg("close")).alias("a"), rounded(F.avg("volume")).alias("b"), rounded(F.avg(F.col("close") - F.col("volume"))).alias("diff"))


@panel_query
def rp_portfolio_summary(p):
    """By year: days, mean and deviation of the return, mean gross weight."""
    path = PF.returns(_held(p), p).join(p.select("t", "d").distinct(), "t")
    return path.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n"), rounded(F.avg("ret")).alias("mean"), rounded(F.stddev_samp("ret")).alias("sd"), rounded(F.avg("gross")).alias("gross"))


@query
def rp_search_efficiency(spark, sf_dir):
    """By brand: candidates, valid ones, those that gain, and the best gain."""
    c = _candidates(spark, sf_dir)
    return c.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid_n"), F.count_if(F.col("valid") & (F.col("delta") > 0)).alias("gain_n"), rounded(F.max(F.when(F.col("valid"), F.col("delta")))).alias("best"))


@panel_query
def rp_curve(p):
    """The source table of a yearly curve: wealth of the market's mean return within each year."""
    from pyspark.sql import Window as W

    m = p.where("member").groupBy("t", "d").agg(F.median("return").alias("r")).withColumn("y", F.year("d"))
    so_far = W.partitionBy("y").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return m.select("t", "y", rounded(F.expm1(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(so_far))).alias("v"))


# --- sources and sinks -------------------------------------------------------------------------------


@query
def src_contracts(spark, sf_dir):
    """Which table of the folder holds the columns of each contract."""
    wanted = {"lines": {"l_orderkey", "l_shipdate"}, "orders": {"o_orderkey", "o_orderdate"}, "suppliers": {"s_suppkey", "s_nationkey"}}
    rows = [(k, v.rsplit("/", 1)[-1], spark.read.parquet(v).count()) for k, v in SRC.discover(spark, sf_dir, wanted).items()]
    return spark.createDataFrame(rows, "contract string, file string, n long")


def scratch(spark: SparkSession, sf_dir: str) -> str:
    """A folder of this application and these tables that all executors share; only a local session may do without a named one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="layer-")
    return f"{folder}/layers/{spark.sparkContext.applicationId}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"


@query
def src_years(spark, sf_dir):
    """The daily layer written by year, checked, and two years of it read back."""
    path = f"{scratch(spark, sf_dir)}/years"
    SRC.write_years(weekly_panel(spark, sf_dir).select("a", "t", "d", "close", "volume"), path, "d", ["a", "t"])
    return SRC.read_years(spark, path, 1997, 1998).select("a", "t", "d", *r6("close", "volume"))
