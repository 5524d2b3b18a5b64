"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import INDUSTRIES, industry, rounded
from .operators import cross_section as CS
from .operators import pool as PO
from .operators import portfolio as PF
from .operators import relational as RL
from .operators import rolling as TS
from .operators import statistics as ST
from .operators import validity as VAL
from .oracles import SIGNALS
from .plans.compiler import compile_batch
from .plans.panel import calendar, table, weekly_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def panel_query(f: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over the weekly panel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(weekly_panel(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return query(run)


def _signal(text: str) -> Query:
    return lambda spark, sf_dir: compile_batch(weekly_panel(spark, sf_dir), {"v": text}).select("a", "t", rounded(F.col("v")).alias("v"))


QUERIES.update({key: _signal(text) for key, (text, _) in SIGNALS.items()})
QUERIES["ts_ema"] = _signal("EMA($close,20)")


def _value(df: DataFrame, v: Column) -> DataFrame:
    return df.withColumn("v", v).select("a", "t", rounded(F.col("v")).alias("v"))


def _labelled(p: DataFrame) -> DataFrame:
    return p.withColumn("y", TS.forward_return(F.col("return"), 2, 5))


def _factors(p: DataFrame) -> DataFrame:
    return _labelled(p).withColumns({"z1": CS.cs_zscore(F.col("close"), F.col("mask")), "z2": CS.cs_zscore(F.log(F.col("volume") + 1), F.col("mask"))})


def _market(p: DataFrame) -> DataFrame:
    """Mean member return of each date, joined to every row."""
    m = p.where("member").groupBy("t").agg(F.avg("return").alias("mret"))
    return p.join(m, "t", "left")


# --- scalar ---------------------------------------------------------------------------------


@query
def sc_coalesce(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.coalesce(F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "F", -1.0), F.lit(0.0))
    return o.select("o_orderkey", v.alias("v"))


def _industries(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), industry(F.col("s_suppkey") * 137 % 10000).alias("industry"))


@query
def sc_industry_map(spark, sf_dir):
    return _industries(spark, sf_dir)


@query
def sc_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", F.upper(F.trim("p_brand")), "p_type"), 256).alias("h"))


@query
def sc_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query
def sc_digits(spark, sf_dir):
    n = F.coalesce(F.try_element_at(F.split("c_name", "#"), F.lit(2)), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", n.rlike("^[0-9]+$").alias("ok"), n.try_cast("bigint").alias("n"))


# --- series ---------------------------------------------------------------------------------


@panel_query
def ts_label(p):
    return _value(p, TS.forward_return(F.col("return"), 2, 5))


@panel_query
def ts_beta(p):
    return _value(TS.with_market_model(_market(p), "return", "mret", 60, 30), F.col("slope"))


@panel_query
def ts_resid_vol(p):
    return _value(TS.with_market_model(_market(p), "return", "mret", 60, 30), F.col("spread"))


@panel_query
def ts_reversal(p):
    return _value(p, TS.compounded(F.col("return"), -3, 0))


@panel_query
def ts_momentum(p):
    return _value(p, TS.compounded(F.col("return"), -8, -3))


@panel_query
def ts_amihud(p):
    return _value(p, TS.amihud(F.col("return"), F.col("close"), F.col("volume")))


def _revenue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("a"), F.year("l_shipdate").alias("y")).agg((F.sum("l_extendedprice") / 1000).alias("rev"))


@query
def ts_growth(spark, sf_dir):
    return _revenue(spark, sf_dir).withColumn("v", TS.growth(F.col("rev"), "a", "y")).select("a", "y", rounded(F.col("v")).alias("v"))


@query
def ts_interval_overlap(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("s"), F.date_add(day, 90).alias("e"))
    return RL.overlaps(i, "k", "s", "e").groupBy("k").agg(F.count("*").alias("n"))


@panel_query
def ts_drawdown(p):
    return _value(TS.drawdown(p, "return", "w"), F.col("w"))


# --- cross sections ---------------------------------------------------------------------------


@panel_query
def cs_standardize(p):
    return _value(CS.standardize(p, "close", "z", F.col("mask")), F.col("z"))


@panel_query
def cs_zscore_plain(p):
    return _value(p, CS.cs_zscore(F.col("volume"), F.col("mask")))


@panel_query
def cs_exposure_prep(p):
    return _value(CS.prepare_exposure(p, "close", "z", F.col("member")), F.col("z"))


@query
def cs_industry_dummies(spark, sf_dir):
    return _industries(spark, sf_dir).select("a", *[(F.col("industry") == n).cast("int").alias(f"ind_{n.lower()}") for n, _ in INDUSTRIES])


@panel_query
def cs_residual_1f(p):
    return _value(CS.residuals(_labelled(p).select("a", "t", "close", "y", "mask"), ["y"], ["close"], F.col("mask")), F.col("y_res"))


@panel_query
def cs_residual_multi(p):
    """Two targets on three exposures at once."""
    p = _factors(p).withColumn("z3", CS.cs_zscore(F.col("high") - F.col("low"), F.col("mask")))
    out = CS.residuals(p.select("a", "t", "y", "return", "z1", "z2", "z3", "mask"), ["y", "return"], ["z1", "z2", "z3"], F.col("mask"))
    return out.select("a", "t", rounded(F.col("y_res")).alias("y_res"), rounded(F.col("return_res")).alias("r_res"))


@panel_query
def cs_combine(p):
    v, here = CS.combine({"z1": 0.7, "z2": -0.3})
    return _factors(p).select("a", "t", rounded(v).alias("v"), here.alias("available"))


def _targets(p: DataFrame) -> DataFrame:
    return p.withColumn("target", CS.buckets(F.when(F.col("mask"), F.col("close"))))


@panel_query
def cs_bucket(p):
    return _value(_targets(p), F.col("target"))


@query
def dsl_batch_shared(spark, sf_dir):
    """Eight expressions with common parts in one plan."""
    texts = ["CSRank(Mean($close,20))", "CSZScore(Mean($close,20))", "Div($close,Mean($close,20))", "CSRank(Std($close,20))", "Delta(Mean($close,20),5)", "Sub(CSRank(Mean($close,20)),CSRank(Std($close,20)))", "TSRank($volume,10)", "EMA($close,10)"]
    out = compile_batch(weekly_panel(spark, sf_dir), {f"v{k}": t for k, t in enumerate(texts)})
    return out.select("a", "t", *[rounded(F.col(f"v{k}")).alias(f"v{k}") for k in range(len(texts))])


# --- joins ------------------------------------------------------------------------------------


@query
def jn_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("r"), "o_orderstatus")
    lookup = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return RL.fill_missing(o, lookup, ["k"], "r", "v", F.col("o_orderstatus") == "F").select("k", F.round("r", 2).alias("v"))


@query
def jn_interval_member(spark, sf_dir):
    s = F.col("s_suppkey")
    start = F.add_months(F.lit("1995-01-01").cast("date"), (s % 12).cast("int"))
    end = F.when(s % 5 != 0, F.add_months(F.lit("2001-12-31").cast("date"), -(s % 7).cast("int")))
    intervals = table(spark, sf_dir, "supplier").where(s % 10 != 0).select(s.alias("a"), start.alias("start"), end.alias("end"))
    return RL.in_interval(weekly_panel(spark, sf_dir), intervals).select("a", "t")


@query
def jn_link_priority(spark, sf_dir):
    s = F.col("s_suppkey")
    prim = F.when(s % 3 == 0, "P").when(s % 3 == 1, "C").otherwise("J")
    k = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = k.select(F.col("n_nationkey").alias("nation"), s.alias("a"), prim.alias("prim"), F.add_months(F.lit("1995-01-01").cast("date"), (s % 24).cast("int")).alias("linkdt"))
    return RL.first_by(k, ["nation"], [F.when(F.col("prim") == "P", 0).when(F.col("prim") == "C", 1).otherwise(2), F.col("linkdt").desc(), F.col("a")]).select("nation", "a", "prim")


@query
def jn_asof_expiry(spark, sf_dir):
    rec = _revenue(spark, sf_dir).select("a", F.add_months(F.make_date("y", F.lit(12), F.lit(31)), 6).alias("available"), "rev")
    return RL.as_of(weekly_panel(spark, sf_dir), rec, ["rev"], 8).select("a", "t", rounded(F.col("rev"), 4).alias("v"))


@panel_query
def jn_grid(p):
    return p.select("a", "t", "d", F.col("close").isNotNull().alias("filled"))


@panel_query
def jn_market(p):
    return _value(_market(p), F.col("return") - F.col("mret"))


@query
def jn_anti_seen(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(F.sha2("p_type", 256).alias("h"), "p_size")
    return h.select("h").distinct().join(h.where("p_size <= 5").select("h"), "h", "left_anti")


@query
def jn_axis_check(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return RL.axis_difference(x, table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")), "d")


# --- aggregations --------------------------------------------------------------------------------


@panel_query
def ag_daily_ic(p):
    return _labelled(p).where("mask").groupBy("t").agg(rounded(ST.pearson(F.col("close"), F.col("y"))).alias("ic"))


@panel_query
def ag_daily_rank_ic(p):
    return ST.daily_spearman(_labelled(p).where("mask"), "close", "y").select("t", rounded(F.col("rank_ic")).alias("rank_ic"))


@panel_query
def ag_ic_zero_rule(p):
    c = F.when(F.col("close").isNotNull(), 1.0)
    return _labelled(p).where("mask").groupBy("t").agg(rounded(ST.pearson(c, F.col("y"), constant_is_zero=True)).alias("ic"))


@panel_query
def ag_pooled_corr(p):
    return _labelled(p).where("mask").agg(rounded(ST.pooled_corr(F.col("close"), F.col("y"))).alias("r"))


@panel_query
def ag_mean_abs_corr(p):
    return p.where("mask").groupBy("t").agg(ST.pearson(F.col("close"), F.col("volume")).alias("ic")).agg(rounded(F.avg(F.abs("ic"))).alias("r"))


@panel_query
def ag_gram(p):
    """Day-equal moments of two factors and the label, with missing factors as 0."""
    stats = PO.daily_statistics(_factors(p), ["z1", "z2"], "y", F.col("mask")).where(F.col("n") >= PO.FEWEST)
    cells = (("z1", "z1", "g0_0"), ("z1", "z2", "g0_1"), ("z2", "z2", "g1_1"), ("z1", "y", "p0"), ("z2", "y", "p1"))
    one = stats.agg(*[F.avg(m).alias(m) for *_, m in cells])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), rounded(F.col(m)).alias("value")) for i, j, m in cells])))


@panel_query
def ag_missingness(p):
    return RL.missingness(p.select("open", "close", "volume", "return"), ["open", "close", "volume", "return"])


@panel_query
def ag_date_coverage(p):
    scopes = F.array(F.lit("all"), F.when(F.col("member"), "member"), F.when(F.col("eligible"), "eligible"))
    s = p.select("a", "d", F.explode(F.array_compact(scopes)).alias("scope"))
    return s.groupBy("scope").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n"), F.countDistinct("d").alias("days"), F.countDistinct("a").alias("assets"))


@panel_query
def ag_universe_counts(p):
    return _labelled(p).groupBy("t").agg(F.count_if("member").alias("members"), F.count_if("eligible").alias("eligible_n"), F.count_if("mask").alias("both_n"), F.count("y").alias("labels"))


@panel_query
def ag_quantiles(p):
    names = ["q001", "q01", "q50", "q99", "q999"]
    found = ST.quantiles(p, "return", [0.001, 0.01, 0.5, 0.99, 0.999])
    return p.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{n} double" for n in names)).select(*[rounded(F.col(n)).alias(n) for n in names])


@panel_query
def ag_summary(p):
    r = F.col("return")
    return p.groupBy("a").agg(rounded(F.median(r)).alias("med"), rounded(F.avg(r)).alias("mean"), rounded(F.stddev_samp(r)).alias("sd"), rounded(F.avg((r > 0).cast("double"))).alias("positive"), F.count(r).alias("n"))


@panel_query
def ag_strict_mean(p):
    """Of each nation and date: missing unless every asset has a return."""
    return p.groupBy("nation", "t").agg(rounded(F.when(F.count("return") == F.count("*"), F.avg("return"))).alias("v"))


@query
def ag_max_by(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"), F.count("*").alias("n"))


# --- filters, sorts, sets -----------------------------------------------------------------------------


@panel_query
def fl_eligibility(p):
    return p.select("a", "t", "eligible", "mask")


@query
def fl_standard(spark, sf_dir):
    both = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), F.add_months(F.col("o_orderdate").cast("date"), 6).alias("available")).dropDuplicates()


@query
def fl_adjust(spark, sf_dir):
    price = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / (F.col("l_discount") * 10))
    volume = F.when(F.col("l_tax") > 0, F.col("l_quantity") * (F.col("l_tax") * 10))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(price, 4).alias("adj_price"), F.round(volume, 4).alias("adj_volume"))


@panel_query
def fl_label_containment(p):
    p = _labelled(p).withColumn("exit_d", F.lead("d", 5).over(TS.ordered()))
    return _value(p, F.when(F.year("exit_d") == F.year("d"), F.col("y")))


@panel_query
def fl_purge(p):
    """Dates are one calendar row, so their window is small."""
    days = calendar(p).select(F.posexplode("dates").alias("t", "d"))
    exit_d = F.lead("d", 5).over(W.partitionBy(F.lit(0)).orderBy("t"))
    return days.withColumn("x", exit_d).select("t", (F.year("d") % 2 == 0).alias("even_fold"), F.coalesce(F.year("x") == F.year("d"), F.lit(False)).alias("usable"))


@panel_query
def so_topk(p):
    rn = F.row_number().over(W.partitionBy("t").orderBy(F.desc("close"), "a"))
    return p.where("mask").select("t", "a", rn.alias("rn")).where("rn <= 3")


@query
def so_argmax_ties(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").limit(1).select("p_partkey", "p_size", F.col("p_retailprice").alias("price"))


@query
def se_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))).groupBy("nation").agg(F.count("*").alias("n"))


@query
def se_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query
def se_intersect(spark, sf_dir):
    x, y = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    sides = x.distinct().withColumn("s", F.lit(1)).unionByName(y.distinct().withColumn("s", F.lit(2))).groupBy("k").agg(F.sum("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 3).alias("both_n"), F.count("*").alias("any_n"))


@query
def se_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query
def se_cross(spark, sf_dir):
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(m).alias("method")) for s in range(3) for m in ("random", "gp")]))
    return table(spark, sf_dir, "region").select("r_name", cells.alias("c")).select("r_name", "c.seed", "c.method")


# --- validity, pool, statistics --------------------------------------------------------------------------


@panel_query
def val_coverage(p):
    out = VAL.gates(compile_batch(p, {"s": "Mean($close,20)"}), ["s"], F.col("member"), min_assets=5, min_days=100)
    return out.select(rounded(F.col("coverage")).alias("coverage"), "valid_days", rounded(F.col("variable_rate")).alias("variable_rate"))


@panel_query
def val_duplicate(p):
    out = VAL.redundancy(p, ["close"], ["high", "volume"], F.col("mask"), min_assets=5)
    return out.select("member", *[rounded(F.col(c)).alias(c) for c in ("daily", "pooled", "ranked", "corr_coverage", "strongest")])


@panel_query
def po_composite_ic(p):
    v, _ = CS.combine({"z1": 0.7, "z2": -0.3})
    return _factors(p).where("mask").withColumn("s", v).groupBy("t").agg(rounded(ST.pearson(F.col("s"), F.col("y"))).alias("ic"))


@panel_query
def po_ridge(p):
    """Weights of the ridge composite, applied to the panel."""
    f = _factors(p)
    w, _ = PO.moments(PO.daily_statistics(f, ["z1", "z2"], "y", F.col("mask")), 2)["all"].ridge(0.01)
    v, here = CS.combine(dict(zip(("z1", "z2"), w.tolist(), strict=True)))
    return f.select("a", "t", rounded(v).alias("v"), here.alias("available"))


def _series(p: DataFrame) -> DataFrame:
    p = _labelled(p)
    ic = p.where("mask").groupBy("t").agg(ST.pearson(F.col("close"), F.col("y")).alias("x"))
    return p.select("t").distinct().join(ic, "t", "left")


@panel_query
def st_gap_hac(p):
    return ST.hac(_series(p), "x", 4).select("n", rounded(F.col("mean")).alias("mean"), rounded(F.col("se")).alias("se"))


@panel_query
def st_nw(p):
    return ST.newey_west(_series(p), "x", 4).select("n", rounded(F.col("mean")).alias("mean"), rounded(F.col("se")).alias("se"))


@query
def st_bh(spark, sf_dir):
    pv = F.least(F.lit(1.0), F.avg("p_retailprice") / 2000 * (F.min("p_partkey") % 7 + 1) / F.lit(7.0))
    f = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(pv.alias("pv"))
    return ST.benjamini_hochberg(f, "pv", "q", "name").select("name", rounded(F.col("q")).alias("q"))


# --- portfolio --------------------------------------------------------------------------------------


def _days(p: DataFrame) -> int:
    return p.agg(F.max("t")).first()[0] + 1


def _held(p: DataFrame) -> DataFrame:
    return PF.holdings(_targets(p).select("t", "a", "target"), _days(p))


@panel_query
def pf_target(p):
    x = F.col("target")
    return _targets(p).groupBy("t").agg(F.count_if(x > 0).alias("longs"), F.count_if(x < 0).alias("shorts"), rounded(F.sum(x)).alias("net"), rounded(F.sum(F.abs(x))).alias("gross"))


@panel_query
def pf_sleeve_weights(p):
    return _held(p).select("a", "t", rounded(F.col("weight")).alias("weight"))


@panel_query
def pf_turnover(p):
    return PF.turnover(_targets(p).select("t", "a", "target"), _days(p)).select("t", rounded(F.col("turnover")).alias("turnover"))


@panel_query
def pf_returns(p):
    return PF.returns(_held(p), p).select("t", *[rounded(F.col(c)).alias(c) for c in ("ret", "gross", "coverage")])


@panel_query
def pf_metrics(p):
    out = PF.metrics(PF.returns(_held(p), p), year=52.0)
    return out.select("days", *[rounded(F.col(c)).alias(c) for c in ("total", "cagr", "mean", "vol", "drawdown", "sharpe")], "invalid")


@panel_query
def pf_exposure(p):
    return PF.exposures(_held(p), p, ["volume"]).select("t", rounded(F.col("volume")).alias("volume"))


# --- audits and reports ---------------------------------------------------------------------------------


@query
def dv_keys(spark, sf_dir):
    return RL.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@panel_query
def rp_ic_summary(p):
    ic = _labelled(p).where("mask").groupBy("t").agg(F.year(F.any_value("d")).alias("y"), ST.pearson(F.col("close"), F.col("y")).alias("ic"))
    x = F.col("ic")
    return ic.groupBy("y").agg(F.count(x).alias("n"), rounded(F.avg(x)).alias("mean"), rounded(F.stddev_samp(x)).alias("sd"), rounded(F.avg((x > 0).cast("double"))).alias("positive"))
