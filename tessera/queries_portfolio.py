"""Queries of projections, full pools, neutralised objectives, blocked moments, lineage, audits and the stored panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sources as SRC
from .functions import rounded
from .operators import combiner as CB
from .operators import cross_section as CS
from .operators import gates as GT
from .operators import gram as GR
from .operators import inference as INF
from .operators import lineage as LN
from .operators import objective as OB
from .operators import pool as PO
from .operators import projection as PJ
from .operators import replacement as RP
from .operators import reselect as RS
from .operators import rolling as TS
from .operators import trace as TR
from .operators import validity as VAL
from .plans.panel import bars, calendar, table, weekly_panel, weeks
from .queries import _factors, _labelled, _targets, panel_query, query
from .queries_research import EXIT, FOLDS, LAGS, QUERIES, RIDGE, _ics, r6, scratch

__all__ = ["QUERIES"]
LARGEST = 0.03
POOL, CANDIDATES = ["z1", "z2"], ["z3", "z4", "z5"]
RULES = RP.Rules(RIDGE, LAGS, tried=2)


# --- neutral portfolios ---------------------------------------------------------------------


@panel_query
def pf_qp(p):
    """Weights nearest to the quintile target with half on each side of the median and a bound on each."""
    held = _targets(p).withColumn("score", F.when(F.col("mask"), F.col("close")))
    return PJ.neutral_weights(held, "target", "score", [], "mask", PJ.Limits(LARGEST)).select("t", "a", "status", *r6("weight"))


@panel_query
def pf_qp_neutral(p):
    """What the projection finds for each date with no exposure to size and range, and bounds."""
    held = _targets(p).withColumns({"score": F.when(F.col("mask"), F.col("close")), "size": F.log("volume"), "range": F.col("high") - F.col("low")})
    for e in ("size", "range"):
        held = CS.prepare_exposure(held, e, e, F.col("mask"))
    found = PJ.audits(PJ.neutral_weights(held, "target", "score", ["size", "range"], "mask", PJ.Limits(0.05)))
    return found.select("t", "status", "accepted", "names", "violations", *r6("net", "gross", "max_weight", "max_exposure"))


# --- full pools -------------------------------------------------------------------------------


def _more_factors(p: DataFrame) -> DataFrame:
    z = lambda c: CS.cs_zscore(c, F.col("mask"))
    return _factors(p).withColumns({"z3": z(F.col("high") - F.col("low")), "z4": z(F.col("open")), "z5": z(F.col("return")), "z6": z(F.log(F.col("high")) - F.log(F.col("low")))})


def _replacements(p: DataFrame) -> DataFrame:
    days = calendar(p)
    blocks = PO.with_exit(GR.daily_blocks(_more_factors(p), [*POOL, *CANDIDATES], "y", F.col("mask")), days, EXIT)
    return RP.score_candidates(blocks, POOL, CANDIDATES, FOLDS, len(POOL), days.select(F.posexplode("dates").alias("t", "d")), RULES)


@panel_query
def po_replace(p):
    """Each candidate against a pool that is full: what it adds, whom it would replace, and the checked gain."""
    s = [rounded(F.col("saliency")[k]).alias(f"saliency{k}") for k in range(3)]
    return _replacements(p).select("candidate", *r6("delta_add", "post_delta"), "days", *s, F.concat_ws(",", "tried").alias("tried"), "replaced", "self_evicted", "valid", "reason")


@panel_query
def po_replace_rewards(p):
    """Rewards shaped from what the candidates add, and which of them is admitted, from the panel to the decision."""
    scored = PO.shape_rewards(_replacements(p).withColumn("grp", F.lit("all")), "grp", "delta_add", F.col("valid"), "candidate", 0.0)
    best = PO.admit(scored, "grp", "post_delta", F.col("valid") & ~F.col("self_evicted"), ["candidate"], 0.0).select(F.col("candidate").alias("best"), F.col("admitted").alias("_in"))
    out = scored.join(F.broadcast(best))
    return out.select("candidate", *r6("scale", "reward"), ((F.col("candidate") == F.col("best")) & F.col("_in")).alias("admitted"))


@panel_query
def po_reselect(p):
    """The three of six factors that explain most together, from stored moments."""
    names = ["z1", "z2", "z3", "z4", "z5", "z6"]
    m = GR.block_moments(GR.daily_blocks(_more_factors(p), names, "y", F.col("mask")), len(names))["all"]
    own, value = RS.select_exact(m, 3, RIDGE)
    return p.sparkSession.createDataFrame([(",".join(names[i] for i in own), value)], "factors string, value double").select("factors", *r6("value"))


# --- objectives on neutralised inputs --------------------------------------------------------


def _sized(p: DataFrame) -> DataFrame:
    return _labelled(p).select("a", "t", "mask", F.col("close").alias("f1"), (F.col("high") - F.col("low")).alias("f2"), "y", F.log("volume").alias("size"))


def _neutral(p: DataFrame) -> DataFrame:
    return OB.neutral_inputs(_sized(p).where("mask"), ["f1", "f2"], "y", F.col("mask"), ["size"])


def _r1(spark, sf_dir: str) -> OB.Scored:
    pools = {"pool": ["f1", "f2"], "first": ["f1"], "none": []}
    return OB.neutral_walk_forward(_sized(weekly_panel(spark, sf_dir)), ["f1", "f2"], "y", F.col("mask"), ["size"], pools, FOLDS, RIDGE, weeks(spark, sf_dir), EXIT)


@query
def po_r1(spark, sf_dir):
    """Out-of-sample correlations of pools on inputs neutral to size: over all days and in each fold, with errors."""
    return OB.summaries(_r1(spark, sf_dir), LAGS).select("name", "scope", "n", *r6("mean", "se"))


@query
def po_r1_increment(spark, sf_dir):
    """What the second factor adds on neutral inputs: mean difference, error and the bound half an error lower, over all days and by fold."""
    return OB.summaries(_r1(spark, sf_dir), LAGS, "first", 0.5).where("name = 'pool'").select("scope", "n", *r6("mean", "se", "lower"))


@panel_query
def po_r1_support(p):
    """Days and rows that each fold has and needs."""
    need = OB.Support(20, 0.8, 0.8)
    return OB.support(_neutral(p), "y", F.col("mask"), F.col("metric"), FOLDS, calendar(p), EXIT, need).select("fold", "part", "expected_days", "valid_days", "required_days", "base_rows", "valid_rows", *r6("day_rate", "row_rate"), "enough")


@query
def po_r1_weights(spark, sf_dir):
    """Weights by fold, and those of all days, which are the ones to deploy."""
    return OB.weight_table(_r1(spark, sf_dir), ["f1", "f2"]).where("name = 'pool'").select("part", "factor", *r6("weight", "share"))


# --- blocked moments --------------------------------------------------------------------------


@panel_query
def ag_gram_blocks(p):
    """Day-equal moments of two factors and the label by matrix products, names dealt over three tasks a day."""
    m = GR.block_moments(GR.daily_blocks(_factors(p), POOL, "y", F.col("mask"), width=1, parts=3), 2, width=1)["all"]
    rows = [("z1", "z1", float(m.gram[0, 0])), ("z1", "z2", float(m.gram[0, 1])), ("z2", "z2", float(m.gram[1, 1])), ("z1", "y", float(m.predictive[0])), ("z2", "y", float(m.predictive[1]))]
    return p.sparkSession.createDataFrame(rows, "i string, j string, value double").select("i", "j", *r6("value"))


@panel_query
def ag_corr_matrix(p):
    """Every left against every right column by masked matrix products, a row for each day and pair."""
    left, right = ["close", "volume"], ["y", "return", "open"]
    named = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(at) + 1)
    return GR.correlations(_labelled(p).where("mask"), left, right).select("t", named(left, "l").alias("left"), named(right, "r").alias("right"), "n", *r6("corr"))


# --- lineage and audits -----------------------------------------------------------------------


def _pool_events(spark, sf_dir: str) -> DataFrame:
    """Events as proposals: a cell for each type, a round for each month; dear ones are admitted, and the pool holds the last five."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), (F.year("ts") * 12 + F.month("ts")).cast("int").alias("round"), F.col("event_id").alias("seq"), F.col("event_id").alias("factor"), (F.col("value") > 50).alias("admitted"))
    before = F.lag("factor", 5).over(W.partitionBy("cell", "admitted").orderBy("seq"))
    return e.withColumn("replaced", F.when(F.col("admitted"), before))


@query
def dv_lineage(spark, sf_dir):
    """The pool of each cell as it stood after each round."""
    return LN.pools(_pool_events(spark, sf_dir))


@query
def dv_snapshots(spark, sf_dir):
    """Version, size and hash of each cell's pool after each round."""
    return LN.snapshots(_pool_events(spark, sf_dir))


@query
def dv_final_lineage(spark, sf_dir):
    """Each factor of the last pools with the admission that it stands on."""
    return LN.final_lineage(_pool_events(spark, sf_dir))


@query
def dv_trace(spark, sf_dir):
    """Three sampled rows a year of the panel, their raw rows found back by key, and each value computed again without the dense grid."""
    p = _labelled(weekly_panel(spark, sf_dir))
    stored = TR.sampled(p.where("mask and y is not null"), [F.year("d")], ["a", "d"], 3, 7).select("a", "d", "t", "close", "volume", "return", F.col("y").alias("label"))
    days = calendar(p).select(F.posexplode("dates").alias("t", "d"))
    # weeks that a sampled row rests on: its own and the one before, and those of its label
    spots = stored.select("a", F.col("t").alias("t0"), F.explode(F.array(*[F.lit(k) for k in range(-1, 6)])).alias("k"))
    spots = spots.join(F.broadcast(days.withColumnsRenamed({"t": "_t", "d": "week"})), F.col("_t") == F.col("t0") + F.col("k"))
    raw = table(spark, sf_dir, "lineitem").withColumn("week", F.date_trunc("week", "l_shipdate").cast("date"))
    rows = raw.join(F.broadcast(spots), (F.col("l_suppkey") == F.col("a")) & (raw.week == spots.week)).drop(raw.week)
    last = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    bars = rows.groupBy("a", "t0", "k").agg((F.max(last)["l_extendedprice"] / 1000).alias("close"), F.sum("l_quantity").alias("volume"))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    again = bars.groupBy("a", "t0").agg(at(0, "close").alias("close"), at(0, "volume").alias("volume"), *[at(k, "close").alias(f"c{k + 1}") for k in range(-1, 6)])
    growth = F.lit(1.0)
    for k in range(2, 6):
        growth = growth * (F.col(f"c{k + 1}") / F.col(f"c{k}"))
    again = again.select("a", F.col("t0").alias("t"), "close", "volume", (F.col("c1") / F.col("c0") - 1).alias("return"), (growth - 1).alias("label"))
    return TR.compared(stored, again, ["a", "t"], ["close", "volume", "return", "label"]).select("a", "t", "field", *r6("stored", "again", "difference"))


def _solved(p: DataFrame) -> DataFrame:
    f = _labelled(p).withColumn("size", F.log("volume"))
    return CS.residuals(f, ["close", "y"], ["size"], F.col("mask"), diagnose=True)


@panel_query
def dv_risk(p):
    """Rows, rank, condition and remaining exposure of each date's solve."""
    return CS.solve_diagnostics(_solved(p)).select("t", F.col("solve_rows").cast("long").alias("n_rows"), F.col("solve_rank").cast("int").alias("n_rank"), rounded(F.log("solve_condition")).alias("log_condition"), rounded(F.col("solve_worst")).alias("worst"))


@panel_query
def dv_risk_gates(p):
    """Hard gates of the risk model on the dates from 1996."""
    solved = _solved(p)
    return CS.risk_gates(solved, CS.solve_diagnostics(solved), ["size"], F.col("member"), F.col("d") >= "1996-01-01", 1e4, 0.5).select("gate", "failures", *r6("value"), "passed")


@panel_query
def st_seed_ci(p):
    """Student intervals of the mean member return of a nation over its assets, as seeds are averaged in reports."""
    own = p.where("member").groupBy("nation", "a").agg(F.avg("return").alias("x"))
    return INF.seed_interval(own, "x", ["nation"]).select("nation", "seeds", *r6("mean", "low", "high"))


# --- stored panel ------------------------------------------------------------------------------


def stored_panel(spark, sf_dir: str) -> str:
    """The panel of a folder as a bucketed table in the shared folder, written anew; its name follows from the application and the folder."""
    path = f"{scratch(spark, sf_dir)}/panel"
    name = "panel_" + "".join(c if c.isalnum() else "_" for c in path.rsplit("/", 2)[1])
    SRC.store_panel(weekly_panel(spark, sf_dir).select("a", "t", "d", "close", "volume", "return", "mask"), name, 8, path=path)
    return name


@query
def src_panel(spark, sf_dir):
    """A rolling mean and deviation on three years of the stored panel, without a shuffle."""
    p = SRC.read_panel(spark, stored_panel(spark, sf_dir), "1994-03-01", "1996-06-30")
    p = p.withColumn("mean", TS.ROLLING["Mean"](F.col("close"), 10))
    return TS.with_moments(p, {"std": ("Std", "close", "close", 10)}).select("a", "t", *r6("mean", "std"))


# --- gates, filters, combined signals ------------------------------------------------------------


def _bundle(spark, sf_dir: str) -> dict[str, DataFrame]:
    """The given tables in the place of a raw bundle: bars, suppliers' intervals, order dates, returned lines, customers and orders."""
    li, o, c, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    a = F.col("s_suppkey")
    daily = bars(li).select("a", (F.col("a") * 7).alias("company"), "d", "open", "high", "low", "close", (F.col("close") / F.col("open") - 1).alias("ret"), "volume", F.lit(2.0).alias("price_factor"), F.when(F.col("a") % 50 != 0, 1.0).alias("share_factor"), (F.col("close") * F.col("volume") * 1000).alias("cap"), (F.col("volume") * 1000).alias("shares"))
    start = F.add_months(F.lit("1995-01-01").cast("date"), (a % 12).cast("int"))
    return {
        "daily": daily,
        "membership": s.select(a.alias("a"), start.alias("start"), F.add_months(F.lit("2001-12-31").cast("date"), -(a % 7).cast("int")).alias("end"), F.when(a % 10 != 0, "norm").otherwise("n").alias("flag")),
        "market": o.select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("ret", F.lit(0.0)),
        "delistings": li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("a"), F.col("l_shipdate").cast("date").alias("d")),
        "links": c.select(F.col("c_custkey").cast("string").alias("gvkey"), (F.col("c_acctbal") / 10).alias("a"), F.lit("1995-01-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit("LC").alias("kind"), F.lit("P").alias("primary")),
        "fundamentals": o.select(F.col("o_custkey").cast("string").alias("gvkey"), F.col("o_orderdate").cast("date").alias("d")),
    }


@query
def dv_bundle(spark, sf_dir):
    """Every hard gate of a raw bundle: what was found, between which limits, and whether it holds."""
    found = GT.bundle_report(_bundle(spark, sf_dir), ["1996-06-28", "1999-06-30"], (5, 550))
    return found.select("gate", *r6("value", "low", "high"), "ok")


@query
def fl_tradable(spark, sf_dir):
    """Orders that pass five sets of categories and have amounts above 0."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = {"security": ("F", "O"), "subtype": ("1-URGENT", "2-HIGH", "5-LOW"), "share": ("BUILDING", "MACHINERY", "FURNITURE"), "exchange": ("ASIA", "EUROPE", "AMERICA"), "status": tuple(f"{x}" for x in ("BRAZIL", "CHINA", "FRANCE", "JAPAN", "GERMANY", "INDIA", "PERU"))}
    both = both.withColumns({"px": F.col("o_totalprice"), "vol": F.col("c_acctbal"), "r": F.col("o_totalprice") / 1e5, "_seg": F.concat(F.lit(" "), F.lower("c_mktsegment"))})
    ok = GT.tradable({"security": "o_orderstatus", "subtype": "o_orderpriority", "share": "_seg", "exchange": "r_name", "status": "n_name"}, sets, "px", "vol", "r")
    return both.select("o_orderkey", ok.alias("ok"))


@panel_query
def po_combiner(p):
    """The signal of weights that were fitted with the label and are applied without it, after a round trip through their stored form."""
    f = _sized(p)
    made = CB.Combiner(["f1", "f2"], ["size"], RIDGE).fit(f, "y", F.col("mask"))
    return CB.Combiner.from_json(made.to_json()).transform(f, F.col("mask"), keep=["a", "t"]).select("a", "t", *r6("signal"))


@panel_query
def st_interval(p):
    """The summary of daily correlations with its bootstrap interval."""
    s = _ics(p, ["close"]).withColumn("name", F.lit("close"))
    return INF.full_summary(s, "close", LAGS, ["name"], block=20, samples=400).select("n", *r6("mean", "sd", "se", "t_value", "low", "high"))


@panel_query
def po_native_chain(p):
    """Baseline rewards of candidates from the panel itself: rank correlation, its ratio, validity and the closest pool member."""
    cands, pool = ["return", "copy", "open"], ["high", "volume"]
    p = _labelled(p).withColumn("copy", F.col("high") * 2 + 0.001)
    rows = VAL.scores(p, cands, pool, "y", F.col("mask"), min_assets=3, min_days=30)
    out = rows.withColumn("reward", F.when(F.col("status") == "valid", PO.native_reward(F.col("ic"), F.col("ir"), F.lit(False), F.lit(0), F.col("corr"))).otherwise(-1.0))
    mined = PO.mined(F.col("ic"), F.col("coverage"), F.lit(False), 0.01, 0.5)
    return out.select("signal", "status", *r6("ic", "corr", "reward"), mined.alias("mined"))
