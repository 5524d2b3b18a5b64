"""Findings of round 4: the panel is dealt once, and what follows from a date is found in one call."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import queries_portfolio as Q
from tessera.operators import combiner as CB
from tessera.operators import cross_section as CS
from tessera.operators import gram as GR
from tessera.operators import statistics as ST
from tessera.operators import validity as VAL
from tessera.plans.panel import calendar, densify, weekly_panel

from test_pool_ops import plan_of
from test_research import NAN, grid

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def inputs(spark):
    r = np.random.default_rng(4)
    f = {k: np.where(r.random((9, 40)) < 0.1, NAN, r.normal(size=(9, 40))) for k in ("f1", "f2", "size", "y")}
    f["f1"][1], f["y"][2], f["size"][3, 2:], f["f2"][4] = 0.5, 0.1, NAN, NAN  # constant, constant label, too few rows, all missing
    f["ok"] = r.random((9, 40)) < 0.8
    return grid(spark, **f).withColumn("ok", F.col("ok") > 0)


# --- F1: po_r1 -----------------------------------------------------------------------------------


def test_grid_of_facts_without_joins(spark):
    d = [dt.date(2020, 1, 6) + dt.timedelta(7 * k) for k in range(5)]
    rows = [(1, d[1], 1.0), (1, d[3], 3.0), (2, d[0], 5.0), (2, d[4], None), (3, None, 7.0), (4, None, 8.0), (4, d[0], 9.0), (None, d[2], 11.0), (5, d[4], 6.0)]
    facts = spark.createDataFrame(rows, "a long, d date, x double")
    got = {(r.a, r.t): (r.d, r.x) for r in densify(facts).collect()}
    known = {(a, day): x for a, day, x in rows if a is not None and day is not None}
    assert got == {(a, t): (day, known.get((a, day))) for a in (1, 2, 3, 4, 5, None) for t, day in enumerate(d)}
    assert densify(facts).count() == 30 and densify(facts, calendar(facts.where("d < '2020-01-20'"))).where("t > 1").count() == 0


@given
def test_panel_is_dealt_once(spark):
    assert plan_of(weekly_panel(spark, SF)).count("Exchange hashpartitioning") == 1


@given
def test_scores_of_a_pool_read_the_panel_once(spark):
    assert "l_suppkey" not in plan_of(Q.QUERIES["po_r1"](spark, SF))


def test_blocks_from_raw_rows(spark):
    df = inputs(spark)
    both = CS.fixed_universe(CS.own_transform(df, ["f1", "f2"], F.col("ok"), ["size"]), ["f1", "f2"], "y", F.col("ok"), ["size"])
    at = lambda f: {(r.t, r.bi, r.bj): r for r in f.collect()}
    apart, direct = at(GR.daily_blocks(both, ["f1", "f2"], "y", F.col("metric"), width=1)), at(GR.neutral_blocks(df, ["f1", "f2"], "y", F.col("ok"), ["size"], width=1))
    assert apart.keys() == direct.keys() and 18 <= len(direct) < 27
    for k, r in direct.items():
        for c in ("n", "y", "vy", "s", "p", "c", "g"):
            assert np.allclose(r[c], apart[k][c], rtol=1e-9, atol=1e-12)
    rows = {(r.a, r.t): (r.metric, r.f1, r.f2, r.y) for r in both.select("a", "t", "metric", "f1", "f2", "y").collect()}
    assert len(rows) == 360 and rows == {(r.a, r.t): (r.metric, r.f1, r.f2, r.y) for r in CS.neutral_inputs(df, ["f1", "f2"], "y", F.col("ok"), ["size"]).collect()}


# --- F2: po_combiner -------------------------------------------------------------------------------


def test_signal_without_a_join(spark):
    df = inputs(spark).withColumn("tag", F.concat(F.lit("n"), F.col("a")))
    made = CB.Combiner(["f1", "f2"], ["size"], 0.01).fit(df, "y", F.col("ok"))
    out = made.transform(df, F.col("ok"))
    assert plan_of(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(out)
    own = CS.own_transform(df, ["f1", "f2"], F.col("ok"), ["size"])
    total, here = CS.combine(dict(zip(["f1", "f2"], made.weights, strict=True)))
    want = {(r.a, r.t): r.s for r in own.select("a", "t", F.when(F.col("ok") & here, total).alias("s")).collect()}
    rows = out.collect()
    assert out.columns == [*df.columns, "signal"] and len(rows) == 360 and 0 < sum(r.signal is None for r in rows) < 360
    assert {(r.a, r.t): r.signal for r in rows} == want
    assert {(r.a, r.t): (r.f1, r.y, r.tag) for r in rows} == {(r.a, r.t): (r.f1, r.y, r.tag) for r in df.collect()}
    few = made.transform(df.drop("y"), F.col("ok"), "s", keep=["tag", "t", "a"])
    assert few.columns == ["tag", "t", "a", "s"] and {(r.a, r.t): r.s for r in few.collect()} == want


@given
def test_combiner_deals_by_asset_and_by_date(spark):
    assert plan_of(Q.QUERIES["po_combiner"](spark, SF)).count("Exchange hashpartitioning") == 2


# --- F3: ag_quantiles ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["many", "close", "ties", "one", "special"])
def test_quantiles_by_counts(spark, kind):
    r = np.random.default_rng(6)
    made = {"many": r.normal(size=20_001) * 10.0 ** r.integers(-8, 8, 20_001), "close": 1 + r.random(5000) * 1e-13, "ties": r.integers(-3, 4, 4000) / 8, "one": np.array([-2.5]), "special": np.array([0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, NAN, 1.0])}
    x = made[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double").repartition(3)
    at = [0.0, 0.001, 0.01, 0.37, 0.5, 0.99, 0.999, 1.0]
    want = df.agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q")).first().q
    assert [str(v) for v in ST.quantiles(df, "x", at)] == [str(v) for v in want] or kind == "special"
    ordered = sorted(x, key=lambda v: (v != v, v))
    places = [k / (len(x) - 1) for k in range(len(x))] if kind == "special" else []
    assert all(a == b or (a != a and b != b) for a, b in zip(ST.quantiles(df, "x", places or [0.5]), ordered if places else [want[4]], strict=True))


def test_quantiles_of_nothing(spark):
    assert ST.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.1, 0.5]) == [None, None]


def test_quantiles_leave_nothing_behind(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert ST.quantiles(spark.range(1001).select(F.col("id").cast("double").alias("x")), "x", [0.5, 0.999]) == [500.0, 999.0]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


# --- F4: po_native_chain -----------------------------------------------------------------------------


def test_scores_equal_their_parts(spark):
    r = np.random.default_rng(8)
    f = {k: np.where(r.random((12, 30)) < 0.15, NAN, np.round(r.normal(size=(12, 30)), 1)) for k in ("s1", "s2", "flat", "m1", "m2", "y")}
    f["flat"], f["s2"][3], f["y"][5], f["m1"][7] = np.where(np.isnan(f["flat"]), NAN, 2.0), NAN, 1.0, NAN
    f["m2"] = np.where(r.random((12, 30)) < 0.5, f["s1"], f["m2"])
    f["s1"][9, 2:] = NAN
    df = grid(spark, **f, ok=r.random((12, 30)) < 0.8).withColumn("ok", F.col("ok") > 0)
    df = df.withColumn("none", F.lit(None).cast("double"))
    signals, pool = ["s1", "s2", "flat", "none"], ["m1", "m2"]
    made = VAL.scores(df, signals, pool, "y", F.col("ok"), min_assets=3, min_days=9)
    assert plan_of(made).count("Scan") <= 1 and plan_of(made).count("Exchange hashpartitioning") == 2
    got = {v.signal: v for v in made.collect()}
    gates = {v.signal: v for v in VAL.gates(df, signals, F.col("ok"), min_assets=3, min_days=9).collect()}
    near = {s: max(v.strongest for v in VAL.redundancy(df, signals, pool, F.col("ok"), 3).where(F.col("signal") == s).collect()) for s in signals}
    assert got.keys() == set(signals)
    for s, v in got.items():
        days = ST.daily_spearman(df.where("ok"), s, "y").agg(F.avg("rank_ic").alias("ic"), F.try_divide(F.avg("rank_ic"), F.stddev_pop("rank_ic")).alias("ir")).first()
        assert (v.ic, v.ir) == (pytest.approx(days.ic) if days.ic is not None else None, pytest.approx(days.ir) if days.ir is not None else None)
        assert v.corr == pytest.approx(near[s]) and v.coverage == pytest.approx(gates[s].coverage)
        assert (v.valid_days, v.status) == (gates[s].valid_days, gates[s].status)
        assert v.variable_rate == (pytest.approx(gates[s].variable_rate) if gates[s].variable_rate is not None else None)
    assert got["s1"].ic is not None and got["flat"].ic is None and got["none"].coverage == 0


@given
def test_candidates_are_scored_from_one_panel(spark):
    assert plan_of(Q.QUERIES["po_native_chain"](spark, SF)).count("Exchange hashpartitioning(l_suppkey") == 1
