"""Projections, blocked moments, full pools, neutral objectives, lineage, audits and frames against plain versions."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import sources
from tessera.operators import cross_section as CS
from tessera.operators import gram as GR
from tessera.operators import inference as INF
from tessera.operators import lineage as LN
from tessera.operators import objective as OB
from tessera.operators import pool as PO
from tessera.operators import projection as PJ
from tessera.operators import replacement as RP
from tessera.operators import reselect as RS
from tessera.operators import rolling as TS
from tessera.operators import trace as TR
from tessera.operators import validity as VAL
from tessera.plans.compiler import compile_batch

from test_research import NAN, frame, grid

# --- frames -----------------------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("w", [2, 5, 20, 60])
def test_moments_of_frames(spark, w):
    r = np.random.default_rng(w)
    x, y = r.normal(50, 1, (47, 3)), r.normal(size=(47, 3))
    x[r.random(x.shape) < 0.1], y[r.random(y.shape) < 0.1] = NAN, NAN
    x[:, 2] = 0.1  # constant
    df = grid(spark, x=x, y=y)
    ops = {"cov": ("Cov", "x", "y", w), "corr": ("Corr", "x", "y", w), "std": ("Std", "x", "x", w), "var": ("Var", "x", "x", w), "own": ("Corr", "y", "y", w)}
    got = {(v.a, v.t): v for v in TS.with_moments(df, ops).collect()}
    for a, t in itertools.product(range(3), range(47)):
        fx, fy = x[max(0, t - w + 1) : t + 1, a], y[max(0, t - w + 1) : t + 1, a]
        both, one = ~np.isnan(fx) & ~np.isnan(fy), fx[~np.isnan(fx)]
        need = max(2, math.ceil(0.8 * w))
        v = got[a, t]
        if both.sum() >= need:
            assert v["cov"] == pytest.approx(np.cov(fx[both], fy[both])[0, 1], abs=1e-12, rel=1e-9)
            assert v["corr"] is None if a == 2 else v["corr"] == pytest.approx(np.corrcoef(fx[both], fy[both])[0, 1], rel=1e-9)
        else:
            assert v["cov"] is None and v["corr"] is None
        sd = one.std(ddof=1) if len(one) >= need else 0.0
        assert (v["std"], v["var"]) == ((None, None) if sd < 1e-12 else (pytest.approx(sd, rel=1e-9), pytest.approx(sd * sd, rel=1e-9)))
        own = fy[~np.isnan(fy)]
        assert v["own"] == (pytest.approx(1.0) if len(own) >= need else None)


def test_frames_shuffle_once_and_start_anywhere(spark):
    df = grid(spark, x=np.random.default_rng(0).normal(size=(30, 2)), y=np.ones((30, 2)))
    made = TS.with_moments(df, {"c": ("Corr", "x", "y", 20), "s": ("Std", "x", "x", 5)})
    assert plan_of(made).count("Exchange hashpartitioning") == 1
    whole = {(v.a, v.t): v.s for v in made.collect()}
    late = {(v.a, v.t): v.s for v in TS.with_moments(df.where("t >= 7"), {"s": ("Std", "x", "x", 5)}).collect()}
    assert all(v == pytest.approx(whole[k]) for k, v in late.items() if k[1] >= 11)
    assert all(v is None for k, v in late.items() if k[1] < 10)
    flat = compile_batch(df.withColumnsRenamed({"x": "close", "y": "volume"}).withColumn("mask", F.lit(True)), {"v": "Corr($close,$volume,20)"})
    assert {r.v for r in flat.select("v").collect()} == {None}


def test_market_model(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=30)
    x = 0.5 + 1.7 * m[:, None] + r.normal(size=(30, 2)) * 0.1
    df = grid(spark, r=x, m=np.tile(m[:, None], 2))
    got = {(v.a, v.t): v for v in TS.with_market_model(df, "r", "m", 12, 6).collect()}
    slope, intercept = np.polyfit(m[8:20], x[8:20, 1], 1)
    rest = x[8:20, 1] - slope * m[8:20] - intercept
    assert got[1, 19].slope == pytest.approx(slope, rel=1e-9) and got[1, 19].spread == pytest.approx(math.sqrt(rest @ rest / 11), rel=1e-9)
    assert got[1, 3].slope is None


# --- projection ---------------------------------------------------------------------------------


def test_projection_limits():
    n = 200
    score, target = np.linspace(-1, 1, n), np.zeros(n)
    target[:40], target[-40:] = -0.5 / 40, 0.5 / 40
    x = np.zeros((n, 21))
    w, audit = PJ.project_date(target, score, x, np.ones(n, bool), PJ.Limits())
    assert abs(w.sum()) < 1e-8 and abs(np.abs(w).sum() - 1) < 1e-6 and np.abs(w).max() <= 0.020001 and audit.max_exposure < 1e-8 and audit.accepted
    w, audit = PJ.project_date(target, score, x, np.ones(n, bool), PJ.Limits(net=1e-30, gross=1e-30, weight=1e-30))
    assert w is None and not audit.accepted and audit.violations
    w, audit = PJ.project_date(target, score, x, np.arange(n) < 40, PJ.Limits())
    assert w is None and audit.status == "insufficient_eligible"
    w, audit = PJ.project_date(target, score, x, np.ones(n, bool), PJ.Limits(turnover=0.1), np.zeros(n))
    assert w is None and audit.violations == "turnover" and audit.turnover == pytest.approx(1)
    w, audit = PJ.project_date(target, score, x, np.ones(n, bool), PJ.Limits(turnover=0.1))
    assert w is None and audit.violations == "turnover"  # nothing to measure it by
    # all exposures on one side can't be neutral
    one = np.column_stack([np.where(score > 0, 1.0, 0.0)])
    assert PJ.project_date(target, score, one, np.ones(n, bool), PJ.Limits())[1].status == "infeasible"


def test_projection_is_the_nearest_point():
    """Karush-Kuhn-Tucker: the pull of a name inside its bounds is a sum of the rows; at a bound it points outwards."""
    r = np.random.default_rng(7)
    for k in range(40):
        n, m = int(r.integers(60, 300)), int(r.integers(0, 8))
        score, x = r.normal(size=n), r.normal(size=(n, m))
        if m > 2 and k % 3 == 0:
            x[:, 1] = x[:, 0]  # not of full rank
        target = np.where(r.random(n) < 0.4, r.normal(size=n) * 0.02, 0.0)
        largest = 0.04
        w, audit = PJ.project_date(target, score, x, np.ones(n, bool), PJ.Limits(largest))
        assert audit.accepted, audit
        long = score >= np.median(score)
        low, high = np.where(long, 0, -largest), np.where(long, largest, 0)
        rows = np.vstack([long, ~long, x.T]).astype(float)
        pull = w - target / (1 + PJ.PULL)
        inside = (w > low + 1e-11) & (w < high - 1e-11)
        level = np.linalg.lstsq(rows[:, inside].T, pull[inside], rcond=None)[0]
        off = pull - level @ rows
        assert np.abs(off[inside]).max(initial=0) < 1e-9
        assert (off[w <= low + 1e-11] > -1e-9).all() and (off[w >= high - 1e-11] < 1e-9).all()


def test_projection_on_rows(spark):
    r = np.random.default_rng(1)
    score = r.normal(size=(3, 80))
    score[1, 50:] = NAN
    score[2, 10:] = NAN
    df = grid(spark, score=score, target=np.where(score > 1, 0.05, np.where(score < -1, -0.05, 0)), e=r.normal(size=(3, 80))).withColumn("ok", F.when(F.col("a") != 3, F.lit(True)))
    out = PJ.neutral_weights(df, "target", "score", ["e"], "ok", PJ.Limits(0.05))
    rows = out.collect()
    assert len(rows) == 240 and {v.weight for v in rows if v.t == 2} == {None}
    assert all(v.weight == 0 for v in rows if v.t == 1 and (v.a >= 50 or v.a == 3))
    assert sum(v.weight for v in rows if v.t == 0) == pytest.approx(0, abs=1e-9)
    by = {v.t: v for v in PJ.audits(out).collect()}
    assert by[0].accepted and by[0].names == 79 and by[2].status == "insufficient_eligible" and not by[2].accepted
    assert PJ.neutral_weights(df.limit(0), "target", "score", ["e"], "ok").count() == 0


# --- moments in blocks --------------------------------------------------------------------------


@pytest.mark.parametrize("width,parts", [(2, 1), (3, 4), (64, 1)])
def test_blocks_equal_expressions(spark, width, parts):
    r = np.random.default_rng(3)
    x = {f"x{k}": np.where(r.random((8, 12)) < 0.1, NAN, r.normal(size=(8, 12))) for k in range(5)}
    y = np.where(r.random((8, 12)) < 0.1, NAN, r.normal(size=(8, 12)))
    y[2], y[3, 2:] = 0.1, NAN  # a constant label, and too few names
    df = grid(spark, **x, y=y)
    stats = PO.daily_statistics(df, list(x), "y", F.lit(True))
    blocks = GR.daily_blocks(df, list(x), "y", F.lit(True), width=width, parts=parts)
    a, b = PO.moments(stats, 5)["all"], GR.block_moments(blocks, 5, width=width)["all"]
    assert np.allclose(a.gram, b.gram, rtol=1e-12) and np.allclose(a.predictive, b.predictive, rtol=1e-12) and a.days == b.days
    w = {"p": [0.5, -1, 0.2, 0, 3], "q": [0, 0, 1, 0, 0], "none": [0] * 5}
    one = {v.t: [v[n] for n in w] for v in PO.scored(stats, w).collect()}
    many = {v.t: v.ic for v in GR.composites(blocks, {"all": np.array(list(w.values()), float)}, width=width).collect()}
    assert one.keys() == many.keys() and one[2] == [None] * 3 and one[3] == [None] * 3
    for t in one:
        assert many[t] == one[t] if one[t][0] is None else many[t] == pytest.approx(one[t], rel=1e-9, abs=1e-12)


def test_many_factors_in_one_pass(spark):
    """200 factors against 50 candidates: a composite for each candidate, without an expression for each pair."""
    r = np.random.default_rng(4)
    x, y = r.normal(size=(3, 60, 250)), r.normal(size=(3, 60))
    df = grid(spark, **{f"x{k}": x[..., k] for k in range(250)}, y=y)
    blocks = GR.daily_blocks(df, [f"x{k}" for k in range(250)], "y", F.lit(True))
    w = np.zeros((50, 250))
    w[:, :200], w[np.arange(50), 200 + np.arange(50)] = 0.01, 1
    got = {v.t: v.ic for v in GR.composites(blocks, {"all": w}).collect()}
    for t in range(3):
        assert got[t] == pytest.approx([np.corrcoef(x[t] @ v, y[t])[0, 1] for v in w], rel=1e-9)
    pairs = GR.correlations(df, [f"x{k}" for k in range(200)], [f"x{k}" for k in range(200, 250)])
    found = {(v.l, v.r): v["corr"] for v in pairs.where("t = 1").collect()}
    assert len(found) == 10_000 and found[17, 3] == pytest.approx(np.corrcoef(x[1, :, 17], x[1, :, 203])[0, 1], rel=1e-9)


def test_correlations_with_gaps_and_constants(spark):
    x = np.array([[1.0, 2, 3, 4, 5, NAN], [0.1, 0.1, 0.1, 7, NAN, NAN]])
    y = np.array([[2.0, 1, 4, 3, NAN, 9], [1.0, 2, 3, NAN, 5, 6]])
    got = {v.t: v for v in GR.correlations(grid(spark, x=x, y=y), ["x"], ["y"]).collect()}
    assert got[0]["corr"] == pytest.approx(np.corrcoef(x[0, :4], y[0, :4])[0, 1]) and got[0].n == 4
    assert got[1]["corr"] is None and got[1].n == 3  # constant where both are there


def test_constant_label_has_no_correlation(spark):
    df = grid(spark, x=np.random.default_rng(0).normal(size=(2, 30)), y=np.vstack([np.full(30, 0.1), np.random.default_rng(1).normal(size=30)]))
    got = {v.t: v.s for v in PO.scored(PO.daily_statistics(df, ["x"], "y", F.lit(True)), {"s": [1.0]}).collect()}
    assert got[0] is None and got[1] is not None


# --- full pools ----------------------------------------------------------------------------------


def test_bordering_and_leaving_equal_solves():
    r = np.random.default_rng(2)
    z = r.normal(size=(200, 6))
    g, p = z.T @ z / 200 + 0.1 * np.eye(6), r.normal(size=6)
    w, inverse = RP.bordered(np.linalg.solve(g[:5, :5], p[:5]), np.linalg.inv(g[:5, :5]), g[:5, 5], g[5, 5], p[5])
    assert np.allclose(w, np.linalg.solve(g, p)) and np.allclose(inverse, np.linalg.inv(g))
    for i in range(6):
        own = [k for k in range(6) if k != i]
        assert np.allclose(RP.without(w, inverse, i)[own], np.linalg.solve(g[np.ix_(own, own)], p[own]))


def panel_of(spark, signals, y):
    names = [f"z{k}" for k in range(len(signals))]
    df = grid(spark, **dict(zip(names, signals, strict=True)), y=y)
    return df.withColumn("d", F.date_add(F.lit(dt.date(2018, 7, 2)), F.col("t") * 4)), names


FOLDS = [PO.Fold((2018, 2018), (2019, 2019)), PO.Fold((2018, 2019), (2020, 2020))]


def plain_scores(signals, y, days, own, penalty):
    """Daily correlations out of sample of a subset, each fold solved for itself."""
    years = np.array([d.year for d in days])
    exits = np.array([days[t + 1].year if t + 1 < len(days) else 9999 for t in range(len(days))])
    out = np.full(len(days), np.nan)
    z = np.nan_to_num(np.stack([signals[i] for i in own], -1)) if own else np.zeros((*y.shape, 0))
    fits = []
    for f in FOLDS:
        fit = (years >= f.fit[0]) & (years <= f.fit[1]) & (exits <= f.fit[1])
        g = np.mean([z[t].T @ z[t] / len(y[t]) for t in np.flatnonzero(fit)], axis=0) + penalty * np.eye(len(own))
        p = np.mean([z[t].T @ y[t] / len(y[t]) for t in np.flatnonzero(fit)], axis=0)
        w = np.linalg.solve(g, p) if own else np.zeros(0)
        fits.append((w, np.linalg.inv(g)))
        for t in np.flatnonzero((years >= f.score[0]) & (years <= f.score[1]) & (exits <= f.score[1])):
            out[t] = np.corrcoef(z[t] @ w, y[t])[0, 1] if own else 0.0
    return out, fits


@pytest.mark.parametrize("capacity", [3, 9])
def test_candidates_equal_refits(spark, capacity):
    r = np.random.default_rng(101)
    signals = [r.normal(size=(170, 25)) for _ in range(6)]
    y = 0.3 * signals[0] + 0.15 * signals[1] + 0.5 * signals[4] + 0.02 * signals[5] + r.normal(size=(170, 25))
    signals[5] = signals[0] + r.normal(size=(170, 25)) * 0.1
    df, names = panel_of(spark, signals, y)
    days = [r_.d for r_ in df.select("t", "d").distinct().orderBy("t").collect()]
    cal = df.agg(F.array_sort(F.collect_set("d")).alias("dates"))
    blocks = PO.with_exit(GR.daily_blocks(df, names, "y", F.lit(True), width=4), cal, 1)
    rules = RP.Rules(0.05, 3, critical=0.5, tried=3, rechecked=2)
    got = RP.score_candidates(blocks, names[:3], names[3:], FOLDS, capacity, cal.select(F.posexplode("dates").alias("t", "d")), rules, same={"z3": "z1"}, width=4).collect()
    base, _ = plain_scores(signals, y, days, [0, 1, 2], 0.05)

    def reward(own):
        x = plain_scores(signals, y, days, own, 0.05)[0] - base
        ok = np.isfinite(x)
        c = np.where(ok, x - x[ok].mean(), 0.0)
        se = math.sqrt(max(0.0, c @ c + sum(2 * (1 - k / 4) * (c[k:] @ c[:-k]) for k in (1, 2, 3)))) / ok.sum()
        return x[ok].mean() - 0.5 * se

    assert got[0].reason == "exact_duplicate" and not got[0].valid and got[0].post_delta is None
    plans = []
    for c, row in zip((4, 5), got[1:], strict=True):
        assert row.delta_add == pytest.approx(reward([0, 1, 2, c]), rel=1e-8)
        _, fits = plain_scores(signals, y, days, [0, 1, 2, c], 0.05)
        salient = np.mean([w * w / np.diag(v) for w, v in fits], axis=0)
        assert row.saliency == pytest.approx(salient.tolist(), rel=1e-8)
        if capacity == 9:
            assert row.replaced is None and row.post_delta == row.delta_add and row.rechecked and list(row.tried) == []
            continue
        order = np.argsort(salient, kind="stable")[:3].tolist()
        union = [0, 1, 2, c]
        gains = [(reward([i for k, i in enumerate(union) if k != gone]), -n, gone) for n, gone in enumerate(order)]
        best, _, gone = max(gains)
        assert list(row.tried) == [names[union[k]] for k in order]
        assert row.self_evicted == (gone == 3) and row.replaced == (None if gone == 3 else names[gone]) and row.rechecked
        assert row.post_delta == pytest.approx(0.0 if gone == 3 else best, rel=1e-8, abs=1e-12)
        plans.append(row)
    assert capacity == 9 or plans[0].replaced is not None  # the strong candidate gets in


def test_exact_size_equals_exhaustive_search():
    for seed in range(12):
        r = np.random.default_rng(seed)
        z = r.normal(size=(120, 6)) @ (np.eye(6) + 0.6 * r.normal(size=(6, 6)))
        m = PO.Moments(z.T @ z / 120, z.T @ (z @ r.normal(size=6) + r.normal(size=120)) / 120, 120)
        for size in range(7):
            value = lambda own: float(m.predictive[own] @ m.part(own).ridge(0.05)[0]) if own else 0.0  # noqa: B023, E731
            best = max((list(c) for c in itertools.combinations(range(6), size)), key=value)
            own, found = RS.select_exact(m, size, 0.05)
            assert found == pytest.approx(value(best), rel=1e-9) and own == best


# --- objectives ------------------------------------------------------------------------------------


def test_walk_forward_purges_and_requires_support(spark):
    r = np.random.default_rng(11)
    signals = [r.normal(size=(170, 20)) for _ in range(2)]
    y = 0.3 * signals[0] + r.normal(size=(170, 20))
    df, names = panel_of(spark, signals, y)
    cal = df.agg(F.array_sort(F.collect_set("d")).alias("dates"))
    days = [v.d for v in df.select("t", "d").distinct().orderBy("t").collect()]
    found = OB.support(df, "y", F.lit(True), F.col("a") != 0, FOLDS, cal, 1, OB.Support(20, 0.8, 0.8)).orderBy("fold", "part").collect()
    for row in found:
        years = FOLDS[row.fold].fit if row.part == "fit" else FOLDS[row.fold].score
        inside = [t for t, d in enumerate(days) if years[0] <= d.year <= years[1]]
        assert row.expected_days == len(inside) - 1 and row.valid_rows == 19 * row.expected_days and row.enough
    few = OB.support(df, "y", F.lit(True), F.col("a") != 0, FOLDS, cal, 1, OB.Support(252))
    with pytest.raises(OB.InsufficientSupport, match="fit of fold 0"):
        OB.require_support(few)
    scored = OB.walk_forward(df.withColumn("metric", F.lit(True)), names, "y", {"new": names, "old": names[:1], "none": []}, FOLDS, 0.05, cal, 1)
    got = {(v.name, v.scope): v for v in OB.summaries(scored, 2).collect()}
    ic, fits = plain_scores(signals, y, days, [0, 1], 0.05)
    assert got["new", "all"].mean == pytest.approx(np.nanmean(ic), rel=1e-9) and got["new", "all"].n == np.isfinite(ic).sum()
    assert got["none", "all"].mean == 0.0 and np.allclose(scored.weights["new"]["f1"], fits[1][0])
    diff = {v.scope: v for v in OB.summaries(scored, 2, "old", 0.5).where("name = 'new'").collect()}
    x = ic - plain_scores(signals, y, days, [0], 0.05)[0]
    years = np.array([d.year for d in days])
    assert diff["f0"].mean == pytest.approx(np.nanmean(x[years == 2019]), rel=1e-9) and diff["f0"].n + diff["f1"].n == diff["all"].n
    assert diff["all"].lower == pytest.approx(diff["all"].mean - 0.5 * diff["all"].se) and diff["f1"].se > 0
    full = {v.factor: v for v in OB.weight_table(scored, names).where("name = 'new' and part = 'full'").collect()}
    assert full["z0"].weight > full["z1"].weight and sum(abs(v.share) for v in full.values()) == pytest.approx(1)


# --- validity ---------------------------------------------------------------------------------------


def test_ranks_are_made_once_for_each_support():
    r = np.random.default_rng(6)
    x, y = r.integers(0, 5, (40, 8)).astype(float), r.normal(size=(40, 20))
    _, ranked = VAL.day_pairs(x, y)
    assert ranked == 28  # signals + pool, not 160 pairs
    x[3, 2], y[5:9, 4] = NAN, NAN
    found, ranked = VAL.day_pairs(x, y)
    assert ranked < 28 + 2 * 30
    for i, j in itertools.product(range(8), range(20)):
        ok = np.isfinite(x[:, i]) & np.isfinite(y[:, j])
        a, b = x[ok, i], y[ok, j]
        assert found["corr"][i, j] == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-9)
        ra, rb = ([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v] for v in (a, b))
        assert found["ranked"][i, j] == pytest.approx(np.corrcoef(ra, rb)[0, 1], rel=1e-9)


# --- intervals ---------------------------------------------------------------------------------------


def test_student_quantiles(spark):
    # tabled values of the 97.5 % quantile
    table = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 4: 2.776445105, 5: 2.570581836, 10: 2.228138852, 15: 2.131449546, 20: 2.085963447, 29: 2.045229642, 30: 2.042272456}
    got = {v.nu: v for v in spark.createDataFrame([(k,) for k in [0, *table]], "nu int").select("nu", INF.t_quantile(F.lit(0.975), F.col("nu")).alias("q"), INF.t_quantile(F.lit(0.025), F.col("nu")).alias("r")).collect()}
    assert got[0].q is None and all(got[k].q == pytest.approx(v, abs=1e-9 * max(1, v)) and got[k].r == pytest.approx(-got[k].q) for k, v in table.items())
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("c", None)], "k string, x double")
    got = {v.k: v for v in INF.seed_interval(d, "x", ["k"]).collect()}
    half = 4.302652730 * np.std([1, 2, 4], ddof=1) / math.sqrt(3)
    assert (got["a"].low, got["a"].high) == pytest.approx((7 / 3 - half, 7 / 3 + half)) and got["b"].low == got["b"].high == 3.0 and got["c"].low is None
    assert {v.k: v.x for v in INF.strict_seed_mean(d, "x", ["k"], 3).collect()} == {"a": pytest.approx(7 / 3), "b": None, "c": None}


def test_a_thousand_series_share_their_draws(spark):
    days = [dt.date(2020, 11, 1) + dt.timedelta(k) for k in range(90)]
    rows = [(d, k, float((k * 7 + n * 13) % 17)) for k in range(1000) for n, d in enumerate(days)]
    got = INF.bootstrap(spark.createDataFrame(rows, "d date, k int, x double"), "x", block=10, samples=200, keys=["k"])
    one = {v.k: v for v in got.collect()}
    assert len(one) == 1000 and all(v.low <= v.high for v in one.values())
    assert (one[3].low, one[3].high) == pytest.approx((one[20].low, one[20].high))  # the same series


# --- lineage, trace, risk, stored panel ------------------------------------------------------------------


def test_pools_at_every_round(spark):
    r = np.random.default_rng(9)
    rows, plain = [], {}
    for cell in ("x", "y"):
        pool, seq = [], 0
        for rnd in range(12):
            for _ in range(int(r.integers(0, 4))):
                seq += 1
                factor = int(r.integers(0, 9))
                admitted = factor not in pool and r.random() < 0.8
                replaced = None
                if admitted:
                    if len(pool) == 4:
                        replaced = pool.pop(int(r.integers(0, 4)))
                    pool.append(factor)
                rows.append((cell, rnd, seq, factor, bool(admitted), replaced))
                plain[cell, rnd] = sorted(pool)
    events = spark.createDataFrame(rows, "cell string, round int, seq int, factor int, admitted boolean, replaced int")
    got = {}
    for v in LN.pools(events).collect():
        got.setdefault((v.cell, v.round), []).append(v.factor)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in plain.items() if v}
    assert {(v.cell, v.round): v.size for v in LN.snapshots(events).collect()} == {k: len(v) for k, v in plain.items()}
    assert LN.faults(events).count() == 0
    bad = spark.createDataFrame([("x", 0, 1, 5, True, None), ("x", 0, 2, 5, True, None), ("x", 1, 3, 6, True, 8)], events.schema)
    assert {(v.factor, v.reason) for v in LN.faults(bad).collect()} == {(5, "admitted_twice"), (8, "replaced_absent")}
    last = LN.final_lineage(events).where("cell = 'x'").collect()
    assert sorted(v.factor for v in last) == plain["x", max(k[1] for k in plain if k[0] == "x")]
    seen = LN.snapshots(events).withColumn("value", F.col("version") * 1.0)
    best = LN.of_exact_size(seen, 4, "value", F.lit(True)).where("cell = 'y'").first()
    assert best is None or best.size == 4


def test_trace_finds_what_differs(spark):
    stored = spark.createDataFrame([(k, k % 3, float(k), 1.0) for k in range(30)], "k int, s int, x double, y double")
    own = TR.sampled(stored, [F.col("s")], ["k"], 4, 5)
    assert own.groupBy("s").count().collect() and {v["count"] for v in own.groupBy("s").count().collect()} == {4}
    assert {v.k for v in own.collect()} == {v.k for v in TR.sampled(stored.repartition(7), [F.col("s")], ["k"], 4, 5).collect()} != {v.k for v in TR.sampled(stored, [F.col("s")], ["k"], 4, 6).collect()}
    again = stored.where("k != 3").withColumn("x", F.when(F.col("k") == 5, 5.5).otherwise(F.col("x")))
    bad = TR.disagreements(TR.compared(stored, again, ["k"], ["x", "y"]), 1e-9).collect()
    assert {(v.k, v.field, v.difference) for v in bad} == {(5, "x", 0.5), (3, "x", None), (3, "y", None)}


def test_risk_diagnostics(spark):
    r = np.random.default_rng(8)
    e, y = r.normal(size=(3, 40)), r.normal(size=(3, 40))
    twin = e * 2
    twin[2] = r.normal(size=40)
    df = grid(spark, e=e, twin=twin, y=y)
    solved = CS.residuals(df, ["y"], ["e", "twin"], F.lit(True), diagnose=True)
    got = {v.t: v for v in CS.solve_diagnostics(solved).collect()}
    design = np.column_stack([np.ones(40), e[2], twin[2]])
    assert got[2].solve_rank == 3 and got[2].solve_condition == pytest.approx(np.linalg.cond(design)) and got[2].solve_rows == 40 and got[2].solve_worst < 1e-12
    assert got[0].solve_rank == 2
    gates = {v.gate: v for v in CS.risk_gates(df, CS.solve_diagnostics(solved), ["e", "twin"], F.lit(True), F.col("t") >= 0).collect()}
    assert gates["rank"].failures == 2 and not gates["rank"].passed and gates["coverage"].passed
    good = {v.gate: v for v in CS.risk_gates(df, CS.solve_diagnostics(solved), ["e", "twin"], F.lit(True), F.col("t") == 2).collect()}
    assert all(v.passed for v in good.values())
    CS.assert_neutral(CS.solve_diagnostics(solved))
    with pytest.raises(ValueError, match="remain"):
        CS.assert_neutral(CS.solve_diagnostics(solved).withColumn("solve_worst", F.lit(1.0)))


def test_windows_on_the_stored_panel_need_no_shuffle(spark):
    df = grid(spark, close=np.random.default_rng(0).normal(size=(900, 5))).withColumn("d", F.date_add(F.lit(dt.date(2019, 1, 1)), F.col("t")))
    sources.store_panel(df, "panel_test", 4)
    try:
        p = sources.read_panel(spark, "panel_test", "2020-02-03", "2020-12-31")
        made = TS.with_moments(p.withColumn("m", TS.ROLLING["Mean"](F.col("close"), 5)), {"s": ("Std", "close", "close", 5)})
        plan = plan_of(made)
        assert "Exchange" not in plan and "PartitionFilters" in plan and "year" in plan
        want = {(v.a, v.t): v.m for v in df.where("d >= '2020-02-03' and year(d) = 2020").withColumn("m", TS.ROLLING["Mean"](F.col("close"), 5)).collect()}
        assert {(v.a, v.t): v.m for v in made.collect()} == want
    finally:
        spark.sql("DROP TABLE IF EXISTS panel_test")


def test_a_writer_that_ended_between_renames(spark, tmp_path):
    d = spark.range(3)
    d.write.parquet(f"{tmp_path}/t.old")
    sources.write_checked(d.limit(1), f"{tmp_path}/t", lambda x: [])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    d.write.parquet(f"{tmp_path}/u.old")
    sources.recover(spark, f"{tmp_path}/u")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 3
