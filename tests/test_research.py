"""Hand cases and plain versions for what SQL doesn't show."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import dsl, queries_research, sources
from tessera.dsl.parser import parse_tagged
from tessera.dsl.sampler import sample
from tessera.operators import cross_section as CS
from tessera.operators import inference as INF
from tessera.operators import pool as PO
from tessera.operators import portfolio as PF
from tessera.operators import relational as RL
from tessera.operators import statistics as ST
from tessera.operators import validity as VAL

NAN = float("nan")
SF = "/root/testdata/sf0.001"


def frame(spark, columns, schema):
    clean = [[None if isinstance(x, float) and math.isnan(x) else x for x in row] for row in columns]
    return spark.createDataFrame([tuple(r) for r in clean], schema)


def grid(spark, **arrays):
    """Panels of days x assets as rows (t, a, ...)."""
    names, shape = list(arrays), next(iter(arrays.values())).shape
    rows = [(t, a, *[float(arrays[n][t, a]) for n in names]) for t in range(shape[0]) for a in range(shape[1])]
    return frame(spark, rows, "t int, a int, " + ", ".join(f"{n} double" for n in names))


def test_moments_count_missing_factors_as_zero(spark):
    f1 = np.array([[1.0, NAN, -1.0, 2.0], [0.5, 1.0, NAN, 3.0]])
    f2 = np.array([[0.0, 2.0, 1.0, NAN], [1.0, -1.0, 2.0, 0.0]])
    y = np.array([[1.0, 2.0, 3.0, NAN], [1.0, -1.0, 0.5, 2.0]])
    mask = np.array([[1.0, 1, 1, 1], [1, 1, 1, 0]])
    df = grid(spark, f1=f1, f2=f2, y=y, mask=mask)
    m = PO.moments(PO.daily_statistics(df, ["f1", "f2"], "y", F.col("mask") > 0), 2)["all"]
    g, p = np.zeros((2, 2)), np.zeros(2)
    for t in range(2):
        use = (mask[t] > 0) & ~np.isnan(y[t])
        z = np.nan_to_num(np.stack([f1[t], f2[t]], 1))[use]
        g += z.T @ z / use.sum() / 2
        p += z.T @ y[t][use] / use.sum() / 2
    assert np.allclose(m.gram, g) and np.allclose(m.predictive, p) and m.days == 2
    w, inv = m.ridge(0.1)
    assert np.allclose((g + 0.1 * np.eye(2)) @ w, p) and np.allclose(inv @ (g + 0.1 * np.eye(2)), np.eye(2))
    with pytest.raises(ValueError):
        m.ridge(0.0)


def test_daily_statistics_give_the_correlations_of_the_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(6, 9, 3))
    x[0, :, 0] = 0.3  # constant on a day
    x[r.random(x.shape) < 0.1] = NAN
    y = r.normal(size=(6, 9))
    df = grid(spark, a0=x[..., 0], a1=x[..., 1], a2=x[..., 2], y=y)
    stats = PO.daily_statistics(df, ["a0", "a1", "a2"], "y", F.lit(True))
    w = [0.5, -1.0, 0.25]
    got = {v.t: v for v in PO.scored(stats, {"s": w, "none": [0.0] * 3, "one": [1.0, 0.0, 0.0]}).collect()}
    z = np.nan_to_num(x)
    for t in range(6):
        assert got[t].s == pytest.approx(np.corrcoef(z[t] @ w, y[t])[0, 1], rel=1e-9) and got[t].none == 0.0


def test_errors_of_means(spark):
    v = [1.0, 3.0, NAN, 2.0, 5.0, NAN, 4.0, 0.5]
    s = frame(spark, list(enumerate(v)), "t int, x double")
    x = np.array(v)
    ok = ~np.isnan(x)
    c = np.where(ok, x - x[ok].mean(), 0.0)
    gap = math.sqrt(c @ c + 2 * (2 / 3) * (c[1:] @ c[:-1]) + 2 * (1 / 3) * (c[2:] @ c[:-2])) / ok.sum()
    assert ST.hac(s, "x", 2).first().se == pytest.approx(gap)
    d = x[ok] - x[ok].mean()
    closed = math.sqrt(d @ d + 2 * (2 / 3) * (d[1:] @ d[:-1]) + 2 * (1 / 3) * (d[2:] @ d[:-2])) / ok.sum()
    assert ST.newey_west(s, "x", 2).first().se == pytest.approx(closed) and gap != pytest.approx(closed)
    one = frame(spark, [(0, 1.0), (1, NAN)], "t int, x double")
    assert ST.hac(one, "x", 3).first().se is None
    two = frame(spark, [(0, 1.0), (1, 2.0)], "t int, x double")  # the lag ends at 1
    assert ST.hac(two, "x", 20).first().se == pytest.approx(math.sqrt(0.5 + 2 * 0.5 * -0.25) / 2)


def test_false_discovery_rates(spark):
    d = frame(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", NAN)], "name string, p double")
    assert {r.name: r.q for r in ST.benjamini_hochberg(d, "p", "q", "name").collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": None}


def test_two_sided_p(spark):
    t = [0.0, 0.5, -1.96, 3.0, 6.0]
    got = [r[0] for r in frame(spark, [(x,) for x in t], "t double").select(INF.two_sided_p(F.col("t"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in t], rel=3e-7)


def test_bootstrap_equals_plain_draws(spark):
    r = np.random.default_rng(1)
    days = [dt.date(2020, 12, 1) + dt.timedelta(k) for k in range(60)]
    x = r.normal(size=60)
    x[[3, 40, 41]] = NAN
    s = frame(spark, [(d, "a", float(v)) for d, v in zip(days, x, strict=True)], "d date, name string, x double")
    got = INF.bootstrap(s, "x", block=7, samples=150, seed=5, keys=["name"]).first()
    years, rng = np.array([d.year for d in days]), np.random.default_rng(5)
    means = np.zeros(150)
    for y in (2020, 2021):
        at = np.flatnonzero(years == y)
        first = rng.integers(0, len(at) - 7 + 1, size=(150, -(-len(at) // 7)))
        for k in range(150):
            own = [at[v + j] for v in first[k] for j in range(7)][: len(at)]
            means[k] += np.nanmean(x[own]) * (~np.isnan(x[at])).sum() / (~np.isnan(x)).sum()
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), rel=1e-9)


def test_sharpe_difference(spark):
    r = np.random.default_rng(9)
    days = [dt.date(2021, 3, 1) + dt.timedelta(k) for k in range(50)]
    a, b = r.normal(0.1, 1, 50), r.normal(0, 1, 50)
    s = frame(spark, [(d, float(x), float(y)) for d, x, y in zip(days, a, b, strict=True)], "d date, a double, b double")
    got = INF.sharpe_difference(s, "a", "b", block=6, samples=80, seed=2).first()
    ratio = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252)
    first = np.random.default_rng(2).integers(0, 45, size=(80, 9))
    drawn = []
    for k in range(80):
        own = [v + j for v in first[k] for j in range(6)][:50]
        drawn.append(ratio(a[own]) - ratio(b[own]))
    assert (got.difference, got.low, got.high) == pytest.approx((ratio(a) - ratio(b), *np.quantile(drawn, [0.025, 0.975])), rel=1e-9)


def test_sleeves_and_metrics(spark):
    score = np.tile(np.arange(20.0), (30, 1))
    r = np.zeros((30, 20))
    r[:, 16:], r[:, :4] = 0.01, -0.01
    p = grid(spark, s=score, ret=r).withColumn("target", CS.buckets(F.col("s")))
    moved = {v.t: v.turnover for v in PF.turnover(p.select("t", "a", "target"), 30).collect()}
    path = {v.t: v for v in PF.returns(PF.holdings(p.select("t", "a", "target"), 30), p, "ret").collect()}
    assert moved[1] == pytest.approx(0.25) and path[2].gross == pytest.approx(0.25) and path[2].ret == pytest.approx(0.0025) and path[17].gross == pytest.approx(1)
    m = PF.metrics(frame(spark, [(0, 0.10), (1, -0.20), (2, -0.10)], "t int, ret double")).first()
    assert m.drawdown == pytest.approx(-0.28) and m.total == pytest.approx(1.1 * 0.8 * 0.9 - 1) and m.cagr == pytest.approx((1.1 * 0.8 * 0.9) ** 84 - 1) and not m.invalid
    assert PF.metrics(frame(spark, [(0, -0.10)], "t int, ret double")).first().drawdown == pytest.approx(-0.10)
    for bad in ([(0, NAN)], [(0, -1.5)], []):
        m = PF.metrics(frame(spark, bad, "t int, ret double")).first()
        assert m.invalid and m.total is None and m.sharpe is None
    assert PF.metrics(frame(spark, [(0, 0.5), (1, -1.0), (2, 0.3)], "t int, ret double")).first().total == pytest.approx(-1)


def test_membership_and_links(spark):
    day = lambda y: dt.date(y, 1, 1)
    facts = spark.createDataFrame([(1, day(y)) for y in (2000, 2001, 2002)], "a int, d date")
    spans = spark.createDataFrame([(1, day(2001), None)], "a int, start date, end date")
    assert RL.in_interval(facts, spans).count() == 0 and RL.in_interval(facts, spans, open_end=True).count() == 2
    with pytest.raises(RL.DuplicateKeys):
        RL.one_to_one(facts, facts.unionAll(facts), ["a", "d"])


def test_validity_statuses(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 12))
    df = grid(spark, x=x, near=x * 2 + r.normal(size=x.shape) * 1e-3, other=r.normal(size=x.shape), flat=np.ones_like(x), gaps=np.where(r.random(x.shape) < 0.5, NAN, x))
    got = {v.signal: v for v in VAL.validate(df, ["near", "other", "flat", "gaps"], ["x", "other"], F.lit(True), min_assets=5, min_days=10).collect()}
    assert {k: v.status for k, v in got.items()} == {"near": "near_duplicate_signal", "other": "near_duplicate_signal", "flat": "near_constant", "gaps": "coverage_failure"}
    assert got["near"].member == "x" and got["other"].member == "other" and got["flat"].member is None
    daily = np.mean([abs(np.corrcoef(df_t, x_t)[0, 1]) for df_t, x_t in zip(r.normal(size=(1, 2)), r.normal(size=(1, 2)), strict=True)])
    assert daily == pytest.approx(1.0)


def test_residuals_are_orthogonal_and_share_factorisations(spark):
    r = np.random.default_rng(4)
    e = {f"e{k}": r.normal(size=(3, 60)) for k in range(21)}
    y = r.normal(size=(3, 60))
    gaps = np.where(r.random(y.shape) < 0.2, NAN, r.normal(size=y.shape))
    df = grid(spark, **e, y=y, gaps=gaps)
    out = CS.residuals(df, ["y", "gaps"], list(e), F.lit(True)).collect()
    for t in range(3):
        own = sorted((v for v in out if v.t == t), key=lambda v: v.a)
        for name, source in (("y_res", y), ("gaps_res", gaps)):
            res = np.array([v[name] if v[name] is not None else NAN for v in own])
            assert (np.isnan(res) == np.isnan(source[t])).all()
            use = ~np.isnan(res)
            assert max(abs(np.array([v[k] for v in own])[use] @ res[use]) for k in e) < 1e-8 and abs(res[use].sum()) < 1e-8


def test_rewards_and_admission(spark):
    rows = [("g", 1, "k1", 0.01, True), ("g", 2, "k2", 0.03, True), ("g", 3, "k3", -0.5, True), ("g", 4, "k4", None, True), ("g", 5, "k5", 0.9, False), ("h", 6, "k6", 0.02, True)]
    d = spark.createDataFrame(rows, "grp string, id int, key string, delta double, valid boolean")
    got = {r.id: r.reward for r in PO.shape_rewards(d, "grp", "delta", F.col("valid"), "key", 0.0).collect()}
    assert got == {1: pytest.approx(0.01 / 0.03), 2: pytest.approx(0.03 / 0.05), 3: 0.0, 4: -1.0, 5: -1.0, 6: pytest.approx(0.5)}
    best = {r.grp: (r.id, r.admitted) for r in PO.admit(d, "grp", "delta", F.col("valid"), ["id"], 0.025).collect()}
    assert best == {"g": (2, True), "h": (6, False)}
    assert PO.decorrelated(["a", "b", "c"], {frozenset("ab"): 0.9, frozenset("ac"): 0.2, frozenset("bc"): 0.95}) == ["a", "c"]


def test_language(spark):
    assert dsl.canonical(dsl.parse("Mean($close,5.0)")) == dsl.canonical(dsl.parse("Mean( $close , 5 )"))
    assert dsl.canonical(parse_tagged(" <EXPR> Abs($open) </expr>\n")) == dsl.canonical(dsl.parse("Abs($open)"))
    for bad in ("so: <expr>Abs($open)</expr>", "<expr>Abs($open)</expr> ok", "Abs($open)", "<expr></expr>"):
        with pytest.raises(ValueError):
            parse_tagged(bad)
    for bad in ("Abs($open", "Abs()", "Abs($open,$close)", "Mean($close)", "Mean($close,7)", "Mean($close,$open)", "Nope($close)", "$price", "Abs($open) $close", "Abs(Abs(Abs(Abs(Abs(Abs(Abs($close)))))))", "Mean(Mean($close,252),252)"):
        with pytest.raises(ValueError):
            dsl.parse(bad)
    rng = random.Random(1)
    for _ in range(50):
        tree = sample(rng)
        assert dsl.canonical(dsl.parse(dsl.canonical(tree))) == dsl.canonical(tree)


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([(1, "2020-05-06", "x"), (2, "no day", "y")], "k int, startdt string, name string")
    assert [str(r[0])[:10] for r in sources.with_dates(d).select("startdt").collect()] == ["2020-05-06", "None"]
    path = f"{tmp_path}/in/a.parquet"
    d.write.parquet(path)
    assert sources.discover(spark, f"{tmp_path}/in", {"t": {"k", "startdt"}})["t"].endswith("a.parquet")
    with pytest.raises(sources.ContractError):
        sources.discover(spark, f"{tmp_path}/in", {"t": {"absent"}})
    assert sources.discover(spark, f"{tmp_path}/in", {"t": {"absent"}}, strict=False) == {}
    out = f"{tmp_path}/out.parquet"
    sources.write_checked(d, out, lambda x: [])
    with pytest.raises(ValueError):
        sources.write_checked(d.limit(1), out, lambda x: ["too few"] if x.count() < 2 else [])
    assert spark.read.parquet(out).count() == 2
    sources.write_checked(d.limit(1), out, lambda x: [])
    assert spark.read.parquet(out).count() == 1
    sources.write_report(d, f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report_csv").count() == 2
    (tmp_path / "x.jsonl").write_text('{"k": 1}\nbroken\n')
    assert [r.k for r in sources.read_json(spark, f"{tmp_path}/x.jsonl", "k int").collect()] == [1, None]


def test_registered_research_queries_without_sql(spark):
    q = queries_research.QUERIES
    status = {r.signal: r.status for r in q["val_status"](spark, SF).collect()}
    assert status == {"return": "valid", "copy": "near_duplicate_signal", "sparse": "coverage_failure", "flat": "near_constant"}
    assert [r.name for r in q["so_greedy"](spark, SF).orderBy("place").collect()] == ["close", "high", "volume", "open", "low"]
    assert all(r.low <= r.high for r in q["st_bootstrap"](spark, SF).collect())
