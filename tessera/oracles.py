"""DuckDB SQL for the panel queries."""

from __future__ import annotations

import math

from .functions import INDUSTRIES, OFF_EDGE

PANEL = """
WITH li AS (
  SELECT l_suppkey AS a, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_extendedprice / 1000 AS px, l_quantity AS q,
    (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem),
bar AS (SELECT a, d, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume FROM li GROUP BY a, d),
cal AS (SELECT d, CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT d FROM bar)),
grid AS (SELECT x.a, c.t, c.d, open, high, low, close, volume FROM (SELECT DISTINCT a FROM bar) x CROSS JOIN cal c LEFT JOIN bar b ON b.a = x.a AND b.d = c.d),
r AS (SELECT *, close / lag(close) OVER (PARTITION BY a ORDER BY t) - 1 AS ret FROM grid),
m AS (SELECT r.*, s_nationkey AS nation,
    (d BETWEEN DATE '1995-01-01' + to_months(CAST(a % 12 AS INTEGER)) AND DATE '2001-12-31' - to_months(CAST(a % 7 AS INTEGER)) AND a % 10 <> 0) AS member,
    coalesce(close > 0 AND volume > 0 AND ret IS NOT NULL AND s_nationkey NOT IN (3, 7), false) AS eligible
  FROM r LEFT JOIN supplier ON s_suppkey = a),
p AS (SELECT *, member AND eligible AS mask FROM m)
"""


def least(w: int) -> int:
    return max(1, math.ceil(0.8 * w - 1e-9))


def win(w: int) -> str:
    return f"(PARTITION BY a ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def fold(expr: str, digits: int = 6) -> str:
    return f"CAST(round(CAST({expr} AS DOUBLE) + CAST({OFF_EDGE} AS DOUBLE), {digits}) + 0.0 AS DOUBLE)"


def signal(expr: str, source: str = "p", more: str = "") -> str:
    return f"{PANEL}{more} SELECT a, t, {fold(expr)} AS v FROM {source}"


def gated(f: str, x: str, w: int, n: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {win(w)} >= {n or least(w)} THEN {f} END"


def rolled(f: str, x: str, w: int) -> str:
    return gated(f"{f}({x}) OVER {win(w)}", x, w)


def spread(f: str, x: str, w: int) -> str:
    v = f"{f}({x}) OVER {win(w)}"
    return f"CASE WHEN count({x}) OVER {win(w)} >= {max(2, least(w))} AND abs({v}) >= 1e-12 THEN {v} END"


def rank_of(x: str, mask: str = "mask") -> str:
    own = f"(CASE WHEN {mask} THEN {x} END)"
    return f"CASE WHEN {own} IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY {own} NULLS LAST) + (count(*) OVER (PARTITION BY t, {own}) - 1) / 2.0) / count({own}) OVER (PARTITION BY t) END"


def z_of(x: str, mask: str = "mask", tiny: str = "0") -> str:
    own = f"(CASE WHEN {mask} THEN {x} END)"
    return f"CASE WHEN stddev_pop({own}) OVER (PARTITION BY t) > {tiny} THEN ({own} - avg({own}) OVER (PARTITION BY t)) / stddev_pop({own}) OVER (PARTITION BY t) END"


def div(x: str, y: str) -> str:
    return f"(CASE WHEN {y} IS NOT NULL THEN {x} / ((CASE WHEN {y} < 0 THEN -1.0 ELSE 1.0 END) * greatest(abs({y}), 1e-6)) END)"


def _wma(x: str, w: int) -> str:
    g, o = f"coalesce({x}, 0)", f"(CASE WHEN {x} IS NULL THEN 0.0 ELSE 1.0 END)"
    s = lambda e: f"sum({e}) OVER {win(w)}"
    return gated(f"(({w} - t) * {s(g)} + {s(f't * {g}')}) / nullif(({w} - t) * {s(o)} + {s(f't * {o}')}, 0)", x, w)


def _pair(f: str, x: str, y: str, w: int) -> str:
    jx, jy = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    cov = f"covar_samp({jx}, {jy}) OVER {win(w)}"
    v = cov if f == "cov" else f"{cov} / nullif((stddev_samp({jx}) OVER {win(w)}) * (stddev_samp({jy}) OVER {win(w)}), 0)"
    return gated(v, jx, w, max(2, least(w)))



C, R, V, O, H, L = "close", "ret", "volume", "open", "high", "low"

#: key -> (expression of the language, SQL over the panel)
SIGNALS: dict[str, tuple[str, str]] = {
    "sc_abs": ("Abs(Sub($close,$open))", signal("abs(close - open)")),
    "sc_sign": ("Sign(Sub($close,$open))", signal("CAST(sign(close - open) AS DOUBLE)")),
    "sc_log": ("Log($close)", signal("ln(abs(close) + 1e-6)")),
    "sc_add": ("Add($close,$open)", signal("close + open")),
    "sc_sub": ("Sub($high,$low)", signal("high - low")),
    "sc_mul": ("Mul($close,$volume)", signal("close * volume")),
    "sc_div": ("Div($close,Sub($high,$low))", signal(div("close", "(high - low)"))),
    "sc_greater": ("Greater($close,$open)", signal("CAST(CASE WHEN close IS NOT NULL AND open IS NOT NULL THEN CASE WHEN close > open THEN 1 ELSE 0 END END AS DOUBLE)")),
    "sc_less": ("Less($close,$open)", signal("CAST(CASE WHEN close IS NOT NULL AND open IS NOT NULL THEN CASE WHEN close < open THEN 1 ELSE 0 END END AS DOUBLE)")),
    "sc_const": ("Mul($close,-0.5)", signal("close * -0.5")),
    "ts_ref": ("Ref($close,5)", signal("lag(close, 5) OVER (PARTITION BY a ORDER BY t)")),
    "ts_delta": ("Delta($close,5)", signal("close - lag(close, 5) OVER (PARTITION BY a ORDER BY t)")),
    "ts_mean": ("Mean($close,20)", signal(rolled("avg", C, 20))),
    "ts_sum": ("Sum($close,20)", signal(rolled("sum", C, 20))),
    "ts_std": ("Std($close,20)", signal(spread("stddev_samp", C, 20))),
    "ts_var": ("Var($close,20)", signal(spread("var_samp", C, 20))),
    "ts_max": ("Max($close,20)", signal(rolled("max", C, 20))),
    "ts_min": ("Min($close,20)", signal(rolled("min", C, 20))),
    "ts_med": ("Med($close,20)", signal(rolled("median", C, 20))),
    "ts_mad": ("Mad($close,20)", signal(rolled("mad", C, 20))),
    "ts_tsrank": ("TSRank($close,20)", signal(gated("CASE WHEN close IS NOT NULL THEN (len(list_filter(l, lambda e: e < close)) + (len(list_filter(l, lambda e: e = close)) + 1) / 2.0) / len(l) END", C, 20), "q", f", q AS (SELECT *, list(close) FILTER (close IS NOT NULL) OVER {win(20)} AS l FROM p)")),
    "ts_wma": ("WMA($close,20)", signal(_wma(C, 20))),
    "ts_cov": ("Cov($close,$volume,20)", signal(_pair("cov", C, V, 20), "p")),
    "ts_corr": ("Corr($close,$volume,20)", signal(_pair("corr", C, V, 20))),
    "ts_window_1": ("Mean($close,1)", signal("close")),
    "cs_rank": ("CSRank($close)", signal(rank_of(C))),
    "cs_zscore": ("CSZScore($close)", signal(z_of(C))),
    "dsl_csrank_mean": ("CSRank(Mean($close,20))", signal(rank_of("x"), "q", f", q AS (SELECT *, {rolled('avg', C, 20)} AS x FROM p)")),
    "dsl_csrank_corr": ("CSRank(Corr($close,$volume,20))", signal(rank_of("x"), "q", f", q AS (SELECT *, {_pair('corr', C, V, 20)} AS x FROM p)")),
    "dsl_zscore_delta_std": ("CSZScore(Div(Delta($close,5),Std($close,20)))", signal(z_of(div("x", "y")), "q", f", q AS (SELECT *, close - lag(close, 5) OVER (PARTITION BY a ORDER BY t) AS x, {spread('stddev_samp', C, 20)} AS y FROM p)")),
    "dsl_div_mean": ("Div($close,Mean($close,20))", signal(div("close", "x"), "q", f", q AS (SELECT *, {rolled('avg', C, 20)} AS x FROM p)")),
    "dsl_nested_mean": ("Mean(Mean($close,5),10)", signal(rolled("avg", "x", 10), "q", f", q AS (SELECT *, {rolled('avg', C, 5)} AS x FROM p)")),
    "dsl_depth6": ("Abs(Sub(CSRank(Mean(Log($close),10)),CSRank(Ref($volume,5))))", signal(f"abs(({rank_of('x')}) - ({rank_of('y')}))", "q", f", q AS (SELECT *, {rolled('avg', 'ln(abs(close) + 1e-6)', 10)} AS x, lag(volume, 5) OVER (PARTITION BY a ORDER BY t) AS y FROM p)")),
}

RECURSIVE = PANEL.replace("WITH li", "WITH RECURSIVE li", 1)


def ema_of(x: str, w: int) -> str:
    """CTE e: a, t, e (the exponential mean), n (values so far)."""
    keep = f"pow(1 - 2.0 / {w + 1}, p.t - e.at)"
    return f"""e AS (
  SELECT a, t, {x} AS e, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS n, CAST(t AS INTEGER) AS at FROM p WHERE t = 0
  UNION ALL
  SELECT p.a, p.t, CASE WHEN p.{x} IS NULL THEN e.e WHEN e.e IS NULL THEN p.{x} ELSE ({keep} * e.e + 2.0 / {w + 1} * p.{x}) / ({keep} + 2.0 / {w + 1}) END,
    e.n + CASE WHEN p.{x} IS NULL THEN 0 ELSE 1 END, CASE WHEN p.{x} IS NULL THEN e.at ELSE CAST(p.t AS INTEGER) END
  FROM e JOIN p ON p.a = e.a AND p.t = e.t + 1)"""


EMA = f"{RECURSIVE}, {ema_of('close', 20)} SELECT a, t, {fold('CASE WHEN n >= 16 THEN e END')} AS v FROM e"

_IND = "CASE " + " ".join(f"WHEN {' OR '.join(f'code BETWEEN {lo} AND {hi}' for lo, hi in ranges)} THEN '{name}'" for name, ranges in INDUSTRIES) + " ELSE 'Other' END"
_STD = f"""w AS (SELECT *, CASE WHEN mask THEN close END AS x FROM p),
q AS (SELECT *, quantile_cont(x, 0.01) OVER (PARTITION BY t) AS lo, quantile_cont(x, 0.99) OVER (PARTITION BY t) AS hi FROM w),
k AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END AS c FROM q),
s AS (SELECT *, {z_of('c', 'true', '1e-12')} AS z FROM k)"""
_LABEL = "lab AS (SELECT *, CASE WHEN count(ret) OVER f = 4 THEN product(1 + ret) OVER f - 1 END AS y FROM p WINDOW f AS (PARTITION BY a ORDER BY t ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING))"
_MKT = "mk AS (SELECT t, avg(ret) AS mret FROM p WHERE member GROUP BY t)"
_FACTORS = f"""fac AS (SELECT a, t, mask, y, close, volume, ret, {z_of('close')} AS z1, {z_of('ln(volume + 1)')} AS z2 FROM lab)"""


def _ic(x: str, y: str, zero: bool = False) -> str:
    jx, jy = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    ok = f"count({jx}) >= 3 AND var_pop({jy}) * count({jx}) > 1e-24"
    extra = f"WHEN {ok} AND var_pop({jx}) * count({jx}) <= 1e-24 THEN 0.0 " if zero else ""
    return f"CASE {extra}WHEN {ok} AND var_pop({jx}) * count({jx}) > 1e-24 THEN covar_pop({jx}, {jy}) / sqrt(var_pop({jx}) * var_pop({jy})) END"


_RANKS = "rk AS (SELECT t, rank() OVER (PARTITION BY t ORDER BY close) + (count(*) OVER (PARTITION BY t, close) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY t ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2.0 AS ry FROM lab WHERE mask AND close IS NOT NULL AND y IS NOT NULL)"
_TARGET = """tg AS (SELECT a, t, ret, s, CASE WHEN s IS NULL THEN NULL WHEN n >= 10 AND rn > n - k THEN 0.5 / k WHEN n >= 10 AND rn <= k THEN -0.5 / k ELSE 0.0 END AS target
  FROM (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS k FROM (
    SELECT a, t, ret, s, count(s) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY s NULLS LAST, a) AS rn FROM (SELECT a, t, ret, CASE WHEN mask THEN close END AS s FROM p))))"""
_HELD = f"""{_TARGET}, nd AS (SELECT max(t) + 1 AS n FROM p),
h AS (SELECT x.a, CAST(u.t AS INTEGER) AS t, sum(x.target / 4) AS weight FROM tg x, nd, LATERAL (SELECT unnest(generate_series(x.t + 2, least(x.t + 21, nd.n - 1))) AS t) u
  WHERE x.t % 5 = 0 AND x.t + 2 < nd.n AND x.target <> 0 GROUP BY x.a, u.t),
path AS (SELECT h.t, sum(weight * coalesce(p.ret, 0)) AS ret, sum(abs(weight)) AS gross, sum(CASE WHEN p.ret IS NOT NULL THEN abs(weight) ELSE 0 END) / nullif(sum(abs(weight)), 0) AS coverage FROM h LEFT JOIN p USING (a, t) GROUP BY h.t)"""
_HAC_DAYS = f"{_LABEL}, ic AS (SELECT t, {_ic('close', 'y')} AS x FROM lab WHERE mask GROUP BY t), days AS (SELECT DISTINCT t FROM p), ser AS (SELECT t, x FROM days LEFT JOIN ic USING (t))"


def _hac(source: str, lags: int) -> str:
    terms = " + ".join(f"CASE WHEN m >= {k} THEN 2 * (1 - {k} / (m + 1.0)) * c * coalesce(lag(c, {k}) OVER (ORDER BY t), 0) ELSE 0 END" for k in range(1, lags + 1))
    return f"""st AS (SELECT avg(x) AS mean, count(x) AS n, least({lags}, count(*) - 1) AS m FROM {source}), cc AS (SELECT t, m, coalesce(x - mean, 0) AS c FROM {source}, st), ss AS (SELECT c * c + {terms} AS s FROM cc)
SELECT CAST((SELECT n FROM st) AS BIGINT) AS n, {fold('(SELECT mean FROM st)')} AS mean, {fold('CASE WHEN (SELECT n FROM st) >= 2 THEN sqrt(greatest(sum(s), 0)) / (SELECT n FROM st) END')} AS se FROM ss"""


_FUND = """fr AS (SELECT l_suppkey AS a, year(l_shipdate) AS y, sum(l_extendedprice) / 1000 AS rev FROM lineitem GROUP BY 1, 2),
rec AS (SELECT a, make_date(y, 12, 31) AS datadate, make_date(y, 12, 31) + to_months(6) AS available, rev FROM fr)"""

QUERIES: dict[str, str] = {
    **{k: sql for k, (_, sql) in SIGNALS.items()},
    "ts_ema": EMA,
    "sc_coalesce": f"SELECT o_orderkey, CAST(coalesce(CASE WHEN o_totalprice > 250000 THEN o_totalprice END, CASE WHEN o_orderstatus = 'F' THEN -1.0 END, 0.0) AS DOUBLE) AS v, o_orderdate AS d FROM orders".replace(", o_orderdate AS d", ""),
    "sc_industry_map": f"SELECT s_suppkey AS a, {_IND} AS industry FROM (SELECT s_suppkey, (s_suppkey * 137) % 10000 AS code FROM supplier)",
    "sc_hash": "SELECT p_partkey, sha256(upper(trim(p_brand)) || '|' || p_type) AS h FROM part",
    "sc_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "sc_digits": "SELECT c_custkey, regexp_matches(split_part(c_name, '#', 2), '^[0-9]+$') AS ok, TRY_CAST(split_part(c_name, '#', 2) AS BIGINT) AS n FROM customer",
    "ts_label": f"{PANEL}, {_LABEL} SELECT a, t, {fold('y')} AS v FROM lab",
    "ts_beta": f"{PANEL}, {_MKT}, j AS (SELECT a, t, CASE WHEN ret IS NOT NULL THEN mret END AS x, CASE WHEN mret IS NOT NULL THEN ret END AS y FROM p LEFT JOIN mk USING (t)) SELECT a, t, {fold(f'CASE WHEN count(x) OVER {win(60)} >= 30 AND var_samp(x) OVER {win(60)} * (count(x) OVER {win(60)} - 1) > 1e-12 THEN covar_samp(x, y) OVER {win(60)} / var_samp(x) OVER {win(60)} END')} AS v FROM j",
    "ts_resid_vol": f"{PANEL}, {_MKT}, j AS (SELECT a, t, CASE WHEN ret IS NOT NULL THEN mret END AS x, CASE WHEN mret IS NOT NULL THEN ret END AS y FROM p LEFT JOIN mk USING (t)), b AS (SELECT *, count(x) OVER {win(60)} AS n, var_samp(x) OVER {win(60)} AS vx, var_samp(y) OVER {win(60)} AS vy, covar_samp(x, y) OVER {win(60)} AS cv FROM j) SELECT a, t, {fold('CASE WHEN n >= 30 AND vx * (n - 1) > 1e-12 THEN sqrt(greatest(vy - cv / vx * cv, 0)) END')} AS v FROM b",
    "ts_reversal": f"{PANEL} SELECT a, t, {fold('CASE WHEN count(ret) OVER f = 4 THEN exp(sum(ln(1 + ret)) OVER f) - 1 END')} AS v FROM p WINDOW f AS (PARTITION BY a ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "ts_momentum": f"{PANEL} SELECT a, t, {fold('CASE WHEN count(ret) OVER f = 6 THEN exp(sum(ln(1 + ret)) OVER f) - 1 END')} AS v FROM p WINDOW f AS (PARTITION BY a ORDER BY t ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING)",
    "ts_amihud": f"{PANEL}, i AS (SELECT a, t, abs(ret) / (abs(close * volume) + 1e-12) AS x FROM p) SELECT a, t, {fold(f'CASE WHEN count(x) OVER {win(20)} >= 15 THEN ln(avg(x) OVER {win(20)}) END')} AS v FROM i",
    "ts_growth": f"WITH {_FUND}, g AS (SELECT a, y, rev, lag(rev) OVER (PARTITION BY a ORDER BY y) AS b FROM fr) SELECT a, CAST(y AS INTEGER) AS y, {fold('CASE WHEN rev > 0 AND b > 0 THEN rev / b - 1 END')} AS v FROM g",
    "ts_interval_overlap": "WITH i AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS e, o_orderkey AS id FROM orders), j AS (SELECT *, lag(e) OVER (PARTITION BY k ORDER BY s, e) AS b FROM i) SELECT k, CAST(count(*) AS BIGINT) AS n FROM j WHERE s <= b GROUP BY k",
    "ts_drawdown": f"{PANEL}, u AS (SELECT a, t, sum(ln(1 + coalesce(ret, 0))) OVER f AS w FROM p WINDOW f AS (PARTITION BY a ORDER BY t)) SELECT a, t, {fold('exp(w - greatest(0, max(w) OVER (PARTITION BY a ORDER BY t))) - 1')} AS v FROM u",
    "cs_standardize": f"{PANEL}, {_STD} SELECT a, t, {fold('z')} AS v FROM s",
    "cs_zscore_plain": f"{PANEL} SELECT a, t, {fold(z_of('volume'))} AS v FROM p",
    "cs_industry_dummies": "SELECT s_suppkey AS a, " + ", ".join(f"CAST(CASE WHEN ind = '{n}' THEN 1 ELSE 0 END AS INTEGER) AS ind_{n.lower()}" for n, _ in INDUSTRIES) + f" FROM (SELECT s_suppkey, {_IND} AS ind FROM (SELECT s_suppkey, (s_suppkey * 137) % 10000 AS code FROM supplier))",
    "cs_exposure_prep": f"""{PANEL}, w AS (SELECT *, CASE WHEN member THEN close END AS x FROM p),
q AS (SELECT *, quantile_cont(x, 0.01) OVER (PARTITION BY t) AS lo, quantile_cont(x, 0.99) OVER (PARTITION BY t) AS hi, count(x) OVER (PARTITION BY t) AS n, count(*) FILTER (member) OVER (PARTITION BY t) AS nm FROM w),
k AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END AS c FROM q),
f AS (SELECT *, CASE WHEN member THEN coalesce(c, median(c) OVER (PARTITION BY t)) END AS f FROM k),
s AS (SELECT *, stddev_pop(f) OVER (PARTITION BY t) AS sd, avg(f) OVER (PARTITION BY t) AS mu FROM f)
SELECT a, t, {fold('CASE WHEN member THEN CASE WHEN n >= greatest(3, least(30, floor(nm / 4))) AND sd > 1e-12 THEN (f - mu) / sd ELSE 0.0 END END')} AS v FROM s""",
    "cs_residual_1f": f"{PANEL}, {_LABEL}, u AS (SELECT *, mask AND close IS NOT NULL AND y IS NOT NULL AS use FROM lab), b AS (SELECT *, count(*) FILTER (use) OVER w AS n, avg(CASE WHEN use THEN close END) OVER w AS mx, avg(CASE WHEN use THEN y END) OVER w AS my, covar_pop(CASE WHEN use THEN y END, CASE WHEN use THEN close END) OVER w AS cv, var_pop(CASE WHEN use THEN close END) OVER w AS vx FROM u WINDOW w AS (PARTITION BY t)) SELECT a, t, {fold('CASE WHEN use AND n > 2 THEN y - my - cv / vx * (close - mx) END')} AS v FROM b",
    "cs_combine": f"{PANEL}, {_LABEL}, {_FACTORS} SELECT a, t, {fold('coalesce(z1, 0) * 0.7 + coalesce(z2, 0) * -0.3')} AS v, (z1 IS NOT NULL OR z2 IS NOT NULL) AS available FROM fac",
    "cs_bucket": f"{PANEL}, {_TARGET} SELECT a, t, {fold('target')} AS v FROM tg",
    "jn_fill": "WITH f AS (SELECT o_orderkey AS k, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS r, o_orderstatus AS flag FROM orders), lk AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT f.k, CAST(round(CASE WHEN flag = 'F' AND r IS NULL THEN v ELSE r END, 2) AS DOUBLE) AS v FROM f LEFT JOIN lk USING (k)",
    "jn_interval_member": f"{PANEL}, iv AS (SELECT s_suppkey AS a, DATE '1995-01-01' + to_months(CAST(s_suppkey % 12 AS INTEGER)) AS s, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '2001-12-31' - to_months(CAST(s_suppkey % 7 AS INTEGER)) END AS e FROM supplier WHERE s_suppkey % 10 <> 0) SELECT a, t FROM p WHERE EXISTS (SELECT 1 FROM iv WHERE iv.a = p.a AND p.d >= s AND p.d <= e)",
    "jn_link_priority": "WITH k AS (SELECT n_nationkey AS nation, s_suppkey AS a, CASE s_suppkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'J' END AS prim, DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER)) AS linkdt FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT nation, a, prim FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY CASE prim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 2 END, linkdt DESC, a) AS rn FROM k) WHERE rn = 1",
    "jn_asof_expiry": f"{PANEL}, {_FUND} SELECT x.a, x.t, {fold('CASE WHEN x.d <= rec.available + to_months(8) THEN rec.rev END', 4)} AS v FROM p x ASOF LEFT JOIN rec ON x.a = rec.a AND x.d >= rec.available",
    "jn_grid": f"{PANEL} SELECT a, t, d, close IS NOT NULL AS filled FROM p",
    "jn_market": f"{PANEL}, {_MKT} SELECT a, t, {fold('ret - mret')} AS v FROM p LEFT JOIN mk USING (t)",
    "jn_anti_seen": "SELECT DISTINCT sha256(p_type) AS h FROM part WHERE sha256(p_type) NOT IN (SELECT sha256(p_type) FROM part WHERE p_size <= 5)",
    "jn_axis_check": "WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), y AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT d, 'left' AS side FROM x WHERE d NOT IN (SELECT d FROM y) UNION ALL SELECT d, 'right' FROM y WHERE d NOT IN (SELECT d FROM x)",
    "ag_daily_ic": f"{PANEL}, {_LABEL} SELECT t, {fold(_ic('close', 'y'))} AS ic FROM lab WHERE mask GROUP BY t",
    "ag_daily_rank_ic": f"{PANEL}, {_LABEL}, {_RANKS} SELECT t, {fold(_ic('rx', 'ry'))} AS rank_ic FROM rk GROUP BY t",
    "ag_ic_zero_rule": f"{PANEL}, {_LABEL} SELECT t, {fold(_ic('c1', 'y', True))} AS ic FROM (SELECT t, y, CASE WHEN close IS NOT NULL THEN 1.0 END AS c1 FROM lab WHERE mask) GROUP BY t",
    "ag_pooled_corr": f"{PANEL}, {_LABEL}, j AS (SELECT close AS x, y FROM lab WHERE mask AND close IS NOT NULL AND y IS NOT NULL) SELECT {fold('CASE WHEN stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END')} AS r FROM j",
    "ag_mean_abs_corr": f"{PANEL}, dd AS (SELECT t, {_ic('close', 'volume')} AS ic FROM p WHERE mask GROUP BY t) SELECT {fold('avg(abs(ic))')} AS r FROM dd",
    "ag_gram": f"{PANEL}, {_LABEL}, {_FACTORS}, dd AS (SELECT t, avg(z1*z1) AS m11, avg(z1*z2) AS m12, avg(z2*z2) AS m22, avg(z1*y) AS m1y, avg(z2*y) AS m2y FROM (SELECT t, coalesce(z1, 0) AS z1, coalesce(z2, 0) AS z2, y FROM fac WHERE mask AND y IS NOT NULL) GROUP BY t HAVING count(*) >= 3) " + " UNION ALL ".join(f"SELECT '{i}' AS i, '{j}' AS j, {fold(f'avg({m})')} AS value FROM dd" for i, j, m in (("z1", "z1", "m11"), ("z1", "z2", "m12"), ("z1", "y", "m1y"), ("z2", "z2", "m22"), ("z2", "y", "m2y"))),
    "ag_missingness": f"{PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({x}) AS BIGINT) AS nulls, CAST(count(*) FILTER (isnan({x}) OR isinf({x})) AS BIGINT) AS non_finite FROM p" for c, x in (("open", "open"), ("close", "close"), ("volume", "volume"), ("return", "ret"))),
    "ag_date_coverage": f"{PANEL}, s AS (SELECT 'all' AS scope, * FROM p UNION ALL SELECT 'member', * FROM p WHERE member UNION ALL SELECT 'eligible', * FROM p WHERE eligible) SELECT scope, min(d) AS first_day, max(d) AS last_day, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT d) AS BIGINT) AS days, CAST(count(DISTINCT a) AS BIGINT) AS assets FROM s GROUP BY scope",
    "ag_universe_counts": f"{PANEL}, {_LABEL} SELECT t, CAST(count(*) FILTER (member) AS BIGINT) AS members, CAST(count(*) FILTER (eligible) AS BIGINT) AS eligible_n, CAST(count(*) FILTER (mask) AS BIGINT) AS both_n, CAST(count(y) AS BIGINT) AS labels FROM lab GROUP BY t",
    "ag_quantiles": f"{PANEL} SELECT {', '.join(f'{fold(f'quantile_cont(ret, {q})')} AS {n}' for q, n in ((0.001, 'q001'), (0.01, 'q01'), (0.5, 'q50'), (0.99, 'q99'), (0.999, 'q999')))} FROM p",
    "ag_summary": f"{PANEL} SELECT a, {fold('median(ret)')} AS med, {fold('avg(ret)')} AS mean, {fold('stddev_samp(ret)')} AS sd, {fold('avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END)')} AS positive, CAST(count(ret) AS BIGINT) AS n FROM p GROUP BY a",
    "ag_strict_mean": f"{PANEL} SELECT nation, t, {fold('CASE WHEN count(ret) = count(*) THEN avg(ret) END')} AS v FROM p GROUP BY nation, t",
    "ag_max_by": "SELECT p_brand, CAST(arg_max(p_partkey, (p_retailprice, p_partkey)) AS BIGINT) AS best, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand",
    "fl_eligibility": f"{PANEL} SELECT a, t, eligible, mask FROM p",
    "fl_standard": "SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS seg, CAST(o_orderdate AS DATE) + to_months(6) AS available FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'".replace("CAST(o_orderdate AS DATE) + to_months(6)", "CAST(CAST(o_orderdate AS DATE) + to_months(6) AS DATE)"),
    "fl_adjust": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(CASE WHEN l_discount > 0 THEN l_extendedprice / (l_discount * 10) END, 4) AS DOUBLE) AS adj_price, CAST(round(CASE WHEN l_tax > 0 THEN l_quantity * (l_tax * 10) END, 4) AS DOUBLE) AS adj_volume FROM lineitem",
    "fl_label_containment": f"{PANEL}, {_LABEL}, x AS (SELECT *, lead(d, 5) OVER (PARTITION BY a ORDER BY t) AS exit_d FROM lab) SELECT a, t, {fold('CASE WHEN year(exit_d) = year(d) THEN y END')} AS v FROM x",
    "fl_purge": f"{PANEL}, x AS (SELECT t, d, lead(d, 5) OVER (ORDER BY t) AS exit_d FROM cal) SELECT t, year(d) % 2 = 0 AS even_fold, coalesce(year(exit_d) = year(d), false) AS usable FROM x",
    "so_topk": f"{PANEL}, x AS (SELECT a, t, row_number() OVER (PARTITION BY t ORDER BY close DESC, a) AS rn FROM p WHERE mask) SELECT t, a, CAST(rn AS INTEGER) AS rn FROM x WHERE rn <= 3",
    "so_argmax_ties": "SELECT p_partkey, p_size, CAST(p_retailprice AS DOUBLE) AS price FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 1",
    "se_union": "SELECT nation, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY nation",
    "se_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "se_intersect": "SELECT CAST(count(*) AS BIGINT) AS both_n, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part)) AS any_n FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part)",
    "se_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "se_cross": "SELECT r_name, s.seed, m.method FROM region CROSS JOIN (VALUES (0), (1), (2)) s(seed) CROSS JOIN (VALUES ('random'), ('gp')) m(method)",
    "val_coverage": f"{PANEL}, x AS (SELECT *, {rolled('avg', C, 20)} AS s FROM p), dd AS (SELECT t, count(*) AS n, count(s) AS ns, var_pop(s) AS v FROM x WHERE member GROUP BY t) SELECT {fold('sum(ns) / sum(n)')} AS coverage, CAST(count(*) FILTER (ns >= 5) AS BIGINT) AS valid_days, {fold('count(*) FILTER (ns >= 5 AND v > 1e-12) / nullif(count(*) FILTER (ns >= 5), 0)')} AS variable_rate FROM dd",
    "po_composite_ic": f"{PANEL}, {_LABEL}, {_FACTORS}, cx AS (SELECT t, y, coalesce(z1, 0) * 0.7 - coalesce(z2, 0) * 0.3 AS s FROM fac WHERE mask) SELECT t, {fold(_ic('s', 'y'))} AS ic FROM cx GROUP BY t",
    "st_gap_hac": f"{PANEL}, {_HAC_DAYS}, {_hac('ser', 4)}",
    "st_nw": f"{PANEL}, {_HAC_DAYS}, pr AS (SELECT row_number() OVER (ORDER BY t) AS t, x FROM ser WHERE x IS NOT NULL), {_hac('pr', 4)}",
    "st_bh": f"WITH f AS (SELECT p_brand AS name, least(1.0, avg(p_retailprice) / 2000 * (min(p_partkey) % 7 + 1) / 7.0) AS pv FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY pv, name) AS rn, count(*) OVER () AS m FROM f) SELECT name, {fold('least(1.0, min(pv * m / rn) OVER (ORDER BY pv, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q FROM r",
    "pf_target": f"{PANEL}, {_TARGET} SELECT t, CAST(count(*) FILTER (target > 0) AS BIGINT) AS longs, CAST(count(*) FILTER (target < 0) AS BIGINT) AS shorts, {fold('sum(target)')} AS net, {fold('sum(abs(target))')} AS gross FROM tg GROUP BY t",
    "pf_sleeve_weights": f"{PANEL}, {_HELD} SELECT a, t, {fold('weight')} AS weight FROM h",
    "pf_turnover": f"{PANEL}, {_TARGET}, nd AS (SELECT max(t) + 1 AS n FROM p), o AS (SELECT t, a, target FROM tg, nd WHERE t % 5 = 0 AND t + 2 < n), b AS (SELECT t + 20 AS t, a, target AS before FROM o WHERE t + 20 IN (SELECT t FROM o)) SELECT CAST(t + 1 AS INTEGER) AS t, {fold('sum(abs(coalesce(target, 0) - coalesce(before, 0)) / 4)')} AS turnover FROM o FULL JOIN b USING (t, a) GROUP BY t",
    "pf_returns": f"{PANEL}, {_HELD} SELECT t, {fold('ret')} AS ret, {fold('gross')} AS gross, {fold('coverage')} AS coverage FROM path",
    "pf_exposure": f"{PANEL}, {_HELD}, e AS (SELECT h.t, weight, volume FROM h LEFT JOIN p USING (a, t)) SELECT t, {fold('CASE WHEN count(volume) = count(*) THEN sum(weight * volume) END')} AS volume FROM e GROUP BY t",
    "dv_keys": "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "rp_ic_summary": f"{PANEL}, {_LABEL}, dd AS (SELECT t, any_value(year(d)) AS y, {_ic('close', 'y')} AS ic FROM lab WHERE mask GROUP BY t) SELECT CAST(y AS INTEGER) AS y, CAST(count(ic) AS BIGINT) AS n, {fold('avg(ic)')} AS mean, {fold('stddev_samp(ic)')} AS sd, {fold('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS positive FROM dd GROUP BY y",
}
