"""DuckDB SQL for the research queries, written from the rows up and not from the daily statistics."""

from __future__ import annotations

from .operators.inference import _ERFC
from .oracles import _FACTORS, _HAC_DAYS, _HELD, _LABEL, _MKT, PANEL, RECURSIVE, _ic, div, ema_of, fold, rank_of, rolled, spread, z_of

L = 0.01
_U = f"""{_LABEL}, {_FACTORS}, cx AS (SELECT t, d, lead(d, 5) OVER (ORDER BY t) AS ex FROM cal),
u AS (SELECT a, fac.t, coalesce(z1, 0) AS z1, coalesce(z2, 0) AS z2, y, d, ex FROM fac JOIN cx USING (t) WHERE mask AND y IS NOT NULL),
ds AS (SELECT t, any_value(d) AS d, any_value(ex) AS ex, avg(z1 * z1) AS g11, avg(z1 * z2) AS g12, avg(z2 * z2) AS g22, avg(z1 * y) AS p1, avg(z2 * y) AS p2 FROM u GROUP BY t HAVING count(*) >= 3)"""
_MEANS = "avg(g11) AS g11, avg(g12) AS g12, avg(g22) AS g22, avg(p1) AS p1, avg(p2) AS p2"
_SOLVE = f"""((g22 + {L}) * p1 - g12 * p2) / ((g11 + {L}) * (g22 + {L}) - g12 * g12) AS w1, ((g11 + {L}) * p2 - g12 * p1) / ((g11 + {L}) * (g22 + {L}) - g12 * g12) AS w2,
p1 / (g11 + {L}) AS o1, p2 / (g22 + {L}) AS o2, (g22 + {L}) / ((g11 + {L}) * (g22 + {L}) - g12 * g12) AS v1, (g11 + {L}) / ((g11 + {L}) * (g22 + {L}) - g12 * g12) AS v2"""
_ALL = f"{_U}, al AS (SELECT count(*) AS days, {_MEANS} FROM ds), wt AS (SELECT *, {_SOLVE} FROM al)"
_FOLDS = f"""{_U}, fd AS (SELECT * FROM (VALUES (0, 1995, 1997, 1998, 1998), (1, 1995, 1998, 1999, 1999), (2, 1995, 1999, 2000, 2000)) f(f, a0, a1, s0, s1)),
fm AS (SELECT f, s0, s1, {_MEANS} FROM fd JOIN ds ON year(d) BETWEEN a0 AND a1 AND year(ex) <= a1 GROUP BY f, s0, s1), wt AS (SELECT f, s0, s1, {_SOLVE} FROM fm),
sc AS (SELECT t, f, y, w1 * z1 + w2 * z2 AS s, o1 * z1 AS b FROM u JOIN wt ON year(d) BETWEEN s0 AND s1 AND year(ex) <= s1)"""


def _days_ic(x: str, y: str = "y") -> str:
    return _ic(x, y, True)


def p_of(t: str) -> str:
    x = f"(abs({t}) / sqrt(2.0))"
    u = f"(1.0 / (1.0 + 0.5 * {x}))"
    poly = repr(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        poly = f"(({poly}) * {u} + ({c!r}))"
    return f"({u} * exp(-{x} * {x} + {poly}))"


def _summary(source: str, keys: str = "", lags: int = 4) -> str:
    """CTEs up to `sm`: keys, n, mean, sd, se, t_value of (keys, t, x)."""
    k, by = (f"{keys}, ", f"PARTITION BY {keys} ") if keys else ("", "")
    terms = " + ".join(f"CASE WHEN m >= {j} THEN 2 * (1 - {j} / (m + 1.0)) * c * coalesce(lag(c, {j}) OVER ({by}ORDER BY t), 0) ELSE 0 END" for j in range(1, lags + 1))
    on = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""s1 AS (SELECT {k}avg(x) AS mean, count(x) AS n, least({lags}, count(*) - 1) AS m, CASE WHEN count(x) > 1 THEN stddev_samp(x) WHEN count(x) = 1 THEN 0.0 END AS sd FROM {source} {group}),
s2 AS (SELECT {k}t, m, coalesce(x - mean, 0) AS c FROM {source} JOIN s1 {on}), s3 AS (SELECT {k}c * c + {terms} AS s FROM s2), s4 AS (SELECT {k}sum(s) AS s FROM s3 {group}),
s5 AS (SELECT {k}mean, n, sd, CASE WHEN n >= 2 THEN sqrt(greatest(s, 0)) / n END AS se FROM s1 JOIN s4 {on}), sm AS (SELECT *, CASE WHEN se > 0 THEN mean / se END AS t_value FROM s5)"""


_SUMMED = f"CAST(n AS BIGINT) AS n, {fold('mean')} AS mean, {fold('sd')} AS sd, {fold('se')} AS se, {fold('t_value')} AS t_value, {fold(p_of('t_value'))} AS p_value"


def _r(*names: str) -> str:
    return ", ".join(f"{fold(n)} AS {n}" for n in names)


_NAMES = ("close", "volume", "open", "return")
_ICS = f"{_LABEL}, dv AS (SELECT t, {', '.join(f'{_ic("ret" if n == "return" else n, "y")} AS i_{n}' for n in _NAMES)} FROM lab WHERE mask GROUP BY t), iw AS (SELECT c.t, c.d, {', '.join(f'i_{n}' for n in _NAMES)} FROM cal c LEFT JOIN dv USING (t))"
_CAND = "cd AS (SELECT p_brand AS grp, p_partkey AS id, p_brand || ':' || CAST(p_partkey % 40 AS VARCHAR) AS k, (p_size - 25) / 1000.0::DOUBLE AS delta, p_partkey % 7 <> 0 AS valid, (p_size - 25) / 1000.0::DOUBLE - (p_partkey % 5) / 1000.0::DOUBLE AS post, p_partkey % 11 = 0 AS evicted FROM part)"
_LINKS = """fr AS (SELECT l_suppkey AS a, year(l_shipdate) AS y, sum(l_extendedprice) / 1000 AS rev FROM lineitem GROUP BY 1, 2),
lk AS (SELECT s_suppkey AS a, s_nationkey, DATE '1995-01-01' + to_months(CAST(s_suppkey % 24 AS INTEGER)) AS linkdt, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2001-12-31' - to_months(CAST(s_suppkey % 40 AS INTEGER)) END AS linkend FROM supplier),
rl AS (SELECT fr.a, y, make_date(y, 12, 31) AS datadate, rev, s_nationkey, linkdt, linkend FROM fr JOIN lk USING (a) WHERE linkdt <= make_date(y, 12, 31) AND (linkend IS NULL OR make_date(y, 12, 31) <= linkend))"""


def metrics_of(path: str, year: float) -> str:
    """From (t, ret): days, total, cagr, mean, vol, sharpe, drawdown, invalid; no return is exactly -1."""
    return f"""m1 AS (SELECT t, ret, sum(ln(1 + CASE WHEN ret > -1 THEN ret END)) OVER (ORDER BY t) AS l FROM {path}), m2 AS (SELECT *, exp(l - greatest(0, max(l) OVER (ORDER BY t))) - 1 AS dd FROM m1),
m3 AS (SELECT count(*) AS days, sum(ln(1 + CASE WHEN ret > -1 THEN ret END)) AS lw, avg(ret) * {year} AS mean, coalesce(stddev_samp(ret), 0) * sqrt({year}) AS vol, least(0, min(dd)) AS drawdown, count(*) = 0 OR count(*) FILTER (ret IS NULL OR ret < -1) > 0 AS invalid FROM m2)
SELECT CAST(days AS BIGINT) AS days, {', '.join(f"{fold(f'CASE WHEN NOT invalid THEN {x} END')} AS {n}" for x, n in (("exp(lw) - 1", "total"), (f"pow(exp(lw), {year} / days) - 1", "cagr"), ("mean", "mean"), ("vol", "vol"), ("drawdown", "drawdown"), ("CASE WHEN vol > 0 THEN mean / vol END", "sharpe")))}, invalid FROM m3"""


def _std(x: str, ok: str, source: str, name: str, out: str, keep: str = "*") -> str:
    """CTEs that add `out`: x on the rows `ok`, winsorised and z-scored."""
    own = f"(CASE WHEN {ok} THEN {x} END)"
    return f"""{name}1 AS (SELECT {keep}, quantile_cont({own}, 0.01) OVER (PARTITION BY t) AS {name}lo, quantile_cont({own}, 0.99) OVER (PARTITION BY t) AS {name}hi FROM {source}),
{name}2 AS (SELECT *, CASE WHEN {own} IS NOT NULL THEN greatest(least({own}, {name}hi), {name}lo) END AS {name}c FROM {name}1), {name}3 AS (SELECT *, {z_of(f'{name}c', 'true', '1e-12')} AS {out} FROM {name}2)"""


def _res(x: str) -> str:
    w = "OVER (PARTITION BY t)"
    own = f"(CASE WHEN mt THEN {x} END)"
    e = "(CASE WHEN mt THEN sz END)"
    return f"CASE WHEN mt AND count({e}) {w} > 2 THEN {x} - avg({own}) {w} - covar_pop({own}, {e}) {w} / var_pop({e}) {w} * (sz - avg({e}) {w}) END"


def _regressed(target: str, out: str) -> str:
    """CTEs that regress the target on three exposures date by date, one orthogonal step after the other, ending in `out` (a, t, v)."""
    w = "OVER (PARTITION BY t)"
    on = lambda x, *rs: f"{x} - avg({x}) {w}" + "".join(f" - covar_pop({x}, {r}) {w} / var_pop({r}) {w} * {r}" for r in rs)
    return f"""{out}0 AS (SELECT a, t, {target} AS x, z1 AS e1, z2 AS e2, z3 AS e3, count(*) {w} AS n FROM fz WHERE mask AND {target} IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL AND z3 IS NOT NULL),
{out}1 AS (SELECT *, e1 - avg(e1) {w} AS r1 FROM {out}0 WHERE n > 4), {out}2 AS (SELECT *, {on('e2', 'r1')} AS r2 FROM {out}1), {out}3 AS (SELECT *, {on('e3', 'r1', 'r2')} AS r3 FROM {out}2),
{out} AS (SELECT a, t, {on('x', 'r1', 'r2', 'r3')} AS v FROM {out}3)"""


_NATIONS = PANEL.split("\nm AS")[0].rstrip().rstrip(",").replace("SELECT l_suppkey AS a", "SELECT CAST(s_nationkey AS BIGINT) AS a").replace("AS k FROM lineitem", "AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
_M20, _S20 = rolled("avg", "close", 20), spread("stddev_samp", "close", 20)
_BATCH = f"""{ema_of('close', 10)}, b0 AS (SELECT *, {_M20} AS m, {_S20} AS s, list(volume) FILTER (volume IS NOT NULL) OVER (PARTITION BY a ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS vl FROM p),
b1 AS (SELECT *, {rank_of('m')} AS rm, {rank_of('s')} AS rs FROM b0)"""
_DUP = """SELECT t, count(close) AS nv FROM p WHERE mask GROUP BY t"""


def _dup(m: str) -> str:
    return f"""(SELECT '{m}' AS member, coalesce((SELECT avg(abs(ic)) FROM (SELECT t, {_ic('close', m)} AS ic FROM p WHERE mask GROUP BY t) JOIN nd USING (t) WHERE nv >= 5), 0) AS daily,
(SELECT abs(covar_pop(close, {m}) / (stddev_pop(close) * stddev_pop({m}))) FROM p WHERE mask AND close IS NOT NULL AND {m} IS NOT NULL) AS pooled,
coalesce((SELECT avg(abs(ic)) FROM (SELECT t, {_ic('rx', 'ry')} AS ic FROM (SELECT t, rank() OVER (PARTITION BY t ORDER BY close) + (count(*) OVER (PARTITION BY t, close) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY t ORDER BY {m}) + (count(*) OVER (PARTITION BY t, {m}) - 1) / 2.0 AS ry FROM p WHERE mask AND close IS NOT NULL AND {m} IS NOT NULL) GROUP BY t) JOIN nd USING (t) WHERE nv >= 5), 0) AS ranked,
(SELECT count(ic) FROM (SELECT t, {_ic('close', m)} AS ic FROM p WHERE mask GROUP BY t) JOIN nd USING (t) WHERE nv >= 5) / greatest(1, (SELECT count(*) FROM nd WHERE nv >= 5)) AS corr_coverage)"""


QUERIES: dict[str, str] = {
    "po_moments": f"{PANEL}, {_ALL}, ev AS (SELECT *, (g11 + g22) / 2 AS h, sqrt(pow((g11 - g22) / 2, 2) + g12 * g12) AS q FROM wt) " + " UNION ALL ".join(f"SELECT {i} AS i, CAST(days AS INTEGER) AS days, {fold(a)} AS g0, {fold(b)} AS g1, {fold(p)} AS p, {fold(w)} AS w, {fold(f'{w} * {w} / {v}')} AS saliency, {fold('h - q')} AS low, {fold('(h + q) / (h - q)')} AS condition FROM ev" for i, a, b, p, w, v in ((0, "g11", "g12", "p1", "w1", "v1"), (1, "g12", "g22", "p2", "w2", "v2"))),
    "po_subsets": f"{PANEL}, {_ALL}, sb AS (SELECT t, y, w1 * z1 + w2 * z2 AS s_both, o1 * z1 AS s_first, o2 * z2 AS s_second, 0.0 AS s_none FROM u, wt), dd AS (SELECT t, {', '.join(f'{_days_ic(f"s_{n}")} AS i_{n}' for n in ('both', 'first', 'second', 'none'))} FROM sb GROUP BY t) " + " UNION ALL ".join(f"SELECT '{n}' AS pool, CAST(count(i_{n}) AS BIGINT) AS days, {fold(f'avg(i_{n})')} AS ic FROM dd" for n in ("both", "first", "second", "none")),
    "po_add_many": f"{PANEL}, {_LABEL}, f3 AS (SELECT t, mask, y, {z_of('close')} AS z1, {z_of('ln(volume + 1)')} AS z2, {z_of('high - low')} AS z3 FROM lab), u3 AS (SELECT t, y, coalesce(z1, 0) AS z1, coalesce(z2, 0) AS z2, coalesce(z3, 0) AS z3 FROM f3 WHERE mask AND y IS NOT NULL), "
    + ", ".join(f"ds{k} AS (SELECT t, avg(z1 * z1) AS g11, avg(z1 * z{k}) AS g12, avg(z{k} * z{k}) AS g22, avg(z1 * y) AS p1, avg(z{k} * y) AS p2 FROM u3 GROUP BY t HAVING count(*) >= 3), al{k} AS (SELECT {_MEANS} FROM ds{k}), wt{k} AS (SELECT {_SOLVE} FROM al{k}), sb{k} AS (SELECT t, y, w1 * z1 + w2 * z{k} AS s, o1 * z1 AS b FROM u3, wt{k}), di{k} AS (SELECT t, {_ic('s', 'y', True)} AS s, {_ic('b', 'y', True)} AS b FROM sb{k} GROUP BY t)" for k in (2, 3))
    + " " + " UNION ALL ".join(f"SELECT '{n}' AS candidate, {fold('avg(s)')} AS ic, {fold('avg(s - b)')} AS delta FROM di{k}" for k, n in ((2, "second"), (3, "third"))),
    "po_walk_forward": f"{PANEL}, {_FOLDS} SELECT t, CAST(f AS INTEGER) AS fold, {fold(_days_ic('s'))} AS ic FROM sc GROUP BY t, f",
    "po_increment": f"{PANEL}, {_FOLDS}, dd AS (SELECT t, f, {_days_ic('s')} - {_days_ic('b')} AS x FROM sc GROUP BY t, f), ser AS (SELECT c.t, x FROM cal c LEFT JOIN dd USING (t)), {_summary('ser')} SELECT CAST(n AS BIGINT) AS n, {_r('mean', 'se')}, {fold('mean - 0.5 * se')} AS lower, {', '.join(f'{fold(f"(SELECT avg(x) FROM dd WHERE f = {k})")} AS fold{k}' for k in range(3))} FROM sm",
    "po_lower_bound": f"{PANEL}, {_ALL}, sb AS (SELECT t, y, w1 * z1 + w2 * z2 AS s FROM u, wt), di AS (SELECT t, {_days_ic('s')} AS x FROM sb GROUP BY t), ser AS (SELECT row_number() OVER (ORDER BY t) AS t, x FROM di WHERE x IS NOT NULL), {_summary('ser')} SELECT CAST(n AS BIGINT) AS n, {_r('mean', 'se')}, {fold('mean - 0.5 * se')} AS lower FROM sm",
    "po_support": f"{PANEL}, {_U}, bs AS (SELECT t, count(*) AS base, count(y) AS n FROM fac WHERE mask GROUP BY t), bd AS (SELECT * FROM bs JOIN cx USING (t)), pt AS (SELECT * FROM (VALUES (0, 'fit', 1995, 1997), (0, 'score', 1998, 1998), (1, 'fit', 1995, 1998), (1, 'score', 1999, 1999), (2, 'fit', 1995, 1999), (2, 'score', 2000, 2000)) v(f, part, lo, hi)) SELECT CAST(f AS INTEGER) AS fold, part, CAST(count(*) FILTER (base >= 3) AS BIGINT) AS expected_days, CAST(count(*) FILTER (n >= 3) AS BIGINT) AS valid_days, CAST(sum(base) AS BIGINT) AS base_rows, CAST(sum(n) AS BIGINT) AS valid_rows FROM pt LEFT JOIN bd ON year(d) BETWEEN lo AND hi AND year(ex) <= hi GROUP BY f, part",
    "po_rewards": f"WITH {_CAND}, un AS (SELECT grp, k, min(delta) AS d FROM cd WHERE valid GROUP BY grp, k), sl AS (SELECT grp, greatest(coalesce(median(d) FILTER (d > 0.001), 0.001), 0.001) AS scale FROM un GROUP BY grp) SELECT id, grp, {fold('scale')} AS scale, {fold('CASE WHEN NOT valid THEN -1.0 WHEN delta <= 0.001 THEN 0.0 ELSE delta / (scale + delta) END')} AS reward FROM cd LEFT JOIN sl USING (grp)",
    "po_admission": f"WITH {_CAND}, rk AS (SELECT *, valid AND NOT evicted AS ok, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN valid AND NOT evicted THEN post END DESC NULLS LAST, id) AS rn FROM cd) SELECT grp, CASE WHEN ok THEN id END AS id, CASE WHEN NOT ok THEN 'no_finite_candidate' WHEN post <= 0.001 THEN 'delta_below_threshold' ELSE 'admitted' END AS reason, ok AND post > 0.001 AS admitted FROM rk WHERE rn = 1",
    "po_native_reward": f"""WITH x AS (SELECT p_partkey, greatest(-1, least(1, (p_size - 20) / 100.0::DOUBLE * 5 + 0.02 * tanh(p_retailprice / 1000 - 1))) AS raw, p_partkey % 3 = 0 AS seen, p_partkey % 12 AS fam, (p_partkey % 10) / 10.0::DOUBLE AS corr FROM part)
SELECT p_partkey, {fold('greatest(-1, least(1, raw - (CASE WHEN seen THEN 0.1 ELSE 0 END) - (CASE WHEN fam > 8 AND raw < 0.08 THEN 0.02 ELSE 0 END) + (CASE WHEN fam = 0 AND raw >= 0.1 THEN 0.02 ELSE 0 END) + (CASE WHEN raw >= 0.12 THEN CASE WHEN corr > 0.85 THEN -0.08 * (corr - 0.85) WHEN corr < 0.5 THEN 0.02 ELSE 0 END ELSE 0 END)))')} AS reward FROM x""",
    "po_ridge": f"{PANEL}, {_ALL} SELECT a, t, {fold('coalesce(z1, 0) * w1 + coalesce(z2, 0) * w2')} AS v, (z1 IS NOT NULL OR z2 IS NOT NULL) AS available FROM fac, wt",
    "st_summary": f"{PANEL}, {_HAC_DAYS}, {_summary('ser')} SELECT {_SUMMED} FROM sm",
    "st_paired": f"{PANEL}, {_ICS}, ser AS (SELECT t, i_close - i_volume AS x FROM iw), {_summary('ser')} SELECT {_SUMMED} FROM sm",
    "st_significance": f"{PANEL}, {_ICS}, ser AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, t, i_{n} AS x FROM iw" for n in _NAMES) + f"), {_summary('ser', 'name')}, fx AS (SELECT name, median(x) AS median, avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) AS positive FROM ser GROUP BY name), ok AS (SELECT *, coalesce(n >= 30 AND sd > 1e-15 AND se > 0, false) AS ok FROM sm JOIN fx USING (name)), pv AS (SELECT *, CASE WHEN ok THEN t_value END AS tv, CASE WHEN ok THEN {p_of('t_value')} END AS pv FROM ok), rn AS (SELECT *, row_number() OVER (ORDER BY pv, name) AS rn, count(pv) OVER () AS m FROM pv WHERE pv IS NOT NULL), qv AS (SELECT name, least(1.0, min(pv * m / rn) OVER (ORDER BY pv, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rn) SELECT name, CAST(n AS BIGINT) AS n, CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS status, {_r('mean', 'median', 'sd', 'positive', 'se')}, {fold('tv')} AS t_value, {fold('pv')} AS p_value, {fold('q')} AS q_value FROM pv LEFT JOIN qv USING (name)",
    "pf_liquidation": f"{PANEL}, {_HELD} SELECT t, {fold('sum(abs(weight))')} AS turnover FROM h, nd WHERE t = n - 1 GROUP BY t",
    "pf_costs": f"{PANEL}, {_HELD}, o AS (SELECT t, a, target FROM tg, nd WHERE t % 5 = 0 AND t + 2 < n), b AS (SELECT t + 20 AS t, a, target AS before FROM o WHERE t + 20 IN (SELECT t FROM o)), mv AS (SELECT t + 1 AS t, sum(abs(coalesce(target, 0) - coalesce(before, 0))) / 4 AS x FROM o FULL JOIN b USING (t, a) GROUP BY t UNION ALL SELECT t, sum(abs(weight)) FROM h, nd WHERE t = n - 1 GROUP BY t), mt AS (SELECT t, sum(x) AS turnover FROM mv GROUP BY t) SELECT CAST(path.t AS INTEGER) AS t, {fold('coalesce(turnover, 0)')} AS turnover, {fold('ret - 0.001 * coalesce(turnover, 0)')} AS net FROM path LEFT JOIN mt ON mt.t = path.t",
    "pf_coverage": f"{PANEL}, {_HELD} SELECT CAST(count(*) FILTER (gross * (1 - coalesce(coverage, 1)) > 1e-12) AS BIGINT) AS missing_days, {fold('avg(gross)')} AS average_gross, {fold('coalesce(1 - sum(gross * (1 - coalesce(coverage, 1))) / nullif(sum(gross), 0), 1)')} AS held_coverage FROM path",
    "pf_metrics_sales": f"WITH mo AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), fl AS (SELECT *, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM mo), wh AS (SELECT i AS t, v / lag(v) OVER (ORDER BY d) - 1 AS ret, row_number() OVER (ORDER BY d) AS j FROM fl WHERE i > 1 AND i < n), pth AS (SELECT t, ret FROM wh WHERE j > 1), {metrics_of('pth', 12.0)}",
    "pf_metrics": f"{PANEL}, {_HELD}, {metrics_of('path', 52.0)}",
    "cs_own_transform": f"{PANEL}, {_std('close', 'mask', 'p', 'x', 'z1')}, {_std('(CASE WHEN a % 3 <> 0 THEN volume END)', 'mask', 'x3', 'v', 'z2')} SELECT a, t, {fold('z1')} AS f1, {fold('z2')} AS f2 FROM v3",
    "cs_joint_transform": f"{PANEL}, {_LABEL}, jm AS (SELECT *, mask AND close IS NOT NULL AND volume IS NOT NULL AND y IS NOT NULL AS ok FROM lab), {_std('close', 'ok', 'jm', 'x', 'z1')}, {_std('volume', 'ok', 'x3', 'v', 'z2')}, {_std('y', 'ok', 'v3', 'yy', 'z3')} SELECT a, t, {fold('z1')} AS f1, {fold('z2')} AS f2, {fold('z3')} AS y FROM yy3",
    "cs_fixed_universe": f"{PANEL}, {_LABEL}, m0 AS (SELECT a, t, close, high - low AS f2, y, ln(volume) AS sz, mask AND y IS NOT NULL AND volume IS NOT NULL AS m FROM lab), {_std('y', 'm', 'm0', 'k', 'ys')}, m1 AS (SELECT *, m AND ys IS NOT NULL AS mt, coalesce(close, 0) AS c1, coalesce(f2, 0) AS c2 FROM k3), rs AS (SELECT a, t, {_res('c1')} AS r1, {_res('c2')} AS r2, {_res('ys')} AS ry FROM m1) SELECT a, t, ry IS NOT NULL AS metric, {fold('r1')} AS f1, {fold('r2')} AS f2, {fold('ry')} AS y FROM rs",
    "dsl_batch_shared": f"{RECURSIVE}, {_BATCH}, b2 AS (SELECT a, t, {fold('rm')} AS v0, {fold(z_of('m'))} AS v1, {fold(div('close', 'm'))} AS v2, {fold('rs')} AS v3, {fold('m - lag(m, 5) OVER (PARTITION BY a ORDER BY t)')} AS v4, {fold('rm - rs')} AS v5, {fold('CASE WHEN volume IS NOT NULL AND len(vl) >= 8 THEN (len(list_filter(vl, lambda q: q < volume)) + (len(list_filter(vl, lambda q: q = volume)) + 1) / 2.0) / len(vl) END')} AS v6 FROM b1) SELECT b2.*, {fold('CASE WHEN e.n >= 8 THEN e.e END')} AS v7 FROM b2 JOIN e ON e.a = b2.a AND e.t = b2.t",
    "cs_residual_multi": f"{PANEL}, {_LABEL}, fz AS (SELECT a, t, mask, y, ret, {z_of('close')} AS z1, {z_of('ln(volume + 1)')} AS z2, {z_of('high - low')} AS z3 FROM lab), {_regressed('y', 'ra')}, {_regressed('ret', 'rb')} SELECT p.a, p.t, {fold('ra.v')} AS y_res, {fold('rb.v')} AS r_res FROM p LEFT JOIN ra ON ra.a = p.a AND ra.t = p.t LEFT JOIN rb ON rb.a = p.a AND rb.t = p.t",
    "ts_long_horizons": f"""{_NATIONS}, mk AS (SELECT t, avg(ret) AS mret FROM r GROUP BY t), j AS (SELECT r.*, mret, CASE WHEN ret IS NOT NULL THEN mret END AS x, CASE WHEN mret IS NOT NULL THEN ret END AS yy FROM r JOIN mk USING (t)),
b AS (SELECT *, count(x) OVER w AS n, var_samp(x) OVER w AS vx, var_samp(yy) OVER w AS vy, covar_samp(x, yy) OVER w AS cv, {', '.join(f"CASE WHEN count(ret) OVER {k} = {n} THEN sum(ln(1 + ret)) OVER {k} END AS {name}" for k, n, name in (('w1', 20, 'lb'), ('w2', 21, 'rv'), ('w3', 232, 'mo')))} FROM j
WINDOW w AS (PARTITION BY a ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY a ORDER BY t ROWS BETWEEN 2 FOLLOWING AND 21 FOLLOWING), w2 AS (PARTITION BY a ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY a ORDER BY t ROWS BETWEEN 252 PRECEDING AND 21 PRECEDING))
SELECT a, t, {fold('lb')} AS label, {fold('rv')} AS reversal, {fold('mo')} AS momentum, {fold('CASE WHEN n >= 126 AND vx * (n - 1) > 1e-12 THEN cv / vx END')} AS slope, {fold('CASE WHEN n >= 126 AND vx * (n - 1) > 1e-12 THEN sqrt(greatest(vy - cv / vx * cv, 0)) END')} AS spread FROM b""",
    "ag_corr_batch": f"{PANEL}, {_LABEL} SELECT t, " + ", ".join(f"{fold(_ic(x, 'ret' if y == 'return' else y))} AS {x}_{y}" for x in ("close", "volume") for y in ("y", "return", "open")) + " FROM lab WHERE mask GROUP BY t",
    "ag_dynamic": f"SELECT p_brand, {', '.join(f'{fold(f"avg({n})")} AS {n}_mean, {fold(f"stddev_samp({n})")} AS {n}_sd' for n in ('p_size', 'p_retailprice'))} FROM part GROUP BY p_brand",
    "ag_families": "SELECT regexp_replace(p_type, '[0-9]+', '#', 'g') AS family, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1",
    "ag_pair_corr": f"{PANEL}, pc AS (" + " UNION ALL ".join(f"SELECT abs(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y}))) AS r FROM p WHERE mask AND {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in (("volume", "close"), ("ret", "close"), ("ret", "volume"))) + f") SELECT {fold('sum(coalesce(r, 0)) / 3')} AS r FROM pc",
    "jn_linked": f"WITH {_LINKS} SELECT a, CAST(y AS INTEGER) AS y, s_nationkey, {fold('rev')} AS rev FROM rl",
    "jn_use_date": f"{PANEL}, {_LINKS}, ra AS (SELECT *, datadate + to_months(6) AS available FROM rl) SELECT x.a, x.t, {fold('CASE WHEN x.d <= available + to_months(18) AND x.d >= linkdt AND (linkend IS NULL OR x.d <= linkend) THEN rev END', 4)} AS v FROM p x ASOF LEFT JOIN ra ON x.a = ra.a AND x.d >= ra.available",
    "jn_last_wins": "SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "jn_one_to_one": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS BIGINT) AS orders_n FROM orders GROUP BY 1), s AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(count(*) AS BIGINT) AS lines_n FROM lineitem GROUP BY 1) SELECT d, orders_n, lines_n FROM o JOIN s USING (d)",
    "jn_lookup": "SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON n_nationkey = c_nationkey",
    "fl_regime": f"{PANEL}, {_MKT} SELECT t, CAST(count(*) FILTER (mask) AS BIGINT) AS n FROM p JOIN mk USING (t) WHERE mret > 0 GROUP BY t",
    "fl_accounting": f"WITH o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS sales, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS costs FROM orders GROUP BY 1), e AS (SELECT c_custkey, sales, coalesce(costs, 0) AS costs, c_acctbal - coalesce(costs, 0) / 1000 AS eq FROM customer LEFT JOIN o USING (c_custkey)) SELECT c_custkey, {fold('CASE WHEN eq > 0 AND sales IS NOT NULL THEN (sales - costs) / eq END', 4)} AS profitability, {fold('CASE WHEN eq > 0 THEN costs / eq END', 4)} AS leverage FROM e",
    "fl_adjust_counts": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT l_discount > 0) AS BIGINT) AS bad_price, CAST(count(*) FILTER (NOT l_tax > 0) AS BIGINT) AS bad_share FROM lineitem",
    "sc_integral": "SELECT o_orderkey, coalesce(isfinite(o_totalprice) AND o_totalprice % 1 = 0, false) AS ok FROM orders",
    "sc_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders",
    "sc_json_round": "SELECT event_id, '{' || coalesce('\"k\":' || CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) || ',', '') || '\"e\":\"' || event_type || '\"}' AS j FROM events",
    "ts_unsorted": "SELECT DISTINCT o_custkey FROM (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE o_orderdate < b",
    "val_duplicate": f"{PANEL}, nd AS ({_DUP}), al AS ({_dup('high')} UNION ALL {_dup('volume')}) SELECT member, {_r('daily', 'pooled', 'ranked', 'corr_coverage')}, {fold('greatest(daily, pooled, ranked)')} AS strongest FROM al",
    "dv_gates": f"""{PANEL}, ov AS (SELECT CAST(o_orderdate AS DATE) AS s, lag(CAST(o_orderdate AS DATE) + 90) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS e FROM orders),
dm AS (SELECT t, count(*) FILTER (member) AS m, count(*) FILTER (mask) AS e, count(*) AS n FROM p GROUP BY t),
g AS (SELECT 'duplicate_keys' AS gate, CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS DOUBLE) AS value, 0.0 AS low, 0.0 AS high
UNION ALL SELECT 'invalid_ids', (SELECT count(*) FROM customer WHERE NOT regexp_matches(c_name, '#[0-9]+$')), 0, 0
UNION ALL SELECT 'overlapping_intervals', (SELECT count(*) FROM ov WHERE s <= e), 0, 0
UNION ALL SELECT 'invalid_factor_rate', (SELECT avg(CASE WHEN NOT l_tax > 0 THEN 1.0 ELSE 0.0 END) FROM lineitem), 0, 0.001
UNION ALL SELECT 'negative_volume', (SELECT count(*) FROM lineitem WHERE l_quantity < 0), 0, 0
UNION ALL SELECT 'ohlc_violation_rate', (SELECT count(*) FILTER (close IS NOT NULL AND (high < greatest(open, close) OR low > least(open, close))) / count(close) FROM p), 0, 1e-5
UNION ALL SELECT 'nonpositive_close', (SELECT count(*) FROM p WHERE close <= 0), 0, 0
UNION ALL SELECT 'return_below_minus_one', (SELECT count(*) FROM p WHERE ret < -1), 0, 0
UNION ALL SELECT 'coverage_close', (SELECT count(close) / count(*) FROM p), 0.8, 1
UNION ALL SELECT 'coverage_return', (SELECT count(ret) / count(*) FROM p), 0.8, 1
UNION ALL SELECT 'coverage_volume', (SELECT count(volume) / count(*) FROM p), 0.8, 1
UNION ALL SELECT 'least_member_share', (SELECT min(m / n) FROM dm), 0.4, 1
UNION ALL SELECT 'eligible_share', (SELECT avg(CASE WHEN m > 0 THEN e / m END) FROM dm), 0.9, 1)
SELECT gate, {_r('value', 'low', 'high')}, coalesce(value BETWEEN low AND high, false) AS ok FROM g""",
    "rp_paired": f"{PANEL}, {_ICS} SELECT CAST(year(d) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n, {fold('avg(i_close)')} AS a, {fold('avg(i_volume)')} AS b, {fold('avg(i_close - i_volume)')} AS diff FROM iw WHERE i_close IS NOT NULL AND i_volume IS NOT NULL GROUP BY year(d)",
    "rp_portfolio_summary": f"{PANEL}, {_HELD} SELECT CAST(year(d) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n, {fold('avg(ret)')} AS mean, {fold('stddev_samp(ret)')} AS sd, {fold('avg(gross)')} AS gross FROM path JOIN cal ON cal.t = path.t GROUP BY year(d)",
    "rp_search_efficiency": f"WITH {_CAND} SELECT grp, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (valid) AS BIGINT) AS valid_n, CAST(count(*) FILTER (valid AND delta > 0) AS BIGINT) AS gain_n, {fold('max(delta) FILTER (valid)')} AS best FROM cd GROUP BY grp",
    "rp_curve": f"{PANEL}, mr AS (SELECT t, any_value(d) AS d, median(ret) AS r FROM p WHERE member GROUP BY t) SELECT t, CAST(year(d) AS INTEGER) AS y, {fold('exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY year(d) ORDER BY t)) - 1')} AS v FROM mr",
    "src_contracts": "SELECT 'lines' AS contract, 'lineitem.parquet' AS file, CAST(count(*) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'orders', 'orders.parquet', count(*) FROM orders UNION ALL SELECT 'suppliers', 'supplier.parquet', count(*) FROM supplier",
    "src_years": f"{PANEL} SELECT a, t, d, {_r('close', 'volume')} FROM p WHERE year(d) BETWEEN 1997 AND 1998",
}
