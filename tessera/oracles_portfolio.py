"""DuckDB SQL for the portfolio, pool, lineage and audit queries, from the rows up."""

from __future__ import annotations

import math

from .functions import INDUSTRIES
from .operators.inference import block_starts
from .oracles import _FACTORS, _IND, _LABEL, _TARGET, PANEL, _ic, fold, rolled, spread, z_of
from .oracles_research import _ICS, L, _r, _std, _summary

QUERIES: dict[str, str] = {}

# --- neutral portfolios: on each side of the median, the level that makes the held weights add up to a half

_U = 0.03


def _side(name: str, where: str, c: str) -> str:
    held = "greatest(0, least({u}, c + b))".format(u=_U)
    return f"""{name}0 AS (SELECT t, a, {c} AS c FROM sd WHERE {where}),
{name}1 AS (SELECT t, -c AS b FROM {name}0 UNION SELECT t, {_U} - c FROM {name}0),
{name}2 AS (SELECT t, b, sum({held}) AS total, count(*) FILTER (-c <= b AND b < {_U} - c) AS inside FROM {name}1 JOIN {name}0 USING (t) GROUP BY t, b),
{name}3 AS (SELECT t, max_by(b + CASE WHEN inside > 0 THEN (0.5 - total) / inside ELSE 0 END, b) AS level FROM {name}2 WHERE total <= 0.5 + 1e-13 GROUP BY t),
{name} AS (SELECT t, a, greatest(0, least({_U}, c + level)) AS w FROM {name}0 JOIN {name}3 USING (t))"""


QUERIES["pf_qp"] = f"""{PANEL}, {_TARGET}, al AS (SELECT t, count(*) AS n, quantile_cont(s, 0.5) AS mid FROM tg WHERE s IS NOT NULL GROUP BY t HAVING count(*) >= {math.ceil(1 / _U)}),
sd AS (SELECT tg.t, a, coalesce(target, 0) / 1.0001 AS c, s >= mid AS lg FROM tg JOIN al USING (t) WHERE s IS NOT NULL),
{_side('lo', 'lg', 'c')}, {_side('sh', 'NOT lg', '-c')}, bw AS (SELECT t, a, w FROM lo UNION ALL SELECT t, a, -w FROM sh)
SELECT p.t, p.a, CASE WHEN n IS NULL THEN 'insufficient_eligible' ELSE 'optimal' END AS status, CASE WHEN n IS NOT NULL THEN {fold('coalesce(w, 0)')} END AS weight FROM p LEFT JOIN al USING (t) LEFT JOIN bw ON bw.t = p.t AND bw.a = p.a"""

# --- full pools -----------------------------------------------------------------------------------

_Z = f"{_LABEL}, {_FACTORS}, mz AS (SELECT *, {z_of('high - low')} AS z3, {z_of('open')} AS z4, {z_of('ret')} AS z5, {z_of('ln(high) - ln(low)')} AS z6 FROM (SELECT fac.*, open, high, low FROM fac JOIN p USING (a, t))), cx AS (SELECT t, d, lead(d, 5) OVER (ORDER BY t) AS ex FROM cal)"
_CELLS = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]


def _inverse() -> str:
    """Inverse and weights of the ridge system of three factors, by cofactors, from columns g11 to g33 and p1 to p3."""
    a, b, e, h, i, k = f"(g11 + {L})", "g12", "g13", f"(g22 + {L})", "g23", f"(g33 + {L})"
    det = f"({a} * ({h} * {k} - {i} * {i}) - {b} * ({b} * {k} - {i} * {e}) + {e} * ({b} * {i} - {h} * {e}))"
    cells = {"11": f"{h} * {k} - {i} * {i}", "22": f"{a} * {k} - {e} * {e}", "33": f"{a} * {h} - {b} * {b}", "12": f"{e} * {i} - {b} * {k}", "13": f"{b} * {i} - {e} * {h}", "23": f"{b} * {e} - {a} * {i}"}
    return ", ".join(f"({v}) / {det} AS v{c}" for c, v in cells.items())


def _v(i: int, j: int) -> str:
    return f"v{min(i, j)}{max(i, j)}"


_WEIGHTS = ", ".join("(" + " + ".join(f"{_v(i, j)} * p{j}" for j in (1, 2, 3)) + f") AS w{i}" for i in (1, 2, 3))


def _dropped(j: int) -> str:
    """The weighted sum without factor j: its row is taken out of the inverse."""
    return " + ".join(f"(w{i} - {_v(i, j)} * w{j} / {_v(j, j)}) * x{i}" for i in (1, 2, 3) if i != j)


_REPLACE = f"""{PANEL}, {_Z}, u3 AS (SELECT a, mz.t, d, ex, y, coalesce(z1, 0) AS x1, coalesce(z2, 0) AS x2, coalesce(z3, 0) AS z3, coalesce(z4, 0) AS z4, coalesce(z5, 0) AS z5 FROM mz JOIN cx USING (t) WHERE mask AND y IS NOT NULL),
u AS ({' UNION ALL '.join(f"SELECT '{z}' AS c, t, d, ex, y, x1, x2, {z} AS x3 FROM u3" for z in ('z3', 'z4', 'z5'))}),
ds AS (SELECT c, t, any_value(d) AS d, any_value(ex) AS ex, {', '.join(f'avg(x{i} * x{j}) AS g{i}{j}' for i, j in _CELLS)}, {', '.join(f'avg(x{i} * y) AS p{i}' for i in (1, 2, 3))} FROM u GROUP BY c, t HAVING count(*) >= 3),
fd AS (SELECT * FROM (VALUES (0, 1995, 1997, 1998, 1998), (1, 1995, 1998, 1999, 1999), (2, 1995, 1999, 2000, 2000)) f(f, a0, a1, s0, s1)),
fm AS (SELECT c, f, s0, s1, {', '.join(f'avg(g{i}{j}) AS g{i}{j}' for i, j in _CELLS)}, {', '.join(f'avg(p{i}) AS p{i}' for i in (1, 2, 3))} FROM fd JOIN ds ON year(d) BETWEEN a0 AND a1 AND year(ex) <= a1 GROUP BY c, f, s0, s1),
iv AS (SELECT *, {_inverse()} FROM fm), wt AS (SELECT *, {_WEIGHTS} FROM iv),
sl AS (SELECT c, {', '.join(f'avg(w{i} * w{i} / {_v(i, i)}) AS s{i}' for i in (1, 2, 3))} FROM wt GROUP BY c),
sc AS (SELECT u.c, t, y, w1 * x1 + w2 * x2 + w3 * x3 AS s_add, {', '.join(f'{_dropped(j)} AS s_{j}' for j in (1, 2, 3))} FROM u JOIN wt ON wt.c = u.c AND year(d) BETWEEN s0 AND s1 AND year(ex) <= s1),
dd AS (SELECT c, t, {', '.join(f'{_ic(f"s_{n}", "y", True)} AS i_{n}' for n in ('add', 1, 2, 3))} FROM sc GROUP BY c, t),
dl AS (SELECT c, count(i_add - i_3) AS days, avg(i_add - i_3) AS delta, avg(i_1 - i_3) AS d1, avg(i_2 - i_3) AS d2, avg(i_3 - i_3) AS d3 FROM dd GROUP BY c),
lt AS (SELECT c, unnest([1, 2, 3]) AS k, unnest([s1, s2, s3]) AS s, unnest([d1, d2, d3]) AS d FROM sl JOIN dl USING (c)),
lr AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s, k) AS place FROM lt),
bs AS (SELECT c, string_agg(CASE k WHEN 1 THEN 'z1' WHEN 2 THEN 'z2' ELSE c END, ',' ORDER BY place) AS tried, arg_max(k, (d, -place)) AS gone, max(d) AS post FROM lr WHERE place <= 2 GROUP BY c),
rp AS (SELECT c AS candidate, delta AS delta_add, CASE WHEN gone = 3 THEN 0.0 ELSE post END AS post_delta, days, s1, s2, s3, tried, CASE gone WHEN 1 THEN 'z1' WHEN 2 THEN 'z2' END AS replaced, gone = 3 AS self_evicted FROM dl JOIN sl USING (c) JOIN bs USING (c))"""

QUERIES["po_replace"] = f"{_REPLACE} SELECT candidate, {_r('delta_add', 'post_delta')}, CAST(days AS BIGINT) AS days, {', '.join(f'{fold(f"s{k + 1}")} AS saliency{k}' for k in range(3))}, tried, replaced, self_evicted, true AS valid, CASE WHEN self_evicted THEN 'self_evicted' ELSE 'ok' END AS reason FROM rp"
QUERIES["po_replace_rewards"] = f"""{_REPLACE}, sk AS (SELECT greatest(coalesce(median(CASE WHEN delta_add > 0 THEN delta_add END), 1e-5), 1e-5) AS scale FROM rp),
bt AS (SELECT candidate AS best, post_delta AS gain FROM rp WHERE NOT self_evicted ORDER BY post_delta DESC, candidate LIMIT 1)
SELECT candidate, {fold('scale')} AS scale, {fold('CASE WHEN delta_add <= 0 THEN 0.0 ELSE least(delta_add / (scale + delta_add), 1 - 1e-16) END')} AS reward, coalesce(candidate = best AND gain > 0, false) AS admitted FROM rp CROSS JOIN sk LEFT JOIN bt ON true"""
_SIX = [(i, j) for i in range(1, 7) for j in range(i, 7)]
QUERIES["po_reselect"] = f"""{PANEL}, {_Z}, u AS (SELECT t, y, {', '.join(f'coalesce(z{i}, 0) AS z{i}' for i in range(1, 7))} FROM mz WHERE mask AND y IS NOT NULL),
ds AS (SELECT t, {', '.join(f'avg(z{i} * z{j}) AS m{i}{j}' for i, j in _SIX)}, {', '.join(f'avg(z{i} * y) AS q{i}' for i in range(1, 7))} FROM u GROUP BY t HAVING count(*) >= 3),
al AS (SELECT {', '.join(f'avg(m{i}{j}) AS m{i}{j}' for i, j in _SIX)}, {', '.join(f'avg(q{i}) AS q{i}' for i in range(1, 7))} FROM ds),
sb AS ({' UNION ALL '.join(f"SELECT 'z{i},z{j},z{k}' AS factors, m{i}{i} AS g11, m{i}{j} AS g12, m{i}{k} AS g13, m{j}{j} AS g22, m{j}{k} AS g23, m{k}{k} AS g33, q{i} AS p1, q{j} AS p2, q{k} AS p3 FROM al" for i in range(1, 7) for j in range(i + 1, 7) for k in range(j + 1, 7))}),
wt AS (SELECT *, {_WEIGHTS} FROM (SELECT *, {_inverse()} FROM sb)), ev AS (SELECT factors, p1 * w1 + p2 * w2 + p3 * w3 AS value FROM wt)
SELECT arg_max(factors, value) AS factors, {fold('max(value)')} AS value FROM ev"""

# --- objectives on neutralised inputs: each factor on its own rows, then all on one universe -------------


def _off(x: str, ok: str) -> str:
    """x less its regression on sz and a constant, on the rows `ok` of its date."""
    w = "OVER (PARTITION BY t)"
    own, e = f"(CASE WHEN {ok} THEN {x} END)", f"(CASE WHEN {ok} THEN sz END)"
    return f"CASE WHEN {ok} AND count({e}) {w} > 2 THEN {x} - avg({own}) {w} - covar_pop({own}, {e}) {w} / var_pop({e}) {w} * (sz - avg({e}) {w}) END"


_NEUTRAL = f"""{PANEL}, {_LABEL}, o0 AS (SELECT a, t, close AS c1, high - low AS c2, y, ln(volume) AS sz, mask, mask AND volume IS NOT NULL AS b FROM lab),
{_std('c1', 'b', 'o0', 'n', 'k1')}, {_std('c2', 'b', 'n3', 'm', 'k2')},
o1 AS (SELECT *, {_off('k1', '(b AND k1 IS NOT NULL)')} AS r1, {_off('k2', '(b AND k2 IS NOT NULL)')} AS r2 FROM m3),
o2 AS (SELECT a, t, y, sz, mask, b AND y IS NOT NULL AS mm, {z_of('r1', 'b', '1e-12')} AS f1, {z_of('r2', 'b', '1e-12')} AS f2 FROM o1),
{_std('y', 'mm', 'o2', 'k', 'ys')}, o3 AS (SELECT *, mm AND ys IS NOT NULL AS mt, coalesce(f1, 0) AS e1, coalesce(f2, 0) AS e2 FROM k3),
rs AS (SELECT a, t, mask, {_off('e1', 'mt')} AS x1, {_off('e2', 'mt')} AS x2, {_off('ys', 'mt')} AS ry FROM o3), cx AS (SELECT t, d, lead(d, 5) OVER (ORDER BY t) AS ex FROM cal)"""
_R1 = f"""{_NEUTRAL}, u AS (SELECT rs.t, d, ex, x1 AS z1, x2 AS z2, ry AS y FROM rs JOIN cx USING (t) WHERE ry IS NOT NULL),
ds AS (SELECT t, any_value(d) AS d, any_value(ex) AS ex, avg(z1 * z1) AS g11, avg(z1 * z2) AS g12, avg(z2 * z2) AS g22, avg(z1 * y) AS p1, avg(z2 * y) AS p2 FROM u GROUP BY t HAVING count(*) >= 3),
fd AS (SELECT * FROM (VALUES ('f0', 1995, 1997, 1998, 1998), ('f1', 1995, 1998, 1999, 1999), ('f2', 1995, 1999, 2000, 2000), ('full', 0, 9999, 1, 0)) f(f, a0, a1, s0, s1)),
fm AS (SELECT f, s0, s1, avg(g11) AS g11, avg(g12) AS g12, avg(g22) AS g22, avg(p1) AS p1, avg(p2) AS p2 FROM fd JOIN ds ON f = 'full' OR (year(d) BETWEEN a0 AND a1 AND year(ex) <= a1) GROUP BY f, s0, s1),
wt AS (SELECT f, s0, s1, ((g22 + {L}) * p1 - g12 * p2) / ((g11 + {L}) * (g22 + {L}) - g12 * g12) AS w1, ((g11 + {L}) * p2 - g12 * p1) / ((g11 + {L}) * (g22 + {L}) - g12 * g12) AS w2, p1 / (g11 + {L}) AS o1 FROM fm),
sc AS (SELECT t, f, y, w1 * z1 + w2 * z2 AS s, o1 * z1 AS b, 0.0 AS o FROM u JOIN wt ON year(d) BETWEEN s0 AND s1 AND year(ex) <= s1),
dd AS (SELECT t, f, {_ic('s', 'y', True)} AS i_pool, {_ic('b', 'y', True)} AS i_first, {_ic('o', 'y', True)} AS i_none FROM sc GROUP BY t, f)"""
_SCOPES = "(VALUES ('all'), ('f0'), ('f1'), ('f2')) q(scope)"


def _by_scope(series: str, lags: int = 4) -> str:
    """CTEs from `series` (name, scope, t, x; every day of the calendar) to hz (name, scope, n, mean, se)."""
    w = "OVER (PARTITION BY name, scope ORDER BY t)"
    terms = " + ".join(f"CASE WHEN m >= {k} THEN 2 * (1 - {k} / (m + 1.0)) * c * coalesce(lag(c, {k}) {w}, 0) ELSE 0 END" for k in range(1, lags + 1))
    return f"""h1 AS (SELECT name, scope, avg(x) AS mean, count(x) AS n, least({lags}, count(*) - 1) AS m FROM {series} GROUP BY name, scope),
h2 AS (SELECT name, scope, t, m, coalesce(x - mean, 0) AS c FROM {series} JOIN h1 USING (name, scope)), h3 AS (SELECT name, scope, c * c + {terms} AS s FROM h2), h4 AS (SELECT name, scope, sum(s) AS s FROM h3 GROUP BY name, scope),
hz AS (SELECT name, scope, n, mean, CASE WHEN n >= 2 THEN sqrt(greatest(s, 0)) / n END AS se FROM h1 JOIN h4 USING (name, scope))"""


def _series(values: dict[str, str]) -> str:
    return "ser AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, scope, cal.t, {x} AS x FROM cal CROSS JOIN {_SCOPES} LEFT JOIN dd ON dd.t = cal.t AND (scope = 'all' OR f = scope)" for n, x in values.items()) + ")"


QUERIES["po_r1"] = f"{_R1}, {_series({n: f'i_{n}' for n in ('pool', 'first', 'none')})}, {_by_scope('ser')} SELECT name, scope, CAST(n AS BIGINT) AS n, {_r('mean', 'se')} FROM hz"
QUERIES["po_r1_increment"] = f"{_R1}, {_series({'pool': 'i_pool - i_first'})}, {_by_scope('ser')} SELECT scope, CAST(n AS BIGINT) AS n, {_r('mean', 'se')}, {fold('mean - 0.5 * coalesce(se, 0)')} AS lower FROM hz"
QUERIES["po_r1_weights"] = f"{_R1}, ww AS (SELECT f AS part, unnest(['f1', 'f2']) AS factor, unnest([w1, w2]) AS weight, abs(w1) + abs(w2) AS total FROM wt) SELECT part, factor, {_r('weight')}, {fold('weight / greatest(total, 1e-30)')} AS share FROM ww"
QUERIES["po_r1_support"] = f"""{_NEUTRAL}, dy AS (SELECT rs.t, any_value(d) AS d, any_value(ex) AS ex, count(*) FILTER (mask) AS base, count(ry) AS n, var_pop(ry) * count(ry) AS sp FROM rs JOIN cx USING (t) GROUP BY rs.t),
fp AS (SELECT * FROM (VALUES (0, 'fit', 1995, 1997), (0, 'score', 1998, 1998), (1, 'fit', 1995, 1998), (1, 'score', 1999, 1999), (2, 'fit', 1995, 1999), (2, 'score', 2000, 2000)) f(f, part, y0, y1)),
sp AS (SELECT f, part, count(*) FILTER (base >= 3) AS expected_days, count(*) FILTER (n >= 3 AND sp > 1e-24) AS valid_days, coalesce(sum(base), 0) AS base_rows, coalesce(sum(n), 0) AS valid_rows FROM fp LEFT JOIN dy ON year(d) BETWEEN y0 AND y1 AND year(ex) <= y1 GROUP BY f, part),
sq AS (SELECT *, greatest(20, CAST(ceil(0.8 * expected_days) AS BIGINT)) AS required_days, valid_days / greatest(1, expected_days) AS day_rate, valid_rows / greatest(1, base_rows) AS row_rate FROM sp)
SELECT CAST(f AS INTEGER) AS fold, part, CAST(expected_days AS BIGINT) AS expected_days, CAST(valid_days AS BIGINT) AS valid_days, CAST(required_days AS BIGINT) AS required_days, CAST(base_rows AS BIGINT) AS base_rows, CAST(valid_rows AS BIGINT) AS valid_rows, {_r('day_rate', 'row_rate')}, valid_days >= required_days AND row_rate >= 0.8 AS enough FROM sq"""

# --- blocked moments ----------------------------------------------------------------------------------

QUERIES["ag_gram_blocks"] = f"{PANEL}, {_LABEL}, {_FACTORS}, dd AS (SELECT t, avg(z1*z1) AS m11, avg(z1*z2) AS m12, avg(z2*z2) AS m22, avg(z1*y) AS m1y, avg(z2*y) AS m2y FROM (SELECT t, coalesce(z1, 0) AS z1, coalesce(z2, 0) AS z2, y FROM fac WHERE mask AND y IS NOT NULL) GROUP BY t HAVING count(*) >= 3) " + " UNION ALL ".join(f"SELECT '{i}' AS i, '{j}' AS j, {fold(f'avg({m})')} AS value FROM dd" for i, j, m in (("z1", "z1", "m11"), ("z1", "z2", "m12"), ("z1", "y", "m1y"), ("z2", "z2", "m22"), ("z2", "y", "m2y")))
QUERIES["ag_corr_matrix"] = f"{PANEL}, {_LABEL} " + " UNION ALL ".join(f"""SELECT t, '{x}' AS "left", '{y}' AS "right", CAST(count(CASE WHEN {x} IS NOT NULL THEN {z} END) AS BIGINT) AS n, {fold(_ic(x, z))} AS corr FROM lab WHERE mask GROUP BY t""" for x in ("close", "volume") for y, z in (("y", "y"), ("return", "ret"), ("open", "open")))

# --- lineage and audits ---------------------------------------------------------------------------------

_POOL = """WITH ev AS (SELECT event_type AS cell, CAST(year(ts) * 12 + month(ts) AS INTEGER) AS round, event_id AS factor, value > 50 AS admitted FROM events),
ad AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY factor) AS version, lead(round, 5) OVER (PARTITION BY cell ORDER BY factor) AS gone FROM ev WHERE admitted),
rd AS (SELECT cell, round, count(*) FILTER (admitted) AS n FROM ev GROUP BY cell, round),
pl AS (SELECT rd.cell, rd.round, factor FROM rd JOIN ad ON ad.cell = rd.cell AND ad.round <= rd.round AND (gone IS NULL OR rd.round < gone))"""
QUERIES["dv_lineage"] = f"{_POOL} SELECT cell, round, factor FROM pl"
QUERIES["dv_snapshots"] = f"""{_POOL}, hs AS (SELECT cell, round, count(*) AS size, string_agg(CAST(factor AS VARCHAR), '|' ORDER BY CAST(factor AS VARCHAR)) AS names FROM pl GROUP BY cell, round)
SELECT rd.cell, rd.round, CAST(sum(n) OVER (PARTITION BY rd.cell ORDER BY rd.round) AS BIGINT) AS version, CAST(coalesce(size, 0) AS BIGINT) AS size, sha256(coalesce(names, '')) AS hash FROM rd LEFT JOIN hs ON hs.cell = rd.cell AND hs.round = rd.round"""
QUERIES["dv_final_lineage"] = f"{_POOL} SELECT cell, factor, factor AS seq_in, round, CAST(version AS INTEGER) AS version FROM ad WHERE gone IS NULL"
QUERIES["dv_trace"] = f"""{PANEL}, {_LABEL}, sm AS (SELECT a, t, close, volume, ret, y FROM (SELECT *, row_number() OVER (PARTITION BY year(d) ORDER BY md5('7|' || CAST(a AS VARCHAR) || '|' || CAST(d AS VARCHAR)), a, d) AS n FROM lab WHERE mask AND y IS NOT NULL) WHERE n <= 3),
w AS (SELECT sm.a, sm.t, g.t - sm.t AS k, g.close, g.volume FROM sm JOIN grid g ON g.a = sm.a AND g.t BETWEEN sm.t - 1 AND sm.t + 5),
ag AS (SELECT a, t, max(close) FILTER (k = 0) AS close, max(volume) FILTER (k = 0) AS volume, max(close) FILTER (k = 0) / max(close) FILTER (k = -1) - 1 AS ret, max(close) FILTER (k = 5) / max(close) FILTER (k = 1) - 1 AS y FROM w GROUP BY a, t)
""" + " UNION ALL ".join(f"SELECT a, t, '{name}' AS field, {fold(f'sm.{c}')} AS stored, {fold(f'ag.{c}')} AS again, {fold(f'abs(sm.{c} - ag.{c})')} AS difference FROM sm JOIN ag USING (a, t)" for name, c in (("close", "close"), ("volume", "volume"), ("return", "ret"), ("label", "y")))
# two columns, a constant and x: the eigenvalues of their Gram matrix give the condition
_SOLVE = f"""{PANEL}, {_LABEL}, rr AS (SELECT a, t, close, y, ln(volume) AS x FROM lab WHERE mask AND volume IS NOT NULL AND close IS NOT NULL),
s1 AS (SELECT t, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM rr GROUP BY t HAVING count(*) > 2), s2 AS (SELECT t, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM rr WHERE y IS NOT NULL GROUP BY t HAVING count(*) > 2),
ss AS (SELECT t, n, sqrt((n + sxx + sqrt((n - sxx) * (n - sxx) + 4 * sx * sx)) / greatest(n + sxx - sqrt((n - sxx) * (n - sxx) + 4 * sx * sx), 1e-300)) AS cond FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)),
dg AS (SELECT t, min(n) AS n, max(cond) AS cond FROM ss GROUP BY t)"""
QUERIES["dv_risk"] = f"{_SOLVE} SELECT t, CAST(n AS BIGINT) AS n_rows, 2 AS n_rank, {fold('ln(cond)')} AS log_condition, {fold('0')} AS worst FROM dg"
QUERIES["dv_risk_gates"] = f"""{_SOLVE}, fm AS (SELECT dg.* FROM dg JOIN cal USING (t) WHERE d >= DATE '1996-01-01'), mb AS (SELECT avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END) AS rate, count(*) FILTER (volume IS NULL) AS missing FROM p WHERE member AND d >= DATE '1996-01-01')
SELECT 'rank' AS gate, CAST(0 AS BIGINT) AS failures, {fold('2')} AS value, true AS passed UNION ALL SELECT 'condition', CAST(count(*) FILTER (cond > 1e4) AS BIGINT), {fold('max(cond)')}, count(*) FILTER (cond > 1e4) = 0 FROM fm UNION ALL SELECT 'coverage', CAST(missing AS BIGINT), {fold('rate')}, rate >= 0.5 FROM mb"""


def _t975(nu: int) -> float:
    """97.5 % quantile of Student's t by halving on its probability, integrated by Simpson's rule in the angle."""

    def inside(a: float) -> float:
        steps = 300
        h = a / steps
        f = lambda x: math.cos(x) ** (nu - 1)
        whole = h / 3 * (f(0) + f(a) + 4 * sum(f(h * k) for k in range(1, steps, 2)) + 2 * sum(f(h * k) for k in range(2, steps, 2)))
        return whole * 2 * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)

    low, high = 0.0, math.pi / 2
    for _ in range(45):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < 0.95 else (low, mid)
    return math.sqrt(nu) * math.tan(low)


#: fixed values: 97.5 % quantiles of Student's t for 1 to 60 degrees, by the rule above when first asked for
def _student() -> str:
    return "tq AS (SELECT * FROM (VALUES " + ", ".join(f"({nu}, {_t975(nu)!r})" for nu in range(1, 61)) + ") q(nu, q))"


QUERIES["st_seed_ci"] = f"""{PANEL}, {_student()}, sd AS (SELECT nation, a, avg(ret) AS x FROM p WHERE member GROUP BY nation, a), sg AS (SELECT nation, count(x) AS seeds, avg(x) AS mean, stddev_samp(x) AS sd FROM sd GROUP BY nation),
sh AS (SELECT *, CASE WHEN seeds > 1 THEN q * sd / sqrt(seeds) WHEN seeds = 1 THEN 0.0 END AS half FROM sg LEFT JOIN tq ON nu = seeds - 1) SELECT nation, CAST(seeds AS BIGINT) AS seeds, {_r('mean')}, {fold('mean - half')} AS low, {fold('mean + half')} AS high FROM sh"""
QUERIES["src_panel"] = f"{PANEL}, q AS (SELECT * FROM p WHERE d BETWEEN DATE '1994-03-01' AND DATE '1996-06-30') SELECT a, t, {fold(rolled('avg', 'close', 10))} AS mean, {fold(spread('stddev_samp', 'close', 10))} AS std FROM q"


# --- combined signals ------------------------------------------------------------------------------------

QUERIES["po_combiner"] = f"{_R1}, cw AS (SELECT w1, w2 FROM wt WHERE f = 'full') SELECT p.a, p.t, {fold('CASE WHEN o2.mask AND (f1 IS NOT NULL OR f2 IS NOT NULL) THEN w1 * coalesce(f1, 0) + w2 * coalesce(f2, 0) END')} AS signal FROM p LEFT JOIN o2 ON o2.a = p.a AND o2.t = p.t CROSS JOIN cw"

# --- intervals: the draws of the generator, written as a table ---------------------------------------------

_WEEKS = {1995: 52, 1996: 53, 1997: 52, 1998: 52, 1999: 52, 2000: 52, 2001: 44}


def _drawn(days: dict[int, int], block: int, samples: int, seed: int = 0) -> str:
    """CTE draws (s, y, pos): the place in its year of every day of every sample."""
    rows = ", ".join(f"({s},{y},{n},{b},{w},{v})" for s, y, n, b, w, v in block_starts(days, block, samples, seed))
    return f"starts AS (SELECT * FROM (VALUES {rows}) q(s, y, n, b, w, v)), draws AS (SELECT s, y, v + k AS pos FROM (SELECT *, unnest(generate_series(0, w - 1)) AS k FROM starts) WHERE b * w + k < n)"


def _boot(series: str) -> str:
    """CTEs from `series` (name, d, x; every date) to bi (name, low, high)."""
    return f"""nu AS (SELECT name, x, year(d) AS y, row_number() OVER (PARTITION BY name, year(d) ORDER BY d) - 1 AS pos FROM {series}), ny AS (SELECT name, y, count(x) AS c FROM nu GROUP BY name, y),
by_ AS (SELECT name, s, y, avg(x) AS m FROM nu JOIN draws USING (y, pos) GROUP BY name, s, y),
ms AS (SELECT name, s, CASE WHEN count(m) = count(*) THEN sum(m * c) / sum(c) END AS m FROM by_ JOIN ny USING (name, y) WHERE c > 0 GROUP BY name, s), bi AS (SELECT name, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM ms GROUP BY name)"""


_LONG = "ln AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, d, i_{n} AS x FROM iw" for n in ("close", "volume", "open", "return")) + ")"
QUERIES["st_bootstrap"] = f"{PANEL}, {_ICS}, {_LONG}, {_drawn(_WEEKS, 20, 400)}, {_boot('ln')} SELECT name, {_r('low', 'high')} FROM bi"
QUERIES["st_interval"] = f"{PANEL}, {_ICS}, ln AS (SELECT 'close' AS name, d, i_close AS x FROM iw), {_drawn(_WEEKS, 20, 400)}, {_boot('ln')}, ser AS (SELECT t, i_close AS x FROM iw), {_summary('ser')} SELECT CAST(n AS BIGINT) AS n, {_r('mean', 'sd', 'se', 't_value', 'low', 'high')} FROM sm, bi"
_RATIO = "avg({0}) / CASE WHEN stddev_samp({0}) > 0 THEN stddev_samp({0}) END * sqrt(52.0)"
QUERIES["st_sharpe"] = f"""{PANEL}, mk AS (SELECT d, median(ret) AS x, avg(ret) AS y0 FROM p WHERE member GROUP BY d), bo AS (SELECT d, x, y0, year(d) AS y, row_number() OVER (PARTITION BY year(d) ORDER BY d) - 1 AS pos FROM mk WHERE x IS NOT NULL AND y0 IS NOT NULL),
{_drawn(_WEEKS | {1995: 51}, 20, 400)}, dr AS (SELECT s, {_RATIO.format('x')} - {_RATIO.format('y0')} AS df FROM bo JOIN draws USING (y, pos) GROUP BY s)
SELECT {fold(f"(SELECT {_RATIO.format('x')} - {_RATIO.format('y0')} FROM bo)")} AS difference, {fold('quantile_cont(df, 0.025)')} AS low, {fold('quantile_cont(df, 0.975)')} AS high FROM dr"""

# --- queries of the research module without SQL so far -----------------------------------------------------

_FIVE = ("close", "high", "volume", "open", "low")


def _greedy() -> str:
    ctes, before = [], "pr"
    pairs = ", ".join(f"covar_pop({x}, {y}) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) / (stddev_pop({x}) FILTER ({y} IS NOT NULL) * stddev_pop({y}) FILTER ({x} IS NOT NULL)) AS r_{x}_{y}" for i, x in enumerate(_FIVE) for y in _FIVE[:i])
    for i, x in enumerate(_FIVE):
        own = " AND ".join(f"NOT (k_{y} AND abs(r_{x}_{y}) >= 0.7)" for y in _FIVE[:i]) or "true"
        ctes.append(f"g{i} AS (SELECT *, {own} AS k_{x} FROM {before})")
        before = f"g{i}"
    rows = " UNION ALL ".join(f"SELECT {i} AS i, '{x}' AS name FROM {before} WHERE k_{x}" for i, x in enumerate(_FIVE))
    return f"{PANEL}, pr AS (SELECT {pairs} FROM p WHERE mask), {', '.join(ctes)}, al AS ({rows}) SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS place, name FROM al"


QUERIES["so_greedy"] = _greedy()
_STATUS = {"return": "ret", "copy": "high * 2 + 0.001", "sparse": "CASE WHEN a % 3 = 0 THEN close END", "flat": "CASE WHEN close IS NOT NULL THEN 1.0 END"}


def _near(x: str, m: str) -> str:
    both = f"mask AND {x} IS NOT NULL AND {m} IS NOT NULL"
    ranks = f"SELECT t, rank() OVER (PARTITION BY t ORDER BY {x}) + (count(*) OVER (PARTITION BY t, {x}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY t ORDER BY {m}) + (count(*) OVER (PARTITION BY t, {m}) - 1) / 2.0 AS ry FROM vs WHERE {both}"
    valid = f"t IN (SELECT t FROM vs WHERE mask GROUP BY t HAVING count({x}) >= 3)"
    daily = f"SELECT avg(abs(ic)) FROM (SELECT t, {_ic(x, m)} AS ic FROM vs WHERE mask GROUP BY t) WHERE {valid}"
    ranked = f"SELECT avg(abs(ic)) FROM (SELECT t, {_ic('rx', 'ry')} AS ic FROM ({ranks}) GROUP BY t) WHERE {valid}"
    pooled = f"SELECT abs(covar_pop({x}, {m}) / (stddev_pop({x}) * stddev_pop({m}))) FROM vs WHERE {both} HAVING stddev_pop({x}) > 1e-12 AND stddev_pop({m}) > 1e-12"
    return f"greatest(coalesce(({daily}), 0), coalesce(({ranked}), 0), coalesce(({pooled}), 0))"


def _gated(name: str) -> str:
    c = f"s_{name}"
    return f"""SELECT '{name}' AS signal, sum(n_{c}) / sum(n) AS coverage, count(*) FILTER (n_{c} >= 3) AS valid_days, count(*) FILTER (n_{c} >= 3 AND v_{c} > 1e-12) / nullif(count(*) FILTER (n_{c} >= 3), 0) AS variable_rate, {_near(c, 'high')} AS c_high, {_near(c, 'volume')} AS c_volume FROM dv"""


QUERIES["val_status"] = f"""{PANEL}, vs AS (SELECT *, {', '.join(f'{x} AS s_{n}' for n, x in _STATUS.items())} FROM p), dv AS (SELECT t, count(*) AS n, {', '.join(f'count(s_{n}) AS n_s_{n}, var_pop(s_{n}) AS v_s_{n}' for n in _STATUS)} FROM vs WHERE mask GROUP BY t),
gt AS ({' UNION ALL '.join(_gated(n) for n in _STATUS)}),
st AS (SELECT *, CASE WHEN coverage < 0.8 THEN 'coverage_failure' WHEN valid_days < 30 THEN 'insufficient_valid_days' WHEN coalesce(variable_rate, 0) < 0.8 THEN 'near_constant' ELSE 'valid' END AS first FROM gt)
SELECT signal, CASE WHEN first = 'valid' AND greatest(c_high, c_volume) > 0.95 THEN 'near_duplicate_signal' ELSE first END AS status, CAST(valid_days AS BIGINT) AS valid_days, {_r('coverage', 'variable_rate')}, {fold("CASE WHEN first = 'valid' THEN greatest(c_high, c_volume) END")} AS strongest, CASE WHEN first = 'valid' THEN CASE WHEN c_volume > c_high THEN 'volume' ELSE 'high' END END AS member FROM st"""
_CHAIN = {"return": "ret", "copy": "high * 2 + 0.001", "open": "open"}


def _chain(name: str) -> str:
    ranks = f"SELECT t, rank() OVER (PARTITION BY t ORDER BY s_{name}) + (count(*) OVER (PARTITION BY t, s_{name}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY t ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2.0 AS ry FROM vs WHERE mask AND s_{name} IS NOT NULL AND y IS NOT NULL"
    return f"SELECT '{name}' AS signal, (SELECT avg(ic) FROM rk_{name}) AS ic, (SELECT avg(ic) / nullif(stddev_pop(ic), 0) FROM rk_{name}) AS ir, greatest({_near(f's_{name}', 'high')}, {_near(f's_{name}', 'volume')}) AS corr, (SELECT count(s_{name}) / count(*) FROM vs WHERE mask) AS coverage", f"rk_{name} AS (SELECT t, {_ic('rx', 'ry')} AS ic FROM ({ranks}) GROUP BY t)"


_CHAINED = {n: _chain(n) for n in _CHAIN}
QUERIES["po_native_chain"] = f"""{PANEL}, {_LABEL}, vs AS (SELECT *, {', '.join(f'{x} AS s_{n}' for n, x in _CHAIN.items())} FROM lab), {', '.join(c for _, c in _CHAINED.values())}, ch AS ({' UNION ALL '.join(q for q, _ in _CHAINED.values())}),
rw AS (SELECT *, greatest(-1, least(1, ic * 5 + 0.02 * tanh(ir))) AS raw FROM ch)
SELECT signal, 'valid' AS status, {_r('ic', 'corr')}, {fold("greatest(-1, least(1, raw + CASE WHEN raw >= 0.1 THEN 0.02 ELSE 0 END + CASE WHEN raw >= 0.12 THEN CASE WHEN corr > 0.85 THEN -0.08 * (corr - 0.85) WHEN corr < 0.5 THEN 0.02 ELSE 0 END ELSE 0 END))")} AS reward, coalesce(ic >= 0.01 AND coverage >= 0.5, false) AS mined FROM rw"""

# --- gates and filters -------------------------------------------------------------------------------------

_GATES = {
    "daily_dates": ("count(*) FILTER (d IS NULL)", "bd", 0, 0), "daily_ids": ("0", "bd", 0, 0), "daily_company_ids": ("0", "bd", 0, 0),
    "return_below_minus_one": ("count(*) FILTER (close / open - 1 < -1)", "bd", 0, 0), "return_not_finite": ("0", "bd", 0, 0),
    "close_not_positive": ("count(*) FILTER (close <= 0)", "bd", 0, 0), "close_not_finite": ("0", "bd", 0, 0), "volume_negative": ("count(*) FILTER (volume < 0)", "bd", 0, 0), "volume_not_finite": ("0", "bd", 0, 0),
    "ohlc_violation_rate": ("(count(*) FILTER (high < greatest(open, close)) + count(*) FILTER (low > least(open, close))) / (2.0 * count(*))", "bd", 0, 1e-5),
    "price_factor_rate": ("0", "bd", 0, 0.001), "share_factor_rate": ("avg(CASE WHEN a % 50 = 0 THEN 1.0 ELSE 0.0 END)", "bd", 0, 0.001),
    "cap_identity": ("1", "bd", 0.9, 1.1), "coverage_close": ("1", "bd", 0.8, 1), "coverage_return": ("avg(CASE WHEN close / open IS NULL THEN 0.0 ELSE 1.0 END)", "bd", 0.8, 1), "coverage_volume": ("1", "bd", 0.8, 1),
    "daily_keys": ("count(*) - count(DISTINCT (a, d))", "bd", 0, 0), "membership_ids": ("0", "mb", 0, 0), "membership_intervals": ("count(*) FILTER (s > e)", "mb", 0, 0),
    "members_1996-06-28": ("count(*) FILTER (a % 10 <> 0 AND DATE '1996-06-28' BETWEEN s AND e)", "mb", 5, 550), "members_1999-06-30": ("count(*) FILTER (a % 10 <> 0 AND DATE '1999-06-30' BETWEEN s AND e)", "mb", 5, 550), "membership_overlaps": ("0", "mb", 0, 0),
    "market_keys": ("0", "orders", 0, 0), "market_dates": ("count(*) FILTER (o_orderdate IS NULL)", "orders", 0, 0),
    "delistings_keys": ("count(*) - count(DISTINCT (a, d))", "dl", 0, 0), "delistings_dates": ("count(*) FILTER (d IS NULL)", "dl", 0, 0), "delistings_ids": ("0", "dl", 0, 0),
    "links_keys": ("0", "customer", 0, 0), "links_ids": ("count(*) FILTER (c_acctbal / 10 IS NULL OR fmod(c_acctbal / 10, 1) <> 0)", "customer", 0, 0), "links_gvkeys": ("0", "customer", 0, 0),
    "fundamentals_keys": ("count(*) - count(DISTINCT (o_custkey, CAST(o_orderdate AS DATE)))", "orders", 0, 0), "fundamentals_gvkeys": ("0", "orders", 0, 0), "date_types": ("0", "orders", 0, 0),
}
_ROWS = " UNION ALL ".join(f"SELECT '{g}' AS gate, CAST({x} AS DOUBLE) AS value, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high FROM {source}" for g, (x, source, lo, hi) in _GATES.items() if "(" in x)
_CONSTANTS = ", ".join(f"('{g}', {float(x)}, {float(lo)}, {float(hi)})" for g, (x, _, lo, hi) in _GATES.items() if "(" not in x)
QUERIES["dv_bundle"] = f"""{PANEL}, bd AS (SELECT * FROM bar), mb AS (SELECT s_suppkey AS a, DATE '1995-01-01' + to_months(CAST(s_suppkey % 12 AS INTEGER)) AS s, DATE '2001-12-31' - to_months(CAST(s_suppkey % 7 AS INTEGER)) AS e FROM supplier),
dl AS (SELECT l_suppkey AS a, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'R'), al AS ({_ROWS} UNION ALL SELECT * FROM (VALUES {_CONSTANTS}) q(gate, value, low, high))
SELECT gate, {_r('value', 'low', 'high')}, coalesce(value BETWEEN low AND high, false) AS ok FROM al"""
QUERIES["fl_tradable"] = """SELECT o_orderkey, o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND r_name IN ('ASIA', 'EUROPE', 'AMERICA') AND n_name IN ('BRAZIL', 'CHINA', 'FRANCE', 'JAPAN', 'GERMANY', 'INDIA', 'PERU') AND o_totalprice > 0 AND c_acctbal > 0 AS ok
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _many_exposures() -> str:
    """Residuals of the label on 21 exposures and a constant, one orthogonal step after the other; a column that the others explain adds nothing."""
    w = "OVER (PARTITION BY t)"
    lags = {f"{c}{k}": f"lag({source}, {k}) OVER (PARTITION BY a ORDER BY t)" for c, source in (("s", "close"), ("v", "volume")) for k in range(5)}
    names = [f"e{k}" for k in range(len(INDUSTRIES))] + list(lags)
    ctes = [f"l0 AS (SELECT *, {_IND} AS ind, {', '.join(f'{x} AS l_{n}' for n, x in lags.items())} FROM (SELECT *, a * 137 % 10000 AS code FROM lab))"]
    dummies = ", ".join(f"CASE WHEN ind = '{n}' THEN 1.0 ELSE 0.0 END AS e{k}" for k, (n, _) in enumerate(INDUSTRIES))
    ctes.append(f"l1 AS (SELECT a, t, mask, y, {dummies}, {', '.join(f'coalesce({z_of(f'l_{n}')}, 0) AS {n}' for n in lags)} FROM l0)")
    ctes.append(f"q0 AS (SELECT * FROM (SELECT *, count(*) {w} AS n FROM l1 WHERE mask AND y IS NOT NULL) WHERE n > {len(names) + 1})")
    # the next column r{i} is what the ones before leave of it; then they take their part of all that follow and of the label
    before = "q0"
    left = [*names, "y"]
    ctes.append(f"q1 AS (SELECT a, t, {', '.join(f'{n} - avg({n}) {w} AS {n}' for n in left)} FROM {before})")
    before = "q1"
    for i, own in enumerate(names):
        left = [*names[i + 1 :], "y"]
        part = lambda n: f"{n} - coalesce(CASE WHEN var_pop({own}) {w} > 1e-12 THEN covar_pop({n}, {own}) {w} / var_pop({own}) {w} END, 0) * {own} AS {n}"  # noqa: B023, E731
        ctes.append(f"q{i + 2} AS (SELECT a, t, {', '.join(map(part, left))} FROM {before})")
        before = f"q{i + 2}"
    return f"{PANEL}, {_LABEL}, {', '.join(ctes)} SELECT p.a, p.t, {fold('q.y', 4)} AS v FROM p LEFT JOIN {before} q ON q.a = p.a AND q.t = p.t"


QUERIES["cs_residual_22"] = _many_exposures()
