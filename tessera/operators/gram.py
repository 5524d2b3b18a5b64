"""Daily moments of many factors by blocks of matrix products.

A day's cross-section is a matrix; its moments are products of that matrix with itself and the label, taken block by
block, so hundreds of factors need no expression for each pair of them.  A row holds one day and one pair of blocks.
With `parts` above 1 a day's names are dealt over so many tasks, and what these find is merged with care for the
means, so that sums are as exact as over all names at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cross_section as CS
from .pool import FEWEST, FLAT_SHARE, NO_SPREAD, Moments

_FIELDS = "bi int, bj int, n long, y double, vy double, s array<double>, p array<double>, c array<double>, g array<double>"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in names]) if names else np.zeros((table.num_rows, 0))


def _row(bi: int, bj: int, n: int, y: float, vy: float, s: np.ndarray, p: np.ndarray, c: np.ndarray, g: np.ndarray) -> tuple:
    return (bi, bj, n, y, vy, s, p, c, g.ravel())


def _lists(col) -> list[np.ndarray]:
    """The arrays of a column of lists, without a Python object for each number."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    edges, values = col.offsets.to_numpy(), col.values.to_numpy()
    return [values[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def day_rows(x: np.ndarray, y: np.ndarray, width: int) -> list[tuple]:
    """The rows of daily_blocks() for one day, from its factors and label without gaps."""
    edges = [*range(0, x.shape[1], width), x.shape[1]]
    n, mean = len(y), float(y.mean())
    off = y - mean
    rows = []
    for bi in range(len(edges) - 1):
        left = x[:, edges[bi] : edges[bi + 1]]
        for bj in range(bi, len(edges) - 1):
            g = left.T @ x[:, edges[bj] : edges[bj + 1]] / n
            at = (left.mean(axis=0), left.T @ y / n, (left - left.mean(axis=0)).T @ off / n) if bi == bj else (np.zeros(0),) * 3
            rows.append(_row(bi, bj, n, mean, float((off * off).mean()), *at, g))
    return rows


def daily_blocks(df: DataFrame, factors: list[str], label: str, universe: Column, key: str = "t", name: str = "a", width: int = 64, parts: int = 1) -> DataFrame:
    """For each day and pair of blocks bi <= bj: n, the label's mean and variance, means of the factors of bi (s), of their
    products with the label (p), their covariances with it (c), and means of products of bi with bj (g, row by row).

    Factors that are missing count as 0 on the universe of names with a label; s, p and c stand on the diagonal alone.
    """
    own = df.where(F.coalesce(universe, F.lit(False)) & F.col(label).isNotNull())
    deal = F.pmod(F.xxhash64(name), F.lit(parts)) if parts > 1 else F.lit(0)
    own = own.select(key, F.col(label).cast("double").alias("_y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(factors)], deal.alias("_part"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {_FIELDS}"
    columns = [f"_x{i}" for i in range(len(factors))]

    def one(keys, table):
        rows = day_rows(_matrix(table, columns), table.column("_y").to_numpy(), width)
        return _arrow(keys[0].as_py(), key, rows, arrow)

    arrow = _arrow_schema(schema)
    blocks = own.groupBy(key, "_part").applyInArrow(one, schema)
    return blocks if parts == 1 else _merged(blocks, key, schema)


def neutral_blocks(df: DataFrame, factors: list[str], label: str, base: Column, exposures: list[str] | None = None, key: str = "t", width: int = 64) -> DataFrame:
    """daily_blocks() of CS.neutral_inputs(), a call for each day from the raw base rows to the moments: base rows are shuffled once, and none comes back."""
    own = df.where(F.coalesce(base, F.lit(False))).select(key, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*factors, label, *(exposures or [])])])
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {_FIELDS}"

    def one(keys, table):
        x, y, here = CS.neutral_day(CS.matrix(table, factors), CS.matrix(table, [label])[:, 0], np.ones(table.num_rows, bool), CS.matrix(table, exposures) if exposures else None)
        rows = day_rows(np.nan_to_num(x[here], nan=0.0), y[here], width) if here.any() else []
        return _arrow(keys[0].as_py(), key, rows, arrow)

    arrow = _arrow_schema(schema)
    return own.groupBy(key).applyInArrow(one, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _arrow(value, key: str, rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = [[value] * len(rows), *map(list, zip(*rows, strict=True))] if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _merged(blocks: DataFrame, key: str, schema: str) -> DataFrame:
    """The parts of each day and pair of blocks as one row."""
    arrow = _arrow_schema(schema)

    def one(keys, table):
        n, means, variances = (table.column(k).to_numpy() for k in ("n", "y", "vy"))
        share = n / n.sum()
        mean = lambda k: share @ np.stack(_lists(table.column(k)))
        y, s = float(share @ means), mean("s")
        vy = float(share @ (variances + (means - y) ** 2))
        c = sum(w * (c + (own - s) * (m - y)) for w, c, own, m in zip(share, _lists(table.column("c")), _lists(table.column("s")), means, strict=True))
        bi, bj = (table.column(k)[0].as_py() for k in ("bi", "bj"))
        return _arrow(table.column(key)[0].as_py(), key, [_row(bi, bj, int(n.sum()), y, vy, s, mean("p"), c, mean("g"))], arrow)

    return blocks.groupBy(key, "bi", "bj").applyInArrow(one, schema)


def block_moments(blocks: DataFrame, k: int, parts: dict[str, Column] | None = None, width: int = 64) -> dict[str, Moments]:
    """Day-equal means of the moments over each named part of the days; k * k numbers a part reach the driver."""
    parts = parts or {"all": F.lit(True)}
    own = [F.when(c & (F.col("n") >= FEWEST), F.lit(name)) for name, c in parts.items()]
    dealt = blocks.select("bi", "bj", "p", "g", F.explode(F.array_compact(F.array(*own))).alias("part"))
    schema = "part string, bi int, bj int, days long, p array<double>, g array<double>"
    arrow = _arrow_schema(schema)

    def partial(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            names = (b.column(k).to_pylist() for k in ("part", "bi", "bj"))
            for part, bi, bj, p, g in zip(*names, _lists(b.column("p")), _lists(b.column("g")), strict=True):
                at = held.setdefault((part, bi, bj), [0, 0.0, 0.0])
                at[0] += 1
                at[1] = at[1] + p
                at[2] = at[2] + g
        yield pa.RecordBatch.from_pylist([{"part": k[0], "bi": k[1], "bj": k[2], "days": v[0], "p": v[1].tolist(), "g": v[2].tolist()} for k, v in held.items()], schema=arrow)

    added = dealt.mapInArrow(partial, schema)
    sums = added.groupBy("part", "bi", "bj").agg(F.sum("days").alias("days"), F.collect_list("p").alias("p"), F.collect_list("g").alias("g"))
    out: dict[str, Moments] = {}
    grams = {name: np.zeros((k, k)) for name in parts}
    preds, days = {name: np.zeros(k) for name in parts}, dict.fromkeys(parts, 0)
    for r in sums.toLocalIterator():
        lo, at = r.bi * width, r.bj * width
        g = np.sum(r.g, axis=0) / r.days
        rows = min(width, k - lo)
        g = g.reshape(rows, -1)
        grams[r.part][lo : lo + rows, at : at + g.shape[1]] = g
        grams[r.part][at : at + g.shape[1], lo : lo + rows] = g.T
        if r.bi == r.bj:
            preds[r.part][lo : lo + rows] = np.sum(r.p, axis=0) / r.days
        days[r.part] = r.days
    for name in parts:
        if not days[name]:
            raise ValueError(f"no day of {name} has {FEWEST} rows")
        out[name] = Moments(grams[name], preds[name], days[name])
    return out


def composites(blocks: DataFrame, weights: dict[str, np.ndarray], part: Column | None = None, key: str = "t", width: int = 64) -> DataFrame:
    """Daily correlations with the label of many weighted sums: key, part, ic array<double>.

    `weights` has for each part of the days a matrix with one composite a row; `part` names the part of a row of
    `blocks` (the only one by default), and days of no part are left out.  A constant sum against a varying label
    counts as 0; a day with too few names or a constant label is missing throughout.
    """
    part = F.lit(next(iter(weights))) if part is None else part
    kind = blocks.schema[key].dataType.simpleString()
    half = f"{key} {kind}, part string, n long, vy double, mean array<double>, cov array<double>, square array<double>"
    arrow = _arrow_schema(half)

    def partial(batches):
        for b in batches:
            made: tuple[list, list, list] = ([], [], [])
            names = (b.column(k).to_pylist() for k in ("part", "bi", "bj"))
            for part, bi, bj, s, c, g in zip(*names, *(_lists(b.column(k)) for k in ("s", "c", "g")), strict=True):
                w = weights[part]
                left, right = w[:, bi * width :][:, :width], w[:, bj * width :][:, :width]
                zero = np.zeros(len(w))
                made[0].append(left @ s if bi == bj else zero)
                made[1].append(left @ c if bi == bj else zero)
                made[2].append(((left @ g.reshape(left.shape[1], right.shape[1])) * right).sum(axis=1) * (1 if bi == bj else 2))
            sums = [pa.array(x, pa.list_(pa.float64())) for x in made]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("part"), b.column("n"), b.column("vy"), *sums], schema=arrow)

    schema = f"{key} {kind}, part string, ic array<double>"
    final = _arrow_schema(schema)

    def one(keys, table):
        total = lambda k: np.sum(_lists(table.column(k)), axis=0)
        mean, cov, square = total("mean"), total("cov"), total("square")
        n, vy = table.column("n")[0].as_py(), table.column("vy")[0].as_py()
        vx = square - mean * mean
        flat = (vx * n <= NO_SPREAD) | (vx <= FLAT_SHARE * square)
        with np.errstate(all="ignore"):
            ic = np.where(flat, 0.0, cov / np.sqrt(np.where(flat, 1.0, vx) * vy))
        good = n >= FEWEST and vy * n > NO_SPREAD
        found = ic.tolist() if good else [None] * len(ic)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((table.column(key)[0].as_py(), table.column("part")[0].as_py(), found), final, strict=True)], schema=final)

    named = blocks.withColumn("part", part).where("part is not null")
    return named.select(key, "part", "bi", "bj", "n", "vy", "s", "c", "g").mapInArrow(partial, half).groupBy(key, "part").applyInArrow(one, schema)


def correlations(df: DataFrame, left: list[str], right: list[str], key: str = "t", fewest: int = 3) -> DataFrame:
    """Correlation of each left with each right column on the day's joint rows: key, l, r (places in the lists), n, corr.

    All pairs of a day come from a few products of the columns and of masks of what is present, not from a pass each.
    """
    names = list(dict.fromkeys([*left, *right]))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, l int, r int, n long, corr double"
    arrow = _arrow_schema(schema)

    def one(keys, table):
        def side(cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
            x = _matrix(table, cols)
            has = np.isfinite(x)
            with np.errstate(invalid="ignore"):
                mid = np.where(has.any(axis=0), np.where(has, x, 0.0).sum(axis=0) / np.maximum(has.sum(axis=0), 1), 0.0)
            return np.where(has, x - mid, 0.0), has.astype(float)

        (x, mx), (y, my) = side(left), side(right)
        n = mx.T @ my
        with np.errstate(all="ignore"):
            sx, sy = x.T @ my, mx.T @ y
            vx, vy, c = (x * x).T @ my - sx * sx / n, mx.T @ (y * y) - sy * sy / n, x.T @ y - sx * sy / n
            # a column that is constant on the joint rows leaves a rounding error instead of 0
            scale_x, scale_y = (x * x).T @ my, mx.T @ (y * y)
            ok = (n >= fewest) & (vx > NO_SPREAD) & (vy > NO_SPREAD) & (vx > FLAT_SHARE * scale_x) & (vy > FLAT_SHARE * scale_y)
            corr = np.where(ok, c / np.sqrt(np.where(ok, vx * vy, 1.0)), np.nan)
        l, r = np.indices(n.shape)
        flat = corr.ravel()
        made = [pa.array([keys[0].as_py()] * n.size, arrow.field(0).type), pa.array(l.ravel(), pa.int32()), pa.array(r.ravel(), pa.int32()), pa.array(n.ravel().astype(np.int64)), pa.array(flat, mask=np.isnan(flat))]
        return pa.Table.from_arrays(made, schema=arrow)

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).groupBy(key).applyInArrow(one, schema)
