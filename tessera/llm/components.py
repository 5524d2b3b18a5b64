"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, settle


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        r = self.up
        while True:
            s = r[r]
            if (s == r).all():
                return r
            r = s


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of the components of these links, without the smallest themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    uf = UnionFind(len(ids))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        uf.join(x, y)
    r = uf.roots()
    own = r != np.arange(len(ids))
    return ids[own], ids[r[own]]


def _contract(edges: DataFrame) -> DataFrame:
    """Links of each batch replaced by stars: the same components, at most one link for each node."""

    def run(batches):
        for x in batches:
            a, b = stars(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False))
            yield batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return edges.mapInArrow(run, "a long, b long")


def _star_step(e: DataFrame) -> DataFrame:
    """Large-star, then small-star: every node points closer to its component's smallest node.

    The smallest neighbours are settled first: then both sides of the join are dealt for it alone, and Spark can split the
    rows of a node with very many neighbours.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return small.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for every node in `edges` (columns a, b; long).

    Links with a null end are left out.  Each round is a fixed number of joins and
    aggregations; nothing but two counts reaches the driver.  Rounds grow with the
    logarithm of a component's width.
    """
    e = settle(_contract(edges.select("a", "b").where("a is not null and b is not null and a <> b")))
    before = None
    for _ in range(max_rounds):
        e = settle(_star_step(e))
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    own = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
