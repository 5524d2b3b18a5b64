"""Embedding near-dedup with robust-pruned flat graphs on overlapping cluster shards.

Vectors with the same label and the same components form one class, numbered by their smallest vec_id; those numbers, not
the ids, are the nodes of the graphs.  The classes of a label are routed to
shards: cluster centres are fitted on a bounded sample of each oversized shard, every vector
goes to its nearest centre, its home, and to each other centre almost as near, and shards that are still
too large are split again.  Each shard gets a flat graph, built by inserting batches: a greedy
search from the medoid finds candidates, robust pruning keeps few and diverse neighbours, and
reverse edges are added.  The adjacency lists of a vector in several shards are united.  Every vector is then
searched for in its home over the united lists: a greedy search from the medoid, then a
range-expanding one, which goes on from every vector in range, over edges in both directions, until no
new one is found; so pruning can't hide a near copy behind a neighbour with a full list.
Pairs found are verified by cosine in double precision and never leave the task: a shard gives each vector's
number of links and one edge to the smallest vector that it reaches there.  A link whose other end has its home elsewhere
counts for that end too, unless the first vector stands in that home and is found from there.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link
with nothing; rows without vec_id have no component and are nobody's link.  Rows that share a vec_id are linked each by its own
vector (the smallest id of what each reaches is its component).  Vectors of different lengths don't link.  Shards that clusters
can't split any more are cut into blocks with a graph each, and every vector at home there is searched for in every block: a
dense group of n different vectors, all linked, takes n * n comparisons, as its numbers of links do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, group_arrow, settle, use
from .components import components

THRESHOLD = 0.93
SHARD, SAMPLE, CENTRES, DEPTH = 500, 1500, 16, 6
#: a vector also goes to a centre whose angle is at most so many radians wider than the nearest one's
SLACK = 0.08
#: a shard is split unless a part would hold more than this share of it, or a vector stand in more than so many parts on average
MOST_SHARE, MOST_COPIES, WHOLE = 0.75, 4, "!"
DEGREE, BEAM, ALPHA = 12, 24, 1.2
#: tables of centres are broadcast up to so many shards (8 KB each for 64 components)
BROADCAST_SHARDS = 4096


# --- one shard's graph ----------------------------------------------------------------


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point p, at most `degree` of its candidates (-1: none): the nearest that no chosen one covers.

    x: unit vectors, p: (n,), cand: (n, c).  Distances are 1 - cosine.
    """
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    d = 1 - np.einsum("ncd,nd->nc", v, x[p])
    d[(cand < 0) | (cand == p[:, None])] = np.inf
    d = np.where(np.isfinite(d), np.maximum(d, 0), np.inf)
    between = 1 - v @ v.transpose(0, 2, 1)
    out, row = np.full((n, degree), -1, np.int64), np.arange(n)
    for k in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[row, best])
        if not ok.any():
            break
        out[ok, k] = cand[ok, best[ok]]
        covered = alpha * between[row, best] <= d
        d[covered & ok[:, None]] = np.inf
        d[row, best] = np.inf
    return out


def greedy(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for each query vector: the beam's points and cosines, best first."""
    n, row = len(q), np.arange(len(q))
    ids = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = entry, q @ x[entry], False
    seen[:, entry] = True
    while True:
        open_sim = np.where(done, -np.inf, sim)
        at = open_sim.argmax(1)
        live = np.flatnonzero(np.isfinite(open_sim[row, at]))
        if not len(live):
            return ids, sim
        done[live, at[live]] = True
        near = graph[ids[live, at[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        seen[np.repeat(live, near.shape[1])[fresh.reshape(-1)], near[fresh]] = True
        s = np.where(fresh, np.einsum("nrd,nd->nr", x[np.maximum(near, 0)], q[live]), -np.inf)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_sim = np.concatenate([sim[live], s], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        pick = np.arange(len(live))[:, None]
        ids[live], sim[live], done[live] = all_ids[pick, keep], all_sim[pick, keep], all_done[pick, keep]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Adjacency (n, degree; -1: none) and the entry point; batches double as the graph grows."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = medoid(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        new = order[at : at + min(at, 256)]
        ids, _ = greedy(x, graph, entry, x[new], min(beam, max(at, 1)))
        # points of the same batch are candidates too, else near copies in one batch would not meet
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -np.inf)
        mates = new[np.argsort(-own, axis=1)[:, : min(8, len(new) - 1)]] if len(new) > 1 else np.full((1, 1), -1)
        graph[new] = robust_prune(x, new, np.concatenate([ids, mates], axis=1), degree, alpha)
        src, dst = np.repeat(new, degree), graph[new].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order2 = np.argsort(dst, kind="stable")
        src, dst = src[order2], dst[order2]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        wide = np.full((len(to), int(count.max()) if len(to) else 0), -1, np.int64)
        place = np.arange(len(dst)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(to)), count), place] = src
        if len(to):
            cand = np.concatenate([graph[to], wide], axis=1)
            graph[to] = robust_prune(x, to, cand, degree, alpha)
        at += len(new)
    return graph, entry


def both_ways(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each point's neighbours begin, and the neighbours, with every edge in both directions."""
    src, dst = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    key = np.unique(np.concatenate([src * len(graph) + dst, dst * len(graph) + src]))
    return np.searchsorted(key, np.arange(len(graph) + 1) * len(graph)), key % len(graph)


def search_range(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, threshold: float, beam: int = BEAM) -> list[np.ndarray]:
    """For each query, the points found with cosine at least about `threshold`: greedy, then expanding every point in range."""
    limit = np.float32(threshold - 1e-4)
    at, edges = both_ways(graph)
    out = []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        ids, sim = greedy(x, graph, entry, part, min(beam, len(x)))
        hit, seen = np.zeros((len(part), len(x)), bool), np.zeros((len(part), len(x)), bool)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        r, c = np.nonzero(sim >= limit)
        front_q, front = r, ids[r, c]
        hit[front_q, front] = True
        while len(front):
            n = at[front + 1] - at[front]
            fq = np.repeat(front_q, n)
            near = edges[np.arange(len(fq)) + np.repeat(at[front] - np.cumsum(n) + n, n)]
            ok = ~seen[fq, near]
            key = np.unique(fq[ok] * len(x) + near[ok])
            fq, near = key // len(x), key % len(x)
            seen[fq, near] = True
            ok = np.einsum("nd,nd->n", part[fq], x[near]) >= limit
            front_q, front = fq[ok], near[ok]
            hit[front_q, front] = True
        out += [np.flatnonzero(h) for h in hit]
    return out


# --- routing -----------------------------------------------------------------------------


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.stack([np.frombuffer(x, np.float64) for x in col.to_pylist()]) if len(col) else np.zeros((0, 1))


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return np.unique(c.round(9), axis=0)


def _classes(vectors: DataFrame) -> DataFrame:
    """Each row's vec_id and, for usable vectors, its label, unit vector as bytes, and class hash (key)."""

    def run(batches):
        for b in batches:
            key, unit = [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                a = v.values if v.is_valid else None
                x = a.to_numpy(zero_copy_only=False).astype(np.float64) if a is not None and a.null_count == 0 and len(a) else np.zeros(1)
                n = np.linalg.norm(x / s) * s if np.isfinite(x).all() and (s := np.abs(x).max()) > 0 else 0.0
                ok = label is not None and n > 0
                key.append(xxhash.xxh3_128_hexdigest(x.tobytes()) if ok else None)
                unit.append((x / n).tobytes() if ok else None)
            yield batch(vec_id=b.column(0), label=b.column(1), key=pa.array(key, pa.string()), unit=pa.array(unit, pa.binary()))

    cols = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cols.mapInArrow(run, "vec_id long, label long, key string, unit binary")


def _route(points: DataFrame, shard: int, sample: int, k: int, slack: float, depth: int) -> DataFrame:
    """node, copies, unit, shard (a path of centres), home (whether this shard is the vector's nearest), and blocks and tiles of the shard."""
    parts = settle(points.withColumn("home", F.lit(True)))
    for level in range(depth):
        large = settle(parts.where(~F.col("shard").endswith(WHOLE)).groupBy("shard").count().where(F.col("count") > shard).withColumn("level", F.lit(level)))
        n_large = large.count()
        if not n_large:
            break
        small = F.broadcast if n_large <= BROADCAST_SHARDS else lambda df: df
        # the sample: rows in hash order up to a bound for each oversized shard
        share = F.least(F.lit(1.0), F.lit(1.5 * sample) / F.col("count"))
        drawn = parts.join(small(large), "shard").where((F.pmod(F.xxhash64("node", "level"), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)

        def fit(key, t, level=level):
            x = _matrix(t.column("unit"))[: 2 * sample]
            c = _centres(x, int(min(k, max(2, -(-t.column("count")[0].as_py() * 2 // shard)))), level)
            # where most vectors stand near most centres, a split would copy them all: the shard stays whole
            angle = np.arccos(np.clip(x @ c.T, -1, 1))
            near = angle <= angle.min(1)[:, None] + slack
            splits = near.mean(0).max() <= MOST_SHARE and near.sum(1).mean() <= MOST_COPIES
            return batch(shard=pa.array([key[0].as_py()]), centres=pa.array([c.astype(np.float64).tobytes() if splits else None], pa.binary()), width=pa.array([c.shape[1]], pa.int32()))

        centres = group_arrow(drawn.select("shard", "unit", "count"), ["shard"], fit, "shard string, centres binary, width int")

        def deal(batches, slack=slack):
            for b in batches:
                t = pa.Table.from_batches([b])
                at, paths, home = [], [], []
                by: dict = {}
                for i, s in enumerate(t.column("shard").to_pylist()):
                    by.setdefault(s, []).append(i)
                own = t.column("home").to_pylist()
                for s, rows in by.items():
                    c = t.column("centres")[rows[0]].as_py()
                    if c is None:
                        at += rows
                        paths += [s if t.column("width")[rows[0]].as_py() is None else s + WHOLE] * len(rows)
                        home += [own[i] for i in rows]
                        continue
                    c = np.frombuffer(c, np.float64).reshape(-1, t.column("width")[rows[0]].as_py())
                    angle = np.arccos(np.clip(_matrix(t.column("unit").take(rows)) @ c.T, -1, 1))
                    near = angle.argmin(1)
                    for i, j in zip(*np.nonzero(angle <= angle.min(1)[:, None] + slack), strict=True):
                        at.append(rows[i])
                        paths.append(f"{s}.{j}")
                        home.append(bool(j == near[i]) and own[rows[i]])
                cols = {c: t.column(c).take(pa.array(at, pa.int64())).combine_chunks() for c in ("node", "copies", "unit")}
                yield batch(**cols, shard=pa.array(paths, pa.string()), home=pa.array(home, pa.bool_()))

        parts = settle(parts.join(small(centres), "shard", "left").mapInArrow(deal, "node long, copies long, unit binary, shard string, home boolean"))
    sizes = parts.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(2.0 * shard)).cast("int").alias("blocks"), F.ceil(F.count_if("home") / F.lit(8.0 * shard)).cast("int").alias("tiles"))
    return parts.join(sizes, "shard")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n reaches over the pairs."""
    r = np.arange(n)
    while True:
        low = np.minimum(r[a], r[b])
        new = r.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == r).all():
            return r
        r = new


def _shard_links(t: pa.Table, here: int, threshold: float) -> pa.RecordBatch | None:
    """node, add (links to count), root (the smallest node reached here) of one shard's members and those that ask."""
    order = np.argsort(~t.column("member").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    n, asks = int(t.column("member").to_numpy().sum()), np.flatnonzero(t.column("asks").to_numpy())
    if not n or not len(asks):
        return None
    node, copies, exact = t.column("node").to_numpy(), t.column("copies").to_numpy(), _matrix(t.column("unit"))
    place = {r: i for i, r in enumerate(node[:n].tolist())}
    lists = [[place[r] for r in near or () if r in place] for near in t.column("near").to_pylist()[:n]]
    graph = np.full((n, max(1, max(map(len, lists)))), -1, np.int64)
    for i, o in enumerate(lists):
        graph[i, : len(o)] = o
    x = exact.astype(np.float32)
    found = search_range(x[:n], graph, medoid(x[:n]), x[asks], threshold)
    a = np.repeat(asks, [len(f) for f in found])
    b = np.concatenate(found)
    ok = a != b
    a, b = a[ok], b[ok]
    ok = np.concatenate([np.einsum("nd,nd->n", exact[a[k : k + 65536]], exact[b[k : k + 65536]]) >= threshold for k in range(0, max(len(a), 1), 65536)])  # verified in double precision
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    # found from either end counts for both, if both ask here
    both = (a < n) & np.isin(b, asks)
    key = np.unique(np.concatenate([a * len(node) + b, b[both] * len(node) + a[both]]))
    a, b = key // len(node), key % len(node)
    add = np.bincount(a, copies[b], len(node))
    home = t.column("at_home").to_numpy()
    away = np.flatnonzero(home[b] != here)
    shards = t.column("shards").to_pylist()
    back = away[np.array([home[j] not in shards[i] for i, j in zip(a[away].tolist(), b[away].tolist(), strict=True)], bool)]
    add += np.bincount(b[back], copies[a[back]], len(node))
    rank = np.argsort(node, kind="stable")
    number = np.empty(len(node), np.int64)
    number[rank] = np.arange(len(node))
    root = node[rank][_roots(len(node), number[a], number[b])[number]]
    k = np.flatnonzero((add > 0) | (root != node))
    return batch(node=pa.array(node[k]), add=pa.array(add[k].astype(np.int64)), root=pa.array(root[k]))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, slack: float = SLACK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label)."""
    rows = settle(_classes(vectors))
    named = rows.where("vec_id is not null and key is not null")
    classes = named.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    # in this order, the smallest node of a component has its smallest vec_id
    classes = settle(classes.orderBy("rep", "label", "key").withColumn("node", F.monotonically_increasing_id()))
    points = classes.select("node", "copies", "unit", F.concat_ws(":", F.col("label").cast("string"), F.length("unit").cast("string")).alias("shard"))
    parts = settle(_route(points, shard, SAMPLE, CENTRES, slack, DEPTH).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    def build(key, t):
        use("neardup")
        node, x = t.column("node").to_numpy(), _matrix(t.column("unit")).astype(np.float32)
        graph, _ = build_graph(x)
        return batch(node=pa.array(node), near=pa.array([node[g[g >= 0]].tolist() for g in graph], pa.list_(pa.int64())), at=t.column("at").combine_chunks(), home=t.column("home").combine_chunks())

    at = F.xxhash64("shard").alias("at")
    lists = group_arrow(parts.select("shard", "block", "node", "unit", at, "home"), ["shard", "block"], build, "node long, near array<long>, at long, home boolean")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("at").alias("shards"), F.max(F.when(F.col("home"), F.col("at"))).alias("at_home"))
    whole = settle(parts.join(united, "node").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.greatest("tiles", F.lit(1))).cast("int")))
    cols = ["node", "copies", "unit", "shards", "at_home"]
    # one row where a vector asks in the tile that holds it as a member
    own = whole.select("shard", F.explode(F.sequence(F.lit(0), F.greatest("tiles", F.lit(1)) - 1)).alias("tile"), "block", *cols, "near", F.lit(True).alias("member"), "home", F.col("tile").alias("asks_in")).withColumn("asks", F.expr("home and tile = asks_in")).drop("home", "asks_in")
    other = whole.where("home and blocks > 1").select("shard", "tile", F.col("block").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *cols, F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("member"), F.lit(True).alias("asks")).where("block <> mine").drop("mine")

    def search(key, t):
        use("neardup")
        return _shard_links(t, t.column("at")[0].as_py(), threshold)

    found = settle(group_arrow(own.unionByName(other).withColumn("at", F.xxhash64("shard")), ["shard", "block", "tile"], search, "node long, add long, root long"))
    linked = found.groupBy("node").agg(F.sum("add").alias("others"))
    comp = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = classes.select(F.col("node").alias("component"), F.col("rep").alias("component_id"))
    about = classes.select("label", "key", "node", "rep", "copies").join(linked, "node", "left").join(comp.join(label, "component").select("node", "component_id"), "node", "left")
    about = about.select("label", "key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component_id", "rep").alias("component"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "key").join(about, ["label", "key"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit_recall(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 50) -> tuple[int, int]:
    """(links that near_duplicates() counted, links by brute force) of the vectors whose vec_id is divisible by `every`.

    The queries meet all rows in blocks: they are dealt to groups of bounded size, and each group meets each batch of rows.
    """
    rows = settle(_classes(vectors).where("vec_id is not null and key is not null"))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "unit")
    groups = max(1, -(-asked.count() // 8192))
    total = 0
    for k in range(groups):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == k).collect()
        if not part:
            continue
        ids, labels = np.array([r[0] for r in part]), np.array([r[1] for r in part])
        q = [np.frombuffer(r[2], np.float64) for r in part]

        def meet(batches, ids=ids, labels=labels, q=q):
            for b in batches:
                own, lab, units = b.column(0).to_numpy(), b.column(1).to_numpy(), [np.frombuffer(x, np.float64) for x in b.column(2).to_pylist()]
                n = 0
                for width in {len(u) for u in q}:
                    i, j = [k for k, u in enumerate(q) if len(u) == width], [k for k, u in enumerate(units) if len(u) == width]
                    if i and j:
                        s = np.stack([q[k] for k in i]) @ np.stack([units[k] for k in j]).T
                        n += int(((s >= threshold) & (labels[i][:, None] == lab[j][None]) & (ids[i][:, None] != own[j][None])).sum())
                yield batch(n=pa.array([n], pa.int64()))

        total += rows.select("vec_id", "label", "unit").mapInArrow(meet, "n long").agg(F.sum("n")).first()[0] or 0
    got = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return int(got), int(total)
