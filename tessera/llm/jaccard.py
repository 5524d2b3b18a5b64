"""n-gram Jaccard join with a token-group matrix.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z) words; a
shorter text is one shingle, an empty or null one an empty set that links with nothing.
Two documents link when 100 * |intersection| >= 80 * |union|.

Exact copies form one class first, of which one text goes on.  The tokens of all sets are counted over the corpus, in blocks of
hashes, and every set orders its tokens by count, rarest first.  A partner shares at least one of the first
|set| - ceil(0.8 |set|) + 1 tokens of both sets in that order; of those, tokens that only one set has can't meet
and are left out, so most sets show none and are done.

Groups: each set pairs with one leader, the smallest set at the tokens that it shows (that of most
shared tokens); pairs are compared exactly, and sets that linked pairs connect are a group of similar documents.
The token-group matrix then has, for each shown token, the groups whose union of shown tokens holds it,
with the smallest and largest set.  A set meets a larger group than its own in the matrix only if a partner can be
there.  Opening a group bounds its overlap with the union of the members' whole sets first, and only
queries that reach 0.8 of their size are compared with the members.  As the members are connected already, pairs within
a group are never looked at, nor is a group's number of pairs ever a number of rows.

The matrix is dealt by leader, very large ones in parts by token; groups with very many sets are opened in
tiles of members.  Sets are 64-bit hashes of shingles, classes 128-bit hashes of sets.  A row without doc_id links
with nothing and has no component; rows that share a doc_id count each by its own text.  Classes are numbered by their
smallest doc_id, and those numbers, not the ids, are the nodes of the links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, binaries, blocks_for, expand, expand_sorted, filled_blocks, free_name, group_arrow, mix, pack_texts, rolling, settle, slices, squeeze, squeeze_sorted, unpack, use, word_hashes
from .components import components

WORDS = 5
PERCENT = 80
#: bytes of text of one unit (a compressed one is no humongous object of the JVM), and tokens of one block of counts
UNIT_BYTES, TOKENS = 1 << 20, 1 << 21
#: rows of the matrix that one call looks at, about, and pairs of a set and a group in one step
ROWS, PAIRS = 1 << 18, 1 << 20
#: heavy leaders that may be broadcast (16 bytes each)
HEAVY = 1 << 20
#: sets of one tile of a group, and of one call that opens groups
TILE = 2048
#: counts are told apart up to here
MOST = 255


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    h = word_hashes([w for own in words for w in own])
    r, out, at = rolling(h, width, 0xD6E8FEB86659FD93), [], 0
    for own in words:
        n = len(own)
        s = np.sort(r[at : at + n - width + 1]) if n >= width else mix(rolling(h[at : at + n], n, 0xA0761D6478BD642F) + np.uint64(n)) if n else h[:0]
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        at += n
    return out


def _text_hash() -> Column:
    """With a doc_id, this names a text of the documents."""
    return F.xxhash64(F.col("text").cast("string"))


def shown(n: int, percent: int = PERCENT) -> int:
    """How many tokens of a set of n, in one order for all sets, hold at least one that any partner shows too."""
    return n - -(-percent * n // 100) + 1


class UnitTokens:
    """The sets of a unit's texts and the distinct values of their tokens' leading `bits`, with the sets that hold each."""

    def __init__(self, texts: list[bytes], width: int, bits: int):
        self.sets = shingle_sets(texts, width)
        digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in self.sets]
        self.d1 = np.array([d >> 64 for d in digest], np.uint64)
        self.d2 = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digest], np.uint64)
        first = {d: k for k, d in reversed(list(enumerate(digest)))}
        self.own = sorted(k for d, k in first.items() if len(self.sets[k]))  # copies count once
        flat = np.concatenate([self.sets[k] for k in self.own]) if self.own else np.zeros(0, np.uint64)
        self.flat, self.values, self.place = flat, *np.unique(flat >> np.uint64(64 - bits), return_inverse=True)


_KINDS = {"kind": "string", "unit": "long", "pos": "int", "doc_id": "long", "th": "long", "n": "long", "d1": "long", "d2": "long", "block": "int", "a": "binary", "b": "binary"}


def _described(docs: DataFrame, width: int, bits: int, n_blocks: int) -> DataFrame:
    """One pass over the texts. Rows of kind 'doc' (a document's set by size and class, and its place), 'unit' (its texts) and 'tokens' (counts of a block)."""
    names = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}

    def rows(kind: str, **cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array([kind] * n) if k == "kind" else pa.array(cols[k], names[t]) if k in cols else pa.nulls(n, names[t]) for k, t in _KINDS.items()], names=list(_KINDS))

    def run(batches):
        from pyspark import TaskContext

        use("jaccard")
        part, k = TaskContext.get().partitionId(), 0
        ids, ths, texts, size = [], [], [], 0

        def flush():
            nonlocal ids, ths, texts, size, k
            unit = (part << 24) + k
            u = UnitTokens(texts, width, bits)
            n = len(ids)
            yield rows("doc", unit=np.full(n, unit), pos=np.arange(n, dtype=np.int32), doc_id=ids, th=ths, n=np.array([len(s) for s in u.sets], np.int64), d1=u.d1.view(np.int64), d2=u.d2.view(np.int64))
            yield rows("unit", unit=[unit], a=[pack_texts(texts)])
            if len(u.values):
                count = np.minimum(np.bincount(u.place), MOST).astype(np.uint8)
                block, at = filled_blocks(u.values, bits, n_blocks)
                yield rows("tokens", unit=np.full(len(block), unit), block=block.astype(np.int32), a=[squeeze_sorted(u.values[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], b=[squeeze(count[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)])
            ids, ths, texts, size, k = [], [], [], 0, k + 1

        for b in (x for y in batches for x in slices(y)):
            for i, t, h in zip(b.column(0).to_pylist(), binaries(b.column(1)), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                ths.append(h)
                texts.append(t)
                size += len(t) + 16
                if size >= UNIT_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select("doc_id", "text", _text_hash().alias("th")).mapInArrow(run, ", ".join(f"{k} {t}" for k, t in _KINDS.items()))


def _merged_counts(key, t: pa.Table) -> pa.RecordBatch:
    """Counts of a block's tokens over all units, up to MOST, back to each unit in the order it sent them."""
    own = [expand_sorted(x, np.uint64) for x in t.column("a").to_pylist()]
    n = np.concatenate([expand(x, np.uint8) for x in t.column("b").to_pylist()])
    values, place = np.unique(np.concatenate(own), return_inverse=True)
    total = np.minimum(np.bincount(place, n, len(values)), MOST).astype(np.uint8)[place]
    at = np.cumsum([0, *map(len, own)])
    return batch(unit=t.column("unit").combine_chunks(), block=pa.array([key[0].as_py()] * len(own), pa.int32()), codes=pa.array([squeeze(total[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()))


def _showing(rows: DataFrame, classes: DataFrame, width: int, bits: int, percent: int) -> DataFrame:
    """node, n, tokens (shown and not alone), body (the set) of each class that shows a token."""
    answers = group_arrow(rows.where("kind = 'tokens'").select("unit", "block", "a", "b"), ["block"], _merged_counts, "unit long, block int, codes binary")
    none = F.lit(None)
    back = answers.select("unit", "block", "codes", none.cast("int").alias("pos"), none.cast("long").alias("node")).unionByName(classes.select("unit", none.cast("int").alias("block"), none.cast("binary").alias("codes"), "pos", "node"))

    def run(key, left, right):
        use("jaccard")
        kinds = right.column("block").to_pylist()
        sent = {b: c for b, c in zip(kinds, right.column("codes").to_pylist(), strict=True) if b is not None}
        node = {p: k for p, k in zip(right.column("pos").to_pylist(), right.column("node").to_pylist(), strict=True) if p is not None}
        out: tuple[list, ...] = ([], [], [], [])
        if left.num_rows and node:
            u = UnitTokens(unpack(left.column("a")[0].as_py()), width, bits)
            code = np.concatenate([expand(sent[b], np.uint8) for b in sorted(sent)])[u.place] if sent else np.zeros(0, np.uint8)
            sizes = [len(u.sets[k]) for k in u.own]
            at = np.cumsum([0, *sizes])
            alone = np.add.reduceat(code == 1, at[:-1], dtype=np.int64) if len(code) else []
            for k, lo, hi, one in zip(u.own, at[:-1], at[1:], alone, strict=True):
                q = shown(hi - lo, percent) - one
                if q > 0 and k in node:
                    c, s = code[lo:hi], u.flat[lo:hi]
                    late = np.flatnonzero(c > 1)
                    late = late[np.argsort(c[late], kind="stable")[:q]]  # equal counts in the order of hashes
                    if len(late):
                        for col, v in zip(out, (node[k], hi - lo, s[late].view(np.int64).tolist(), squeeze_sorted(s)), strict=True):
                            col.append(v)
        return pa.table({"node": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "tokens": pa.array(out[2], pa.list_(pa.int64())), "body": pa.array(out[3], pa.binary())})

    units = rows.where("kind = 'unit'").select("unit", "a")
    return units.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(run, "node long, n long, tokens array<long>, body binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return (100 + percent) * shared >= percent * (len(a) + len(b))


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets link; a very frequent node's rows can be split, as nothing is grouped."""

    def run(batches):
        for x in batches:
            ok = [linked(expand_sorted(p, np.uint64), expand_sorted(q, np.uint64), percent) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            keep = x.filter(pa.array(ok, pa.bool_()))
            yield batch(a=keep.column(0), b=keep.column(1))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long")


def fits(n: Column, low: Column, high: Column, percent: int) -> Column:
    """Whether a set of n can link with one of low to high tokens."""
    return (F.lit(100) * high >= F.lit(percent) * n) & (F.lit(100) * n >= F.lit(percent) * low)


def meetings(token: np.ndarray, node: np.ndarray, n: np.ndarray, group: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (node, group) where the node's set shows a token of the union of a group of a higher number than its own, and the sizes fit.

    The matrix: for each token the groups, in order, with their smallest and largest set among those that show it.
    """
    order = np.lexsort((group, token))
    token, node, n, group = token[order], node[order], n[order], group[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
    cell = np.flatnonzero(new)
    low, high, of = np.minimum.reduceat(n, cell), np.maximum.reduceat(n, cell), group[cell]
    row = np.flatnonzero(np.concatenate([[True], token[cell][1:] != token[cell][:-1]]))
    end = np.repeat(np.append(row[1:], len(cell)), np.diff(row, append=len(cell)))
    own = np.cumsum(new) - 1
    more = end[own] - own - 1  # groups of the token after the set's own
    found: list[np.ndarray] = []
    part = np.cumsum(more) // PAIRS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(more)]
    width = int(group.max()) + 1
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        k = more[lo:hi]
        q = np.repeat(np.arange(lo, hi), k)
        c = own[q] + 1 + np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)
        ok = (100 * high[c] >= percent * n[q]) & (100 * n[q] >= percent * low[c])
        found.append(np.unique(node[q[ok]] * width + of[c[ok]]))
    key = np.unique(np.concatenate(found))
    return key // width, key % width


def _matches(met: DataFrame, percent: int) -> DataFrame:
    """(node, target): sets and the groups that they meet in the token-group matrix. met: leader, token, node, n, root, size (of the group)."""
    blocks = max(1, -(-met.count() // ROWS))
    # fewer than `blocks` leaders have more than ROWS rows
    heavy = met.groupBy("leader").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = met.join(F.broadcast(heavy) if blocks <= HEAVY else heavy, "leader", "left").withColumn("block", F.pmod(F.xxhash64("leader", F.pmod(F.xxhash64("token"), parts)), F.lit(blocks)).cast("int"))

    def run(key, t):
        root, size = t.column("root").to_numpy(), t.column("size").to_numpy()
        roots, at, place = np.unique(root, return_index=True, return_inverse=True)
        order = np.lexsort((roots, size[at]))  # the members of smaller groups ask
        number = np.empty(len(roots), np.int64)
        number[order] = np.arange(len(roots))
        nodes, node = np.unique(t.column("node").to_numpy(), return_inverse=True)
        q, g = meetings(t.column("token").to_numpy(), node, t.column("n").to_numpy(), number[place], percent)
        return batch(node=pa.array(nodes[q]), target=pa.array(roots[order][g]))

    return group_arrow(dealt.select("block", "token", "node", "n", "root", "size"), ["block"], run, "node long, target long").distinct()


def open_group(members: list[np.ndarray], queries: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The numbers of the queries that link with any member. A query whose bound on the group's union is too small isn't compared."""
    flat = np.concatenate(members)
    own = np.repeat(np.arange(len(members)), [len(s) for s in members])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    union, first = np.unique(flat, return_index=True)
    last, size = np.append(first[1:], len(flat)), np.array([len(s) for s in members])
    out = []
    for k, s in enumerate(queries):
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        if 100 * len(at) < percent * len(s):
            continue
        n = last[at] - first[at]
        hits = own[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        shared = np.bincount(hits, minlength=len(members))
        if ((100 + percent) * shared >= percent * (size + len(s))).any():
            out.append(k)
    return out


def _opened(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): of sets that ask for groups, (node, root) where the set links with a member. asked: node, target; sets: node, root, body."""
    targets = asked.select("target").distinct()
    members = sets.join(targets, F.col("root") == F.col("target"), "left_semi")
    tiles = members.groupBy(F.col("root").alias("target")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = members.join(tiles.withColumnRenamed("target", "root"), "root").select(F.col("root").alias("target"), F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), F.lit(True).alias("member"), "node", "body")
    queries = asked.join(tiles, "target").select("target", "node", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")).join(sets.select("node", "body"), "node")
    fed = members.unionByName(queries.select("target", "tile", F.lit(False).alias("member"), "node", "body"))
    calls = max(1, -(-(sets.count() + asked.count()) // TILE))

    def run(key, t):
        target, tile, member = (t.column(c).to_numpy() for c in ("target", "tile", "member"))
        order = np.lexsort((~member, tile, target))
        target, tile, member, node = target[order], tile[order], member[order], t.column("node").to_numpy()[order]
        body = t.column("body").to_pylist()
        edge = np.flatnonzero(np.concatenate([[True], (target[1:] != target[:-1]) | (tile[1:] != tile[:-1])]))
        a, b = [], []
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(node)], strict=True):
            own = [expand_sorted(body[order[k]], np.uint64) for k in range(lo, hi)]
            m = int(member[lo:hi].sum())
            if 0 < m < hi - lo:
                hit = open_group(own[:m], own[m:], percent)
                a += [node[lo + m + k] for k in hit]
                b += [target[lo]] * len(hit)
        return batch(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    dealt = fed.withColumn("call", F.pmod(F.xxhash64("target", "tile"), F.lit(calls)).cast("int"))
    return group_arrow(dealt, ["call"], run, "a long, b long")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Each row's doc_id, th and n_shingles; if it has a class, also the class's node and first text (rep, rep_th), its component's
    smallest node and that node's rep (label)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    about = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # tokens
    n_blocks = blocks_for(about, TOKENS)
    bits = min(64, max(int(math.log2(n_blocks)) + 8, about.bit_length() + 5))
    rows = settle(_described(docs, width, bits, n_blocks))
    meta = rows.where("kind = 'doc'").select("doc_id", "th", "n", "d1", "d2", "unit", "pos")
    named = meta.where("doc_id is not null and n > 0")
    first = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "unit", "pos")).alias("x"))
    # in this order, the smallest node of a component has its smallest doc_id
    classes = settle(first.select("d1", "d2", F.col("x.doc_id").alias("rep"), "x.th", "x.unit", "x.pos").orderBy("rep", "d1", "d2").withColumn("node", F.monotonically_increasing_id()))

    sets = settle(_showing(rows, classes, width, bits, percent))
    posted = sets.select("node", "n", F.explode("tokens").alias("token"))
    leaders = posted.groupBy("token").agg(F.min(F.struct("node", "n")).alias("x"), F.count("*").alias("c")).where("c > 1").select("token", F.col("x.node").alias("leader"), F.col("x.n").alias("leader_n"))
    met = settle(posted.join(leaders, "token"))
    pairs = met.where(F.col("node") != F.col("leader")).where(fits(F.col("n"), F.col("leader_n"), F.col("leader_n"), percent)).groupBy("node", "leader").agg(F.count("*").alias("c"))
    pairs = pairs.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("b")).select(F.col("node").alias("a"), "b")
    comp = components(_linked_pairs(pairs, sets, percent))

    grouped = settle(sets.select("node", "body").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("root"), "body"))
    of = grouped.select("node", "root")
    sizes = of.groupBy("root").agg(F.count("*").alias("size"))
    asked = settle(_matches(met.select("leader", "token", "node", "n").join(of, "node").join(sizes, "root"), percent))
    more = settle(_opened(asked, grouped, percent))
    if not more.isEmpty():
        comp = components(comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    label = classes.select(F.col("node").alias("component"), F.col("rep").alias("label"))
    comp = comp.join(label, "component")
    named = classes.join(comp, "node", "left").select("d1", "d2", "node", "rep", F.col("th").alias("rep_th"), F.coalesce("component", "node").alias("component"), F.coalesce("label", "rep").alias("label"))
    return meta.join(named, ["d1", "d2"], "left").select("doc_id", "th", F.col("n").alias("n_shingles"), "node", "rep", "rep_th", "component", "label")


def similar_documents(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    own = F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return _labelled(docs, width, percent).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all columns, one of each component: that of the smallest doc_id, then of the smallest
    class, text hash and hash of the whole row.

    Rows without doc_id or without words stay.  Rows are told apart by doc_id and text.
    """
    id_, th, gone, n, row = (free_name(docs.columns, x) for x in ("id", "th", "gone", "rows", "row"))
    rows = _labelled(docs, width, percent).where("doc_id is not null and n_shingles > 0")
    marks = rows.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.bool_or(F.expr("component <> node or doc_id <> rep or th <> rep_th")).alias(gone), F.count("*").alias(n))
    marks = settle(marks.where(F.col(gone) | (F.col(n) > 1)))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (_text_hash() == F.col(th))
    once = docs.join(marks, same, "left_anti")
    repeated = marks.where(~F.col(gone))
    if repeated.isEmpty():
        return once
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(repeated, same).groupBy(id_, th).agg(F.min_by(whole, F.sha2(F.to_json(whole).cast("binary"), 256)).alias(row)).select(f"{row}.*")
    return once.unionByName(again)
