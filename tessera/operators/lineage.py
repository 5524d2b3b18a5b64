"""Lineage of pools: an append-only table of events, folded to the pool as it stood after any round.

An event is one proposal of a cell: cell, round, seq (its order in the cell), factor, admitted, replaced (the factor
that left for it, or null).  A factor is in the pool from an admission to the next event that replaces it, so
its stays are intervals that a window finds; no pool is replayed event by event, and cells need not fit anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def admissions(events: DataFrame) -> DataFrame:
    """The admitted events with the pool's version after each, counted from 1 in the cell."""
    version = F.row_number().over(W.partitionBy("cell").orderBy("seq"))
    return events.where("admitted").withColumn("version", version)


def stays(events: DataFrame) -> DataFrame:
    """cell, factor, seq and round of its admission, and seq and round of the event that replaced it (null: it is still there)."""
    came = events.where("admitted").select("cell", "factor", "seq", "round", F.lit(True).alias("came"))
    left = events.where(F.col("admitted") & F.col("replaced").isNotNull()).select("cell", F.col("replaced").alias("factor"), "seq", "round", F.lit(False).alias("came"))
    after = W.partitionBy("cell", "factor").orderBy("seq", F.col("came").cast("int"))
    moves = came.unionByName(left).withColumns({"_came": F.lead("came").over(after), "_seq": F.lead("seq").over(after), "_round": F.lead("round").over(after)})
    gone = ~F.coalesce("_came", F.lit(True))
    return moves.where("came").select("cell", "factor", F.col("seq").alias("seq_in"), F.col("round").alias("round_in"), F.when(gone, F.col("_seq")).alias("seq_out"), F.when(gone, F.col("_round")).alias("round_out"))


def faults(events: DataFrame) -> DataFrame:
    """Events that can't have been: a factor admitted while it is in the pool, or one replaced that is not."""
    came = events.where("admitted").select("cell", "factor", "seq", F.lit(1).alias("move"))
    left = events.where(F.col("admitted") & F.col("replaced").isNotNull()).select("cell", F.col("replaced").alias("factor"), "seq", F.lit(-1).alias("move"))
    order = W.partitionBy("cell", "factor").orderBy("seq", "move")
    moves = came.unionByName(left).withColumn("_before", F.lag("move", 1, -1).over(order))
    reason = F.when(F.col("move") == 1, "admitted_twice").otherwise("replaced_absent")
    return moves.where(F.col("_before") == F.col("move")).select("cell", "factor", "seq", reason.alias("reason"))


def pools(events: DataFrame) -> DataFrame:
    """cell, round, factor: the pool after each round of the cell that has events; as many rows as pools have factors."""
    rounds = events.groupBy("cell").agg(F.array_sort(F.collect_set("round")).alias("rounds"))
    held = stays(events).join(rounds, "cell")
    inside = F.filter("rounds", lambda r: (r >= F.col("round_in")) & (F.col("round_out").isNull() | (r < F.col("round_out"))))
    return held.select("cell", F.explode(inside).alias("round"), "factor")


def snapshots(events: DataFrame) -> DataFrame:
    """cell, round, version, size and hash of the pool after each round; an empty pool has no row in pools() but has one here."""
    so_far = events.groupBy("cell", "round").agg(F.count_if("admitted").alias("_n"))
    so_far = so_far.withColumn("version", F.sum("_n").over(W.partitionBy("cell").orderBy("round"))).drop("_n")
    held = pools(events).groupBy("cell", "round").agg(F.count("*").alias("size"), F.concat_ws("|", F.array_sort(F.collect_list(F.col("factor").cast("string")))).alias("names"))
    out = so_far.join(held, ["cell", "round"], "left")
    return out.select("cell", "round", "version", F.coalesce("size", F.lit(0)).alias("size"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("hash"))


def final_lineage(events: DataFrame) -> DataFrame:
    """The last pool of each cell: factor, the admission that it stands on with its version, and the round."""
    last = stays(events).where(F.col("seq_out").isNull())
    own = admissions(events).select("cell", F.col("seq").alias("seq_in"), "version")
    return last.join(own, ["cell", "seq_in"]).select("cell", "factor", "seq_in", F.col("round_in").alias("round"), "version")


# --- pools of an exact size -------------------------------------------------------------------


def of_exact_size(pools_seen: DataFrame, size: int, objective: str, valid: Column, key: str = "cell") -> DataFrame:
    """Of each cell's snapshots with exactly `size` factors and valid support, the best objective; equal ones by the earlier version.

    Snapshots with the same hash count once, as first seen.
    """
    first = pools_seen.withColumn("_n", F.row_number().over(W.partitionBy(key, "hash").orderBy("version"))).where("_n = 1")
    usable = first.where((F.col("size") == size) & valid & F.col(objective).isNotNull() & ~F.isnan(objective))
    best = W.partitionBy(key).orderBy(F.desc(objective), "version")
    return usable.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
