"""The k best by a weighted sum of two similarities, from two ranked lists read only as deep as they must be.

Both spaces have an index that lists a target's nearest rows. Lists are read to a depth; every row seen in either is
scored in both spaces, and a row not seen has at most the weighted sum of the last scores of the lists. A target whose
k-th score is above that is done. The others are compared with all rows in both spaces at once, as matrix products of blocks:
where lists bound little, as with vectors without groups, deeper ones would hold most of the rows. Whether they do is tried with
TRIED targets; if most of these stay open, all others are compared so at once. The result is exact either way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.functions.vectors import dot
from fewstep.operators.cells import ROOM, Index, search
from fewstep.operators.retrieve import BLOCK_ROWS, best_of_blocks, crossed, crossed_sides, rows_of, top_k
from fewstep.plans.storage import Scratch

#: Targets whose lists show whether lists bound anything.
TRIED = 1024


def hybrid_top(one: Index, other: Index, k: int, w: float = 0.6, depth: int | None = None, targets: DataFrame | None = None, seen: list | None = None) -> DataFrame:
    """t, s, score, rank: the k rows of the largest w * first + (1 - w) * second dot product, exact; ties by id.

    targets: id; all rows of both spaces without them. seen: gets (targets, pairs scored) of each round.
    """
    if not 0 <= w <= 1:
        raise ValueError("w must be 0 to 1, or the lists bound nothing")
    spark = one.vectors.sparkSession
    scratch, depth = Scratch(spark, "hybrid"), depth or 2 * k
    both = scratch.stash(one.vectors.select("id", F.col("vec").alias("a")).join(other.vectors.select("id", F.col("vec").alias("b")), "id"))
    open_ = both.select("id") if targets is None else targets.select("id").distinct().join(both.select("id"), "id")
    open_ = scratch.stash(open_)
    total, done, late = open_.count(), [], []
    tried = scratch.stash(open_.orderBy(F.xxhash64("id"), "id").limit(TRIED)) if total > TRIED else open_
    rest = open_.join(tried, "id", "left_anti")
    for asks, n in ((tried, min(total, TRIED)), (rest, total - min(total, TRIED))):
        if not n:
            continue
        if late and 2 * late[0][1] > TRIED:  # lists bound little here
            late.append((asks, n))
            continue
        pairs, scored, left = _by_lists(asks, one, other, both, k, w, depth, scratch)
        if seen is not None:
            seen.append((n, pairs))
        done.append(scored.join(left.withColumnRenamed("id", "t"), "t", "left_anti"))
        late.append((left, left.count()))
    if n := sum(m for _, m in late):
        asks = late[0][0] if len(late) == 1 else late[0][0].unionByName(late[1][0])
        done.append(_compared(both.join(asks, "id"), both, k, w))
        if seen is not None:
            seen.append((n, n * both.count()))
    out = done[0] if done else top_k(both.select(F.col("id").alias("t"), F.col("id").alias("s"), F.lit(0.0).alias("score")).limit(0), k)
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _by_lists(asks: DataFrame, one: Index, other: Index, both: DataFrame, k: int, w: float, depth: int, scratch: Scratch) -> tuple[int, DataFrame, DataFrame]:
    """How many pairs the lists of asks (id) hold, their k best for each (t, s, score, rank), and the ids for which an unseen row may be better."""
    lists = []
    for index, weight in ((one, w), (other, 1 - w)):
        found = search(index.vectors.join(asks, "id"), index, depth).withColumn("part", F.col("score") * weight)
        lists.append(scratch.stash(found.select("t", "s", "rank", "part")))
    pairs = lists[0].select("t", "s").unionByName(lists[1].select("t", "s")).distinct()
    t, s = both.select(F.col("id").alias("t"), F.col("a").alias("_ta"), F.col("b").alias("_tb")), both.select(F.col("id").alias("s"), F.col("a").alias("_sa"), F.col("b").alias("_sb"))
    near = F.round(F.round(dot(F.col("_ta"), F.col("_sa")), 6) * w + F.round(dot(F.col("_tb"), F.col("_sb")), 6) * (1 - w), 6)
    scored = scratch.stash(top_k(pairs.join(t, "t").join(s, "s").select("t", "s", near.alias("score")), k))
    ends = lists[0].where(F.col("rank") == depth).select("t", "part").unionByName(lists[1].where(F.col("rank") == depth).select("t", "part"))
    bounds = ends.groupBy("t").agg(F.sum("part").alias("bound"), F.count("*").alias("n")).where("n = 2")  # a list that ended has shown every row
    kth = scored.where(F.col("rank") == k).select("t", F.col("score").alias("kth"))
    left = bounds.join(kth, "t", "left").where(F.col("kth").isNull() | (F.col("kth") <= F.col("bound") + ROOM)).select(F.col("t").alias("id"))
    return pairs.count(), scored, scratch.stash(left)


def _compared(asks: DataFrame, both: DataFrame, k: int, w: float) -> DataFrame:
    """t, s, score, rank of asks among both (id, a, b), by blocks of them that meet in a task."""

    def exact(x: list, y: list, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        one, other = (np.round(np.einsum("ij,ij->i", x[c][m], y[c][n]), 6) for c in (1, 2))
        return np.round(one * w + other * (1 - w), 6)

    def best(batches):
        if sides := crossed_sides(batches):
            x, y = ([z["id"].to_numpy(), rows_of(z["a"]), rows_of(z["b"])] for z in sides)
            like = (lambda z: np.hstack((z[1] * w, z[2] * (1 - w))), lambda z: np.hstack(z[1:]))
            for found in best_of_blocks(x, y, k, BLOCK_ROWS, exact, like, both=False):
                yield found.found()

    return top_k(crossed(asks, both).mapInArrow(best, "t long, s long, score double"), k)
