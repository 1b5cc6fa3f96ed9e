"""The k best pairs of all, in waves of block pairs under a rising threshold.

Rows (or documents) go to blocks, and each two blocks have an upper bound of what a pair of theirs can score. Block pairs are
taken in the order of their bounds, in waves that grow; after each wave the k-th best score of all is known, tasks of the next
one return only pairs that reach it, and block pairs whose bound is below it are never looked at. The result is exact: with
bounds that say nothing every pair is scored once. Only the block pairs, bounds and k rows are held by the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.operators import pairwise
from fewstep.plans.storage import Scratch

#: Blocks, rows of a block that meet in one task, and directions in which a block's bounds are known, at most. A row is sent
#: to as many tasks as there are pieces, so pieces are large and compared STRIPE rows at once.
BLOCKS, PIECE, DIRECTIONS, STRIPE = 144, 8192, 16, 1000
#: Scores are rounded to six digits; bounds get a bit more room than that.
ROOM = 2e-6


def _waves(bounds: np.ndarray, k: int, find: Callable[[list[tuple[int, int]], float], DataFrame], order: list, scratch: Scratch, log: list | None) -> DataFrame | None:
    """bounds: of each block with each (-inf: no pair). find(block pairs, least score): i, j, score and more of their pairs.

    log: gets (block pairs of the wave, those skipped for good) of each wave.
    """
    x, y = np.nonzero(np.isfinite(bounds))
    ranked = np.lexsort((y, x, -bounds[x, y]))
    at, size, least, best = 0, max(8, len(bounds)), -np.inf, None
    while at < len(ranked):
        wave = ranked[at : at + size]
        wave = wave[bounds[x[wave], y[wave]] >= least - ROOM]
        if not len(wave):  # bounds only fall from here on
            break
        found = find(list(zip(x[wave].tolist(), y[wave].tolist(), strict=True)), float(least))
        best = scratch.stash((found if best is None else best.unionByName(found)).orderBy(*order).limit(k))
        kth = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        least = kth["least"] if kth["n"] == k else -np.inf
        at, size = at + size, 2 * size
        if log is not None:
            log.append((len(wave), int((bounds[x[ranked[at:]], y[ranked[at:]]] < least - ROOM).sum())))
    return best


def _directions(rows: DataFrame) -> np.ndarray:
    """The directions in which the vectors vary most, a column each, from their sums of products."""

    def summed(batches):
        for batch in batches:
            if len(batch):
                v = np.stack(batch["vec"].to_numpy())
                v = np.hstack([v, np.ones((len(v), 1))])
                i, j = np.triu_indices(v.shape[1])
                yield pd.DataFrame({"i": i, "j": j, "x": (v.T @ v)[i, j]})

    found = rows.select("vec").mapInPandas(summed, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    n = max(r["i"] for r in found) + 1
    m = np.zeros((n, n))
    for r in found:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["x"]
    mean = m[:-1, -1] / m[-1, -1]
    return np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))[1][:, ::-1][:, :DIRECTIONS]


def top_pairs(rows: DataFrame, k: int, blocks: int | None = None, log: list | None = None) -> DataFrame:
    """i, j, sim: the k pairs i < j of the largest dot products of all rows (id, vec of unit length); ties by i, then j.

    Blocks are boxes: ranges along the two directions of most variance, with the extent in DIRECTIONS of them. Unit vectors
    whose boxes are a distance apart have a dot product of at most 1 - distance ** 2 / 2.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "waves")
    n = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    if not n:
        return rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("sim")).limit(0)
    axes = _directions(rows)
    shared = spark.sparkContext.broadcast(axes)

    def turned(batches):
        for b in batches:
            if len(b):
                yield b.assign(place=list(np.stack(b["vec"].to_numpy()) @ shared.value))

    placed = scratch.stash(rows.select("id", "vec").mapInPandas(turned, f"id {kind}, vec array<double>, place array<double>"))
    side = max(1, int((blocks or min(BLOCKS, max(1, n // min(PIECE, 1000) * 4))) ** 0.5))
    cuts = [f / side for f in range(1, side)]
    one = placed.withColumn("p", F.col("place")[0]).approxQuantile("p", cuts, 0.001) if cuts else []
    two = placed.withColumn("p", F.element_at("place", F.least(F.lit(2), F.size("place")))).approxQuantile("p", cuts, 0.001) if cuts else []

    def which(value, edges):
        out = F.lit(0)
        for e in edges:
            out = out + F.when(value > e, 1).otherwise(0)
        return out

    block = which(F.col("place")[0], one) * side + which(F.element_at("place", F.least(F.lit(2), F.size("place"))), two)
    placed = scratch.stash(placed.withColumn("block", block))
    dims = axes.shape[1]
    box = placed.groupBy("block").agg(F.count("*").alias("n"), *[F.min(F.col("place")[d]).alias(f"a{d}") for d in range(dims)], *[F.max(F.col("place")[d]).alias(f"b{d}") for d in range(dims)]).orderBy("block").collect()
    low, high = (np.array([[r[f"{s}{d}"] for d in range(dims)] for r in box]) for s in "ab")
    gap = np.maximum(0, np.maximum(low[:, None, :] - high[None, :, :], low[None, :, :] - high[:, None, :]))
    bounds = 1 - (gap * gap).sum(axis=-1) / 2
    bounds[np.tril_indices(len(box), -1)] = -np.inf
    numbers, pieces = [r["block"] for r in box], [-(-r["n"] // PIECE) for r in box]
    parts = F.broadcast(spark.createDataFrame(list(zip(numbers, pieces, strict=True)), "block int, pieces int"))
    placed = placed.select("id", "vec", "block").join(parts, "block").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")).drop("pieces")

    def find(wanted: list[tuple[int, int]], least: float) -> DataFrame:
        each = [(numbers[x], numbers[y], p, q) for x, y in wanted for p in range(pieces[x]) for q in range(pieces[y]) if x != y or p <= q]
        tiles = F.broadcast(spark.createDataFrame(each, "x int, y int, p int, q int"))
        a = placed.join(tiles, (F.col("block") == F.col("x")) & (F.col("piece") == F.col("p"))).withColumn("left", F.lit(True))
        b = placed.join(tiles, (F.col("block") == F.col("y")) & (F.col("piece") == F.col("q"))).withColumn("left", F.lit(False))

        def tile(frame: pd.DataFrame) -> pd.DataFrame:
            left = frame["left"].to_numpy()
            ids, vectors = frame["id"].to_numpy(), np.stack(frame["vec"].to_numpy())
            i, j, u, v = ids[left], ids[~left], vectors[left], vectors[~left]
            same = bool((frame["x"].iloc[0] == frame["y"].iloc[0]) and (frame["p"].iloc[0] == frame["q"].iloc[0]))
            found = pd.DataFrame({"i": i[:0], "j": j[:0], "score": np.empty(0)})
            for at in range(0, len(i), STRIPE):
                part = i[at : at + STRIPE]
                scores = np.round(u[at : at + STRIPE] @ v.T, 6)
                fine = (scores >= least) & (part[:, None] < j[None, :] if same else part[:, None] != j[None, :])
                if k < scores.size and int(fine.sum()) > k:  # those that tie with the k-th stay
                    fine &= scores >= np.partition(scores[fine], -k)[-k]
                x, y = np.nonzero(fine)
                new = pd.DataFrame({"i": np.minimum(part[x], j[y]), "j": np.maximum(part[x], j[y]), "score": scores[x, y]})
                found = pd.concat([found, new]).sort_values(["score", "i", "j"], ascending=[False, True, True]).head(k)
            return found

        return a.unionByName(b).groupBy("x", "y", "p", "q").applyInPandas(tile, f"i {kind}, j {kind}, score double")

    best = _waves(bounds, k, find, [F.desc("score"), "i", "j"], scratch, log)
    return best.select("i", "j", F.col("score").alias("sim"))


def top_documents(lines: DataFrame, k: int, tau: float, log: list | None = None) -> DataFrame:
    """t, s, jaccard_overall: the k pairs t < s of documents of the largest soft Jaccard of their lines, counted from t; ties by t, s.

    Documents of like numbers of lines share a block. At most all of t's lines of a section match, which with n lines in t and m
    in s gives n / m, and the sections' mean is the bound of a pair.
    """
    spark = lines.sparkSession
    scratch = Scratch(spark, "waves")
    count = lambda x: F.count_if(F.col("section") == x)
    sizes = scratch.stash(lines.groupBy("doc").agg(*[count(x).alias(x) for x in pairwise.SECTIONS]))
    n = sizes.count()
    side = max(1, int(min(BLOCKS, n) ** 0.5))
    rank_ = lambda x: F.floor(F.log2(F.col(x) + 1) * 2).cast("int")
    grouped = scratch.stash(sizes.withColumn("group", rank_("ingr") * 256 + rank_("instr") + F.pmod(F.xxhash64("doc"), F.lit(side)).cast("int") * 65536))
    box = grouped.groupBy("group").agg(*[f(F.when(F.col(x) > 0, F.col(x)) if low else F.col(x)).alias(f"{low}{x}") for x in pairwise.SECTIONS for low, f in (("a", F.min), ("", F.max))]).orderBy("group").collect()
    numbers = [r["group"] for r in box]
    bounds = np.zeros((len(box), len(box)))
    for x in pairwise.SECTIONS:
        most, fewest = np.array([r[x] for r in box], dtype=float), np.array([r[f"a{x}"] or np.inf for r in box], dtype=float)
        bounds += most[:, None] / fewest[None, :] / 2
    own = scratch.stash(lines.join(grouped.select("doc", "group"), "doc"))

    def find(wanted: list[tuple[int, int]], least: float) -> DataFrame:
        allowed = spark.createDataFrame([(numbers[x], numbers[y]) for x, y in wanted], "gx int, gy int")
        sums = pairwise.line_sums(own, [tau], among=allowed)
        out = pairwise.line_jaccard(sums, lines).where((F.col("t") < F.col("s")) & (F.col("jaccard_overall") >= least))
        return out.select("t", "s", F.col("jaccard_overall").alias("score"))

    best = _waves(bounds, k, find, [F.desc("score"), "t", "s"], scratch, log)
    return (best if best is not None else find([], -np.inf)).select("t", "s", F.col("score").alias("jaccard_overall"))
