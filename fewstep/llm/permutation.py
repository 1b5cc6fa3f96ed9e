"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of PIVOTS pivots from nearest to farthest. The index keeps each
row's vector and the place of every pivot in its order. A block of ROWS rows is held as inverted files:
for each pivot, the places it takes in the rows of the block. A query goes through the files of its
pivots, nearest first, and adds up the differences of places: the footrule distance between the orders.
The rows of smallest footrule are reranked by exact cosine, FIRST of them at a time, until a round adds
nothing to the query's best k of the block; rows of equal footrule come by id, however many they are. So a query in a dense group looks at more rows, and no fixed
cap cuts it off. The blocks' bests are merged by score.

Pivots are a bounded sample: the PIVOTS distinct vectors of smallest hash. Every row is indexed. Queries
are dealt into blocks of CHUNK, and every block of queries meets every block of rows in a task. Both kinds of
blocks are named by the ids' hashes, so the result doesn't depend on partitions or batches, and only the
pivots reach the driver. recall() measures against brute force.

Posting a row under its nearest pivots only would let a query skip rows, but the neighbours of vectors
without clusters are lost by that: the README has the figures.

Vectors that vectors.usable() leaves out take no part. Copies tie in score; ties go to the smaller id.
Rows of equal id and vector count once as candidates; a row is no candidate of queries with its own id.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.llm.vectors import cosines, matrix, usable, whole_runs
from fewstep.plans.storage import Scratch
from fewstep.sources.tables import table

PIVOTS = 128  # at most 256: a place is one byte
FIRST = 256
#: Rows and queries that a block has on average.
ROWS, CHUNK = 16_384, 2048
NEAREST = 5


def pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """The pivots, normed: n distinct vectors, those of smallest hash."""
    rows = vectors.select("id", F.xxhash64("vector").alias("h")).groupBy("h").agg(F.min("id").alias("id")).orderBy("h").limit(n)
    found = rows.join(vectors, "id").select("h", "vector").dropDuplicates(["h"]).orderBy("h").limit(n).collect()
    if not found:
        return np.empty((0, 0))
    out = np.array([r["vector"] for r in found], dtype=np.float64)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def places(vectors: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """For each vector, the place (from 0) of every pivot in its order of nearness; ties by pivot."""
    order = np.argsort(-np.round(vectors @ pivot.T, 12), axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return out


def index(vectors: DataFrame, pivot: np.ndarray, scratch: Scratch) -> DataFrame:
    """id, vector (doubles, binary), places (a byte per pivot): a row for every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivot)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vs = matrix(batch["vector"])
                yield pd.DataFrame({"id": batch["id"], "vector": [v.tobytes() for v in vs], "places": [p.tobytes() for p in places(vs, shared.value)]})

    return scratch.stash(vectors.dropDuplicates(["id", "vector"]).mapInPandas(rows, "id long, vector binary, places binary"))


def _search(k: int):
    """query_id, vec_id, score: the best k of a block of rows for each query of a block of queries."""

    def nearest(ids, vs, files, query, vector, place) -> list[tuple[float, int]]:
        n = len(ids)
        footrule = np.zeros(n, dtype=np.int32)
        for p in np.argsort(place):
            footrule += np.abs(files[p] - np.int16(place[p]))
        footrule[ids == query] = np.iinfo(np.int32).max
        usable_rows = int((ids != query).sum())
        best: list[tuple[float, int]] = []
        seen, order, sorted_to = 0, None, 0
        while seen < usable_rows:
            upto = min(usable_rows, seen + FIRST)
            if upto > sorted_to:
                sorted_to = min(n, max(2 * FIRST, 4 * sorted_to))
                # with all rows tied with the last one, so that the ids decide between them
                part = np.flatnonzero(footrule <= np.partition(footrule, sorted_to - 1)[sorted_to - 1])
                order, sorted_to = part[np.lexsort((ids[part], footrule[part]))], len(part)
            rows = order[seen:upto]
            scores = cosines(vs[rows], vector)
            top = np.lexsort((ids[rows], -scores))[:k]
            merged = sorted(best + [(-float(scores[t]), int(ids[rows[t]])) for t in top])[:k]
            seen = upto
            if merged == best:
                break
            best = merged
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_runs(batches, ["rb", "qb"]):
            for _, group in groups.groupby(["rb", "qb"], sort=False):
                rows, asked = group[~group["asks"]], group[group["asks"]]
                if not len(rows) or not len(asked):
                    continue
                ids = rows["id"].to_numpy()
                vs = np.frombuffer(b"".join(rows["vector"]), dtype=np.float64).reshape(len(rows), -1)
                files = np.ascontiguousarray(np.frombuffer(b"".join(rows["places"]), dtype=np.uint8).reshape(len(rows), -1).T.astype(np.int16))
                found = []
                for query, vector, place in zip(asked["id"].tolist(), asked["vector"], asked["places"], strict=True):
                    best = nearest(ids, vs, files, query, np.frombuffer(vector, dtype=np.float64), np.frombuffer(place, dtype=np.uint8))
                    found += [(query, i, -s) for s, i in best]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """vectors, queries: id, vector, as usable() gives them. query_id, rank, vec_id, score.

    Of queries of one id the least vector (by its components in order) asks; of rows of one id the nearest one counts.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "permutation")
    pivot = pivots(vectors)
    if not len(pivot):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = index(vectors, pivot, scratch)
    asked = index(queries.groupBy("id").agg(F.min("vector").alias("vector")), pivot, scratch)
    row_blocks, query_blocks = (max(1, -(-t.count() // n)) for t, n in ((indexed, ROWS), (asked, CHUNK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rest = ["id", "vector", "places"]
    rows = indexed.select(block(row_blocks).alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("asks"), *rest)
    rows = rows.unionByName(asked.select(every(row_blocks).alias("rb"), block(query_blocks).alias("qb"), F.lit(True).alias("asks"), *rest))
    placed = rows.repartition("rb", "qb").sortWithinPartitions("rb", "qb", "asks", "id")
    out = placed.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the rows of exact (query_id, vec_id) that found has."""
    total = exact.count()
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    vectors = Scratch(spark, "op9").stash(usable(rows, "id", "vector"))
    return search(vectors, vectors.where("id % 50 = 0"))
