"""Connected components of a link table, by alternating large-star and small-star steps.

Each step replaces a vertex's links by links to its smallest neighbour, so that the links become stars
around the smallest vertex of each component. The steps are joins and minima by key: minima combine
before the shuffle, and a vertex with very many links is a skewed join key that AQE splits. No list of
neighbours is ever gathered. Each step's links are written, so lineage stays short.

Up to ONE_TASK links are instead joined by union-find in one task, whose memory that number bounds; the
result is the same, without the steps' fixed costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.plans.storage import Scratch


ONE_TASK = 500_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    yield pd.DataFrame({"id": list(parent), "component": [root(x) for x in parent]}, dtype="int64")


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()


def components(links: DataFrame, scratch: Scratch, rows: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """links: a, b (long), about rows of them if that is known. Returns id and component, its smallest reachable id, for every linked id."""
    old = scratch.stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows)
    mark = _mark(old)
    if mark[0] <= one_task:
        return old.coalesce(1).mapInPandas(_union_find, "id long, component long")
    while mark[0]:
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.stash(large, mark[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), mark[0])
        scratch.drop(old, large)
        old, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return old.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(old.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
