"""Components of a similarity join, without expanding groups of copies into pairs.

Nodes that share a key are candidates. In a group of g copies every pair is a candidate, so testing all
pairs would cost g * g. Only the components are wanted, and a pair inside a component need not be tested:

1. In rounds every key names a centre by hash, and every node is tested with the nearest centre of its
   keys that it is neither connected nor tested with: at most one test per node and round. The rounds go
   on while one links more than a FEW-th of the nodes, ROUNDS at most.
2. After that each key's largest component is left alone, and the nodes outside it (the
   stragglers) are tested with all nodes of the key in other components: by a join, or by what the
   caller gives as finish, which may do it in blocks where too many pairs are near but not linked.

So every candidate pair is tested, or connected by tested links: no link between components is lost.
Hot keys are handled by aggregates that combine before the shuffle and by joins that AQE can split.

family_blocks() is such a finish: keys that share a node are a family, a family is cut into blocks of
bounded rows and bytes, every two blocks meet in a task, and only links come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.llm.graph import components
from fewstep.llm.vectors import whole_runs
from fewstep.plans.storage import Scratch

ROUNDS, FEW = 8, 200
#: Nodes in a block of a family, and bytes (about; one node may have more).
FAMILY, FAMILY_BYTES = 4096, 16 << 20
#: Blocks of a family up to which they may be smaller, to spread work of few bytes.
SPREAD = 16


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, id) whose key has two ids or more."""
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(many, "key")


def family_blocks(live: DataFrame, columns: list[str], payload: DataFrame, size: str, links: Callable[[pd.DataFrame, pd.DataFrame, bool], list[tuple[int, int]]], scratch: Scratch, most: int = FAMILY, most_bytes: int = FAMILY_BYTES) -> DataFrame:
    """All links (a, b) between different components of a key, and of its family.

    live: key, id, component and columns; payload: id and what else links() needs; size: the bytes of a
    node's payload. links(x, y, same): the links between the rows of two blocks, or within one. most, most_bytes: nodes
    and bytes in a block, while a family has no more than SPREAD blocks of that size (every node is sent to all blocks
    of its family); beyond, FAMILY and FAMILY_BYTES are the bounds.
    """

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["family", "i", "j"]):
            for (_, i, j), group in rows.groupby(["family", "i", "j"], sort=False):
                x = group[group["own"] == i]
                y = x if i == j else group[group["own"] == j]
                if not len(x) or not len(y) or (x["component"].nunique() == 1 and set(x["component"]) == set(y["component"])):
                    continue
                yield pd.DataFrame(links(x, y, i == j), columns=["a", "b"], dtype="int64")

    same = live.join(live.groupBy("key").agg(F.min("id").alias("low")), "key").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    family = components(same, scratch).withColumnRenamed("component", "family")
    nodes = live.select("id", "component", *columns).distinct().join(family, "id")
    fine = F.least(F.lit(SPREAD), F.greatest(F.count("*") / most, F.sum(size) / most_bytes))
    many = F.greatest(fine, F.count("*") / FAMILY, F.sum(size) / FAMILY_BYTES)
    sizes = nodes.groupBy("family").agg(F.ceil(many).cast("int").alias("blocks"))
    nodes = nodes.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(payload, "id")
    nodes = nodes.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    nodes = nodes.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other", "blocks")
    # a number of its own: AQE would put the blocks of many families, small in bytes but long in work, into one task
    tasks = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartition(tasks, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return placed.mapInPandas(tested, "a long, b long").distinct()


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "key" else prefix + c) for c in df.columns])


def linked_components(members: DataFrame, close: Callable[[str, str], F.Column], distance: Callable[[str, str], F.Column], verify: Callable[[DataFrame], DataFrame], scratch: Scratch, rounds: int = ROUNDS, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """members: key, id and what close() needs, rows of shared keys only.

    close(p, q): whether the nodes whose columns have the prefixes p and q may be linked; distance(p, q):
    how far they seem to be apart.
    verify(pairs): those rows of pairs (a, b) that are links. finish(live): all links (a, b) between nodes
    of one key and different components; live has the rows of members of all keys with two components or
    more, and their component. Returns components()'s table.
    """
    spark = members.sparkSession
    nodes, rows = members.agg(F.count_distinct("id"), F.count("*")).first()
    links = tested = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "id long, component long")

    def pair(x: str, y: str) -> list[F.Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    k, last = 0, rounds == 0
    while True:
        live = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if not last:
            centre = F.min_by(F.struct(*live.columns), F.xxhash64(F.lit(k), "key", "id"))
            centres = live.groupBy("key").agg(centre.alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            centres = centres.select("key", *[F.col("c." + c).alias("c_" + c) for c in live.columns if c != "key"])
            near = _side(live, "m_").join(centres, "key").where(F.col("m_component") != F.col("c_component"))
            near = near.where(close("m_", "c_")).select("m_id", *pair("m_id", "c_id"), distance("m_", "c_").alias("far"))
            near = near.join(tested, ["a", "b"], "left_anti")
            pairs = near.groupBy("m_id").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        else:
            sizes = live.groupBy("key", "component").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.component").alias("main"))
            live = scratch.stash(live.join(main, "key"), rows)
            if finish is not None:
                new = scratch.stash(finish(live.drop("main")), nodes)
                return scratch.stash(components(links.unionByName(new), scratch, nodes), nodes) if not new.isEmpty() else found
            out = _side(live.where("component <> main").drop("main"), "s_")
            near = out.join(_side(live, "m_"), "key").where((F.col("s_component") != F.col("m_component")) & ((F.col("m_component") == F.col("m_main")) | (F.col("m_id") < F.col("s_id"))))
            pairs = near.where(close("s_", "m_")).select(*pair("s_id", "m_id")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = scratch.stash(pairs, nodes)
        new = scratch.stash(verify(pairs), nodes)
        tested, links = tested.unionByName(pairs), links.unionByName(new)
        n = new.count()
        if n:
            before, found = found, scratch.stash(components(links, scratch, nodes), nodes)
            scratch.drop(before)
        if last:
            return found
        k, last = k + 1, k + 1 >= rounds or n * FEW <= nodes
