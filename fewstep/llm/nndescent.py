"""Embedding near-dedup by NN-descent.

Vectors of one label are nodes of a neighbour graph. It starts from random projections: in each of
TABLES tables a node is tested with the next ones of its bucket. Then it is refined: every node gathers
its neighbours and those that have it as a neighbour, tests them with each other (neighbours of
neighbours), and each node keeps its LIST nearest. Edges of THRESHOLD or more are the links.

Every two members of a connected group are tested, in blocks of BLOCK rows that return how many links a
node has, so all links inside groups are counted whatever their size, and only links between groups can be missing. A list that is full of links
is saturated, and so is its group. An audit draws vectors by hash, AUDIT outside saturated groups and
AUDIT_FULL inside, and tests them with all vectors. Each drawn vector's share of links found counts
alike, and the two kinds are judged apart, so a hot group can't hide the losses of others. Below RECALL the
graph is refined again with more tables and lists twice as long; if the audit of pass PASSES fails too,
all vectors of a label are tested with each other, in blocks.

Equal vectors of one label are one node, so copies cost nothing and a row per copy comes out. A node's
reverse list is cut to the 2 * LIST nearest while refining; the links between groups that this could
miss are what the audit looks for. Rows are kept sorted by key and streamed, no group of nodes is
gathered but for a node's lists and a block.

Vectors that vectors.usable() leaves out, and rows without a label, have no links: they are their own
component and kept (a null id has a null component). Rows of one id are one vector: their links are
those of all of them. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.llm.graph import components
from fewstep.llm.vectors import cosines, matrix, usable, whole_runs
from fewstep.plans.storage import Scratch
from fewstep.sources.tables import table

THRESHOLD = 0.98
LIST, TABLES, AHEAD, ITERATIONS = 10, 6, 4, 2
#: Rows that a bucket of the first graph has on average, and rows in a block of the last tests.
BUCKET, BLOCK = 64, 2048
AUDIT, AUDIT_FULL, RECALL, PASSES = 4096, 256, 0.995, 3
SEED = 60_013

_EDGES = "u long, v long, cosine double"


def _unit(vs: np.ndarray) -> np.ndarray:
    return vs / np.sqrt((vs * vs).sum(axis=1, keepdims=True))


def _bytes(column) -> np.ndarray:
    column = list(column)
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _edges(u, v, c) -> pd.DataFrame:
    """Each tested pair in both directions."""
    return pd.DataFrame({"u": np.concatenate((u, v)), "v": np.concatenate((v, u)), "cosine": np.concatenate((c, c))})


def _coded(bits: int, seed: int):
    """Rows of t (table), label, code (signs of random projections), at (one more projection), id, vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            vs = _bytes(batch["vector"])
            if planes is None:
                planes = np.random.Generator(np.random.PCG64([SEED, seed])).standard_normal((TABLES, bits + 1, vs.shape[1]))
            for t in range(TABLES):
                dots = _unit(vs) @ planes[t].T
                code = (dots[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vs), np.int64)
                yield pd.DataFrame({"t": t, "label": batch["label"], "code": code, "at": dots[:, bits], "id": batch["id"], "vector": batch["vector"]})

    return run


def _ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tests every row with the AHEAD next ones of its bucket."""
    tail = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
        old = 0 if tail is None else len(tail)
        vs, ids = _bytes(rows["vector"]), rows["id"].to_numpy()
        key = rows[["t", "label", "code"]].to_numpy()
        for k in range(1, AHEAD + 1):
            lo = np.arange(max(0, old - k), len(rows) - k)
            lo = lo[(key[lo] == key[lo + k]).all(axis=1) & (ids[lo] != ids[lo + k])]
            if len(lo):
                yield _edges(ids[lo], ids[lo + k], cosines(vs[lo], vs[lo + k]))
        tail = rows.iloc[-AHEAD:]


def _local(keep: int):
    """Tests a centre's neighbours with each other; keeps for each the nearest few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["w"]):
            centre, ids = rows["w"].to_numpy(), rows["x"].to_numpy()
            vs = _unit(_bytes(rows["vector"]))
            cuts = np.append(np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1]))), len(rows))
            us, xs, cs = [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                near = vs[lo:hi] @ vs[lo:hi].T
                np.fill_diagonal(near, -2)
                most = min(keep, hi - lo - 1)
                best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                us.append(np.repeat(ids[lo:hi], most))
                xs.append(ids[lo:hi][best.ravel()])
                cs.append(cosines(vs[lo:hi][np.repeat(np.arange(hi - lo), most)], vs[lo:hi][best.ravel()]))
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(xs), "cosine": np.concatenate(cs)})

    return run


def _nearest(edges: DataFrame, size: int) -> DataFrame:
    edges = edges.where("u <> v").groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cosine"), "v"))).where(F.col("_n") <= size).drop("_n")


def first_graph(nodes: DataFrame, size: int, seed: int, scratch: Scratch) -> DataFrame:
    """nodes: id, label, vector (binary). u, v, cosine: each node's nearest found by projections."""
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(0, min(40, int(np.ceil(np.log2(max(1, largest / BUCKET))))))
    coded = nodes.select("id", "label", "vector").mapInPandas(_coded(bits, seed), "t int, label long, code long, at double, id long, vector binary")
    sorted_ = coded.repartition("t", "label", "code").sortWithinPartitions("t", "label", "code", "at", "id")
    return scratch.stash(_nearest(sorted_.mapInPandas(_ahead, _EDGES), size))


def refine(graph: DataFrame, nodes: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """One step of NN-descent."""
    there = graph.select(F.col("u").alias("w"), F.col("v").alias("x"))
    back = graph.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cosine"), "u"))).where(F.col("_n") <= 2 * size)
    around = there.unionByName(back.select(F.col("v").alias("w"), F.col("u").alias("x"))).distinct()
    around = around.join(nodes.select(F.col("id").alias("x"), "vector"), "x").select("w", "x", "vector")
    tested = around.repartition("w").sortWithinPartitions("w").mapInPandas(_local(max(3, size // 3)), _EDGES)
    return scratch.stash(_nearest(graph.unionByName(tested), size))


def _connecting(near: np.ndarray) -> list[tuple[int, int]]:
    """Some of the links (row, column), at most one for each row and column, that connect what all of them connect."""
    group, kept = np.arange(near.shape[1]), []
    for r in np.flatnonzero(near.any(axis=1)):
        columns = np.flatnonzero(near[r])
        met, at = np.unique(group[columns], return_index=True)
        kept += [(r, columns[k]) for k in at]
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
    return kept


def _links(threshold: float):
    """Tests the rows of block i with those of block j of one group: u, u, copies that u is linked with; and u, v, 0 of the links that connect them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, ["component", "i", "j"]):
            for (_, i, j), group in rows.groupby(["component", "i", "j"], sort=False):
                a = group[group["own"] == i]
                b = a if i == j else group[group["own"] == j]
                if not len(a) or not len(b):
                    continue
                ia, ib, ca, cb = a["id"].to_numpy(), b["id"].to_numpy(), a["copies"].to_numpy(), b["copies"].to_numpy()
                va, vb = _bytes(a["vector"]), _bytes(b["vector"])
                dots = _unit(va) @ _unit(vb).T
                near = dots >= threshold
                x, y = np.nonzero(np.abs(dots - threshold) < 1e-9)  # the product's rounding could decide
                near[x, y] = cosines(va[x], vb[y]) >= threshold
                near &= ia[:, None] != ib[None, :]
                counts = [(ia, near @ cb)] if i == j else [(ia, near @ cb), (ib, near.T @ ca)]
                for ids, n in counts:
                    yield pd.DataFrame({"u": ids[n > 0], "v": ids[n > 0], "n": n[n > 0]})
                kept = np.array(_connecting(near), dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame({"u": ia[kept[:, 0]], "v": ib[kept[:, 1]], "n": 0})

    return run


def saturated(graph: DataFrame, groups: DataFrame, size: int, threshold: float) -> DataFrame:
    """component of the groups that have a node whose list is full of links."""
    full = graph.where(F.col("cosine") >= threshold).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= size)
    return groups.join(full.select(F.col("u").alias("id")), "id").select("component").distinct()


def inner_links(groups: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """What _links() finds inside the components of groups (id, component): a row for a node and block, and few links. nodes: id, vector, copies."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = groups.select("id", "component").join(nodes.select("id", "vector", "copies"), "id").join(sizes, "component")
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.withColumn("_other", other).select("component", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "id", "vector", "copies")
    paired = paired.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return scratch.stash(paired.mapInPandas(_links(threshold), "u long, v long, n long"))


def audit(nodes: DataFrame, groups: DataFrame, wide: DataFrame, threshold: float) -> float:
    """The mean share of a drawn node's links that lie inside the groups: the lower one of the nodes outside and inside the wide groups."""
    inside = groups.join(wide, "component").select("id")
    return min(
        _found(nodes, nodes.join(inside, "id", "left_anti"), AUDIT, groups, threshold),
        _found(nodes, nodes.join(inside, "id", "left_semi"), AUDIT_FULL, groups, threshold),
    )


def _found(nodes: DataFrame, some: DataFrame, n: int, groups: DataFrame, threshold: float) -> float:
    """The mean share, over n nodes drawn from some, of a node's links that lie inside the groups."""
    drawn = some.select("id", "label", "vector").orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(n).collect()
    if not drawn:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in drawn]), np.array([r["label"] for r in drawn]), _bytes([bytes(r["vector"]) for r in drawn])))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, vs = shared.value
        vs = _unit(vs).T
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                near = _unit(_bytes(part["vector"])) @ vs >= threshold + 1e-9  # links whatever the rounding
                near &= (part["label"].to_numpy()[:, None] == labels[None, :]) & (part["id"].to_numpy()[:, None] != ids[None, :])
                x, y = np.nonzero(near)
                yield pd.DataFrame({"u": part["id"].to_numpy()[x], "v": ids[y]})

    true = nodes.mapInPandas(test, "u long, v long")
    side = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias("in_" + c))
    both = true.join(side("u"), "u", "left").join(side("v"), "v", "left")
    by_node = both.groupBy("v").agg((F.count_if(F.col("in_u") == F.col("in_v")) / F.count("*")).alias("share"))
    return by_node.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors: id, label, vector. id, n_links, component_id for each row."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nndescent")
    rows = usable(vectors.where("id IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("long")), "id", "vector")
    keyed = scratch.stash(rows.select("id", "label", "vector", F.xxhash64("vector").alias("h0"), F.xxhash64(F.lit(1), "vector").alias("h1")).dropDuplicates(["id", "label", "h0", "h1"]))
    key = ["label", "h0", "h1"]
    classes = scratch.stash(keyed.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "vector": [v.tobytes() for v in matrix(batch["vector"])]})

    reps = keyed.join(classes.select(*key, F.col("rep").alias("id")), [*key, "id"], "left_semi")
    nodes = reps.select("id", "label", "vector").mapInPandas(packed, "id long, label long, vector binary")
    nodes = scratch.stash(nodes.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum("copies").alias("copies")), "id"))
    graph, size = None, LIST
    for turn in range(PASSES):
        start = first_graph(nodes, size, turn, scratch)
        graph = start if graph is None else scratch.stash(_nearest(graph.unionByName(start), size))
        for _ in range(ITERATIONS):
            new = refine(graph, nodes, size, scratch)
            scratch.drop(graph)
            graph = new
        linked = graph.where(F.col("cosine") >= threshold)
        groups = scratch.stash(components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")), scratch))
        wide = scratch.stash(saturated(graph, groups, size, threshold))
        if audit(nodes, groups, wide, threshold) >= RECALL:
            more = inner_links(groups, nodes, threshold, scratch)
            break
        size *= 2
    else:
        more = inner_links(nodes.select("id", F.col("label").alias("component")), nodes, threshold, scratch)
        groups = scratch.stash(components(more.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")), scratch))
    by_node = more.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    per_class = classes.join(by_node, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = per_class.select(*key, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    by_id = keyed.select("id", *key).join(per_class, key).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("id").join(by_id, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op8_embedding_duplicates(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("vector"))
    found = near_duplicates(rows)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
