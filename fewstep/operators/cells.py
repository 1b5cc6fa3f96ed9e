"""An index of unit vectors by cells and product codes, and searches in it.

The space is cut into cells by centres (k-means, run on Spark). A row is posted under the cell of its nearest centre with
a code: what is left of it without the centre is cut into parts, each replaced by the nearest entry of its codebook.
The posting also holds the length of the error that this makes, so each dot product is known up to that length from the
code alone: a byte per part, where the vector has eight for each component.

A search that is not certified looks up the codes in the cells nearest to a query by one table of dot products per part, and
reads whole vectors of the few best rows only; audit() measures the recall. certified: all cells and rows that could still hold
one of the k nearest, by radius and error, are looked at, so the result is exact.

Cells and queries are cut into pieces of bounded size, so neither a full cell nor a frequent one is one task. Only
centres, radii and codebooks are collected and broadcast; the parameters bound them. Training reads a bounded sample by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewstep.functions.vectors import dot
from fewstep.operators.retrieve import Best, crossed, crossed_sides, rows_of, top_k
from fewstep.plans.storage import Scratch

#: Rows that centres and codebooks are learned from, at most.
SAMPLE = 1 << 17
#: Cells, parts of a vector, entries of a part's codebook (a byte each), and rounds of k-means, at most.
CELLS, PARTS, CODES, ROUNDS = 4096, 32, 256, 4
#: Rows of a cell, and queries, that meet in one task.
PIECE = 4096
#: Scores are rounded to six digits; bounds get a bit more room than that.
ROOM = 2e-6
_WHOLE = float(1 << 30)
#: Pairs of a query and a cell, or a row, that a task looks at at once; and queries that look at cells together.
ASKED, TILE = 1 << 17, 512


@dataclass
class Model:
    """centres: a row per cell. books: of each part, a row per code. edges: where the parts begin, and the dimension."""

    centres: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centres)

    def code(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Of each part: each query's dot product with each entry of the codebook."""
        return [queries[:, a:b] @ book.T for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]


@dataclass
class Index:
    """postings: cell, id, code, error. cells: cell, n, radius. vectors: id, vec, as they were given."""

    model: Model
    postings: DataFrame
    cells: DataFrame
    vectors: DataFrame


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (rows @ centres.T)).argmin(axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _means(rows: DataFrame, start: list[np.ndarray], edges: list[int], rounds: int) -> list[np.ndarray]:
    """k-means of each part of vec: every round a task sums up its rows per part and centre, and the sums meet in one row each.

    Sums are of whole numbers, so the centres do not depend on how the rows are dealt. A centre without rows stays.
    """
    centres = start
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def summed(batches, shared=shared):
            sums = [np.zeros((len(c), c.shape[1] + 1), dtype=np.int64) for c in shared.value]
            for batch in batches:
                if len(batch):
                    vectors = _matrix(batch["vec"])
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        part = np.rint(vectors[:, a:b] * _WHOLE).astype(np.int64)
                        np.add.at(sums[k], _nearest(vectors[:, a:b], shared.value[k]), np.hstack([part, np.ones((len(part), 1), np.int64)]))
            for k, total in enumerate(sums):
                code, at = np.nonzero(total)
                yield pd.DataFrame({"part": k, "code": code, "at": at, "x": total[code, at]})

        found = rows.select("vec").mapInPandas(summed, "part int, code int, at int, x long")
        new = [np.zeros((len(c), c.shape[1] + 1)) for c in centres]
        for part, code, at, x in found.groupBy("part", "code", "at").agg(F.sum("x").alias("x")).collect():  # a row per number of a centre
            new[part][code, at] = x
        new = [np.where(x[:, -1:] > 0, x[:, :-1] / _WHOLE / np.maximum(x[:, -1:], 1), c) for x, c in zip(new, centres, strict=True)]
        shared.unpersist()
        if all(np.array_equal(a, b) for a, b in zip(new, centres, strict=True)):
            break
        centres = new
    return centres


def _drawn(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """n vectors by the hash of their ids."""
    first = rows.select("id", "vec", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "id").limit(n).collect()
    return np.array([r["vec"] for r in sorted(first, key=lambda r: (r["h"], r["id"]))], dtype=np.float64)


def train(rows: DataFrame, cells: int | None = None, parts: int = PARTS, codes: int = CODES, seed: int = 0) -> Model:
    """rows: id, vec (unit). cells: by default the root of the number of rows, CELLS at most."""
    n = rows.count()
    if not n:
        raise ValueError("there are no vectors to learn cells from")
    if not 1 <= codes <= 256:
        raise ValueError("a code is a byte: codes must be 1 to 256")
    share = F.xxhash64("id", F.lit(seed + 1)).bitwiseAND(F.lit((1 << 30) - 1)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = Scratch(rows.sparkSession, "cells").stash(rows.where(share).select("id", "vec") if n > SAMPLE else rows.select("id", "vec"))
    cells = min(CELLS, max(1, int(n**0.5))) if cells is None else min(cells, n)
    start = _drawn(sample, max(cells, codes), seed)
    dim = start.shape[1]
    centres = _means(sample, [start[:cells]], [0, dim], ROUNDS)[0]
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<double>")
    def rest(vec: pd.Series) -> pd.Series:
        x = _matrix(vec)
        return pd.Series(list(x - shared.value[_nearest(x, shared.value)]))

    edges = [int(e) for e in np.linspace(0, dim, min(parts, dim) + 1).round()]
    left = Scratch(rows.sparkSession, "cells").stash(sample.select("id", rest("vec").alias("vec")))
    start = _drawn(left, min(codes, n), seed)
    books = _means(left, [start[:, a:b] for a, b in zip(edges, edges[1:], strict=False)], edges, ROUNDS)
    return Model(centres, books, edges)


def build(rows: DataFrame, model: Model | None = None, **parameters) -> Index:
    """Posts every row (id, vec of unit length; rows without either are left out)."""
    scratch = Scratch(rows.sparkSession, "postings")
    rows = scratch.stash(rows.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec"))
    model = model or train(rows, **parameters)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def posted(batches):
        m = shared.value
        for batch in batches:
            if len(batch):
                x = _matrix(batch["vec"])
                cell = m.cell(x)
                rest = x - m.centres[cell]
                code = m.code(rest)
                error = np.sqrt(((rest - m.decode(code)) ** 2).sum(axis=1))
                radius = np.sqrt((rest * rest).sum(axis=1))
                yield pd.DataFrame({"cell": cell, "id": batch["id"], "code": [c.tobytes() for c in code], "error": error, "radius": radius})

    kind = rows.schema["id"].dataType.simpleString()
    postings = scratch.stash(rows.mapInPandas(posted, f"cell long, id {kind}, code binary, error double, radius double"))
    cells = scratch.stash(postings.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")))
    return Index(model, postings.drop("radius"), cells, rows)


def save(index: Index, path: str) -> None:
    """Four tables under path: postings by cell, cells with their centres, codebooks and vectors."""
    spark, m = index.postings.sparkSession, index.model
    index.postings.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/postings")
    index.vectors.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")
    centres = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(m.centres)], "cell long, centre array<double>")
    centres.join(index.cells, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")
    books = [(k, c, m.edges[k], entry.tolist()) for k, book in enumerate(m.books) for c, entry in enumerate(book)]
    spark.createDataFrame(books, "part int, code int, begins int, entry array<double>").coalesce(1).write.parquet(f"{path}/books")


def load(spark: SparkSession, path: str) -> Index:
    cells = spark.read.parquet(f"{path}/cells")
    centres = np.array([r["centre"] for r in sorted(cells.collect(), key=lambda r: r["cell"])])
    books: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{path}/books").collect(), key=lambda r: (r["part"], r["code"])):
        books.setdefault(r["part"], []).append((r["begins"], r["entry"]))
    edges = [books[k][0][0] for k in sorted(books)] + [centres.shape[1]]
    model = Model(centres, [np.array([e for _, e in books[k]]) for k in sorted(books)], edges)
    return Index(model, spark.read.parquet(f"{path}/postings"), cells.where("n IS NOT NULL").drop("centre"), spark.read.parquet(f"{path}/vectors"))


def _asked(queries: DataFrame, index: Index, probes: int | None) -> DataFrame:
    """q, vec, least, cell, near: each query at its probes nearest cells, or (None) at every cell that may hold a row of its least score."""
    shared = queries.sparkSession.sparkContext.broadcast(index.model.centres)
    known = index.cells.collect()  # a row per cell
    numbers, radii = np.array([r["cell"] for r in known], dtype=np.int64), np.array([r["radius"] for r in known])

    def told(batches):
        centres = shared.value[numbers] if len(numbers) else np.zeros((0, 1))
        at_once = max(1, ASKED // max(1, len(numbers)))
        for batch in (b.iloc[at : at + at_once] for b in batches for at in range(0, len(b), at_once)):
            if not len(numbers):
                continue
            near = _matrix(batch["vec"]) @ centres.T
            if probes is None:
                wanted = near + radii >= batch["least"].to_numpy()[:, None] - ROOM
            else:
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                wanted = np.zeros(near.shape, dtype=np.bool_)
                np.put_along_axis(wanted, order, True, axis=1)
            q, cell = np.nonzero(wanted)
            out = batch.iloc[q].reset_index(drop=True)
            yield out.assign(cell=numbers[cell], near=near[q, cell])[["q", "vec", "least", "cell", "near"]]

    kind = queries.schema["q"].dataType.simpleString()
    return queries.mapInPandas(told, f"q {kind}, vec array<double>, least double, cell long, near double")


def _scanned(asked: DataFrame, index: Index, most: int | None) -> DataFrame:
    """q, id of the rows found by their codes: of each query and piece of a cell the most likely ones, or (None) all that may reach least."""
    shared = asked.sparkSession.sparkContext.broadcast(index.model)
    pieces = index.cells.select("cell", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    times = asked.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("turns")).join(pieces, "cell")
    times = F.broadcast(times)  # a row per cell
    rows = index.postings.join(times, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asks = asked.join(times, "cell").withColumn("turn", F.pmod(F.xxhash64("q"), "turns").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)))

    def scan(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({"q": [], "id": [], "about": []})
        m = shared.value
        codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
        ids, error = rows["id"].to_numpy(), rows["error"].to_numpy()
        found = []
        for at in range(0, len(asks), 256):
            part = asks.iloc[at : at + 256]
            about = part["near"].to_numpy()[:, None] + np.zeros(len(rows))
            for k, table in enumerate(m.tables(_matrix(part["vec"]))):
                about += table[:, codes[:, k]]
            about[part["q"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            if most is None:
                q, r = np.nonzero(about + error >= part["least"].to_numpy()[:, None] - ROOM)
            else:
                best = np.argsort(-about, axis=1, kind="stable")[:, :most]
                q, r = np.repeat(np.arange(len(part)), best.shape[1]), best.ravel()
            out = pd.DataFrame({"q": part["q"].to_numpy()[q], "id": ids[r], "about": about[q, r]})
            found.append(out[np.isfinite(out["about"])])
        return pd.concat(found, ignore_index=True)

    kinds = f"q {asked.schema['q'].dataType.simpleString()}, id {index.postings.schema['id'].dataType.simpleString()}, about double"
    keys = ["cell", "piece", "turn"]
    return asks.groupBy(*keys).cogroup(rows.select(*keys, "id", "code", "error").groupBy(*keys)).applyInPandas(scan, kinds)


def _reread(found: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """t, s, score, rank by the whole vectors."""
    both = found.select("q", "id").join(index.vectors, "id").join(queries.select("q", F.col("vec").alias("_q")), "q")
    return top_k(both.select(F.col("q").alias("t"), F.col("id").alias("s"), F.round(dot(F.col("_q"), F.col("vec")), 6).alias("score")), k)


def _certified(asks: DataFrame, index: Index, k: int) -> DataFrame:
    """t, s, score, rank, exact. asks: q, vec.

    Blocks of queries and of rows meet in a task, with the rows' codes and vectors. Queries of about one cell look at cells together,
    nearest first: at those whose radius may still reach a query's k-th score so far, by the codes, as a matrix product of what they
    stand for; vectors are read where the code, with its error, may reach it. Only the k best of a query come out.
    """
    known = index.cells.collect()  # a row per cell
    radius = np.zeros(len(index.model.centres))
    radius[[r["cell"] for r in known]] = [r["radius"] for r in known]
    shared = asks.sparkSession.sparkContext.broadcast((index.model, radius))
    met = crossed(asks.select(F.col("q").alias("id"), "vec"), index.postings.join(index.vectors, "id").select("id", "vec", "cell", "code", "error"))

    def best(batches):
        sides = crossed_sides(batches)
        if sides is None:
            return
        m, radius = shared.value
        queries, ids = rows_of(sides[0]["vec"]), sides[0]["id"].to_numpy()
        order = np.argsort(m.cell(queries), kind="stable")
        queries, ids = queries[order], ids[order]
        rows = sides[1].sort_by("cell")
        cell, error, vectors, row_ids = rows["cell"].to_numpy(), rows["error"].to_numpy(), rows_of(rows["vec"]), rows["id"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8).reshape(len(cell), -1)
        about = (m.centres[cell] + m.decode(codes)).astype(np.float32)
        present, first = np.unique(cell, return_index=True)
        size = np.diff(np.append(first, len(cell)))
        room = ROOM + 2 * (vectors.shape[1] + 8) * np.finfo(np.float32).eps * max(1.0, np.abs(about).sum(axis=1).max())
        found = Best(ids, k)
        for at in range(0, len(ids), TILE):
            q = slice(at, min(at + TILE, len(ids)))
            near = queries[q] @ m.centres[present].T + radius[present]
            single = queries[q].astype(np.float32)
            turn = np.argsort(-near.mean(axis=0), kind="stable")
            for some in np.split(turn, np.flatnonzero(np.diff(np.cumsum(size[turn]) // (4 * TILE))) + 1):
                wanted = near[:, some] >= found.least(q)[:, None] - ROOM
                some, asking = some[wanted.any(axis=0)], np.flatnonzero(wanted.any(axis=1))
                if not len(some):
                    continue
                here = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in some])
                product = single[asking] @ about[here].T
                product[ids[q][asking][:, None] == row_ids[here][None, :]] = -np.inf
                least = found.least(q)[asking]
                if len(bare := np.flatnonzero(~np.isfinite(least))) and len(here) > k:  # k rows that the codes find likely bound the k-th score
                    likely = np.argpartition(product[bare], len(here) - k, axis=1)[:, -k:]
                    score = np.round(np.einsum("qd,qkd->qk", queries[at + asking[bare]], vectors[here[likely]]), 6)
                    least[bare] = np.where(np.isfinite(np.take_along_axis(product[bare], likely, axis=1)), score, -np.inf).min(axis=1)
                hit = np.flatnonzero(product + error[here].astype(np.float32) >= (least - room).astype(np.float32)[:, None])
                x, y = np.divmod(hit, len(here))
                for part in range(0, len(x), ASKED):
                    a, b = at + asking[x[part : part + ASKED]], here[y[part : part + ASKED]]
                    score = np.round(np.einsum("ij,ij->i", queries[a], vectors[b]), 6)
                    fine = (score >= found.score[a, -1]) & (ids[a] != row_ids[b])
                    found.add(a[fine], row_ids[b[fine]], score[fine])
        yield found.found()

    return top_k(met.mapInArrow(best, "t long, s long, score double"), k)


def search(queries: DataFrame, index: Index, k: int, probes: int = 8, most: int | None = None, certified: bool = True) -> DataFrame:
    """t, s, score, rank: the k rows of the largest dot product with each query, the query's own id left out, ties by id.

    queries: id (unique), vec (unit). probes, most: if not certified, the cells of a query, and its rows whose vectors are read (8 k by default).
    """
    scratch, most = Scratch(queries.sparkSession, "search"), most or 8 * k
    asks = scratch.stash(queries.where("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").alias("q"), "vec", F.lit(None).cast("double").alias("least")))
    if certified:
        return _certified(asks, index, k)
    found = _scanned(_asked(asks, index, probes), index, most)
    likely = top_k(found.select(F.col("q").alias("t"), F.col("id").alias("s"), F.col("about").alias("score")), most).select(F.col("t").alias("q"), F.col("s").alias("id"))
    return _reread(likely, asks, index, k)


def read_share(queries: DataFrame, index: Index, least: DataFrame) -> DataFrame:
    """One row: pairs of a query and a row, those whose code and those whose vector a certified search reads. least: t and the score of its k-th row."""
    asks = queries.select(F.col("id").alias("q"), "vec").join(least.select(F.col("t").alias("q"), F.col("score").alias("least")), "q")
    asked = Scratch(queries.sparkSession, "share").stash(_asked(asks, index, None))
    codes = asked.join(F.broadcast(index.cells.select("cell", "n")), "cell").agg(F.sum("n").alias("codes"))
    vectors = _scanned(asked, index, None).agg(F.count("*").alias("vectors"))
    return codes.join(vectors).join(asks.agg((F.count("*") * index.vectors.count()).alias("pairs")))


def audit(index: Index, k: int, probes: int, most: int | None = None, queries: int = 256) -> float:
    """The share of the true k nearest that an uncertified search finds, over a number of rows by hash."""
    drawn = index.vectors.orderBy(F.xxhash64("id", F.lit(99)), "id").limit(queries)
    drawn = Scratch(drawn.sparkSession, "audit").stash(drawn)
    true = search(drawn, index, k).select("t", "s")
    hits = search(drawn, index, k, probes, most, certified=False).select("t", "s").join(true, ["t", "s"], "left_semi").count()
    return hits / max(1, true.count())
