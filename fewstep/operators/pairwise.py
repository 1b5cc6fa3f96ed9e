"""Pairwise measures of documents with an ingredient and an instruction section of embedded lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.operators.retrieve import sent_blocks
from fewstep.operators.score import HALF
from fewstep.plans.storage import Scratch

#: Lines of a tile; two blocks of tiles meet in a task. A document of more lines in a section is dealt over several pieces.
TILE_LINES = 1000
SECTIONS = ("ingr", "instr")


def section_max(sim_instr, sim_ingr, alpha: float = 1.0, beta: float = 1.0, missing_is_zero: bool = False) -> F.Column:
    """The larger weighted section similarity. A missing side is skipped, or counts 0; both missing: 0."""
    a, b = F.col(sim_instr) * alpha, F.col(sim_ingr) * beta
    if missing_is_zero:
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.coalesce(F.greatest(a, b), F.lit(0.0))


def _blocks(lines: DataFrame, size: int) -> tuple[DataFrame, int, bool]:
    """lines with their block, the number of blocks, and whether a document is in more than one of them.

    A document's lines of a section share a block unless they are more than size; then they have several.
    """
    sizes = Scratch(lines.sparkSession, "lines").stash(lines.groupBy("doc", "section").agg(F.count("*").alias("_n")))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    blocks, split = sent_blocks(total["n"], size), total["most"] > size
    piece = F.lit(0)
    if split:
        lines = lines.join(sizes, ["doc", "section"])
        piece = F.pmod(F.xxhash64("line"), F.ceil(F.col("_n") / size))
    own = F.pmod(F.xxhash64("doc", "section", piece), F.lit(blocks)).cast("int")
    return lines.select("doc", "section", "line", "vec", own.alias("own"), *(["group"] if "group" in lines.columns else [])), blocks, split


def _starts(docs: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))


def _pieces(docs: np.ndarray, size: int, split: bool) -> list[slice]:
    """Runs of about size rows (sorted by document), without a document in two of them unless split."""
    ends = np.arange(size, len(docs), size) if split else _starts(docs)[1:]
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= size:
            cuts.append(e)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True)]


def _tiles(lines: DataFrame, size: int, taus: list[float] | None, among: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """What every two blocks of a section give, tile by tile: a matrix product, and of it the largest of each line and source document.

    taus None: t, s, section, line, best. Else t, s, section, n, total (of best, in millionths) and hard, the lines with
    each tau or more; only for documents that are not split. Also returned is whether any is, so that rows must be combined.
    among: gx, gy, the groups of documents (a column group of lines) that meet; a bounded number of rows.
    """
    rows, blocks, split = _blocks(lines, size)
    rows = Scratch(lines.sparkSession, "tiles").stash(rows)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    t = rows.select("section", F.col("own").alias("x"), every.alias("y"), F.lit(True).alias("asks"), "doc", "line", "vec")
    s = rows.select("section", every.alias("x"), F.col("own").alias("y"), F.lit(False).alias("asks"), "doc", "line", "vec")
    keys = ["section", "x", "y"]
    if among is not None:
        keys += ["gx", "gy"]
        groups = F.broadcast(among)
        t = t.join(rows.select("doc", F.col("group").alias("gx")).distinct(), "doc").join(groups, "gx")
        s = s.join(rows.select("doc", F.col("group").alias("gy")).distinct(), "doc").join(groups, "gy")
    kind, doc, line = dict(rows.dtypes)["section"], dict(rows.dtypes)["doc"], dict(rows.dtypes)["line"]
    by_line = taus is None or split
    schema = f"t {doc}, s {doc}, section {kind}, line {line}, best double" if by_line else f"t {doc}, s {doc}, section {kind}, n long, total long, hard array<long>"

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches), ignore_index=True)
        a, b = frame[frame["asks"]].sort_values("doc", kind="stable"), frame[~frame["asks"]].sort_values("doc", kind="stable")
        if len(a) and len(b):
            x, y = (_pieces(z["doc"].to_numpy(), size, split) for z in (a, b))
            for i in x:
                for j in y:
                    yield one(a.iloc[i], b.iloc[j])

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        source, target = b["doc"].to_numpy(), a["doc"].to_numpy()
        starts = _starts(source)
        best = np.round(np.maximum.reduceat(np.stack(a["vec"].to_numpy()) @ np.stack(b["vec"].to_numpy()).T, starts, axis=1), 6)
        sources, section = source[starts], a["section"].iloc[0]
        if by_line:
            i, j = np.nonzero(target[:, None] != sources[None, :])
            return pd.DataFrame({"t": target[i], "s": sources[j], "section": section, "line": a["line"].to_numpy()[i], "best": best[i, j]})
        rows = _starts(target)
        targets, n = target[rows], np.diff(np.append(rows, len(target)))
        total = np.add.reduceat(np.rint(best * 1e6).astype(np.int64), rows, axis=0)
        hard = np.stack([np.add.reduceat((best >= tau).astype(np.int64), rows, axis=0) for tau in taus], axis=-1)
        i, j = np.nonzero(targets[:, None] != sources[None, :])
        return pd.DataFrame({"t": targets[i], "s": sources[j], "section": section, "n": n[i], "total": total[i, j], "hard": pd.Series(list(hard[i, j]), dtype=object)})

    return t.unionByName(s).groupBy(*keys).applyInPandas(tile, schema), split


def best_matches(lines: DataFrame, size: int = TILE_LINES) -> DataFrame:
    """lines: doc, section, line, vec (unit). t, s, section, line, best: the best cosine of each line of t in s.

    As many rows as there are lines times documents. Lines of a repeated number count once, by their best match.
    """
    found, split = _tiles(lines, size, None)
    return found.groupBy("t", "s", "section", "line").agg(F.max("best").alias("best")) if split else found


def line_sums(lines: DataFrame, taus: list[float], size: int = TILE_LINES, among: DataFrame | None = None) -> DataFrame:
    """t, s, section, n, total, hard: the lines of t, their best cosines in s added up in millionths, and how many reach each tau.

    The millionths are whole numbers, so the order of the rows does not matter. Sums are made where the tile is, unless a
    document has too many lines for one block: then its partial largest ones are combined first. among: see _tiles().
    """
    found, split = _tiles(lines, size, taus, among)
    if not split:
        return found
    best = found.groupBy("t", "s", "section", "line").agg(F.max("best").alias("best"))
    hard = F.array(*[F.count_if(F.col("best") >= tau) for tau in taus])
    return best.groupBy("t", "s", "section").agg(F.count("*").alias("n"), F.sum(F.round(F.col("best") * 1e6).cast("long")).alias("total"), hard.alias("hard"))


def _soft() -> F.Column:
    return F.floor((F.col("total") * 2 + F.col("n")) / (F.col("n") * 2)) / F.lit(1e6)


def _jaccard(sums: DataFrame, lines: DataFrame, at: int) -> DataFrame:
    sizes = lines.groupBy("doc", "section").agg(F.count("*").alias("_s"))
    met = sums.join(sizes.withColumnRenamed("doc", "s"), ["s", "section"]).withColumn("inter", F.col("hard")[at])
    union = F.col("n") + F.col("_s") - F.col("inter")
    return met.withColumn("j", F.when(union > 0, F.col("inter") / union).otherwise(0.0))


def _of(section: str, value: str) -> F.Column:
    return F.max(F.when(F.col("section") == section, F.col(value)))


def line_jaccard(sums: DataFrame, lines: DataFrame, at: int = 0) -> DataFrame:
    """t, s and the soft Jaccard of each section and overall, counted from t: asymmetric, and may exceed 1. at: which tau."""
    zero = F.lit(0.0)
    out = _jaccard(sums, lines, at).groupBy("t", "s").agg(*[F.coalesce(_of(x, "j"), zero).alias(f"jaccard_{x}") for x in SECTIONS])
    overall = F.round((F.col("jaccard_ingr") + F.col("jaccard_instr")) / 2, 6)
    return out.select("t", "s", *[F.round(f"jaccard_{x}", 6).alias(f"jaccard_{x}") for x in SECTIONS], overall.alias("jaccard_overall"))


def coverage(sums: DataFrame, at: int = 0) -> DataFrame:
    """t, s, section, soft (mean best match, rounded half up), hard (lines with the tau or more)."""
    return sums.select("t", "s", "section", _soft().alias("soft"), F.col("hard")[at].alias("hard"))


def line_metrics(sums: DataFrame, lines: DataFrame, w_instr: float = 0.5, w_ingr: float = 0.5, w: float = 0.6, at: int = 0) -> DataFrame:
    """t, s and the earlier engine's metrics of a pair: coverage (the sections' soft ones by weight; an absent one counts 0),
    jaccard (overall) and hybrid, w of the one and 1 - w of the other. The weight of hybrid is this package's own choice."""
    zero = F.lit(0.0)
    rows = _jaccard(sums, lines, at).withColumn("soft", _soft())
    out = rows.groupBy("t", "s").agg(*[F.coalesce(_of(x, v), zero).alias(f"{v}_{x}") for x in SECTIONS for v in ("soft", "j")])
    out = out.select("t", "s", F.round(F.col("soft_instr") * w_instr + F.col("soft_ingr") * w_ingr, 7).alias("coverage"), F.round((F.col("j_ingr") + F.col("j_instr")) / 2, 6).alias("jaccard"))
    return out.withColumn("hybrid", F.round(F.col("coverage") * w + F.col("jaccard") * (1 - w) + HALF, 6))


def gap_lines(best: DataFrame, threshold: float) -> DataFrame:
    """t, s, section, gaps: the target's lines whose best match is below the threshold."""
    return best.where(F.col("best") < threshold).groupBy("t", "s", "section").agg(F.sort_array(F.collect_list("line")).alias("gaps"))


def mean_pool(rows: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group: by, pos, value."""
    return rows.select(by, F.posexplode("vec").alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("value"))
