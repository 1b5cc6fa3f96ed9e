"""What the vector operators share: which vectors take part, and rows that come sorted by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """The rows with an id and a vector that is not null, not zero and has finite components only.

    Vectors of a length other than the most frequent one (the smaller of two) can't be compared with
    the rest and take no part either. The vector becomes array<double>.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).withColumn(vector, v).where(F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "n").first()
    return rows.where(F.size(vector) == (lengths["n"] if lengths else 0))


def matrix(column: pd.Series) -> np.ndarray:
    """The vectors of a column, a row each, in double precision."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def cosines(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosine of each row with one vector or with its own row of as many. Equal rows give equal numbers."""
    dot = (rows * one).sum(axis=1)
    return dot / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((one * one).sum(axis=-1)))


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole runs of equal keys, from batches that come sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        new[0] = bool(held) and (batch[keys].iloc[0].to_numpy() != held[-1][keys].iloc[-1].to_numpy()).any()
        starts = np.flatnonzero(new)
        if len(starts):
            held.append(batch.iloc[: starts[-1]])
            if whole := [h for h in held if len(h)]:
                yield pd.concat(whole, ignore_index=True)
            held = [batch.iloc[starts[-1] :]]
        else:
            held.append(batch)
    if whole := [h for h in held if len(h)]:
        yield pd.concat(whole, ignore_index=True)
