"""Text to vectors, with a model that can be exchanged.

The default hashes words into DIM signed buckets and norms the sum: deterministic, and without a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 384


def hashed_bag(texts: list[str]) -> np.ndarray:
    import hashlib

    out = np.zeros((len(texts), DIM))
    for k, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[k, h % DIM] += 1 if h >> 63 else -1
    return out / (np.sqrt((out * out).sum(axis=1, keepdims=True)) + 1e-12)


def encode(df: DataFrame, text: str, out: str, model: Callable[[list[str]], np.ndarray] = hashed_bag) -> DataFrame:
    """df with the vector of each text, batch by batch; null for a null or empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = model(batch.fillna("").tolist()) if len(batch) else []
            yield pd.Series([v.tolist() if t else None for t, v in zip(batch, vectors, strict=True)], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text)))
