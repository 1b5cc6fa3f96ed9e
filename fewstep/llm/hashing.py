"""Hashes of the words of many texts at once, in numpy.

A word's bytes are read eight at a time and mixed in turn, for all words together; a word of more than LONG_WORD
bytes is hashed by itself. The hash depends on the word's bytes alone. Nothing of eight bytes is kept for a
byte of text: the arrays have a row for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Bytes of text that are hashed at once (or the longest word beyond).
BLOCK_BYTES = 1 << 20
#: Bytes of rows that are handed to Python at once.
BATCH_BYTES = 8 << 20
LONG_WORD = 128
_START, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the rows that Python workers get at once by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # a Spark without this setting has a bound by rows only
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of raw[start:end]."""
    padded = raw + bytes(8)
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    out = mixed((eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]) * _STEP + sizes.astype(np.uint64) * _START)
    more, at = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD)), 8
    while len(more):
        part = eight[starts[more] + at] & _FIRST_BYTES[np.minimum(sizes[more] - at, 8)]
        out[more] = mixed(out[more] ^ (part * _STEP))
        at += 8
        more = more[sizes[more] > at]
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def _bounds(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.bool_)
    np.logical_not(separator[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def words(raw: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, the start and the end of each word of raw. separator: for each byte value, whether it parts words."""
    if len(raw) <= 2 * BLOCK_BYTES:
        starts, ends = _bounds(np.frombuffer(raw, dtype=np.uint8), separator)
        return _hash(raw, starts, ends), starts, ends
    found, at = [], 0
    while at < len(raw):  # a long text in pieces that end where a word does
        end = min(len(raw), at + BLOCK_BYTES)
        while end < len(raw) and not separator[raw[end]]:
            end += 1
        piece = raw[at:end]
        starts, ends = _bounds(np.frombuffer(piece, dtype=np.uint8), separator)
        found.append((_hash(piece, starts, ends), starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of up to BLOCK_BYTES together (or one longer text), with the first one's place."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < BLOCK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        yield at, texts[at:end]
        at = end
