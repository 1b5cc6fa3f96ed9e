"""Periodic runs of words, found with the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, of max(SHORTEST, TIMES * q) words or more, that no neighbouring
word extends. Spark hands out whole texts; no text is compared with another one, so nothing is shuffled.

1. Zones. Each word of a run lies in a stretch of GRAM words that occurs twice in its text, since a run holds
   three periods and three times GRAM words. So only zones covered by repeated stretches are looked at, and a run is
   found in its zone with the bounds it has in the text. Most prose has none.
2. Suffix tree. Zones are put together, each with an end mark of its own. The names of all stretches of 1, 2, 4, ...
   words give common extensions to both sides; the sorted suffixes with the common prefixes of neighbours are the
   tree, an interval of them and a depth a point in it.
3. LZ blocks (the longest factor that occurs further left) give the leftmost covering set: for each block and
   period at most two squares, by one extension to either side of a border of blocks.
4. Vocabulary. From the point of each such square with a primitive root the suffix links lead to its rotations; as
   every square's leftmost occurrence is in the covered stretch, the walk goes along that stretch, once for each
   run it is in. Each point is kept once.
5. Occurrences. The leaves below a point are the places of its square. Squares of one period at neighbouring places
   merge into a run.

Null and empty texts have no run. A null doc_id leaves a text as it is. Rows may repeat; each is treated by itself.
A zone of n words takes about 4 n log2(n) bytes while it is looked at, a text some 60 bytes for a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.llm.hashing import bounded_batches
from fewstep.sources.tables import table

#: A run's least length, in words and in periods.
SHORTEST, TIMES = 24, 3
#: Words of the stretches that mark zones: a third of SHORTEST, so that each occurs again in a run.
GRAM = SHORTEST // TIMES
#: Words of zones that are looked at together (or one longer zone).
TOGETHER = 1 << 16

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def zones(codes: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the longest stretches covered by stretches of GRAM words that occur twice or more."""
    if len(codes) < SHORTEST:
        return []
    names, width = codes.astype(np.uint64), 1
    for odd in _ODD:
        names = (names[:-width] ^ (names[:-width] >> np.uint64(29))) * odd + names[width:]
        width *= 2
    order = np.argsort(names)
    same = names[order[1:]] == names[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(codes) + 1, dtype=np.int32)
    twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    np.add.at(again, twice, 1)
    np.add.at(again, twice + GRAM, -1)
    inside = np.concatenate(([False], np.cumsum(again[:-1]) > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= SHORTEST]


class Tree:
    """The suffix tree of a string whose last symbol occurs once, as sorted suffixes with common prefixes."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, width = [], 1
        while True:
            self.names.append(names.astype(np.int32))
            if int(names.max()) == n - 1:
                break
            right = np.zeros(n, dtype=np.int64)
            right[: max(0, n - width)] = names[width:] + 1
            names = np.unique(names * (n + 1) + right, return_inverse=True)[1]
            width *= 2
        self.rank = self.names[-1]
        self.leaves = np.empty(n, dtype=np.int64)
        self.leaves[self.rank] = np.arange(n)
        common = np.zeros(n, dtype=np.int32)
        common[1:] = self.ahead(self.leaves[1:], self.leaves[:-1])
        self.least = [common]  # least common prefix of 1, 2, 4, ... neighbours up to a leaf
        while (width := 1 << len(self.least)) < n:
            last = self.least[-1]
            self.least.append(np.concatenate((last[: width // 2], np.minimum(last[width // 2 :], last[: -(width // 2)]))))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal; i and j differ."""
        out = np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            out += (self.names[level][i + out] == self.names[level][j + out]).astype(np.int64) << level
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j are equal; 0 where one is -1."""
        out, low = np.zeros(len(i), dtype=np.int64), np.minimum(i, j)
        for level in range(len(self.names) - 1, -1, -1):
            back = out + (1 << level) - 1
            fits = low >= back
            at = np.where(fits, back, 0)
            equal = fits & (low >= 0) & (self.names[level][i - at] == self.names[level][j - at])
            out += equal.astype(np.int64) << level
        return out

    def points(self, starts: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last leaf below the point at a depth on the way to a suffix."""
        first = self.rank[starts].astype(np.int64)
        last = first.copy()
        for level in range(len(self.least) - 1, -1, -1):
            step, least = 1 << level, self.least[level]
            fits = first >= step
            down = fits & (least[np.where(fits, first, 0)] >= depths)
            first -= np.where(down, step, 0)
            ahead = last + step
            fits = ahead < self.n
            down = fits & (least[np.where(fits, ahead, 0)] >= depths)
            last += np.where(down, step, 0)
        return first, last

    def blocks(self) -> np.ndarray:
        """The starts of the LZ blocks, and n."""
        n, rank = self.n, self.rank.tolist()
        left, right = list(range(-1, n)), list(range(1, n + 2))  # of each leaf and of a border at n: those further left in the string
        before, after = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            r = rank[i]
            a, b = left[r], right[r]
            before[i], after[i] = a, b
            right[a if a >= 0 else n] = b
            left[b if b <= n else n] = a
        size = np.zeros(n, dtype=np.int64)
        for other in (np.array(before), np.array(after)):
            there = np.flatnonzero((other >= 0) & (other < n))
            size[there] = np.maximum(size[there], self.ahead(there, self.leaves[other[there]]))
        size, found, at = np.maximum(size, 1).tolist(), [], 0
        while at < n:
            found.append(at)
            at += size[at]
        return np.array([*found, n], dtype=np.int64)

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and half length of squares; the leftmost occurrence of each square is one of them or some rotations to its right."""
        cuts = self.blocks()
        here, following = cuts[:-1], cuts[1:]
        sizes = following - here
        # squares with their centre in a block that reach into the next one
        k, border = _counts(sizes), np.repeat(following, sizes)
        k, border = k[border < self.n], border[border < self.n]
        other = border - k
        ahead, behind = self.ahead(border, other), self.behind(border - 1, other - 1)
        good = (ahead + behind >= k) & (ahead > 0)
        starts, halves = [np.maximum(other - behind, other - k + 1)[good]], [k[good]]
        # squares with their centre in a block that begin left of it
        both = sizes + np.concatenate((sizes[1:], [0]))
        k, border, end = _counts(both), np.repeat(here, both), np.repeat(following, both)
        fits = (border > 0) & (border + k < self.n)
        k, border, end = k[fits], border[fits], end[fits]
        ahead, behind = self.ahead(border, border + k), self.behind(border - 1, border + k - 1)
        start = np.maximum(border - behind, border - k + 1)
        good = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (start + k <= end)
        starts.append(start[good])
        halves.append(k[good])
        return np.concatenate(starts), np.concatenate(halves)

    def primitive(self, starts: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Whether a square's half is no power of a shorter word."""
        out, rest = np.ones(len(starts), dtype=np.bool_), halves.copy()
        divisor = _least_divisors(int(halves.max(initial=1)))
        while (open_ := np.flatnonzero(out & (rest > 1))).size:
            prime = divisor[rest[open_]]
            shorter = halves[open_] // prime
            out[open_] = self.ahead(starts[open_], starts[open_] + shorter) < 2 * halves[open_] - shorter
            rest[open_] //= prime
        return out


def _counts(sizes: np.ndarray) -> np.ndarray:
    """1, 2, ..., size for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(1, int(sizes.sum()) + 1) - np.repeat(ends - sizes, sizes)


def _least_divisors(n: int) -> np.ndarray:
    """The least prime divisor of each number up to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            part = out[p * p :: p]
            part[part == np.arange(p * p, n + 1, p)] = p
    return out


def squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half length and start of every square with a primitive root, ordered by them."""
    tree = Tree(symbols)
    starts, halves = tree.covering()
    keep = tree.primitive(starts, halves)
    starts, halves = starts[keep], halves[keep]
    ends = starts + halves + tree.ahead(starts, starts + halves)  # of the run that a square is in
    order = np.lexsort((starts, ends, halves))
    starts, halves, ends = starts[order], halves[order], ends[order]
    first = np.ones(len(starts), dtype=np.bool_)
    first[1:] = (halves[1:] != halves[:-1]) | (ends[1:] != ends[:-1])
    starts, halves, ends = starts[first], halves[first], ends[first]
    rotations = ends - starts - 2 * halves + 1
    walked, halves = np.repeat(starts, rotations) + _counts(rotations) - 1, np.repeat(halves, rotations)
    low, high = tree.points(walked, 2 * halves)
    point = np.unique(np.stack((halves, low, high), axis=1), axis=0) if len(low) else np.empty((0, 3), dtype=np.int64)
    times = point[:, 2] - point[:, 1] + 1
    places = tree.leaves[np.repeat(point[:, 1], times) + _counts(times) - 1]
    halves = np.repeat(point[:, 0], times)
    order = np.lexsort((places, halves))
    return halves[order], places[order]


def runs(parts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Of each part (whole numbers from 0): the start, length and period of each run, by start and period."""
    marks = max((int(p.max()) for p in parts if len(p)), default=0) + 1
    symbols = np.concatenate([np.append(p, marks + k) for k, p in enumerate(parts)])
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    period, place = squares(symbols)
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    if not len(period):
        return out
    breaks = np.flatnonzero((period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(period)])) - 1
    start, period = place[first], period[first]
    length = place[last] - start + 2 * period
    for k in np.flatnonzero(length >= np.maximum(SHORTEST, TIMES * period)).tolist():
        part = int(np.searchsorted(begins, start[k], side="right")) - 1
        out[part].append((int(start[k] - begins[part]), int(length[k]), int(period[k])))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def rebuilt(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text, made periodic from a place on for a tenth of the ids."""
    if doc_id is None or not words or (h := zlib.crc32(str(int(doc_id)).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def found_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given by its words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def settle():
        for (k, at, _), found in zip(held, runs([z for _, _, z in held]) if held else [], strict=True):
            out[k].extend((start + at, length, period) for start, length, period in found)
        held.clear()

    for k, words in enumerate(texts):
        if len(words) < SHORTEST:
            continue
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        for a, b in zones(codes):
            if held and size + b - a > TOGETHER:
                settle()
                size = 0
            held.append((k, a, codes[a:b]))
            size += b - a
    settle()
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run the first period stays."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _described(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    if found:
        start, length, period = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (start, length, period, 1000 * length // period)
    else:
        best = (None,) * 4
    return (len(found), *best, _sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), _sha(b" ".join(collapsed(words, found))))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rebuild: bool = False) -> DataFrame:
    """docs with what was found in each text (SCHEMA); columns of those names are replaced.

    rebuild: texts of a tenth of the ids are made periodic first.
    """
    bounded_batches(docs.sparkSession)

    def of_rows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, column in batches:
            texts = [b"" if t is None else t.encode("utf-8", "replace") for t in column]
            words = [t.split() for t in texts]  # bytes part at 0x20 and 0x09 to 0x0D
            if rebuild:
                words = [rebuilt(w, None if pd.isna(i) else i) for w, i in zip(words, ids, strict=True)]
            rows = [_described(w, f) for w, f in zip(words, found_runs(words), strict=True)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield frame.astype({c: "Int64" for c in ("n_runs", "start", "length", "period", "exponent_milli")})

    keep = [c for c in docs.columns if c not in {c.split()[0] for c in SCHEMA.split(", ")}]
    return docs.withColumn("_found", F.pandas_udf(of_rows, SCHEMA)(F.col(doc_id), F.col(text))).select(*keep, "_found.*")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs(docs, rebuild=True).drop("text")
