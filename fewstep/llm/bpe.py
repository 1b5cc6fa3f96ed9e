"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The texts of a block of the corpus are split into words once. The block's distinct words that are not
known yet are laid out as one chain of byte tokens, with an inverted index from the token pair (named by
the rank of its merge) to the positions where the pair stands. Every merge is applied in rank order to
all its positions at once in the index, and only the neighbours it touches get new index entries. A
word's ids depend on the word alone, so how the corpus is cut into blocks changes no result, and a
bounded cache of words carries results from block to block. Nothing is shuffled.

Within a word merges go lowest rank first, then leftmost. A merge can make a pair of a lower rank than
its own; the rest of its positions then wait until that pair is merged. A word that is itself in the
vocabulary is that one token.

Nulls: a null text is the empty text: no ids, the hashes of nothing. Memory is bounded by BLOCK_CHARS of
text (or the longest text) and, in each Python worker, the words of CACHE_WORDS and one block. Ids, ties, repeated rows and empty
tables need no special case. Columns of the same names as the outputs are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.llm.hashing import bounded_batches
from fewstep.sources.tables import table

#: Characters of text that are split at once, and words whose ids a worker keeps.
BLOCK_CHARS, CACHE_WORDS = 1_000_000, 400_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the token, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Replay:
    """Merges of one vocabulary, with the words encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens: dict[int, bytes] = {k: v for v, k in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = np.full((256, 256), -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                pairs[token[0], token[1]] = rank
        self.byte_pairs = pairs
        self.known: dict[tuple[int, int], int] = {}
        #: word: (number of ids, ids joined by commas, bytes that the ids decode to)
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        #: the cache before the last time it was full; words still in use move over
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def pair_rank(self, a: int, b: int) -> int:
        """The rank of the merge of two adjacent tokens, -1 if there is none."""
        rank = self.known.get((a, b))
        if rank is None:
            rank = self.known[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of the distinct words."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else [] if not w else None for w in words]
        open_words = [k for k, ids in enumerate(out) if ids is None]
        if not open_words:
            return out
        raw = np.frombuffer(b"".join(words[k] for k in open_words), dtype=np.uint8)
        ends = np.cumsum([len(words[k]) for k in open_words])
        size = len(raw)
        starts = np.concatenate(([0], ends[:-1]))
        after = np.arange(1, size + 1)
        after[ends - 1] = -1
        before = np.arange(-1, size - 1)
        before[starts] = -1
        # the inverted index: rank of a pair's merge -> positions of its left token
        ranks_at = np.full(size, -1, dtype=np.int64)
        ranks_at[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        ranks_at[ends - 1] = -1
        there = np.flatnonzero(ranks_at >= 0)
        there = there[np.argsort(ranks_at[there], kind="stable")]
        values, cuts = np.unique(ranks_at[there], return_index=True)
        index = {int(v): part.tolist() for v, part in zip(values, np.split(there, cuts[1:]), strict=True)} if len(there) else {}
        token, left, right = self.first[raw].tolist(), before.tolist(), after.tolist()
        due, known, pair_rank = list(index), self.known, self.pair_rank
        heapq.heapify(due)
        while due:
            rank = heapq.heappop(due)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for n, i in enumerate(places):
                a, j = token[i], right[i]
                if a < 0 or j < 0:
                    continue
                b = token[j]
                now = known.get((a, b))
                if (pair_rank(a, b) if now is None else now) != rank:
                    continue
                token[i], token[j] = rank, -1
                k = right[i] = right[j]
                lower = False
                if k >= 0:
                    left[k] = i
                    new = known.get((rank, token[k]))
                    if new is None:
                        new = pair_rank(rank, token[k])
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(due, new)
                        lower = new < rank
                h = left[i]
                if h >= 0:
                    new = known.get((token[h], rank))
                    if new is None:
                        new = pair_rank(token[h], rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            heapq.heappush(due, new)
                        lower = lower or new < rank
                if lower:
                    index[rank] = places[n + 1 :]
                    heapq.heappush(due, rank)
                    break
        for k, start, end in zip(open_words, starts.tolist(), ends.tolist(), strict=True):
            out[k] = [t for t in token[start:end] if t >= 0]
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[t] for t in ids])

    def learn(self, words: set[str]) -> None:
        """Replays the merges over those words that the cache lacks."""
        if len(self.cache) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
        new = [w for w in words if w not in self.cache]
        self.cache |= {w: self.older[w] for w in new if w in self.older}
        new = [w for w in new if w not in self.older]
        if len(self.known) > 2_000_000:
            self.known.clear()
        for w, ids in zip(new, self.replay([w.encode() for w in new]), strict=True):
            self.cache[w] = (len(ids), ",".join(map(str, ids)), self.decode(ids))

    def texts(self, texts: list[str]) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text, what the cache has of each of its words, in order."""
        at = 0
        while at < len(texts):
            block, chars = [], 0
            while at < len(texts) and (not block or chars + len(texts[at]) <= BLOCK_CHARS):
                chars += len(texts[at])
                block.append(self.find(texts[at]))
                at += 1
            self.learn(set().union(*block))
            get = self.cache.__getitem__
            for split in block:
                yield list(map(get, split))


_replays: dict[str, Replay] = {}


def _worker(key: str, data: bytes, pattern: str) -> Replay:
    """This process's Replay of a vocabulary: parsed once, its cache kept between tasks."""
    if key not in _replays:
        _replays.clear()
        _replays[key] = Replay(parse_ranks(data), pattern)
    return _replays[key]


def _vocabulary(spark, path: str, pattern: str):
    """The rank file, read by the driver and broadcast (its size is the vocabulary's, under a few MB)."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data + pattern.encode()).hexdigest(), spark.sparkContext.broadcast(data)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text as array<int>."""
    key, data = _vocabulary(df.sparkSession, ranks_path, pattern)

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replay = _worker(key, data.value, pattern)
        for batch in batches:
            yield pd.Series([np.array([int(x) for w in t for x in w[1].split(",")], dtype=np.int32) for t in replay.texts(batch.fillna("").tolist())])

    return df.withColumn(out, F.pandas_udf(ids, "array<int>")(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; null ids give null."""
    key, data = _vocabulary(df.sparkSession, ranks_path, pattern)

    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replay = _worker(key, data.value, pattern)
        for batch in batches:
            yield pd.Series([None if x is None else replay.decode(x) for x in batch])

    return df.withColumn(out, F.pandas_udf(raw, "binary")(F.col(ids)))


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 (of the ids, joined by commas) and decoded_sha256 in place of the text."""
    key, data = _vocabulary(df.sparkSession, ranks_path, pattern)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        replay = _worker(key, data.value, pattern)
        for batch in batches:
            rows = []
            for words in replay.texts(batch.fillna("").tolist()):
                ids, raw = ",".join([w[1] for w in words]), b"".join([w[2] for w in words])
                rows.append((sum([w[0] for w in words]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    keep = [c for c in df.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    return df.withColumn("_digest", F.pandas_udf(digest, kind)(F.col(text))).select(*keep, "_digest.*")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
