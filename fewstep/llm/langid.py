"""Language ID with hyperdimensional profiles.

Every letter has a random vector of DIM signs, drawn from its code point. An n-gram's vector binds its
letters' vectors, each permuted (rotated) by its place, by multiplication. A text's vector bundles
(adds) the vectors of its n-grams, a language's prototype bundles those of its training texts, and the
prediction is the language whose prototype has the largest cosine with the text's vector.

A training text's n-gram counts are scaled to the length WEIGHT and rounded, so that every text weighs
the same in its language, however long it is. Bundling adds whole numbers, so a prototype does not depend
on the order or the partitions of the rows.
Training adds up n-gram counts per language and task, and projects them once; its result is DIM numbers
per language, whatever the corpus holds. Prediction needs no shuffle.

Letters are Unicode letters in lower case; everything else is one blank between words and at both ends,
so any text with a letter has an n-gram. A text that is null or has no letter is UNKNOWN with score 0, as
is every text if nothing was learned. Rows with a null text or language are not learned from. Ties go to
the smaller language. Scores are cosines, and 0 where negative. Texts are read whole. Columns of the same
names as the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.llm.hashing import bounded_batches
from fewstep.sources.tables import table

UNKNOWN = "und"
#: Length of the vectors, letters in an n-gram, and the seed of the letters' vectors.
DIM, GRAM, SEED = 1024, 3, 20_011
#: n-grams whose vectors a worker keeps, and languages that a set of prototypes may have (it is broadcast).
GRAMS, MAX_LANGUAGES = 1 << 15, 4096
#: Length of a training text's n-gram counts.
WEIGHT = 1 << 16
#: Texts that are bundled in one matrix product.
TOGETHER = 64
#: A text of a smaller score is rejected by keep_known(): three and a half standard deviations of the cosine that chance alone gives.
MIN_SCORE = 3.5 / DIM**0.5

_BLANK = 32
_vectors: dict[int, np.ndarray] = {}
_letters = np.zeros(0x110000, dtype=np.int8)  # 0: not looked at, 1: letter, 2: other


def _letter(code: int) -> np.ndarray:
    """The signs of a letter, from its code point and SEED alone."""
    if code not in _vectors:
        _vectors[code] = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIM).astype(np.float32) * 2 - 1
    return _vectors[code]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed 21 bits a letter, and their counts; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    for c in np.unique(codes[_letters[codes] == 0]) if len(codes) else ():
        _letters[c] = 1 if chr(c).isalpha() else 2
    is_letter = _letters[codes] == 1
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate(([_BLANK], np.where(is_letter, codes, _BLANK), [_BLANK]))
    codes = codes[np.concatenate(([True], (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)))]
    packed = codes[: len(codes) - GRAM + 1]
    for k in range(1, GRAM):
        packed = (packed << 21) | codes[k : len(codes) - GRAM + 1 + k]
    return np.unique(packed, return_counts=True)


class Vectors:
    """Vectors of n-grams, a bounded number of them kept."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.rows = np.empty((GRAMS, DIM), dtype=np.int8)

    def of(self, packed: np.ndarray) -> np.ndarray:
        """The bound vectors of up to GRAMS n-grams, one row each."""
        wanted = packed.tolist()
        places = [self.at.get(g, -1) for g in wanted]
        if -1 in places:
            new = [g for g, p in zip(wanted, places, strict=True) if p < 0]
            if len(self.at) + len(new) > GRAMS:
                self.at.clear()
                new = wanted
            for g in new:
                self.rows[len(self.at)] = self._bind(g)
                self.at[g] = len(self.at)
            places = [self.at[g] for g in wanted]
        return self.rows[places]

    @staticmethod
    def _bind(packed: int) -> np.ndarray:
        out = np.ones(DIM, dtype=np.float32)
        for k in range(GRAM):
            out *= np.roll(_letter((packed >> (21 * (GRAM - 1 - k))) & 0x1FFFFF), GRAM - 1 - k)
        return out

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row per text: the sum of its n-grams' vectors by their counts. The sums are whole and exact."""
        exact = np.float32 if max((int(c.sum()) for _, c in texts if len(c)), default=0) < 1 << 24 else np.float64
        packed = np.concatenate([p for p, _ in texts])
        row = np.repeat(np.arange(len(texts)), [len(p) for p, _ in texts])
        distinct, place = np.unique(packed, return_inverse=True)
        counts = np.concatenate([c for _, c in texts]).astype(exact)
        out = np.zeros((len(texts), DIM), dtype=exact)
        for k in range(0, len(distinct), 4096):
            inside = (place >= k) & (place < k + 4096)
            part = self.of(distinct[k : k + 4096]).astype(exact)
            matrix = np.zeros((len(texts), len(part)), dtype=exact)
            matrix[row[inside], place[inside] - k] = counts[inside]
            out += matrix @ part
        return out.astype(np.float64)


_own: list[Vectors] = []


def _of_worker() -> Vectors:
    if not _own:
        _own.append(Vectors())
    return _own[0]


def _bundle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One bundle per language of a task's rows."""
    vectors, sums, counts = _of_worker(), {}, {}

    def settle(lang):
        held = counts.pop(lang)
        packed = np.fromiter(held.keys(), np.int64, len(held))
        sums[lang] = sums.get(lang, 0) + np.rint(vectors.bundles([(packed, np.fromiter(held.values(), np.int64, len(held)))])[0]).astype(np.int64)

    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=True)["text"]:
            held = counts.setdefault(lang, {})
            for text in rows:
                packed, n = grams(text)
                n = np.rint(WEIGHT * n / max(1.0, float(np.sqrt((n * n).sum())))).astype(np.int64)
                for g, c in zip(packed.tolist(), n.tolist(), strict=True):
                    held[g] = held.get(g, 0) + c
                if len(held) > 2 * GRAMS:
                    settle(lang)
                    held = counts.setdefault(lang, {})
    for lang in list(counts):
        settle(lang)
    if sums:
        yield pd.DataFrame({"lang": list(sums), "bundle": [x.tolist() for x in sums.values()]})


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language of docs (text, lang). Its size is bounded by MAX_LANGUAGES x DIM."""
    bounded_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    parts = rows.mapInPandas(_bundle_rows, "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    by_lang = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("bundle"))
    found = by_lang.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"there are more than {MAX_LANGUAGES} languages; lang does not hold languages")
    return {r["lang"]: np.array(r["bundle"], dtype=np.float64) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    langs = list(prototypes)
    matrix = np.array([v / max(float(np.sqrt(v @ v)), 1e-300) for v in prototypes.values()]).reshape(len(langs), DIM)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors, (langs, matrix) = _of_worker(), shared.value
        for batch in batches:
            out = [(UNKNOWN, 0.0)] * len(batch)
            found = ((k, grams(t)) for k, t in enumerate(batch) if t is not None and langs)
            while chunk := list(islice(((k, g) for k, g in found if len(g[0])), TOGETHER)):
                bundles = vectors.bundles([g for _, g in chunk])
                norms = np.sqrt((bundles * bundles).sum(axis=1))
                cosines = np.round(bundles @ matrix.T / np.maximum(norms, 1e-300)[:, None], 12)
                for (k, _), row in zip(chunk, cosines, strict=True):
                    best = int(np.argmax(row))
                    out[k] = (langs[best], min(1.0, max(0.0, float(row[best]))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    kind = "lang_pred string, score double"
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_found", F.pandas_udf(scored, kind)(F.col(text))).select(*keep, "_found.*")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are not learned from: a fifth of the ids, by CRC-32. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_unheld(docs: DataFrame) -> dict[str, np.ndarray]:
    return learn(docs.where(~held_out()))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose text is in a language: with a letter, and like one of the prototypes."""
    found = predict(docs, learn_unheld(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*docs.columns)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), learn_unheld(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
