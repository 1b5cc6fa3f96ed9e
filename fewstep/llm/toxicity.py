"""Toxicity of texts by a convolutional network over hashed words, trained in numpy.

A word's vector is the sum of the vectors of its hash and of the hashes of its first PREFIXES bytes, so that words of
one stem are alike. Filters of several widths run over the words; each one's largest answer in the text (max
pooling over the whole text, whatever its length) goes into a logistic output. A text's language is guessed from its
words by naive Bayes, and the output is shifted by the language's threshold, so that 0.5 parts the classes in each.

Training takes every labelled text that is not held out, whole. Counts of hashes by label and language are summed by a shuffle. The texts go to
parts of about PART documents and TRAIN_WORDS words; each part trains from the same start in a task of its own, and
the weights that parts changed are averaged by a shuffle, so what comes to the driver and is broadcast is one network, whatever the number of
texts. Only doc_id, text, lang and the label are read for it. A text is scored from its words alone, in its own task; nothing else is shuffled.

Vectors start with the log odds of a hash in the two classes as one component; of a hash that occurs in fewer than two
texts all components stay zero, as do those of unseen ones. A fifth of the texts sets the thresholds (by counts of logits to three digits):
the largest F1, with the labels weighted as in all labelled rows; a language with fewer than LEAST texts of either
label there takes the threshold of all languages, and 0 if that has as few.

A document with several labels has the largest one; labels other than 0 and 1, labels without a document and documents
without a text are not learned from. Without labels of both kinds every score is the share of label 1 (0 without any).
Null texts are scored like empty ones. Repeated rows get equal scores. Columns of the names of the outputs are replaced.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.llm.hashing import blocks, bounded_batches, mixed, words
from fewstep.llm.langid import held_out
from fewstep.plans.storage import Scratch, join_small
from fewstep.sources.tables import table

#: Documents and words (about) that one task trains on.
PART, TRAIN_WORDS = 9000, 1 << 22
#: Labelled documents up to which they are broadcast; above, texts are shuffled to them.
LABELS = 500_000
#: Vectors (one for each bucket of hashes), their components, bytes of the prefixes, filter widths and filters of each.
BUCKETS, DIM, PREFIXES, WIDTHS, FILTERS = 1 << 17, 16, (4, 5, 6), (1, 2, 3), 8
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.05, 4127
#: Texts of either label that a threshold is set from, and languages that have one.
LEAST, LANGUAGES = 20, 32
#: Words that the filters run over at once.
TOGETHER = 1 << 15

_PAD = BUCKETS  # the row of zeros after a text
_KINDS = 1 + len(PREFIXES)
_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word of raw (a row each) and where the words start."""
    hashes, starts, ends = words(raw, _BETWEEN)
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))[starts]
    out = np.empty((len(hashes), _KINDS), dtype=np.int32)
    out[:, 0] = hashes & np.uint64(BUCKETS - 1)
    for k, size in enumerate(PREFIXES):
        begin = eight & _MASKS[np.minimum(ends - starts, size)]
        out[:, k + 1] = mixed(begin * np.uint64(2 * size + 1) + np.uint64(size)) & np.uint64(BUCKETS - 1)
    return out, starts


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The buckets of the words of each text."""
    raws = [b"" if t is None else t.lower().encode("utf-8", "replace") for t in texts]
    for _, group in blocks(raws):
        found, starts = buckets(b" ".join(group))
        ends = np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group]))
        yield from np.split(found, ends[:-1])


@dataclass
class Network:
    """The weights, the languages' tables and thresholds. filters[k]: (WIDTHS[k], DIM, FILTERS)."""

    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: np.ndarray | None = None  # (BUCKETS + 1, languages) log chances of a word's first prefix
    thresholds: np.ndarray | None = None  # of each language and of all
    share: float | None = None  # the answer where nothing could be learned

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = self.vectors[rows[:, 0]]
        for k in range(1, _KINDS):
            out += self.vectors[rows[:, k]]
        return out

    def answers(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        """The filters' answers at each of the first n words of x, which has max(WIDTHS) - 1 rows more."""
        out = []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            found = x[:n] @ weights[0] + bias
            for k in range(1, width):
                found += x[k : n + k] @ weights[k]
            out.append(found)
        return out

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text the largest answer of each filter over all its words; long texts in pieces."""
        out = np.empty((len(texts), len(WIDTHS) * FILTERS), dtype=np.float32)
        for first, group in _groups(texts):
            rows, starts, inside = _padded(group)
            if not isinstance(first, slice):
                inside[TOGETHER:] = False  # the next piece begins there
            answers = self.answers(self.embed(rows), len(rows) - max(WIDTHS) + 1)
            for answer in answers:
                answer[~inside[: len(answer)]] = -np.inf
            found = np.concatenate([np.maximum.reduceat(a, starts) for a in answers], axis=1)
            if isinstance(first, slice):
                out[first] = found
            else:
                k, again = first
                out[k] = np.maximum(out[k], found[0]) if again else found[0]
        return np.maximum(out, 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts) @ self.out + self.bias

    def language(self, text: np.ndarray) -> int:
        """The place of the likeliest language; the place of all languages for a text without words."""
        if self.languages is None or not len(text):
            return -1
        sums = np.zeros(self.languages.shape[1])
        for k in range(0, len(text), TOGETHER):
            sums += self.languages[text[k : k + TOGETHER, 1]].sum(axis=0, dtype=np.float64)
        return int(np.argmax(sums))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        shift = self.thresholds[[self.language(t) for t in texts]] if texts else 0.0
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(texts) - shift, -30, 30))), 6)


def _groups(texts: list[np.ndarray]) -> Iterator[tuple[slice | tuple[int, bool], list[np.ndarray]]]:
    """Texts of up to TOGETHER words together, and longer ones in overlapping pieces (place, whether it goes on)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= TOGETHER:
            size += len(texts[end])
            end += 1
        if end > at:
            yield slice(at, end), texts[at:end]
        else:
            for k in range(0, len(texts[at]), TOGETHER):
                yield (at, k > 0), [texts[at][k : k + TOGETHER + max(WIDTHS) - 1]]
            end = at + 1
        at = end


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all texts with rows of zeros after each, where each starts, and which rows filters may start at."""
    pad = max(WIDTHS) - 1
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(np.maximum(sizes, 1) + pad)
    starts = ends - np.maximum(sizes, 1) - pad
    rows = np.full((int(ends[-1]), _KINDS), _PAD, dtype=np.int32)
    inside = np.zeros(len(rows), dtype=np.bool_)
    for t, at in zip(texts, starts.tolist(), strict=True):
        rows[at : at + len(t)] = t
        inside[at : at + max(1, len(t))] = True
    return rows, starts, inside


def _start(seen: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Network:
    """A network before training: log odds as the first component, small random numbers as the others. seen: texts of either label with each hash; n: texts of either."""
    total = seen.sum(axis=0)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    vectors = np.zeros((BUCKETS + 1, DIM), dtype=np.float32)
    often = total >= 2
    vectors[often, 0] = (np.clip(odds * total / (total + 5), -4, 4) / _KINDS)[often]
    vectors[often, 1:] = rng.normal(0, 0.1 / _KINDS, (int(often.sum()), DIM - 1))
    vectors[_PAD] = 0
    filters = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 1 / len(f)
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    out.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] += 0.3
    return Network(vectors, filters, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], out, -2.0)


class _Steps:
    """Adagrad."""

    def __init__(self):
        self.squares: dict[str, np.ndarray] = {}

    def step(self, name: str, weights: np.ndarray, slope: np.ndarray, rows: np.ndarray | None = None) -> None:
        held = self.squares.setdefault(name, np.full(weights.shape, 1e-4, dtype=np.float32))
        at = slice(None) if rows is None else rows
        held[at] += slope * slope
        weights[at] -= RATE * slope / np.sqrt(held[at])


def _short(text: np.ndarray, net: Network) -> np.ndarray:
    """text, or of one longer than TOGETHER the words that the filters' largest answers come from, apart."""
    if len(text) <= TOGETHER:
        return text
    best, at, pad = np.full(len(WIDTHS) * FILTERS, -np.inf), np.zeros(len(WIDTHS) * FILTERS, dtype=np.int64), max(WIDTHS) - 1
    for k in range(0, len(text), TOGETHER):
        rows, _, _ = _padded([text[k : k + TOGETHER + pad]])
        n = min(TOGETHER, len(text) - k)
        found = np.concatenate([x[:n] for x in net.answers(net.embed(rows), n)], axis=1)
        place = found.argmax(axis=0)
        more = found[place, np.arange(len(place))] > best
        best[more], at[more] = found[place, np.arange(len(place))][more], k + place[more]
    apart = np.full((pad, _KINDS), _PAD, dtype=np.int32)
    return np.concatenate([x for p in np.unique(at) for x in (text[p : p + pad + 1], apart)])


def train(texts: list[np.ndarray], labels: np.ndarray, net: Network) -> Network:
    """Fits net, in place."""
    rng, steps = np.random.Generator(np.random.PCG64(SEED)), _Steps()
    rows_of = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    for _ in range(EPOCHS):
        order = np.array_split(np.array(rows_of), max(1, len(texts) // BATCH))  # texts of like length together
        for batch in (order[k] for k in rng.permutation(len(order))):
            for few in _together([_short(texts[k], net) for k in batch], labels[batch]):
                _learn(net, steps, *few)
    return net


def _together(texts: list[np.ndarray], labels: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """A batch in pieces of about 16 * TOGETHER words."""
    piece = np.cumsum([len(t) for t in texts]) // (16 * TOGETHER)
    for k in np.unique(piece):
        at = np.flatnonzero(piece == k)
        yield [texts[i] for i in at], labels[at]


def _learn(net: Network, steps: _Steps, texts: list[np.ndarray], labels: np.ndarray) -> None:
    rows, starts, inside = _padded(texts)
    x = net.embed(rows)
    answers, places = net.answers(x, len(rows) - max(WIDTHS) + 1), []
    for answer in answers:
        answer[~inside[: len(answer)]] = -np.inf
        places.append(np.stack([s + answer[s : s + max(1, len(t))].argmax(axis=0) for s, t in zip(starts.tolist(), texts, strict=True)]))
    pooled = np.concatenate([np.take_along_axis(a, p, 0) for a, p in zip(answers, places, strict=True)], axis=1)
    hidden = np.maximum(pooled, 0)
    slope = ((1 / (1 + np.exp(-np.clip(hidden @ net.out + net.bias, -30, 30))) - labels) / len(texts)).astype(np.float32)
    back = slope[:, None] * net.out * (pooled > 0)
    steps.step("out", net.out, hidden.T @ slope)
    net.bias -= RATE * float(slope.sum())
    touched, slopes = [], []
    for k, (width, place) in enumerate(zip(WIDTHS, places, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        change = np.empty_like(net.filters[k])
        for o in range(width):
            change[o] = np.einsum("bfe,bf->ef", x[place + o], own)
            slopes.append(np.repeat((own[:, :, None] * net.filters[k][o].T[None]).reshape(-1, DIM), _KINDS, axis=0))
            touched.append(rows[place + o].reshape(-1))
        steps.step(f"f{k}", net.filters[k], change)
        steps.step(f"b{k}", net.biases[k], own.sum(axis=0))
    touched, slopes = np.concatenate(touched), np.concatenate(slopes)
    fine = (touched != _PAD) & (slopes != 0).any(axis=1)
    at, inverse = np.unique(touched[fine], return_inverse=True)
    total = np.zeros((len(at), DIM), dtype=np.float32)
    np.add.at(total, inverse, slopes[fine])
    known = net.vectors[at].any(axis=1)
    steps.step("vectors", net.vectors, total[known], at[known])


def threshold(logits: np.ndarray, labels: np.ndarray, weights: tuple[float, float], times: np.ndarray | None = None) -> float:
    """The middle of the gap between two logits that gives the largest F1, labels weighted by weights. times: how often each logit occurs."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order]
    n = np.ones(len(z)) if times is None else times[order]
    true, false = np.cumsum((y == 1) * n) * weights[1], np.cumsum((y == 0) * n) * weights[0]
    f1 = 2 * true / (true + false + weights[1] * ((y == 1) * n).sum())
    gap = np.append(z[:-1] - z[1:], 1.0)
    f1 = np.where(gap > 0, f1, -1)
    best = int(np.argmax(f1))
    return float(z[best] - gap[best] / 2)


def _flat(net: Network) -> np.ndarray:
    """All weights but the vectors, as rows of DIM."""
    all_ = np.concatenate([*(x.ravel() for x in (*net.filters, *net.biases, net.out)), [net.bias]])
    return np.append(all_, np.zeros(-len(all_) % DIM)).reshape(-1, DIM).astype(np.float32)


def _unflat(net: Network, flat: np.ndarray) -> None:
    at, flat = 0, flat.ravel()
    for x in (*net.filters, *net.biases, net.out):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    net.bias = float(flat[at])


def _counts(rows: DataFrame, langs: list[str]) -> pd.DataFrame:
    """kind, bucket, n: texts of label 0 and 1 (kind 0, 1) with a hash, and words with a first prefix in each language (2 and on); kind -1: all words."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2 + len(langs), BUCKETS + 1))
        of = {x: k + 2 for k, x in enumerate(langs)}
        size = 0
        for batch in batches:
            for label, lang, text in zip(batch["label"], batch["lang"], features(batch["text"].tolist()), strict=True):
                size += len(text)
                seen[int(label), np.unique(text)] += 1
                if lang in of:
                    np.add.at(seen[of[lang]], text[:, 1], 1.0)
        kind, bucket = np.nonzero(seen)
        yield pd.DataFrame({"kind": np.append(kind, -1), "bucket": np.append(bucket, 0), "n": np.append(seen[kind, bucket], size)})

    found = rows.select("label", "lang", "text").mapInPandas(counted, "kind int, bucket int, n double")
    return found.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()


def _averaged(rows: DataFrame, start: Network, parts: int) -> Network:
    """start after training in parts; a weight is the mean of those parts that changed it."""
    shared, columns = rows.sparkSession.sparkContext.broadcast(start), [f"d{k}" for k in range(DIM)]

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat([pd.DataFrame(columns=["place", "lang", "label", "text"]), *batches])
        if not len(part):
            return
        net = copy.deepcopy(shared.value)
        part = part.sort_values(["place", "lang", "text"], ignore_index=True)
        train(list(features(part["text"].tolist())), part["label"].to_numpy(dtype=np.float32), net)
        at = np.flatnonzero((net.vectors != shared.value.vectors).any(axis=1))
        flat = _flat(net)
        out = pd.DataFrame(np.concatenate([net.vectors[at], flat]), columns=columns)
        yield out.assign(key=np.append(at, BUCKETS + 1 + np.arange(len(flat))))

    # each part is a partition: dealt out by a hash of their numbers, several would meet in one task
    dealt = rows.repartitionById(parts, F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int")).select("place", "lang", "label", "text")
    found = dealt.mapInPandas(trained, ", ".join(f"{c} float" for c in columns) + ", key int")
    mean = found.groupBy("key").agg(*(F.avg(c).alias(c) for c in columns)).toPandas().sort_values("key")
    key, values = mean["key"].to_numpy(), mean[columns].to_numpy(dtype=np.float32)
    own = key <= BUCKETS
    start.vectors[key[own]] = values[own]
    _unflat(start, values[~own])
    return start


def _settle(rows: DataFrame, net: Network, counts: tuple[int, int], langs: int) -> np.ndarray:
    """The thresholds of the languages and of all."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(features(batch["text"].tolist()))
            z = np.round(np.clip(shared.value.logits(texts), -60, 60) * 1000) if texts else []
            yield pd.DataFrame({"lang": [shared.value.language(t) for t in texts], "z": z, "label": batch["label"].to_numpy()})

    found = rows.select("label", "text").mapInPandas(judged, "lang int, z int, label int").groupBy("lang", "z", "label").agg(F.count("*").alias("n")).toPandas()
    found = found.sort_values(["z", "label", "lang"], ignore_index=True)
    z, y, n, of = found["z"].to_numpy() / 1000, found["label"].to_numpy(), found["n"].to_numpy(), found["lang"].to_numpy()
    weights = tuple(counts[k] / max(1, int(n[y == k].sum())) for k in (0, 1))

    def settled(at: np.ndarray, other: float) -> float:
        enough = all(int(n[at & (y == k)].sum()) >= LEAST for k in (0, 1))
        return threshold(z[at], y[at], weights, n[at]) if enough else other

    common = settled(np.ones(len(y), dtype=np.bool_), 0.0)
    return np.array([*(settled(of == k, common) for k in range(langs)), common])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network:
    """docs: doc_id, text, lang; labels: doc_id and a label 0 or 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("place", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = (counts.get(0, 0), counts.get(1, 0))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # texts and not their buckets are written and shuffled: those are several times larger
    rows = scratch.stash(join_small(texts, known, "doc_id", rows=LABELS).select("place", "label", "lang", "text"))
    fitted, aside = rows.where("place % 5 <> 0"), rows.where("place % 5 = 0")
    of = {r["label"]: r for r in fitted.groupBy("label").agg(F.count("*").alias("texts")).collect()}
    if len(of) < 2:
        scratch.drop(rows)
        return Network(np.zeros((0, DIM)), [], [], np.zeros(0), 0.0, share=counts[1] / max(1, sum(counts)))
    langs = [r["lang"] for r in fitted.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    found = _counts(fitted, langs)
    seen = np.zeros((2 + len(langs), BUCKETS + 1))
    size, found = int(found.loc[found["kind"] < 0, "n"].sum()), found[found["kind"] >= 0]
    seen[found["kind"], found["bucket"]] = found["n"]
    start = _start(seen[:2], np.array([of[k]["texts"] for k in (0, 1)]), np.random.Generator(np.random.PCG64(SEED)))
    n = sum(r["texts"] for r in of.values())
    net = _averaged(fitted, start, max(1, -(-n // PART), -(-size // TRAIN_WORDS)))
    if langs:
        chances = seen[2:].T + 0.1
        net.languages = np.log(chances / chances.sum(axis=0)).astype(np.float32)
    net.thresholds = _settle(aside, net, counts, len(langs))
    scratch.drop(rows)
    return net


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(list(features(batch.tolist()))), dtype="float64")

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.withColumn("score", F.pandas_udf(scored, "double")(F.col(text))).select(*keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = learn(docs.select("doc_id", "text", "lang"), labels.where(~held_out()).select("doc_id", "toxic"))
    return score(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
