"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fewstep.llm import registry, tandem, toxicity, trie

# 11


def _texts(rng, n, marks):
    """Prose of invented words; label 1 has marks. Some labels are wrong."""
    rows = []
    for k in range(n):
        lang, bad = ("en", "de")[k % 2], k % 5 == 0
        words = [("t" if lang == "en" else "sch") + "".join(rng.choice("aeioulnr") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(20, 90))]
        if bad:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(marks[lang]) + ("" if lang == "en" else rng.choice(["en", "ig", "heit", "er"]))
        rows.append((k, " ".join(words), lang, int(bad) if rng.random() > 0.01 else 1 - int(bad)))
    return rows


MARKS = {"en": ["idiot", "scum", "moron"], "de": ["lostra", "lowei"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = _texts(random.Random(3), 900, MARKS)
    docs = spark.createDataFrame([(k, t, lang, "src", 7) for k, t, lang, _ in rows], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(k, y) for k, _, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels


@pytest.fixture(scope="module")
def net(labelled):
    _, docs, labels = labelled
    return toxicity.learn(docs, labels.where(~toxicity.held_out()))


def test_toxicity_on_held_out_rows(spark, labelled, net):
    rows, docs, _ = labelled
    truth = {k: any(m in t for m in MARKS[lang]) for k, t, lang, _ in rows}
    out = toxicity.score(docs, net)
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "predicted"]
    got = {r["doc_id"]: r["predicted"] for r in out.withColumn("h", toxicity.held_out()).where("h").collect()}
    assert 100 < len(got) and sum(got[k] == truth[k] for k in got) >= 0.97 * len(got)
    assert sum(got[k] for k in got if not truth[k]) <= 0.02 * len(got)


def test_toxicity_learns_from_every_text(spark, labelled, monkeypatch):
    rows, docs, labels = labelled
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 16_000)  # less than the texts have
    net = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    places = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)).alias("p")).collect()}
    seen = np.zeros(toxicity.BUCKETS + 1, dtype=int)
    for k, t, _, _ in rows:
        if zlib.crc32(str(k).encode()) % 5 and places[k] % 5:
            seen[np.unique(next(toxicity.features([t])))] += 1
    assert net.vectors[seen >= 2].any(axis=1).all() and not net.vectors[seen < 2].any()
    truth = {k: any(m in t for m in MARKS[lang]) for k, t, lang, _ in rows}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, net).where(toxicity.held_out()).collect()}
    assert sum(got[k] == truth[k] for k in got) >= 0.95 * len(got)


def test_toxicity_of_odd_texts(spark, net):
    long = "tale " * 70_000 + "scum idiot moron"
    odd = [(1, None), (2, ""), (3, "\n \t"), (4, "!!!"), (5, long), (6, "tale " * 70_000), (7, "scum"), (7, "scum"), (None, "İ\udcff".encode("utf-8", "replace").decode())]
    rows = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), net).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] == by[3] == by[4] and by[5] > 0.5 > by[6]  # a long text is read to its end
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0


def test_toxicity_reads_pieces_like_wholes(net, monkeypatch):
    texts = list(toxicity.features([" ".join(random.Random(k).choices(["tale", "scum", "toru", "tin"], k=k)) for k in range(60)]))
    whole = net.scores(texts)
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    assert np.allclose(net.scores(texts), whole, atol=2e-6)


def test_toxicity_without_labels(spark, labelled):
    _, docs, labels = labelled
    for given_, share in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.0)):
        found = toxicity.score(docs.limit(5), toxicity.learn(docs, given_)).select("score").distinct().collect()
        assert [r[0] for r in found] == [share]


def test_threshold_takes_the_widest_gap():
    z, y = np.array([5.0, 4.0, 1.0, -2.0]), np.array([1, 1, 0, 0])
    assert toxicity.threshold(z, y, (1.0, 1.0)) == 2.5
    assert toxicity.threshold(np.array([1.0, 1.0]), np.array([1, 0]), (1.0, 1.0)) == 0.5  # equal logits stay together


# 12


def _rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def _trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len(t.split()) if t.isascii() else len([w for w in t.split(" ") if w])
    own = {p: (len(m) - 1) * (words(p[-1][1]) if p else 0) for p, m in nodes.items()}
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    rows = set()
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        rows.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), sum(own[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def _conversations(rng, n, vocabulary):
    rows, convs = [], {}
    for c in range(n):
        turns = [(("user", "bot")[k % 2], rng.choice(vocabulary)) for k in range(rng.randint(1, 5))]
        convs[c] = turns
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    for c in range(n, n + 60):  # many copies of one conversation
        convs[c] = [("user", "hello there"), ("bot", "yes")]
        rows += [(c, 0, "user", "hello there"), (c, 1, "bot", "yes")]
    rng.shuffle(rows)
    return rows, convs


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_trie(spark, tasks):
    rows, convs = _conversations(random.Random(tasks), 90, ["a b", "a b c", "hello there", "", "yes"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.sequences(spark.createDataFrame(rows, SCHEMA))
        assert {tuple(r) for r in trie.trie(found).collect()} == _trie(convs)
        got = trie.trie(trie.rebuilt(found)).collect()
        want = _trie(_rebuilt(convs))
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    odd = [(None, 0, "user", "gone"), (1, None, None, None), (1, None, "", ""), (1, 5, "x", "late"), (2, 1, "", ""), (2, 1, "", ""), (3, 0, "u", "w " * 50_000), (-7, 0, "u", "n")]
    extra = spark.createDataFrame([(*r, "clash") for r in odd], SCHEMA + ", words string")
    got = {tuple(r) for r in trie.trie(trie.sequences(extra)).collect()}
    assert got == _trie({1: [("", ""), ("", ""), ("x", "late")], 2: [("", ""), ("", "")], 3: [("u", "w " * 50_000)], -7: [("u", "n")]})
    assert trie.trie(trie.sequences(extra.limit(0))).count() == 0
    for ties in (odd, odd[::-1]):  # turns of one number come in an order of their own
        rows = [(9, 0, r, t) for _, _, r, t in ties]
        assert trie.trie(trie.sequences(spark.createDataFrame(rows, SCHEMA))).count() == len(rows) + 1


def test_trie_sql(spark, tmp_path):
    rows, convs = _conversations(random.Random(8), 50, ["a b", "c", "hello there"])
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    found = con.sql(registry.ORACLE_SQL["op12_conversation_trie"])
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == order and set(found.fetchall()) == _trie(_rebuilt(convs))


# 13


def _runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(24, 3 * q) and not any(all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _described(w):
    found = _runs(w)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    own = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


@st.composite
def _periodic(draw):
    parts = []
    for _ in range(draw(st.integers(1, 4))):
        base = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 30]))), min_size=1, max_size=11))
        parts += (base * 60)[: draw(st.integers(1, 70))]
    return parts


@settings(max_examples=150, deadline=None)
@given(_periodic())
def test_runs(numbers):
    w = [str(x).encode() for x in numbers]
    assert tandem.found_runs([w, w[::-1], w]) == [_runs(w), _runs(w[::-1]), _runs(w)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_squares(w):
    want = set()
    for k in range(1, len(w) // 2 + 1):
        for i in range(len(w) - 2 * k + 1):
            half = w[i : i + k]
            if half == w[i + k : i + 2 * k] and not any(k % p == 0 and half == half[:p] * (k // p) for p in range(1, k)):
                want.add((k, i))
    got = tandem.squares(np.array([*w, 9]))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_periodic_runs_of_documents(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(40)}"
    texts = [None, "", " \t\n", "one", "a " * 30, ("x y z " * 20) + "tail", "é\x85 " * 40, "a b " * 26, " ".join(word() for _ in range(300)), "t\x1cu " * 30]
    texts += [" ".join(["p q"] * 13 + ["r"] + ["p q"] * 13), ("long run of words " * 9000)]
    rows = [(k, t) for k, t in enumerate(texts * 4)] + [(None, "a " * 30)] * 2
    monkeypatch.setattr(tandem, "TOGETHER", 64)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, period string")
    for rebuild in (False, True):
        out = tandem.periodic_runs(docs, rebuild=rebuild).drop("text")
        want = []
        for k, t in rows:
            w = (t or "").encode().split()
            if rebuild and k is not None and w and zlib.crc32(str(k).encode()) % 10 == 0:
                g = zlib.crc32(str(k).encode()) // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            if len(w) > 5000:  # too long for the brute force
                want.append((k, None))
            else:
                want.append((k, *_described(w)))
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want)
        short = {x for x in want if len(x) > 2}
        assert short <= set(got) and len({g[0] for g in got} - {x[0] for x in short}) == len({x[0] for x in want if len(x) == 2})
    assert tandem.periodic_runs(docs.limit(0)).count() == 0
    long = [r for r in tandem.periodic_runs(docs).where("doc_id = 11").collect()]
    assert (long[0]["start"], long[0]["length"], long[0]["period"], long[0]["exponent_milli"]) == (0, 36_000, 4, 9_000_000)


def test_a_round_of_near_copies_shuffles_the_sets_of_its_pairs_only(spark, monkeypatch):
    """Late rounds test few documents; the sets of all others stay where they are."""
    from fewstep.llm import neardup

    word = lambda k: f"w{k}"
    rows = []
    for g in range(60):  # copies with a word changed; some groups have a third one that only the second resembles
        text = [word(g * 1000 + k) for k in range(60)]
        second = text[:5] + ["x"] + text[6:]
        rows += [(g * 3, " ".join(text)), (g * 3 + 1, " ".join(second)), (g * 3 + 2, " ".join(second[:40] + ["y"] + second[41:]))]
    docs = spark.createDataFrame(rows, "id long, text string")
    kept, join_small = [], neardup.join_small

    def counted(big, small, on, how="inner", rows=None):
        out = join_small(big, small, on, how, rows=rows)
        kept.append((out.count(), big.count()))
        return out

    monkeypatch.setattr(neardup, "join_small", counted)
    found = {r["id"]: r["component_id"] for r in neardup.classes(docs, 2).collect()}
    assert found == {g * 3 + k: g * 3 for g in range(60) for k in range(3)}
    rounds = kept[1:]  # the first call picks the documents whose sets are made
    assert len(rounds) >= 2 and min(few for few, _ in rounds) < rounds[0][1]


def test_toxicity_keeps_texts_and_not_buckets(spark, monkeypatch):
    kept, stash = [], toxicity.Scratch.stash
    monkeypatch.setattr(toxicity.Scratch, "stash", lambda self, df, *rest: kept.append(df.columns) or stash(self, df, *rest))
    docs = spark.createDataFrame([(k, "some words here", "en") for k in range(9)], "doc_id long, text string, lang string")
    toxicity.learn(docs, spark.createDataFrame([(k, 0) for k in range(9)], "doc_id long, toxic int"))
    assert kept == [["place", "label", "lang", "text"]]
