"""Operators against brute force: the index, merged lists, waves, tiles, postings, phrases, prefixes, methods, the engine."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewstep.operators import cells, evaluate, explain, features, merge, pairwise, phrases, postings, rank, retrieve, score, waves
from fewstep.plans.config import RunConfig
from fewstep.sources import records
from fewstep.streaming import limited


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _frame(spark, vectors):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def grouped():
    """600 vectors around 12 centres in 16 dimensions."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    return _unit(centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.25)


def _nearest(vectors, k):
    sims = np.round(vectors @ vectors.T, 6)
    return {(t, s, sims[t, s], r + 1) for t in range(len(vectors)) for r, s in enumerate(sorted((j for j in range(len(vectors)) if j != t), key=lambda j: (-sims[t, j], j))[:k])}


def test_cell_index(spark, grouped, tmp_path, monkeypatch):
    rows = _frame(spark, grouped)
    monkeypatch.setattr(cells, "PIECE", 50)  # full cells are cut into pieces
    index = cells.build(rows, cells=12, parts=8)
    want = _nearest(grouped, 5)
    found = cells.search(rows, index, 5, probes=2)
    assert {(r["t"], r["s"], r["score"], r["rank"]) for r in found.collect()} == want
    read = cells.read_share(rows, index, found.where("rank = 5")).first()
    assert read["vectors"] < 0.1 * read["pairs"] and read["codes"] < 0.5 * read["pairs"]
    few = cells.search(rows, index, 5, probes=2, certified=False)
    hits = {(r["t"], r["s"]) for r in few.collect()} & {(t, s) for t, s, _, _ in want}
    assert len(hits) >= 0.9 * len(want)
    assert cells.audit(index, 5, 2, queries=50) >= 0.9
    cells.save(index, str(tmp_path / "index"))
    again = cells.search(rows.where("id < 40"), cells.load(spark, str(tmp_path / "index")), 5)
    assert {(r["t"], r["s"], r["score"], r["rank"]) for r in again.collect()} == {x for x in want if x[0] < 40}


def test_cell_index_of_little(spark):
    rows = _frame(spark, _unit(np.array([[1.0, 0, 0], [1, 0, 0], [0, 1, 0]])))
    got = {(r["t"], r["s"]) for r in cells.search(rows, cells.build(rows), 5).collect()}
    assert got == {(t, s) for t in range(3) for s in range(3) if t != s}
    with pytest.raises(ValueError, match="no vectors"):
        cells.build(rows.where("id < 0"))


def test_hybrid_top(spark, grouped):
    a, b = grouped[:200], _unit(grouped[:200, ::-1] + grouped[200:400])
    sims = np.round(np.round(a @ a.T, 6) * 0.6 + np.round(b @ b.T, 6) * 0.4, 6)
    want = {(t, s, r + 1) for t in range(200) for r, s in enumerate(sorted((j for j in range(200) if j != t), key=lambda j: (-sims[t, j], j))[:3])}
    seen = []
    one, other = cells.build(_frame(spark, a), cells=8, parts=8), cells.build(_frame(spark, b), cells=8, parts=8)
    got = merge.hybrid_top(one, other, 3, 0.6, depth=8, seen=seen)
    assert {(r["t"], r["s"], r["rank"]) for r in got.collect()} == want
    assert seen[0][0] == 200 and seen[-1][0] < 200 and seen[0][1] < 0.15 * 200 * 199  # targets leave, and no round forms all pairs
    some = merge.hybrid_top(one, other, 3, 0.6, targets=spark.createDataFrame([(5,), (7,)], "id long"))
    assert {(r["t"], r["s"], r["rank"]) for r in some.collect()} == {x for x in want if x[0] in (5, 7)}


def test_waves(spark, grouped, monkeypatch):
    monkeypatch.setattr(waves, "PIECE", 40)
    close = np.vstack([grouped, grouped[:6]])
    sims = np.round(close @ close.T, 6)
    want = sorted(((-sims[i, j], i, j) for i, j in itertools.combinations(range(len(close)), 2)))[:6]
    log = []
    got = [(-r["sim"], r["i"], r["j"]) for r in waves.top_pairs(_frame(spark, close), 6, blocks=36, log=log).collect()]
    assert sorted(got) == want and log[0][1] > 100  # block pairs that are skipped for good
    one = waves.top_pairs(_frame(spark, close[:1]), 3)
    assert one.count() == 0


def _lines(spark, rng, sizes):
    rows = [(d, x, f"{d}{x}{k}", _unit(rng.normal(size=(1, 6)))[0].tolist()) for d, (a, b) in enumerate(sizes) for x, n in (("ingr", a), ("instr", b)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc long, section string, line string, vec array<double>")


def _best(rows):
    by = {}
    for d, x, line, v in rows:
        by.setdefault((d, x), []).append((line, np.array(v)))
    return {(t, s, x, line): round(max(float(v @ w) for _, w in by[s, x]), 6) for (t, x), own in by.items() for line, v in own for (s, y) in by if y == x and s != t}


@pytest.mark.parametrize("size", [4, 1000])  # documents split over blocks, and all in one
def test_tiles(spark, size):
    rows, lines = _lines(spark, np.random.default_rng(7), [(3, 9), (1, 4), (0, 5), (6, 0), (2, 2)])
    want = _best(rows)
    got = {(r["t"], r["s"], r["section"], r["line"]): r["best"] for r in pairwise.best_matches(lines, size).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    sums = {(r["t"], r["s"], r["section"]): (r["n"], r["total"], list(r["hard"])) for r in pairwise.line_sums(lines, [0.2, 0.6], size).collect()}
    for key in {k[:3] for k in want}:
        own = [v for k, v in want.items() if k[:3] == key]
        assert sums[key] == (len(own), sum(round(v * 1e6) for v in own), [sum(v >= x for v in own) for x in (0.2, 0.6)])


def test_top_documents(spark):
    rows, lines = _lines(spark, np.random.default_rng(8), [(k % 4, 1 + k % 5) for k in range(24)])
    all_of_them = pairwise.line_jaccard(pairwise.line_sums(lines, [0.7]), lines).where("t < s").collect()
    want = sorted((-r["jaccard_overall"], r["t"], r["s"]) for r in all_of_them)[:7]
    log = []
    got = waves.top_documents(lines, 7, 0.7, log).collect()
    assert sorted((-r["jaccard_overall"], r["t"], r["s"]) for r in got) == want and log


def test_credited_prefixes_lose_nothing(spark):
    rng = random.Random(2)
    sets = sorted({(r, rng.randrange(25)) for r in range(60) for _ in range(rng.randint(1, 6))})
    near = [(f, g, round(rng.uniform(0.5, 1), 2)) for f in range(25) for g in rng.sample(range(25), 3) if f != g]
    heads = spark.createDataFrame(sets, "recipe long, feat long")
    edges = spark.createDataFrame(near, "feat long, neighbour long, sim double")
    h = features.weighted(heads, features.idf(heads))
    full = {(r["t"], r["s"]): r["recall"] for r in score.soft_recall(heads, h, edges).collect()}
    for least in (0.3, 0.55, 0.9, 1.0):
        got = {(r["t"], r["s"]): r["recall"] for r in score.soft_recall(heads, h, edges, least_recall=least).collect()}
        assert got == pytest.approx({k: v for k, v in full.items() if v >= least}, abs=1e-6)
    joined = score.credited_prefixes(h, edges, 0.9).join(heads.withColumnRenamed("feat", "token"), "token").count()
    spread = heads.withColumnRenamed("feat", "token").join(edges.select(F.col("neighbour").alias("token"), "feat"), "token").select("recipe", "feat").union(heads).join(heads.withColumnRenamed("recipe", "x"), "feat").count()
    assert joined < spread / 3


def test_soft_pairs_are_met_once(spark):
    rng = random.Random(5)
    sets = sorted({(r, rng.randrange(30)) for r in range(70) for _ in range(rng.randint(1, 6))})
    near = [(f, g, round(rng.uniform(0.5, 1), 2)) for f in range(30) for g in rng.sample(range(30), 3) if f != g]
    heads = spark.createDataFrame(sets, "recipe long, feat long")
    edges = spark.createDataFrame(near, "feat long, neighbour long, sim double")
    h = features.weighted(heads, features.idf(heads))
    w, of = {r["feat"]: r["w"] for r in h.collect()}, {}
    for r, f in sets:
        of.setdefault(r, set()).add(f)
    credit = {}
    for f, g, sim in near:
        credit.setdefault(f, []).append((g, sim**2))
    for recall, precision, size in ((0.3, 0.0, 200), (0.55, 0.55, 1 << 20)):  # several slices, and one
        want = {}
        for t in of:
            for s in of:
                earned = sum(w[f] * (1 if f in of[s] else max((c for g, c in credit.get(f, []) if g in of[s]), default=0)) for f in of[t])
                got = round(earned / sum(w[f] for f in of[t]), 6), sum(w[f] for f in of[t] & of[s])
                if t != s and got[0] >= recall and round(got[1] / sum(w[f] for f in of[s]), 6) >= precision:
                    want[t, s] = got
        pairs = score.soft_met(heads, h, edges, recall, precision, slice_rows=size)
        rows = pairs.collect()
        assert len(rows) == len(want)  # no pair twice
        assert {(r["t"], r["s"]): (r["recall"], pytest.approx(r["common"])) for r in rows} == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # pairs are neither looked up nor made distinct


@pytest.mark.parametrize("bucket", [2.0, 0.3])  # all rows in one bucket, and many buckets
def test_lsh_pairs_in_blocks(spark, bucket):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = np.random.default_rng(11).normal(size=(90, 8))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    v[50] = v[3]
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>")
    data = rows.select("id", array_to_vector("vec").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=4, seed=7).fit(data)
    joined = model.approxSimilarityJoin(data, data, 0.9, "distance").where("datasetA.id < datasetB.id")
    want = {(r[0], r[1]): r[2] for r in joined.select("datasetA.id", "datasetB.id", "distance").collect()}
    pairs = retrieve.lsh_pairs(rows, 0.9, bucket=bucket, block=7)
    got = pairs.collect()
    assert len(got) == len(want) and {(r["i"], r["j"]): r["distance"] for r in got} == pytest.approx(want, abs=1e-6)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString() or bucket < 1  # no pair is a row of a join


def test_postings(spark, tmp_path):
    rng = random.Random(3)
    rows = {(rng.randrange(400), rng.randrange(6)) for _ in range(900)} | {(k, 9) for k in range(400)}
    sets = spark.createDataFrame(sorted(rows), "recipe long, feat long")
    lists = postings.build(sets, 32)
    assert lists.agg(F.max("n")).first()[0] == 32
    assert {(r["recipe"], r["feat"]) for r in postings.expand(lists).collect()} == rows
    postings.write(lists, str(tmp_path / "p"))
    lists = spark.read.parquet(str(tmp_path / "p"))
    assert {(r["recipe"], r["feat"]) for r in postings.between(lists, 30, 70).collect()} == {x for x in rows if 30 <= x[0] <= 70}
    asked = spark.createDataFrame([("a", 9), ("a", 1), ("a", 2), ("b", 3), ("c", 77), ("c", 1)], "query string, feat long")
    has = lambda f: {r for r, g in rows if g == f}
    want = {("a", r) for r in has(9) & has(1) & has(2)} | {("b", r) for r in has(3)}
    assert {(r["query"], r["recipe"]) for r in postings.having_all(lists, asked).collect()} == want
    met = {(r["t"], r["s"]): r["met"] for r in postings.candidates(spark.createDataFrame([(5, 1), (5, 2)], "t long, feat long"), lists).collect()}
    assert met == {(5, s): (s in has(1)) + (s in has(2)) for s in (has(1) | has(2)) - {5}}


def test_phrases(spark):
    entries = [("Sour cream", "cream"), ("sour", "acid"), ("cream cheese", "cheese"), ("cream", "cream"), ("Olive  OIL!", "oil"), ("", "none"), ("olive oil", "zz"), ("x", None)]
    known = phrases.dictionary(spark.createDataFrame(entries, "phrase string, canonical string"))
    texts = [(1, "Sour cream cheese and olive-oil"), (2, "sour olives"), (3, None), (4, ""), (5, "nothing"), (6, "cream " * 3)]
    got = {r["id"]: [(x["at"], x["size"], x["canonical"]) for x in r["found"]] for r in phrases.match(spark.createDataFrame(texts, "id long, text string"), "id", "text", known).collect()}
    assert got == {1: [(0, 2, "cream"), (4, 2, "oil")], 2: [(0, 1, "acid")], 6: [(0, 1, "cream"), (1, 1, "cream"), (2, 1, "cream")]}
    assert phrases.match(spark.createDataFrame(texts, "id long, text string"), "id", "text", known.limit(0)).count() == 0


def test_canonical_heads_and_techniques(spark):
    known = phrases.dictionary(spark.createDataFrame([("spring onion", "scallion"), ("onion", "onion"), ("cream cheese", "soft cheese")], "phrase string, canonical string"))
    lines = [(1, "2 chopped spring onion (fresh)"), (2, "1 onion"), (3, "3 cups cream cheese, softened"), (4, "2 eggs"), (5, "7"), (6, None)]
    got = dict(map(tuple, phrases.canonical_heads(spark.createDataFrame(lines, "id long, line string"), "id", "line", known).collect()))
    assert got == {1: "scallion", 2: "onion", 3: "soft cheese", 4: "egg", 5: None, 6: None}
    acts = phrases.dictionary(spark.createDataFrame([("bring to a boil", "boil"), ("boil", "boil"), ("stir fry", "stir-fry"), ("stir", "stir"), ("fry", "fry")], "phrase string, canonical string"))
    texts = [(1, "Stir fry, then bring to a boil."), (2, "Stir. Fry?"), (3, None)]
    got = {r[0]: r[1] for r in phrases.techniques_in(spark.createDataFrame(texts, "id long, text string"), "id", "text", acts).collect()}
    assert got == {1: ["boil", "stir-fry"], 2: ["stir-fry"], 3: []}


def test_explained(spark):
    heads = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (1, 12, 3.0), (2, 11, 1.0), (2, 20, 4.0), (2, 21, 5.0), (3, 10, 2.0)], "recipe long, feat long, w double")
    ops = spark.createDataFrame([(1, "bake", 1.0), (2, "fry", 2.0), (2, "bake", 1.0)], "recipe long, feat string, w double")
    near = spark.createDataFrame([(12, 20, 0.9), (12, 21, 0.8), (10, 99, 0.99), (11, 20, 0.7)], "feat long, neighbour long, sim double")
    pairs = spark.createDataFrame([(1, 2, 0.125, 0.8824), (2, 1, 0.5, 0.6), (3, 9, 0.5, 0.6)], "t long, s long, switch_cost double, edit_score double")
    rows = {(r["t"], r["s"]): r for r in explain.explained(pairs, heads, ops, near).withColumn("said", explain.full_sentence(F.lit("T"), F.lit("S"))).withColumn("asked", explain.full_prompt(F.lit("T"), F.lit("S"))).collect()}
    one = rows[1, 2]
    assert [(x["feat"], round(x["w"], 6)) for x in one["missing_heads"]] == [(10, 2.0), (12, 0.57)]  # 3 * (1 - 0.9 ** 2)
    assert [(x["feat"], x["neighbour"], x["sim"]) for x in one["swaps"]] == [(12, 20, 0.9)]
    assert [x["feat"] for x in one["extra_heads"]] == [21, 20] and [x["feat"] for x in one["extra_ops"]] == ["fry"] and not one["missing_ops"]
    assert one["said"] == "From S to T: add 10 and 12; swap 20 for 12; remove/skip 21 and 20; remove op(s): fry (switch_cost=0.13, edit_score=0.882)."
    assert "Swaps: 20 for 12" in json.loads(one["asked"])[1]["content"]
    assert [x["feat"] for x in rows[3, 9]["missing_heads"]] == [10] and not rows[3, 9]["extra_heads"]  # a source that is not there


def test_importance(spark):
    weighed = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 2.0)], "recipe long, feat long, w double")
    share = spark.createDataFrame([(1, 1, 0.5)], "recipe long, feat long, importance double")
    got = {(r["recipe"], r["feat"]): r["w"] for r in features.by_importance(weighed, share).collect()}
    assert got == pytest.approx({(1, 1): 2 / 3, (1, 2): 4 / 3, (2, 1): 1.0})


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([(1, 2, 1, 0.1), (1, 3, 2, 0.2), (2, 3, 1, 0.3)], "t long, s long, rank int, switch_cost double")
    audit = spark.createDataFrame([("r", ["ingredients"])], "recipe_id string, warnings array<string>")
    records.write_rankings(run, run, audit, str(tmp_path / "run"))
    lines = [json.loads(x) for x in spark.read.text(str(tmp_path / "run/targets_to_sources.jsonl")).toPandas()["value"]]
    assert {x["query_id"]: [y["other_id"] for y in x["results"]] for x in lines} == {1: [2, 3], 2: [3]}
    back = [json.loads(x) for x in spark.read.text(str(tmp_path / "run/sources_to_targets.jsonl")).toPandas()["value"]]
    assert {x["query_id"]: sorted(y["other_id"] for y in x["results"]) for x in back} == {2: [1], 3: [1, 2]}
    assert spark.read.option("header", True).csv(str(tmp_path / "run/sources_to_targets.csv")).count() == 3
    summary = spark.createDataFrame([("a", 1.5, 2), ("b", None, 3)], "method string, mean double, n int")
    records.write_summary(summary, "method", str(tmp_path / "sum"))
    assert json.loads(spark.read.text(str(tmp_path / "sum")).first()[0]) == {"a": {"mean": 1.5, "n": 2}, "b": {"n": 3}}
    records.write_enriched(run.withColumn("said", F.lit('add "x", skip y')), "said", str(tmp_path / "rich"))
    rich = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "rich/texts.csv")).collect()
    assert [(r["query_id"], r["other_id"], r["said"]) for r in rich] == [("1", "2", 'add "x", skip y'), ("1", "3", 'add "x", skip y'), ("2", "3", 'add "x", skip y')]
    (tmp_path / "titles.json").write_text('["zero", "one", null]')
    titles = records.read_positions(spark, str(tmp_path / "titles.json"), "title")
    named = {(r["t"], r["s"]): (r["title"], r["id"]) for r in records.with_names(records.with_names(run, "t", titles, "title", ""), "s", None, "id").collect()}
    assert named == {(1, 2): ("one", "2"), (1, 3): ("one", "3"), (2, 3): ("", "3")}
    records.write_matrix(spark.createDataFrame([(0, 1, 0.5), (0, 0, 1.0), (1, 0, 0.5), (1, 1, 1.0)], "i int, j int, sim double"), str(tmp_path / "matrix"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "matrix")).collect()] == ["1.0,0.5", "0.5,1.0"]
    old, new = run.where("rank = 1"), spark.createDataFrame([(1, 2), (2, 9)], "t long, s long")
    assert [(r["t"], r["s"]) for r in evaluate.kept_first(old, new).collect()] == [(1, 2)]


def test_fallback_for_targets_without_candidates(spark):
    recipes = spark.createDataFrame([(k,) for k in range(7)], "recipe long")
    some = spark.createDataFrame([(t, 0) for t in range(1, 5)] + [(0, 1)], "t long, s long")
    got = {(r["t"], r["s"]) for r in retrieve.with_fallback(some, recipes, 2).collect()}
    assert got == {(t, 0) for t in range(1, 5)} | {(0, 1)} | {(t, s) for t in (5, 6) for s in range(7) if s != t}


def test_nearest_recipes_share_vectors(spark):
    vectors = _unit(np.random.default_rng(5).normal(size=(9, 4)))
    owner = {r: (r * r) % 8 for r in range(40)}
    recipes = spark.createDataFrame(list(owner.items()), "recipe long, id long")
    got = {(r["t"], r["s"], r["rank"]) for r in retrieve.nearest_recipes(recipes, _frame(spark, vectors), 4).collect()}
    sims = np.round(vectors @ vectors.T, 6)
    order = lambda t: sorted((s for s in owner if s != t), key=lambda s: (-sims[owner[t], owner[s]], owner[s], s))[:4]
    assert got == {(t, s, k + 1) for t in owner for k, s in enumerate(order(t))}


def test_jaccard_by_sets(spark):
    rng = random.Random(9)
    kinds = [sorted(rng.sample(range(8), rng.randint(1, 4))) for _ in range(9)]
    sets = spark.createDataFrame([(r, f) for r in range(60) for f in kinds[rng.randrange(9)]], "recipe long, feat long")
    weighed = features.weighted(sets, features.idf(sets))
    for rare in (None, 1, 2):
        want = retrieve.top_k(retrieve.weighted_jaccard(weighed, rare), 4).select("t", "s", "score", "rank")
        assert sorted(map(tuple, retrieve.jaccard_by_sets(weighed, rare, 4).collect())) == sorted(map(tuple, want.collect()))


def _scored(spark):
    rng = random.Random(6)
    rows = [(t, s, round(rng.random(), 3), round(rng.random() / 3, 3), round(rng.random(), 3) if rng.random() < 0.9 else None) for t in range(20) for s in range(6)]
    return rows, spark.createDataFrame(rows, "t long, s long, edit_score double, switch_cost double, sim double")


def test_sweep(spark):
    rows, pairs = _scored(spark)
    settings = [{"least": x, "most": y} for x in (0.1, 0.5, 0.95) for y in (0.1, 0.3)]
    tests = [(F.col("edit_score") >= p["least"]) & (F.col("switch_cost") <= p["most"]) for p in settings]
    got = {(r["least"], r["most"]): (r["targets"], r["mean_switch_cost"]) for r in evaluate.sweep_summary(pairs, settings, tests, ["switch_cost"]).collect()}
    top = evaluate.ranked_by_setting(pairs, tests, 1).collect()
    for k, p in enumerate(settings):
        first = {}
        for t, s, e, c, sim in sorted((r for r in rows if r[2] >= p["least"] and r[3] <= p["most"]), key=lambda r: (r[0], -r[2], r[3], r[4] is None, -(r[4] or 0), r[1])):
            first.setdefault(t, (s, c))
        n, mean = got[p["least"], p["most"]]
        assert n == len(first) and (not first or mean == pytest.approx(sum(c for _, c in first.values()) / n, abs=6e-4))
        assert {(r["t"], r["s"]) for r in top if r["setting"] == k} == {(t, s) for t, (s, _) in first.items()}
    with pytest.raises(ValueError):
        evaluate.marked(pairs, [])


def test_limited_stream_goes_on_after_a_crash(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):  # every second line parses
        (folder / f"{k}.txt").write_text("\n".join(f'{{"id":"{k}-{n}"}}' if n % 2 else "broken" for n in range(8)) + "\n")
    parse = lambda df: df.withColumn("id", F.get_json_object("value", "$.id")).where("id IS NOT NULL").select("id", "file", "place")
    out, counters, checkpoint = (str(tmp_path / x) for x in ("out", "counters", "checkpoint"))

    def run(after=None):
        limited.take(limited.lines(spark, str(folder), 2), parse, 10, out, counters, checkpoint, after).awaitTermination()

    def crash(n):
        if n == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(crash)
    assert limited.counted(spark, counters).agg(F.sum("written")).first()[0] == 8
    run()
    rows = sorted(map(tuple, limited.counted(spark, counters).collect()))
    assert [(r[1], r[2], r[3]) for r in rows] == [(16, 8, 8), (16, 8, 2), (16, 8, 0)]
    assert spark.read.parquet(out).select("id").distinct().count() == spark.read.parquet(out).count() == 10


@pytest.fixture(scope="module")
def engine(spark):
    from fewstep.plans.service import Engine

    rng = random.Random(11)
    base = [sorted(rng.sample(range(30), 8)) for _ in range(6)]
    heads = {(10 * k + n, f) for k, b in enumerate(base) for n in range(5) for f in b if rng.random() < 0.9}
    ops = {(10 * k + n, (k + f) % 7) for k in range(6) for n in range(5) for f in range(4) if rng.random() < 0.9}
    ids = sorted({r for r, _ in heads})
    near = np.random.default_rng(3).normal(size=(6, 8))
    vec = lambda noise: [(r, _unit((near[r // 10] + np.random.default_rng(r + noise).normal(size=8) * 0.3)[None])[0].tolist()) for r in ids]
    frame = lambda rows: spark.createDataFrame(rows, "recipe long, vec array<double>")
    config = RunConfig(retrieval="exact", top_k=3, min_instr_sim=0.0)
    make = lambda **x: Engine(spark.createDataFrame(sorted(heads), "recipe long, feat long"), spark.createDataFrame(sorted(ops), "recipe long, feat long"), frame(vec(0)), RunConfig(**{**config.__dict__, **x}), spaces={"ingr": frame(vec(100)), "full": frame(vec(200))})
    return make


def test_engine_runs(spark, engine, tmp_path):
    exact = engine()
    rows = exact.run().collect()
    assert rows and all(r["in_zone"] and r["rank"] <= 3 for r in rows)
    found = {k: {(r["t"], r["s"]) for r in engine(retrieval=k, cand_k=5).candidates().collect()} for k in ("hybrid", "ingr", "full", "jaccard")}
    assert all(len(x) and max(sum(t == y for t, _ in x) for y in {t for t, _ in x}) <= 5 for x in found.values())
    run = engine(retrieval="hybrid", cand_k=5).run()
    assert {(r["t"], r["s"]) for r in run.collect()} <= found["hybrid"]
    few = exact.transfer_from(rows[0]["s"], 2).collect()
    assert len(few) <= 2 and {r["s"] for r in few} == {rows[0]["s"]}
    assert {r["s"] for r in exact.sources_to_targets().collect()} <= {r["recipe"] for r in exact.heads.collect()}
    one = exact.explain(rows[0]["t"], rows[0]["s"]).first()
    assert one["switch_cost"] == pytest.approx(rows[0]["switch_cost"], abs=2e-6) and one["said"].startswith(f"From {rows[0]['s']} to {rows[0]['t']}: ")
    assert {x["feat"] for x in one["missing_heads"]} == {r["feat"] for r in exact.heads.where(f"recipe = {rows[0]['t']}").collect()} - {r["feat"] for r in exact.heads.where(f"recipe = {rows[0]['s']}").collect()}
    assert one["miss_ingr"] == pytest.approx(1 - rows[0]["ingr_recall"], abs=1e-6)
    assert exact.similarity(rows[0]["t"], rows[0]["s"]) == pytest.approx(rows[0]["sim"], abs=1e-6)
    with pytest.raises(ValueError, match="recipe 999"):
        exact.similarity(rows[0]["t"], 999)
    assert exact.resolve([1, 2, 3], 4).count() <= 4
    path = str(tmp_path / "ranked")
    records.write_results(rank.nested(exact.run()), exact.run(), path)
    back = [json.loads(x) for x in spark.read.text(f"{path}/results.jsonl").toPandas()["value"]]
    assert spark.read.option("header", True).csv(f"{path}/results.csv").count() == len(rows)
    assert {(str(b["query_id"]), str(x["other_id"])) for b in back for x in b["results"]} == {(str(r["t"]), str(r["s"])) for r in rows}


def test_engine_refuses_a_retrieval_it_cannot_do(engine):
    from dataclasses import replace

    with pytest.raises(ValueError, match="spaces"):
        replace(engine(retrieval="hybrid"), spaces=None).candidates()
    with pytest.raises(ValueError, match="retrieval"):
        engine(retrieval="guess").candidates()


def test_build_and_load(spark, tmp_path):
    from fewstep.plans import service
    from fewstep.plans.config import BuildConfig

    foods = ["onions", "eggs", "olive oil", "flour", "butter", "milk", "rice", "beans"]
    rng = random.Random(1)
    lines = [json.dumps({"id": f"r{k}", "input": f"Dish {k}\n\nIngredients:\n" + "\n".join(f"- 2 cups {f}" for f in rng.sample(foods, 4)) + "\n\nDirections:\nMix and bake\nStir"}) for k in range(30)]
    (tmp_path / "in.ndjson").write_text("\n".join([*lines, "broken", '{"input": "A title alone"}']))
    audit = service.build(spark, str(tmp_path / "in.ndjson"), str(tmp_path / "art"), BuildConfig(skip_bad_records=True))
    assert audit.count() == 1
    engine = service.load(spark, str(tmp_path / "art"), RunConfig(cand_k=6, top_k=3, min_instr_sim=0.0))
    assert engine.indexes and engine.heads.count() == 120
    found = engine.candidates().collect()
    assert len(found) == 180
    assert {(r["t"], r["s"]) for r in engine.run().collect()} <= {(r["t"], r["s"]) for r in found}
    assert {r["recipe"] for r in spark.read.parquet(str(tmp_path / "art/numbers")).collect()} == {f"r{k}" for k in range(30)}
    with pytest.raises(ValueError, match="limit"):
        service.build(spark, "nowhere", "nowhere", BuildConfig(use_ann=False))


def _plan_over(df, join="Join"):
    """The nodes of a plan above its topmost join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return "\n".join(lines[: next(k for k, x in enumerate(lines) if join in x)])


def test_met_pairs_are_not_shuffled(spark):
    """A pair comes out of the join of prefixes once, with what it shares; it is not made distinct or looked up afterwards."""
    rng = random.Random(11)
    sets = {r: set(rng.sample(range(30), rng.randint(1, 8))) for r in range(150)}
    sets[0], sets[1] = {1, 2, 3}, {1, 2, 3}
    heads = spark.createDataFrame([(r, f) for r, x in sets.items() for f in x], "recipe long, feat long")
    weighed = features.weighted(heads, features.idf(heads))
    w = {r["feat"]: r["w"] for r in features.idf(heads).collect()}
    total = {r: sum(w[f] for f in x) for r, x in sets.items()}
    common = {(t, s): sum(w[f] for f in sets[t] & sets[s]) for t in sets for s in sets if t != s}
    for recall, precision in ((0.55, 0.55), (0.55, 0.0), (0.0, 0.0)):
        out = score.met_shares(weighed, "ingr", recall, precision)
        assert "Exchange" not in _plan_over(out) and "Aggregate" not in _plan_over(out)
        rows = out.collect()
        assert len({(r["t"], r["s"]) for r in rows}) == len(rows)
        got = {(r["t"], r["s"]): (r["ingr_recall"], r["ingr_precision"]) for r in rows if r["ingr_recall"] >= recall and r["ingr_precision"] >= precision}
        want = {(t, s): (round(c / total[t], 6), round(c / total[s], 6)) for (t, s), c in common.items() if c > 0}
        want = {k: v for k, v in want.items() if v[0] >= recall and v[1] >= precision}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())


def test_rows_are_sent_to_few_blocks(spark, monkeypatch):
    """A row meets all others in a bounded number of blocks, compared tile by tile, with the results of small blocks."""
    assert retrieve.sent_blocks(50_000) == 8 and retrieve.sent_blocks(1_000_000, 256) == 31 and retrieve.sent_blocks(600) == 1
    vectors = _unit(np.random.default_rng(8).normal(size=(90, 6)))
    rows = _frame(spark, vectors)
    read = lambda df: {tuple(r) for r in df.select("t", "s", "score", "rank").collect()}
    assert read(retrieve.topk_dot(rows, 5, 7)) == _nearest(vectors, 5)
    sims = np.round(vectors @ vectors.T, 6)
    got = {(r["i"], r["j"]): r["sim"] for r in retrieve.all_sims(rows, same_side=True, unit=False).collect()}
    assert got.keys() == {(i, j) for i in range(90) for j in range(i + 1, 90)} and all(abs(v - sims[i, j]) < 2e-6 for (i, j), v in got.items())
    assert retrieve.all_sims(rows).count() == 90 * 89
    lines = spark.createDataFrame([(k // 4, ("ingr", "instr")[k % 2], k, v.tolist()) for k, v in enumerate(vectors)], "doc int, section string, line int, vec array<double>")
    want = {(r["t"], r["s"], r["section"]): (r["n"], r["total"], tuple(r["hard"])) for r in pairwise.line_sums(lines, [0.3]).collect()}
    for size in (1, 3, 10):
        found = {(r["t"], r["s"], r["section"]): (r["n"], r["total"], tuple(r["hard"])) for r in pairwise.line_sums(lines, [0.3], size).collect()}
        assert found == want
    top = [(r["i"], r["j"], r["sim"]) for r in waves.top_pairs(rows, 10).collect()]
    monkeypatch.setattr(waves, "STRIPE", 9)
    assert [(r["i"], r["j"], r["sim"]) for r in waves.top_pairs(rows, 10).collect()] == top == sorted(((i, j, sims[i, j]) for i in range(90) for j in range(i + 1, 90)), key=lambda x: (-x[2], x[0], x[1]))[:10]


def test_queries_are_asked_of_cells_in_bounded_pieces(spark, grouped, monkeypatch):
    """A batch of queries times all cells is never held at once."""
    monkeypatch.setattr(cells, "ASKED", 30)
    rows = _frame(spark, grouped[:80])
    got = {(r["t"], r["s"], r["score"], r["rank"]) for r in cells.search(rows, cells.build(rows, cells=12, parts=8), 5).collect()}
    assert got == _nearest(grouped[:80], 5)


def test_rare_and_shared_heads_meet_once(spark):
    rng = random.Random(12)
    sets = {r: set(rng.sample(range(25), rng.randint(1, 7))) for r in range(80)}
    heads = spark.createDataFrame([(r, f) for r, x in sets.items() for f in x], "recipe long, feat long")
    weighed = features.weighted(heads, features.idf(heads))
    near = retrieve.weighted_jaccard(weighed, rare=2)
    assert "Exchange" not in _plan_over(near) and "Aggregate" not in _plan_over(near)
    w = {r["feat"]: r["w"] for r in features.idf(heads).collect()}
    rare = {r: set(sorted(x, key=lambda f: (-w[f], f))[:2]) for r, x in sets.items()}
    sum_ = lambda x: sum(w[f] for f in x)
    want = {(t, s): sum_(sets[t] & sets[s]) / sum_(sets[t] | sets[s]) for t in sets for s in sets if t != s and rare[t] & sets[s]}
    rows = near.collect()
    got = {(r["t"], r["s"]): r["score"] for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    rows = retrieve.head_overlap(heads).collect()
    assert {(r["t"], r["s"], r["shared"]) for r in rows} == {(t, s, len(sets[t] & sets[s])) for t in sets for s in sets if t != s and sets[t] & sets[s]}
    assert len(rows) == len({(r["t"], r["s"]) for r in rows})


def test_answers_of_having_all_are_not_shuffled(spark):
    """A query meets the recipes of its rarest feature, which bring their features: only answers come out of that join."""
    sets = spark.createDataFrame([(r, 9) for r in range(300)] + [(r, 1) for r in (4, 7)] + [(r, 2) for r in range(3, 6)], "recipe long, feat long")
    asked = spark.createDataFrame([("a", 9), ("a", 1), ("b", 9), ("b", 2), ("b", 1), ("c", 1), ("c", 5)], "query string, feat long")
    out = postings.having_all(postings.build(sets, 32), asked)
    assert "Exchange" not in _plan_over(out) and "Aggregate" not in _plan_over(out)
    assert sorted(map(tuple, out.collect())) == [("a", 4), ("a", 7), ("b", 4)]


def test_candidates_of_postings_meet_once(spark):
    """A pair with several shared features comes out of the join once, with their number; nothing is counted by a shuffle."""
    rng = random.Random(13)
    sets = {r: set(rng.sample(range(12), rng.randint(1, 6))) for r in range(70)}
    lists = postings.build(spark.createDataFrame([(r, f) for r, x in sets.items() for f in x], "recipe long, feat long"), 16)
    asked = {t: set(rng.sample(sorted(sets[t]), min(3, len(sets[t])))) for t in range(0, 70, 3)}
    out = postings.candidates(spark.createDataFrame([(t, f) for t, x in asked.items() for f in x], "t long, feat long"), lists)
    assert "Exchange" not in _plan_over(out) and "Aggregate" not in _plan_over(out)
    assert sorted(map(tuple, out.collect())) == sorted((t, s, len(x & sets[s])) for t, x in asked.items() for s in sets if s != t and x & sets[s])


def test_methods_are_compared_in_rows_of_targets(spark):
    """Pairs that the lists name are scored, ranked and compared where their target is: after its row is made nothing is shuffled."""
    from fewstep.operators import compare
    from fewstep.plans.storage import Scratch

    rng = random.Random(14)
    sets = {r: set(rng.sample(range(14), rng.randint(1, 5))) for r in range(60)}
    kinds = {r: {f"k{rng.randrange(4)}" for _ in range(3)} for r in range(60)}
    heads = spark.createDataFrame([(r, f) for r, x in sets.items() for f in x], "recipe long, feat long")
    ops = spark.createDataFrame([(r, f) for r, x in kinds.items() for f in x], "recipe long, feat string")
    vectors = _frame(spark, _unit(np.random.default_rng(15).normal(size=(11, 4))))
    scratch = Scratch(spark, "test")
    base, by_set = compare.profiles(heads, ops, 11, scratch)
    pairs = compare.listed(base, by_set, {"v": vectors}, "h", "o", 3, scratch)
    got = {(m["method"], r["t"], r["s"], m["rank"], m["value"]) for r in pairs.collect() for m in r["of"]}
    h, o = (features.weighted(x, features.idf(x)) for x in (heads, ops))
    recipes = heads.select("recipe").distinct().withColumn("id", F.col("recipe") % 11)
    lists = {"v": retrieve.nearest_recipes(recipes, vectors, 3), "h": retrieve.top_k(retrieve.weighted_jaccard(h, 2), 3), "o": retrieve.top_k(retrieve.weighted_jaccard(o, 1), 3)}
    want = {(m, r["t"], r["s"], r["rank"], r["score"]) for m, x in lists.items() for r in x.collect()}
    assert {x[:4] for x in got} == {x[:4] for x in want} and {x[:4]: x[4] for x in got} == pytest.approx({x[:4]: x[4] for x in want}, abs=2e-6)
    config = RunConfig(gates=False)
    out = compare.scored(pairs, by_set, vectors, config)
    full = score.scored(heads, ops, recipes.join(vectors, "id").select("recipe", "vec"), config, among=pairs.select("t", "s"))
    columns = ["t", "s", "ingr_recall", "ingr_precision", "ops_recall", "ops_precision", "sim", "switch_cost", "edit_cost"]
    one, two = ({(r["t"], r["s"]): tuple(r)[2:] for r in x.select(*columns).collect()} for x in (out, full))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=3e-6) for k in one)
    placed = evaluate.placed(out, {"closest": ("edit_score", None)}, 2, ["id", "t"]).groupBy("id", "t").agg(F.collect_list("s"))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == len([x for x in plan.splitlines() if "REPARTITION_BY_COL" in x or "hashpartitioning(feat" in x])


def test_pairs_of_blocks_meet_once(spark):
    """A row goes to as many partitions as there are blocks, and ties, equal vectors, long and broken ones are ranked as by brute force."""
    rng = np.random.default_rng(21)
    vectors = np.round(rng.normal(size=(150, 5)), 1)
    vectors[100:110], vectors[120:] = vectors[3], vectors[120:] * 1e3
    rows = _frame(spark, vectors)
    met, pairs = retrieve.block_pairs(rows, 8)
    assert pairs == met.rdd.getNumPartitions() == 36 and met.count() == 8 * 150
    assert met.select("x", "y", F.spark_partition_id().alias("at")).distinct().count() == met.select("x", "y").distinct().count()
    read = lambda df: {tuple(r) for r in df.select("t", "s", "score", "rank").collect()}
    for block in (7, 1000):
        got, want = read(retrieve.topk_dot(rows, 9, block)), _nearest(vectors, 9)
        assert {(t, rank) for t, _, _, rank in got} == {(t, rank) for t, _, _, rank in want}
        assert {(t, s, rank) for t, s, _, rank in got if t < 120} == {(t, s, rank) for t, s, _, rank in want if t < 120}
    vectors[5, 2], vectors[6, 1] = np.nan, np.inf
    assert {r["t"] for r in retrieve.topk_dot(_frame(spark, vectors), 3).collect()} == set(range(150)) - {5, 6}
    assert {(r["i"], r["j"]) for r in retrieve.all_sims(rows).collect()} == {(i, j) for i in range(150) for j in range(150) if i != j}
    assert retrieve.topk_dot(rows.where("id < 0"), 3).count() == retrieve.all_sims(rows.where("id < 0")).count() == 0


@pytest.mark.parametrize("most", [1024, 7])
def test_jaccard_of_all_pairs_without_rows_of_pairs(spark, monkeypatch, most):
    """A head that all have is dealt to lists; features that repeat, lone recipes and ties are ranked as from all pairs."""
    monkeypatch.setattr(retrieve, "LIST", most)
    rng = random.Random(31)
    sets = {r: {0} | {1 + int(rng.random() ** 2 * 30) for _ in range(rng.randint(0, 6))} for r in range(90)} | {500: {99}, 501: {98, 97}, 502: {97, 98}}
    weighed = spark.createDataFrame([(r, f, 1.0 + (f % 5) / 3) for r, s in sets.items() for f in s], "recipe long, feat long, w double")
    read = lambda df: {tuple(r) for r in df.select("t", "s", "score", "rank").collect()}
    assert read(retrieve.jaccard_nearest(weighed, 4)) == read(retrieve.top_k(retrieve.weighted_jaccard(weighed), 4))
    plan = retrieve.jaccard_nearest(weighed, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate [t" not in plan


def test_nearest_of_vectors_without_groups(spark, monkeypatch):
    """Where cells and lists bound nothing, searches and their merge stay exact and form no row per pair and no deeper lists."""
    rng = np.random.default_rng(41)
    a, b = (_unit(rng.normal(size=(220, 12))) for _ in range(2))
    a[50:60] = a[7]
    one, other = cells.build(_frame(spark, a), cells=10, parts=6), cells.build(_frame(spark, b), cells=10, parts=6)
    monkeypatch.setattr(cells, "TILE", 16)
    asked = cells.search(one.vectors.where("id >= 20"), one, 6)
    assert {(r["t"], r["s"], r["score"], r["rank"]) for r in asked.collect()} == {x for x in _nearest(a, 6) if x[0] >= 20}
    assert "FlatMapCoGroups" not in asked._jdf.queryExecution().optimizedPlan().toString()
    sims, seen = np.round(np.round(a @ a.T, 6) * 0.6 + np.round(b @ b.T, 6) * 0.4, 6), []
    want = {(t, s, sims[t, s], r + 1) for t in range(220) for r, s in enumerate(sorted((j for j in range(220) if j != t), key=lambda j: (-sims[t, j], j))[:4])}
    monkeypatch.setattr(merge, "TRIED", 30)
    got = merge.hybrid_top(one, other, 4, 0.6, seen=seen)
    assert {(r["t"], r["s"], r["score"], r["rank"]) for r in got.collect()} == want and got.count() == len(want)
    assert [n for n, _ in seen][0] == 30 and len(seen) == 2 and seen[1][0] > 190


def test_length_of_a_vector_is_taken_once(spark):
    from fewstep.functions.vectors import l2_normalise

    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id long, vec array<double>").select("id", l2_normalise("vec").alias("u"))
    assert {r["id"]: r["u"] for r in rows.collect()} == {1: [3 / (5 + 1e-12), 4 / (5 + 1e-12)], 2: [0.0, 0.0], 3: None, 4: []}
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and "/ lambda x_" in plan  # numbers are divided by a bound length
