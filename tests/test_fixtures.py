"""Hand-computed micro-fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from fewstep.functions import text as tx
from fewstep.functions.encoder import encode
from fewstep.operators import evaluate, explain, features, pairwise, rank, retrieve, score
from fewstep.plans.config import BuildConfig, RunConfig, check_exact, configured, sweep
from fewstep.sources import records
from fewstep.streaming import scoring

HEADS = {1: [1, 2], 2: [2, 3], 3: [1, 2, 3]}
OPS = {1: [7], 2: [7, 8], 3: [8]}
SIM = {(1, 2): 0.8, (1, 3): 0.6, (2, 3): 0.5}
EXPECTED = {  # t, s: ingr recall and precision, ops recall and precision, sim, switch, edit, edit score, legacy, zone
    (2, 1): (0.446705, 0.446705, 0.5, 1.0, 0.8, 0.462306, 0.482306, 0.617358, 0.605333, False),
    (3, 1): (0.643793, 1.0, 0.0, 0.0, 0.6, 0.395914, 0.435914, 0.646673, 0.574805, False),
    (1, 2): (0.446705, 0.446705, 1.0, 0.5, 0.8, 0.412306, 0.432306, 0.649011, 0.703296, False),
    (3, 2): (0.643793, 1.0, 1.0, 0.5, 0.5, 0.220914, 0.270914, 0.762682, 0.768185, True),
    (1, 3): (1.0, 0.643793, 0.0, 0.0, 0.6, 0.253431, 0.293431, 0.745701, 0.711770, False),
    (2, 3): (1.0, 0.643793, 0.5, 1.0, 0.5, 0.128431, 0.178431, 0.836582, 0.818731, True),
}


def _sets(spark, sets):
    return spark.createDataFrame([(r, f) for r, fs in sets.items() for f in fs], "recipe long, feat long")


@pytest.fixture(scope="module")
def recipes(spark):
    heads, ops = _sets(spark, HEADS), _sets(spark, OPS)
    return heads, ops, features.weighted(heads, features.idf(heads)), features.weighted(ops, features.idf(ops))


def _pairs(spark, recipes):
    heads, ops, h, o = recipes
    pairs = score.ratios(score.overlap(h), features.totals(h), "ingr")
    pairs = score.ratios(pairs.join(score.overlap(o, pairs), ["t", "s"], "left"), features.totals(o), "ops")
    sims = spark.createDataFrame([(a, b, v) for (x, y), v in SIM.items() for a, b in ((x, y), (y, x))], "t long, s long, sim double")
    return score.costs(pairs.join(sims, ["t", "s"]))


def test_idf(recipes, spark):
    w = {r["feat"]: r["w"] for r in features.idf(recipes[0]).collect()}
    assert w[1] == pytest.approx(0.693147, abs=1e-6) and w[2] == pytest.approx(0.559616, abs=1e-6)


def test_components_and_costs(spark, recipes):
    got = {(r["t"], r["s"]): r for r in _pairs(spark, recipes).collect()}
    for key, want in EXPECTED.items():
        r = got[key]
        have = [r[c] for c in ("ingr_recall", "ingr_precision", "ops_recall", "ops_precision", "sim", "switch_cost", "edit_cost", "edit_score", "legacy_score")]
        assert have == pytest.approx(list(want[:9]), abs=2e-6), key
        assert r["in_zone"] == want[9]
    for t, s in got:  # recall of one direction is precision of the other
        assert got[t, s]["ingr_recall"] == got[s, t]["ingr_precision"]


def test_gates_modes_and_ranks(spark, recipes):
    pairs = _pairs(spark, recipes)
    assert {(r["t"], r["s"]) for r in score.gate(pairs).collect()} == {(3, 2), (2, 3)}
    few = rank.run_mode(pairs, RunConfig(top_k=1))
    closest = rank.run_mode(pairs, RunConfig(top_k=1, mode="closest"))
    assert {(r["t"], r["s"]) for r in few.collect()} == {(3, 2), (2, 3)}
    assert {(r["t"], r["s"]) for r in closest.collect()} == {(1, 3), (2, 3), (3, 2)}
    nested = {r["query_id"]: r["results"] for r in rank.nested(closest).collect()}
    assert nested[1][0]["other_id"] == 3


def test_neighbour_credit(spark, recipes):
    heads, _, h, _ = recipes
    near = spark.createDataFrame([(3, 1, 0.9)], "feat long, neighbour long, sim double")
    got = {(r["t"], r["s"]): r["recall"] for r in score.soft_recall(heads, h, near).collect()}
    assert got[2, 1] == pytest.approx(0.894874, abs=1e-6)
    add = explain.difference(spark.createDataFrame([(2, 1)], "t long, s long"), h, heads)
    assert [(r["feat"], r["neighbour"]) for r in explain.swaps(add, heads, near).collect()] == [(3, 1)]


def test_differences(spark, recipes):
    heads, ops, h, o = recipes
    pair = spark.createDataFrame([(2, 1)], "t long, s long")
    side = lambda w, s, of, other: [r["feat"] for r in explain.difference(pair, w, s, of, other).collect()]
    assert side(h, heads, "t", "s") == [3] and side(h, heads, "s", "t") == [1]
    assert side(o, ops, "t", "s") == [8] and side(o, ops, "s", "t") == []


def test_prefix_filter_keeps_all_that_can_pass(spark, recipes):
    heads, _, h, _ = recipes
    cand = {(r["t"], r["s"]) for r in score.candidates(h, heads, 0.55).collect()}
    assert {k for k, v in EXPECTED.items() if v[0] >= 0.55} <= cand


def test_weighted_jaccard(spark, recipes):
    got = {(r["t"], r["s"]): r["score"] for r in retrieve.weighted_jaccard(recipes[2]).collect()}
    assert got[1, 2] == got[2, 1] == pytest.approx(0.287586, abs=1e-6)
    rare = {(r["t"], r["s"]) for r in retrieve.weighted_jaccard(recipes[2], rare=1).collect()}
    assert rare <= set(got)


def test_line_jaccard_may_exceed_one(spark):
    rows = [(0, "ingr", k, [1.0, 0.0]) for k in range(3)] + [(1, "ingr", 9, [1.0, 0.0])]
    lines = spark.createDataFrame(rows, "doc int, section string, line int, vec array<double>")
    got = {(r["t"], r["s"]): r["jaccard_ingr"] for r in pairwise.line_jaccard(pairwise.line_sums(lines, [0.8]), lines).collect()}
    assert got[0, 1] == 3.0 and got[1, 0] == pytest.approx(1 / 3, abs=1e-6)


def test_section_max_rules(spark):
    df = spark.createDataFrame([(None, -0.2), (None, None)], "n double, g double")
    assert [r[0] for r in df.select(pairwise.section_max("n", "g")).collect()] == [-0.2, 0.0]
    assert [r[0] for r in df.select(pairwise.section_max("n", "g", missing_is_zero=True)).collect()] == [0.0, 0.0]


def test_summaries(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2, 3, 9)] + [("a", None), ("a", float("nan"))], "m string, x double")
    r = evaluate.rank_summary(df, "x").first()
    assert [r[c] for c in ("count", "mean", "p05", "p25", "p50", "p75", "p95", "min", "max")] == [6, 4.0, 1, 2, 3, 4, 5, 1, 9]
    q = evaluate.quantile_summary(df, "m", "x").first()
    assert (q["p10"], q["p50"], q["p90"], q["count"]) == (1.5, 3.5, 7.0, 6)


def test_agreement_skips_targets_without_lists(spark):
    lists = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 2), (1, "b", 3), (2, "c", 1)], "t int, method string, s int")
    got = {(r["method_a"], r["method_b"]): (r["mean_jaccard"], r["targets"]) for r in evaluate.agreement(lists).collect()}
    assert got["a", "b"] == (pytest.approx(1 / 3, abs=1e-6), 1) and got["a", "c"] == (0.0, 2)


def test_duplicates_and_disagreements(spark):
    old = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "t int, s int")
    pairs = spark.createDataFrame([(1, 5, 0.02), (2, 6, 0.01), (3, 7, 0.5)], "t int, s int, switch_cost double")
    new = spark.createDataFrame([(1, 5), (3, 8)], "t int, s int")
    r = evaluate.duplicates(old, pairs, new).first()
    assert (r["total"], r["duplicates"], r["removed"]) == (3, 2, 1)
    best = spark.createDataFrame([(1, 9, 0.1)], "t int, s int, switch_cost double")
    one = spark.createDataFrame([(1, 5, 0.23), (2, 6, 0.9)], "t int, s int, switch_cost double")
    assert [r["t"] for r in evaluate.disagreements(one, best).collect()] == [1]


def test_text_sections(spark):
    cases = ["T\n\nIngredients:\na\n\nDirections:\nb\n\nNotes", "T\n\nfoo\n\nbar", "", None, "T"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    got = [r["x"] for r in df.orderBy("k").select(tx.split_sections("t").alias("x")).collect()]
    assert [(g["title"], g["ingredients"], g["instructions"]) for g in got] == [("T", ["a"], ["b"]), ("T", ["foo"], ["bar"]), ("", [], []), ("", [], []), ("T", [], [])]
    fall = [r["x"] for r in df.where("k < 2").orderBy("k").select(tx.split_sections_prefixed("t").alias("x")).collect()]
    assert (fall[0]["ingredients"], fall[1]["ingredients"], fall[1]["instructions"]) == ("a", cases[1], cases[1])


def test_text_functions(spark):
    df = spark.createDataFrame([(["- 1. Step 2: Mix", "• a"], [], ["a"], ["a", "b"], ["a", "b", "c"])], "l array<string>, n array<string>, a array<string>, b array<string>, c array<string>")
    r = df.select(F.transform("l", tx.clean_line), *[tx.fmt_list(c) for c in "nabc"]).first()
    assert list(r) == [["Mix", "a"], "", "a", "a and b", "a, b, and c"]
    ids = spark.createDataFrame([("12",), ("-1",), ("a1",), ("",), (None,)], "x string").select(tx.numeric_id("x")).collect()
    assert [r[0] for r in ids] == [12, None, None, None, None]
    heads = spark.createDataFrame([("2 cups chopped onions (red)",), ("1 tbsp olive oil",), ("3",)], "x string").select(tx.head("x")).collect()
    assert [r[0] for r in heads] == ["onion", "olive oil", None]
    said = spark.range(1).select(explain.sentence(F.lit("Q"), F.lit("O"), F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0]
    assert said == "From O to Q: no major edits."


def test_vectors_topk_paths_agree(spark):
    import random

    random.seed(3)
    rows = [(k, [random.random() - 0.5 for _ in range(8)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    plain = sorted(map(tuple, retrieve.topk_dot(df, 4).select("t", "s", "score", "rank").collect()))
    assert plain == sorted(map(tuple, retrieve.topk_dot(df, 4, block=16).select("t", "s", "score", "rank").collect()))
    texts = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [r["v"] for r in encode(texts, "t", "v").collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1.0) and got[1] is None and got[2] is None


def test_config():
    assert configured(RunConfig, "quality").cand_k == 500 and configured(RunConfig, "quality", cand_k=7).cand_k == 7
    assert configured(BuildConfig, "debug").limit == 200 and len(sweep(a=(1, 2, 3), b=(4, 5))) == 6
    with pytest.raises(ValueError):
        check_exact(BuildConfig(use_ann=False, limit=None))
    check_exact(BuildConfig(use_ann=False, limit=50_000))


def test_ndjson(spark, tmp_path):
    lines = ['{"input":"T\\n\\nIngredients:\\n2 onions\\n\\nInstructions:\\nBake"}', "not json", '{"x":1}', "", '{"input":"b"}']
    (tmp_path / "in.ndjson").write_text("\n".join(lines))
    path = str(tmp_path / "in.ndjson")
    rows = records.read_ndjson(spark, path).orderBy("line_no").collect()
    assert [(r["line_no"], r["input"][:1]) for r in rows] == [(1, "T"), (3, ""), (5, "b")]
    assert records.read_ndjson(spark, path, 2).count() == 2 and records.read_ndjson(spark, path, 2, physical=True).count() == 1
    good, audit = records.read_strict(spark, path, skip_bad=True)
    assert [(r["title"], r["heads"], r["techniques"]) for r in good.collect()] == [("T", ["onion"], ["bake"])]
    assert audit.count() == 2
    with pytest.raises(Exception, match="line 3"):
        records.read_strict(spark, path)[0].collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"input": "x"}, {"input": "y"}]')
    records.json_to_ndjson(spark, str(tmp_path / "a.json"), str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 2
    (tmp_path / "v.json").write_text('{"salt": 0, "egg": 2}')
    assert {tuple(r) for r in records.read_vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("salt", 0), ("egg", 2)}
    df = spark.createDataFrame([(1, 2, 0.5), (2, 1, None)], "i int, j int, sim double")
    assert records.write_csv(df, str(tmp_path / "c"), 1, ["i"]) and not records.write_csv(df.where("i > 9"), str(tmp_path / "none"))
    assert records.read_csv(spark, str(tmp_path / "c"), ["sim", "other"]).first()["sim"] == 0.5
    assert records.optional(records.read_vocabulary, spark, str(tmp_path / "no")) is None
    out = [{"query_id": "1", "results": [{"other_id": "2", "pzt_edit_score": 0.5}, {"other_id": "3"}]}, {"query_id": "1", "results": [{"other_id": "4"}]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, out)))
    ids = lambda which: sorted(r["other_id"] for r in records.read_results(spark, str(tmp_path / "r.jsonl"), which).collect())
    assert ids("all") == ["2", "3", "4"] and ids("last") == ["4"] and ids("first") == ["2", "4"]
    records.write_matrix(df, str(tmp_path / "m"))
    records.write_config(spark, {"a": 1}, str(tmp_path / "conf"))
    records.write_artifacts({"pairs": df}, str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art/pairs")).count() == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"id": "r1", "input": "T\n\nIngredients:\n2 onions\n1 egg\n\nInstructions:\nBake"}))
    corpus = spark.createDataFrame([("c", "onion")], "recipe string, feat string")
    weights = spark.createDataFrame([("onion", 1.0), ("egg", 3.0)], "feat string, w double")
    got = []
    scoring.start(scoring.read_stream(spark, str(tmp_path / "in")), corpus, weights, lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination()
    assert got == [("r1", "c", 0.25)]
