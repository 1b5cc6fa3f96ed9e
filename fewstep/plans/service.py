"""The engine as calls: build its tables from records, run a ranking, resolve a text, explain a pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.functions.encoder import encode
from fewstep.operators import cells, explain, features, merge, postings, rank, retrieve, score
from fewstep.plans.catalog import _IN, _SCORED, CONFIG, _heads, _ops, _recipe_vectors, _with, query
from fewstep.plans.config import BuildConfig, RunConfig, check_exact
from fewstep.sources import records


@dataclass
class Engine:
    """heads, ops: recipe, feat (distinct); vectors: recipe, vec (unit length)."""

    heads: DataFrame
    ops: DataFrame
    vectors: DataFrame
    config: RunConfig = RunConfig()
    #: recipe, vec of the spaces that the retrievals by vectors need: ingr and full.
    spaces: dict[str, DataFrame] | None = None
    #: indexes of those spaces, if they were built.
    indexes: dict[str, cells.Index] | None = None
    #: feat, neighbour, sim: heads that may stand for one another.
    neighbours: DataFrame | None = None

    def candidates(self) -> DataFrame | None:
        """t, s: the config's cand_k candidates of each target by its retrieval; None for exact, which takes all pairs that can pass the gates.

        hybrid: by w times the ingr and 1 - w times the full similarity; ingr, full: by one of them; jaccard: by shared rare heads.
        """
        kind, k = self.config.retrieval, self.config.cand_k
        if kind == "exact":
            return None
        if kind == "jaccard":
            weighed = features.weighted(self.heads, features.idf(self.heads), self.config.tfidf_heads)
            return retrieve.top_k(retrieve.weighted_jaccard(weighed, rare=6), k).select("t", "s")
        if kind not in ("hybrid", "ingr", "full"):
            raise ValueError(f"there is no retrieval {kind}: exact, jaccard, hybrid, ingr or full")
        needed = ("ingr", "full") if kind == "hybrid" else (kind,)
        if not self.spaces or any(n not in self.spaces for n in needed):
            raise ValueError(f"the retrieval {kind} needs spaces {needed}")
        index = [self.indexes[n] if self.indexes else cells.build(self.spaces[n].select(F.col("recipe").alias("id"), "vec")) for n in needed]
        found = merge.hybrid_top(*index, k, self.config.hybrid_w) if kind == "hybrid" else cells.search(index[0].vectors, index[0], k)
        return found.select("t", "s")

    def pairs(self) -> DataFrame:
        """Candidates, scores with substitution credit, and gates."""
        return score.scored(self.heads, self.ops, self.vectors, self.config, self.candidates(), self.neighbours)

    def run(self) -> DataFrame:
        """Every target's ranked sources, by the mode of the config."""
        return rank.run_mode(self.pairs(), self.config)

    def sources_to_targets(self) -> DataFrame:
        return rank.run_mode(self.pairs(), self.config, "s", "t")

    def transfer_from(self, source, k: int) -> DataFrame:
        """The k best targets of one source; all modes' pairs when the zone leaves none."""
        pairs = self.pairs().where(F.col("s") == source)
        zone = pairs.where("in_zone")
        chosen = pairs if self.config.mode != "few_switches" or zone.isEmpty() else zone
        return rank.ranked(chosen, k, "s", "t")

    def resolve(self, feats: list, k: int) -> DataFrame:
        """recipe, score: the k recipes that share most weight with a list of features."""
        weighed = features.weighted(self.heads, features.idf(self.heads)).where(F.col("feat").isin(feats))
        return weighed.groupBy("recipe").agg(F.round(F.sum("w"), 6).alias("score")).orderBy(F.desc("score"), "recipe").limit(k)

    def similarity(self, t, s) -> float:
        """The cosine of two recipes' vectors; an error says which one is not there."""
        found = {r["recipe"]: r["vec"] for r in self.vectors.where(F.col("recipe").isin([t, s])).collect()}
        if gone := [x for x in (t, s) if x not in found]:
            raise ValueError(f"there is no vector of recipe {gone[0]}")
        return round(sum(x * y for x, y in zip(found[t], found[s], strict=True)), 6)

    def explain(self, t, s) -> DataFrame:
        """One row: the components and costs of a pair, what sets the two apart, and the sentence."""
        config = RunConfig(**{**self.config.__dict__, "gates": False})
        only = lambda df: df.where(F.col("recipe").isin([t, s]))
        h, o = only(features.weighted(self.heads, features.idf(self.heads))), only(features.weighted(self.ops, features.idf(self.ops)))
        spark = self.heads.sparkSession
        pair = spark.createDataFrame([(t, s)], f"t {self.heads.schema['recipe'].dataType.simpleString()}, s {self.heads.schema['recipe'].dataType.simpleString()}")
        pairs = score.costs(score.with_sim(score.shares(score.shares(pair, h, "ingr"), o, "ops"), self.vectors), config)
        feat = self.heads.schema["feat"].dataType.simpleString()
        near = self.neighbours if self.neighbours is not None else spark.createDataFrame([], f"feat {feat}, neighbour {feat}, sim double")
        out = explain.explained(score.masses(pairs), h, o, near, self.config.explain_top_n, self.config.substitution_credit_exp)
        return out.withColumn("said", explain.full_sentence(F.col("t").cast("string"), F.col("s").cast("string")))


def build(spark, ndjson: str, out: str, config: BuildConfig = BuildConfig()) -> DataFrame:
    """Writes an engine's tables under out, from records as NDJSON, and returns the audit of records that were left out.

    recipes, heads, ops, idf_heads, idf_ops, postings, the spaces instr, ingr and full, and (use_ann) an index of each of the
    last two. strict fails on a bad record unless skip_bad_records is set; limit counts records that parse.
    """
    check_exact(config)
    good, audit = records.read_strict(spark, ndjson, skip_bad=config.skip_bad_records or not config.strict)
    if config.limit:
        good = good.orderBy("source_line_number").limit(config.limit)
    good.withColumnRenamed("recipe_id", "recipe").dropDuplicates(["recipe"]).write.parquet(f"{out}/recipes")
    rows = spark.read.parquet(f"{out}/recipes")
    order = rows.select("recipe").withColumnRenamed("recipe", "token")
    features.vocabulary(order).withColumnRenamed("token", "recipe").write.parquet(f"{out}/numbers")
    numbers = spark.read.parquet(f"{out}/numbers")
    own = rows.join(numbers, "recipe").select(F.col("id").cast("long").alias("recipe"), "heads", "techniques", "ingredients", "instructions", "full_text")
    for name, column in (("heads", "heads"), ("ops", "techniques")):
        sets = own.select("recipe", F.explode(F.array_distinct(column)).alias("feat"))
        sets.write.parquet(f"{out}/{name}")
        features.idf(spark.read.parquet(f"{out}/{name}")).write.parquet(f"{out}/idf_{name}")
    postings.write(postings.build(spark.read.parquet(f"{out}/heads")), f"{out}/postings")
    texts = {"instr": F.array_join("instructions", "\n"), "ingr": F.array_join("ingredients", "\n"), "full": F.col("full_text")}
    for name, text in texts.items():
        encode(own.select("recipe", text.alias("text")), "text", "vec").where("vec IS NOT NULL").select("recipe", "vec").write.parquet(f"{out}/{name}")
        if config.use_ann and name != "instr":
            cells.save(cells.build(spark.read.parquet(f"{out}/{name}").select(F.col("recipe").alias("id"), "vec")), f"{out}/index_{name}")
    return audit


def load(spark, out: str, config: RunConfig = RunConfig()) -> Engine:
    """The engine of what build() wrote; recipes go by their numbers (the table numbers has their ids)."""
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    index = {n: records.optional(cells.load, spark, f"{out}/index_{n}") for n in ("ingr", "full")}
    return Engine(read("heads"), read("ops"), read("instr"), config, {n: read(n) for n in index}, index if all(index.values()) else None)


def engine(spark, d, config: RunConfig = CONFIG) -> Engine:
    heads = _heads(spark, d)
    return Engine(heads, _ops(spark, d), _recipe_vectors(spark, d, heads), config)


@query(_with(_IN, "SELECT recipe, round(sum(w), 6) AS score FROM h WHERE feat IN (1, 2, 3) GROUP BY recipe ORDER BY score DESC, recipe LIMIT 10"))
def resolve(spark, d):
    return engine(spark, d).resolve([1, 2, 3], 10)


@query(_with(_SCORED, "SELECT * FROM (SELECT s, count(*) AS targets, min(switch_cost) AS cheapest FROM scored WHERE in_zone GROUP BY s)"))
def transfer_from(spark, d):
    """What every source transfers to; Engine.transfer_from() is the same for one source."""
    e = engine(spark, d)
    pairs = score.scored(e.heads, e.ops, e.vectors, e.config)
    return pairs.where("in_zone").groupBy("s").agg(F.count("*").alias("targets"), F.min("switch_cost").alias("cheapest"))
