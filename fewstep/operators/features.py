"""Feature sets as long tables: recipe, feat, and weights from how rare a feature is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.plans.storage import Scratch

WEIGHT_DIGITS = 6


def in_order(rows: DataFrame, by: str, add: F.Column, scratch: Scratch) -> DataFrame:
    """rows with upto: the sum of add over all rows that come no later by a column (distinct values).

    Rows go to ranges of the column; a range's rows are added up in its task, and the sums of the ranges
    before it, one row for each, are joined.
    """
    ranged = scratch.stash(rows.withColumn("_add", add).repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_add").alias("_all"))
    before = sums.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_before"))
    upto = F.sum("_add").over(Window.partitionBy("_range").orderBy(by)) + F.col("_before")
    return ranged.join(F.broadcast(before), "_range").withColumn("upto", upto).drop("_range", "_add", "_before")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, id: dense ids from 0 in token order."""
    distinct = tokens.where("token IS NOT NULL").select("token").distinct()
    numbered = in_order(distinct, "token", F.lit(1), Scratch(tokens.sparkSession, "vocabulary"))
    return numbered.select("token", (F.col("upto") - 1).cast("int").alias("id"))


def encode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab, "token").drop("token").distinct()


def decode(ids: DataFrame, vocab: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """ids with their token; unknown ids become their digits, or go."""
    if not keep_unknown:
        return ids.join(vocab, "id")
    return ids.join(vocab, "id", "left").withColumn("token", F.coalesce("token", F.col("id").cast("string")))


def idf(sets: DataFrame) -> DataFrame:
    """feat, df, w: ln(1 + N / (1 + df)), N the recipes with a feature. sets has distinct rows."""
    n = sets.agg(F.count_distinct("recipe").alias("n"))
    return sets.groupBy("feat").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("feat", "df", F.log(F.lit(1.0) + F.col("n") / (F.lit(1.0) + F.col("df"))).alias("w"))


def weighted(sets: DataFrame, weights: DataFrame, by_idf: bool = True) -> DataFrame:
    """recipe, feat, w: the feature's weight, or 1."""
    if not by_idf:
        return sets.select("recipe", "feat", F.lit(1.0).alias("w"))
    return sets.join(weights.select("feat", "w"), "feat").select("recipe", "feat", "w")


def by_importance(weighed: DataFrame, importance: DataFrame) -> DataFrame:
    """Weights times the importance of the feature in its recipe (recipe, feat, importance; 1 where it has none), over their mean."""
    rows = weighed.join(importance.select("recipe", "feat", "importance"), ["recipe", "feat"], "left")
    return mean_one(rows.select("recipe", "feat", (F.col("w") * F.coalesce("importance", F.lit(1.0))).alias("w")))


def totals(weighed: DataFrame) -> DataFrame:
    return weighed.groupBy("recipe").agg(F.sum("w").alias("total"))


def mean_one(weighed: DataFrame) -> DataFrame:
    """Weights over their mean in the recipe; unchanged where the mean is not positive."""
    mean = F.avg("w").over(Window.partitionBy("recipe"))
    return weighed.withColumn("w", F.when(mean > 0, F.col("w") / mean).otherwise(F.col("w")))


def postings(sets: DataFrame) -> DataFrame:
    return sets.groupBy("feat").agg(F.sort_array(F.collect_list("recipe")).alias("recipes"))


def set_arrays(sets: DataFrame, name: str = "feats") -> DataFrame:
    return sets.groupBy("recipe").agg(F.sort_array(F.collect_set("feat")).alias(name))
