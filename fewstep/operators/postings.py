"""Posting lists in blocks: which recipes have a feature, without a row that holds a whole list.

The numbers of the recipes are cut into ranges of SPAN. A row has the recipes of one feature in one range, in order, as small
offsets from the first of them, which it names with the last one for skipping. So a row holds SPAN recipes at most, whatever the
feature, and lists of different features meet range by range. Written sorted by feature and block, a reader skips files and
row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Recipe numbers in a range.
SPAN = 1024


def build(sets: DataFrame, span: int = SPAN) -> DataFrame:
    """sets: recipe (a whole number), feat. feat, block, first, last, n, offsets; rows may repeat, those with a null are left out."""
    rows = sets.where("recipe IS NOT NULL AND feat IS NOT NULL").select("feat", F.floor(F.col("recipe") / span).cast("long").alias("block"), "recipe")
    lists = rows.groupBy("feat", "block").agg(F.sort_array(F.collect_set("recipe")).alias("_r"))
    first = F.element_at("_r", 1)
    offsets = F.transform("_r", lambda x: (x - first).cast("int"))
    return lists.select("feat", "block", first.alias("first"), F.element_at("_r", -1).alias("last"), F.size("_r").alias("n"), offsets.alias("offsets"))


def recipes() -> F.Column:
    """The recipes of a block, in order."""
    return F.transform("offsets", lambda x: F.col("first") + x)


def write(postings: DataFrame, path: str) -> None:
    postings.repartitionByRange("feat", "block").sortWithinPartitions("feat", "block").write.parquet(path)


def expand(postings: DataFrame) -> DataFrame:
    """feat, recipe."""
    return postings.select("feat", F.explode(recipes()).alias("recipe"))


def between(postings: DataFrame, low: int, high: int) -> DataFrame:
    """feat, recipe of recipes low to high; blocks of other ranges are skipped by their first and last one."""
    return expand(postings.where((F.col("last") >= low) & (F.col("first") <= high))).where(F.col("recipe").between(low, high))


def _with_all(postings: DataFrame) -> DataFrame:
    """feat, recipe, and _has: all features of the recipe."""
    return expand(postings).withColumn("_has", F.collect_list("feat").over(Window.partitionBy("recipe")))


def candidates(features: DataFrame, postings: DataFrame) -> DataFrame:
    """t, s, met: for each t the recipes that have any of its features, and how many. features: t, feat.

    A recipe comes to a t with all its features, and out at the first that both have: no pair is counted by a shuffle.
    """
    asked = features.select("t", "feat").distinct().withColumn("_want", F.collect_list("feat").over(Window.partitionBy("t")))
    met = asked.join(_with_all(postings), "feat").where("t <> recipe").withColumn("_met", F.array_intersect("_want", "_has"))
    return met.where(F.get("_met", F.lit(0)) == F.col("feat")).select("t", F.col("recipe").alias("s"), F.size("_met").cast("long").alias("met"))


def having_all(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, recipe: the recipes that have all features of a query. wanted: query, feat.

    A query meets the recipes of its rarest feature only. A recipe comes there with all its features, so only answers come out.
    """
    asked = wanted.select("query", "feat").distinct()
    sizes = postings.groupBy("feat").agg(F.sum("n").alias("_n"))
    asked = asked.join(sizes, "feat", "left").groupBy("query").agg(F.collect_list("feat").alias("_want"), F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "feat"))["feat"].alias("feat"))
    return asked.join(_with_all(postings), "feat").where(F.size(F.array_except("_want", "_has")) == 0).select("query", "recipe")
