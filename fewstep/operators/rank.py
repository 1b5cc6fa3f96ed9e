"""Rankings with total orders, and their nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.plans.config import RunConfig


def ranked(pairs: DataFrame, k: int, by: str = "t", other: str = "s", score: str = "edit_score") -> DataFrame:
    """The k best others of each: score, then switch cost, then similarity, then id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "switch_cost", F.desc_nulls_last("sim"), other)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def run_mode(pairs: DataFrame, config: RunConfig, by: str = "t", other: str = "s") -> DataFrame:
    """closest ranks all pairs, few_switches those in the zone."""
    if config.mode == "few_switches":
        pairs = pairs.where("in_zone")
    return ranked(pairs, config.top_k, by, other)


def nested(rows: DataFrame, by: str = "t", other: str = "s") -> DataFrame:
    """A row per query: results, an array of structs in rank order."""
    fields = [c for c in rows.columns if c not in (by, "rank")]
    return rows.groupBy(F.col(by).alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*[x[c].alias("other_id" if c == other else c) for c in fields])).alias("results"))


def first_rows(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each, in the order of a column."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") == 1).drop("_n")


def last_rows(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each: later records replace earlier ones."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") == 1).drop("_n")


def best_rows(rows: DataFrame, by: str, score: str, fallback: str, order: str) -> DataFrame:
    """The row of the largest score (the fallback where the score is not above 0); the first of equals."""
    s = F.when(F.coalesce(F.col(score), F.lit(0.0)) > 0, F.col(score)).otherwise(F.coalesce(F.col(fallback), F.lit(0.0)))
    ranked_ = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(s), order)))
    return ranked_.where(F.col("_n") == 1).drop("_n")
