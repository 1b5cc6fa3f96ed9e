"""Comparing methods: top-1 tables, summaries, agreement, regret, disagreement, old against new runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.operators.features import in_order
from fewstep.operators.rank import first_rows
from fewstep.plans.storage import Scratch

#: Quantiles of the two summaries.
INTERPOLATED, BY_RANK = (0.1, 0.5, 0.9), (0.05, 0.25, 0.5, 0.75, 0.95)


def top1_wide(long: DataFrame, methods: list[str], values: list[str], by: list[str] | None = None, more: dict[str, list[str]] | None = None) -> DataFrame:
    """long: t, method, values. A row per target, a column per method and value; null where a method has none.

    by: columns that tell the target, if not t. more: further methods and their values; a target with those alone has no row.
    """
    columns = [(m, v) for m in methods for v in values] + [(m, v) for m, x in (more or {}).items() for v in x]
    wide = long.groupBy(*(by or ["t"])).agg(F.count_if(F.col("method").isin(methods)).alias("_n"), *[F.max(F.when(F.col("method") == m, F.col(v))).alias(f"{m}_{v}") for m, v in columns])
    return wide.where("_n > 0").drop("_n")


def quantile_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, interpolated p10, p50 and p90, min and max of the values that are there."""
    q = [F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{round(p * 100):02d}") for p in INTERPOLATED]
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by).agg(F.count("*").alias("count"), F.round(F.avg(value), 6).alias("mean"), *q, F.min(value).alias("min"), F.max(value).alias("max"))


def rank_summary(rows: DataFrame, value: str) -> DataFrame:
    """count, mean, quantiles by rank floor(p (n - 1)), min and max: one row.

    Values are counted first, so ranges of distinct values are ordered, and the ranks are those of rows.
    """
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    total = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.count("*").alias("all"))
    upto = in_order(counted, "x", F.col("n"), Scratch(rows.sparkSession, "ranks")).join(F.broadcast(total))
    q = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("all") - 1)), F.col("x"))).alias(f"p{round(p * 100):02d}") for p in BY_RANK]
    return upto.agg(F.sum("n").alias("count"), F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("mean"), *q, F.min("x").alias("min"), F.max("x").alias("max"))


def mean_of_first(rows: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """One row: how many have a first row by order, and the mean of each value over those rows."""
    first = first_rows(rows, by, order)
    return first.agg(F.count("*").alias("count"), *[F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values])


def ranked_by(pairs: DataFrame, methods: dict[str, tuple[str, str | None]], k: int) -> DataFrame:
    """method, and the columns of pairs with rank: each method's k best sources of every target, in one pass.

    methods: name -> the score that it ranks by, and the boolean column that a pair must have, if any.
    """
    out = pairs
    for m, (score, only) in methods.items():
        order = Window.partitionBy("t", *([only] if only else [])).orderBy(F.desc(score), "switch_cost", F.desc_nulls_last("sim"), "s")
        place = F.row_number().over(order)
        out = out.withColumn(f"_{m}", F.when(F.col(only), place) if only else place)
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("rank")) for m in methods]), lambda x: x["rank"] <= k))
    return out.withColumn("_of", each).select("_of.method", *pairs.columns, "_of.rank")


def placed(pairs: DataFrame, methods: dict[str, tuple[str, str | None]], k: int, by: list[str]) -> DataFrame:
    """pairs (with of, their places in lists: method, rank, value) with the places that these methods give them added, up to k.

    methods: as for ranked_by(). by: columns that tell the target; pairs that are dealt by them are not shuffled.
    """
    out = pairs
    for m, (score, only) in methods.items():
        order = Window.partitionBy(*by, *([only] if only else [])).orderBy(F.desc(score), "switch_cost", F.desc_nulls_last("sim"), "s")
        place = F.row_number().over(order)
        out = out.withColumn(f"_{m}", F.when(F.col(only), place) if only else place)
    own = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_{m}").alias("rank"), F.col(score).alias("value")) for m, (score, _) in methods.items()])
    return out.withColumn("of", F.concat("of", F.filter(own, lambda x: x["rank"] <= k))).drop(*[f"_{m}" for m in methods])


def agreement(lists: DataFrame) -> DataFrame:
    """lists: t, method, s. The mean Jaccard of two methods' lists over the targets that either has."""
    rows = Scratch(lists.sparkSession, "agreement").stash(lists.groupBy("t").agg(F.collect_set(F.struct("method", "s")).alias("lists")))
    methods = rows.select(F.explode("lists.method").alias("m")).distinct()
    return agreement_of(rows, sorted(r["m"] for r in methods.collect()))


def agreement_of(rows: DataFrame, methods: list[str]) -> DataFrame:
    """agreement() of rows that hold a target's lists (lists: an array of method and s), which are compared in their row."""
    of = lambda m: F.array_distinct(F.transform(F.filter("lists", lambda x: x["method"] == m), lambda x: x["s"]))
    lists = rows.select(*[of(m).alias(f"_{k}") for k, m in enumerate(methods)])
    pairs = [F.struct(F.lit(methods[a]).alias("method_a"), F.lit(methods[b]).alias("method_b"), F.size(f"_{a}").alias("a"), F.size(f"_{b}").alias("b"), F.size(F.array_intersect(f"_{a}", f"_{b}")).alias("both"))
             for a in range(len(methods)) for b in range(a + 1, len(methods))]
    if not pairs:
        return rows.sparkSession.createDataFrame([], "method_a string, method_b string, mean_jaccard double, targets long")
    every = lists.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("a + b > 0").withColumn("j", F.col("both") / (F.col("a") + F.col("b") - F.col("both")))
    return every.groupBy("method_a", "method_b").agg(F.round(F.avg("j"), 6).alias("mean_jaccard"), F.count("*").alias("targets"))


def regret(top1: DataFrame, best: DataFrame) -> DataFrame:
    """top1: t, method, switch_cost, edit_cost; best: t, switch_cost, edit_cost. Cost over the best source's."""
    b = best.select("t", F.col("switch_cost").alias("_s"), F.col("edit_cost").alias("_e"))
    out = top1.join(b, "t", "left").where("_s IS NOT NULL")
    return out.select("t", "method", F.round(F.col("switch_cost") - F.col("_s"), 6).alias("switch_regret"), F.round(F.col("edit_cost") - F.col("_e"), 6).alias("edit_regret"))


def rates(top1: DataFrame, min_switch_cost: float = 0.02, means: list[str] | None = None) -> DataFrame:
    """method, zone hit rate, rate of duplicates (below the least cost), targets, and the means of further columns."""
    more = [F.round(F.avg(x), 6).alias(x) for x in means or []]
    return top1.groupBy("method").agg(F.round(F.avg(F.col("in_zone").cast("double")), 6).alias("zone_rate"), F.round(F.avg((F.col("switch_cost") < min_switch_cost).cast("double")), 6).alias("duplicate_rate"), F.count("*").alias("targets"), *more)


def disagreements(one: DataFrame, best: DataFrame, max_switch_cost: float = 0.25, most: int = 50) -> DataFrame:
    """Targets whose source by one method (the most similar one, say) costs more than the best one, and 0.9 of the zone's limit or more."""
    b = best.select("t", F.col("s").alias("best_s"), F.col("switch_cost").alias("best_cost"))
    return costlier(one.join(b, "t"), max_switch_cost, most)


def side_by_side(long: DataFrame, one: str, best: str, by: list[str]) -> DataFrame:
    """long: t, s, method, value, switch_cost, one row per method. t, s, value, switch_cost of one, best_s and best_cost of best; targets with both."""
    row = lambda m: F.max(F.when(F.col("method") == m, F.struct("s", "value", "switch_cost")))
    both = long.groupBy(*by).agg(row(one).alias("a"), row(best).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("t", "a.*", F.col("b.s").alias("best_s"), F.col("b.switch_cost").alias("best_cost"))


def costlier(both: DataFrame, max_switch_cost: float = 0.25, most: int = 50, also: list[str] | None = None) -> DataFrame:
    out = both.where((F.col("switch_cost") > F.col("best_cost")) & (F.col("switch_cost") >= 0.9 * max_switch_cost))
    return out.select("t", "s", "switch_cost", "best_s", "best_cost", *(also or [])).orderBy("t").limit(most)


def duplicates(old: DataFrame, new_pairs: DataFrame, new_top: DataFrame, threshold: float = 0.02) -> DataFrame:
    """One row: of the old top-1 pairs the number, the duplicates (cost up to threshold), their percentage,
    and the removed ones: duplicates whose target has no new top-1, or another one."""
    cost = new_pairs.select("t", "s", F.col("switch_cost").alias("_cost"))
    top = new_top.select("t", F.col("s").alias("_new"))
    rows = old.select("t", "s").join(cost, ["t", "s"], "left").join(top, "t", "left")
    dup = F.coalesce(F.col("_cost") <= threshold, F.lit(False))
    out = rows.agg(F.count("*").alias("total"), F.count_if(dup).alias("duplicates"), F.count_if(dup & ~F.col("s").eqNullSafe(F.col("_new"))).alias("removed"))
    return out.withColumn("percentage", F.when(F.col("total") > 0, F.round(100 * F.col("duplicates") / F.col("total"), 6)).otherwise(0.0))


def frequencies(features: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent features: feat, times."""
    return features.groupBy("feat").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "feat").limit(n)


def target_coverage(rows: DataFrame, recipes: DataFrame) -> DataFrame:
    """The part of all recipes that have a result."""
    return rows.agg(F.count_distinct("t").alias("covered")).join(recipes.agg(F.count_distinct("recipe").alias("recipes"))).withColumn("part", F.round(F.col("covered") / F.col("recipes"), 6))


def marked(pairs: DataFrame, settings: list[F.Column]) -> DataFrame:
    """pairs with passes, whose bit k says whether the pair passes the k-th setting; pairs that pass none go."""
    if not 0 < len(settings) < 63:
        raise ValueError("a mask holds 1 to 62 settings")
    bits = [F.when(F.coalesce(x, F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, x in enumerate(settings)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return pairs.withColumn("passes", out).where("passes <> 0")


def _passes(k: int) -> F.Column:
    return F.col("passes").bitwiseAND(F.lit(1 << k).cast("long")) != 0


def ranked_by_setting(pairs: DataFrame, settings: list[F.Column], k: int) -> DataFrame:
    """setting, t, rank and the pair's columns: the k best of each target in each setting, of pairs scored once."""
    rows = marked(pairs, settings)
    which = F.filter(F.array(*[F.when(_passes(n), F.lit(n)) for n in range(len(settings))]), lambda x: x.isNotNull())
    order = Window.partitionBy("setting", "t").orderBy(F.desc("edit_score"), "switch_cost", F.desc_nulls_last("sim"), "s")
    rows = rows.withColumn("setting", F.explode(which)).drop("passes")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sweep_summary(pairs: DataFrame, settings: list[dict], tests: list[F.Column], values: list[str], digits: int = 3) -> DataFrame:
    """A row per setting: its parameters, the targets that have a source, and the means of their first sources' values.

    The pairs are read once. A target's first source in every setting is found in one aggregation, by minima over the pairs
    that pass; the means of all settings come out as one row.
    """
    order = [-F.col("edit_score"), F.col("switch_cost"), F.col("sim").isNull(), -F.col("sim"), F.col("s")]
    best = F.struct(*[x.alias(f"o{k}") for k, x in enumerate(order)], *values)
    firsts = marked(pairs, tests).groupBy("t").agg(*[F.min(F.when(_passes(k), best)).alias(f"b{k}") for k in range(len(settings))])
    row = firsts.agg(*[F.struct(F.count(f"b{k}").alias("targets"), *[F.round(F.avg(F.col(f"b{k}")[v]), digits).alias(f"mean_{v}") for v in values]).alias(f"b{k}") for k in range(len(settings))])
    told = F.explode(F.array(*[F.struct(*[F.lit(v).alias(name) for name, v in p.items()], F.col(f"b{k}").alias("_m")) for k, p in enumerate(settings)]))
    return row.select(told.alias("x")).select("x.*").select(*settings[0], "_m.*")


def first_of_methods(lists: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """lists: method, t, s, rank, value. The first source of each target by each method, with the costs of the pair."""
    return lists.where("rank = 1").join(pairs.select("t", "s", *columns), ["t", "s"])


def kept_first(old: DataFrame, new_top: DataFrame) -> DataFrame:
    """The rows of an old run's first results (t, s) whose pair a new run has first as well."""
    return old.join(new_top.select("t", "s").distinct(), ["t", "s"], "left_semi")
