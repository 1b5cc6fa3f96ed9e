"""Directional scores of pairs: t (target) from s (source).

Recall and precision are ratios of weights over shared features; a pair without a shared feature has 0,
so equi-joins on the features make every pair that can pass a gate, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.operators.features import idf, totals, weighted
from fewstep.plans.config import RunConfig
from fewstep.plans.storage import Scratch, join_small

DIGITS = 6
#: Added before costs are rounded: their seventh digit is often an exact 5, which binary numbers may fall short of.
HALF = 1e-9
#: Asked tokens that are joined at once.
SLICE_ROWS = 8_000_000


def prefixes(weighed: DataFrame, least_recall: float) -> DataFrame:
    """Of each recipe, rarest features first, those of which a source of enough recall must have one; and total.

    A source without any of them has at most the weight of the rest, which is below least_recall of all.
    Shares are rounded to DIGITS before they are compared, so a bit less than least_recall may do.
    """
    order = Window.partitionBy("recipe").orderBy(F.desc("w"), "feat").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(order), F.lit(0.0))
    total = F.sum("w").over(Window.partitionBy("recipe"))
    out = weighed.withColumn("total", total).withColumn("_rest", F.col("total") - before)
    return out.where(F.col("_rest") >= F.col("total") * (least_recall - 10**-DIGITS)).drop("_rest")


def met(weighed: DataFrame, least_recall: float, least_precision: float = 0.0) -> DataFrame:
    """t, s, common, _t, _s: every pair whose recall and precision can reach these, the weight both share and their totals.

    The rarest feature that both have is in the prefixes of both, and a pair is met there only: common is at most what either
    has from there on, and neither total can be far above the other. The rows that meet bring their recipe's features, so
    only met pairs come out and none is looked up. The weights must be those of the features.
    """
    small = 10**-DIGITS

    def side(name: str, least: float) -> DataFrame:
        rarest = Window.partitionBy("recipe").orderBy(F.desc("w"), "feat")
        all_ = rarest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.coalesce(F.sum("w").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = weighed.select(F.col("recipe").alias(name), "feat", F.collect_list("feat").over(all_).alias(f"_{name}f"), F.collect_list("w").over(all_).alias(f"_{name}w"),
                              F.sum("w").over(all_).alias(f"_{name}"), before.alias("_before"), F.row_number().over(rarest).alias(f"_{name}n"))
        rows = rows.withColumn(f"_{name}r", F.col(f"_{name}") - F.col("_before")).drop("_before")
        return rows.where(F.col(f"_{name}r") >= F.col(f"_{name}") * (least - small))

    t, s = side("t", least_recall), side("s", least_precision).drop("_sw")
    both = t.join(s, "feat").where((F.col("t") != F.col("s")) & (F.col("_sr") >= F.col("_t") * (least_recall - small)) & (F.col("_tr") >= F.col("_s") * (least_precision - small)))
    rarer = lambda x: F.slice(f"_{x}f", F.lit(1), F.col(f"_{x}n") - 1)
    both = both.where((F.col("_tn") == 1) | (F.col("_sn") == 1) | ~F.arrays_overlap(rarer("t"), rarer("s")))
    return both.select("t", "s", common("_tf", "_tw", "_sf").alias("common"), "_t", "_s")


def candidates(weighed: DataFrame, sets: DataFrame, least_recall: float, least_precision: float = 0.0) -> DataFrame:
    """t, s: every pair of met() whose source is in sets."""
    return met(weighed, least_recall, least_precision).join(sets.select(F.col("recipe").alias("s")).distinct(), "s", "left_semi").select("t", "s")


def common(feats: str, weights: str, others: str) -> F.Column:
    """The weight of those features (arrays) that the others have."""
    kept = F.zip_with(feats, weights, lambda x, w: F.when(F.array_contains(others, x), w).otherwise(0.0))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)


def profiles(weighed: DataFrame) -> DataFrame:
    """A row per recipe: items, its features and their weights in the order of the features, and total."""
    return weighed.groupBy("recipe").agg(F.sort_array(F.collect_list(F.struct("feat", "w"))).alias("items"), F.sum("w").alias("total"))


def with_common(pairs: DataFrame, weighed: DataFrame) -> DataFrame:
    """pairs with common, the target's weight of shared features, and _t and _s, the totals (null without a feature).

    Each pair is looked up twice, as a row; its features are never rows of a join.
    """
    own = profiles(weighed)
    t = own.select(F.col("recipe").alias("t"), F.col("items").alias("_ti"), F.col("total").alias("_t"))
    s = own.select(F.col("recipe").alias("s"), F.transform("items", lambda x: x["feat"]).alias("_sf"), F.col("total").alias("_s"))
    out = pairs.join(t, "t", "left").join(s, "s", "left")
    shared = F.filter("_ti", lambda x: F.array_contains("_sf", x["feat"]))
    return out.withColumn("common", F.coalesce(F.aggregate(shared, F.lit(0.0), lambda a, x: a + x["w"]), F.lit(0.0))).drop("_ti", "_sf")


def overlap(weighed: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """t, s, common: the shared weight of every pair (of among, if given) with a shared feature."""
    if among is not None:
        return with_common(among.select("t", "s"), weighed).where("common > 0").select("t", "s", "common")
    t = weighed.select(F.col("recipe").alias("t"), "feat", "w")
    s = weighed.select(F.col("recipe").alias("s"), "feat")
    return t.join(s, "feat").where("t <> s").groupBy("t", "s").agg(F.sum("w").alias("common"))


def shares(pairs: DataFrame, weighed: DataFrame, name: str, empty: float = 0.0) -> DataFrame:
    """pairs with name_recall and name_precision, as ratios() gives them, of the pairs' shared weight."""
    return _shared(with_common(pairs, weighed), name, empty)


def met_shares(weighed: DataFrame, name: str, least_recall: float, least_precision: float = 0.0, empty: float = 0.0) -> DataFrame:
    """The pairs of met() with name_recall and name_precision."""
    return _shared(met(weighed, least_recall, least_precision), name, empty)


def ratios(pairs: DataFrame, sums: DataFrame, name: str, empty: float = 0.0) -> DataFrame:
    """pairs with name_recall (common over the target's weight) and name_precision (over the source's)."""
    t = sums.select(F.col("recipe").alias("t"), F.col("total").alias("_t"))
    s = sums.select(F.col("recipe").alias("s"), F.col("total").alias("_s"))
    return _shared(pairs.join(t, "t", "left").join(s, "s", "left"), name, empty)


def _shared(out: DataFrame, name: str, empty: float) -> DataFrame:
    def ratio(total: str):
        return F.round(F.when(F.col(total) > 0, F.coalesce("common", F.lit(0.0)) / F.col(total)).otherwise(F.lit(empty)), DIGITS)

    return out.withColumn(f"{name}_recall", ratio("_t")).withColumn(f"{name}_precision", ratio("_s")).drop("common", "_t", "_s")


def credited_prefixes(weighed: DataFrame, neighbours: DataFrame, least_recall: float, exponent: float = 2.0) -> DataFrame:
    """t, token: of each target the features, or neighbours of features, one of which a source of enough soft recall has.

    Let f be the first of a target's features, rarest first, that earns a source any credit, by the token (itself or a
    neighbour) that earns most. Then the source gets at most that credit for f and all of the rest after f. Tokens for
    which even that is too little are left out. sim must not exceed 1.
    """
    order = Window.partitionBy("recipe").orderBy(F.desc("w"), "feat").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("w").over(Window.partitionBy("recipe"))
    rows = weighed.select("recipe", "feat", "w", total.alias("total"), F.coalesce(F.sum("w").over(order), F.lit(0.0)).alias("before"))
    rows = rows.where(F.col("total") - F.col("before") >= F.col("total") * (least_recall - 10**-DIGITS))
    near = neighbours.select("feat", F.col("neighbour").alias("token"), F.pow("sim", F.lit(exponent)).alias("credit"))
    own = rows.withColumn("token", F.col("feat")).withColumn("credit", F.lit(1.0))
    tokens = own.unionByName(rows.join(near, "feat"))
    rest = F.col("total") - F.col("before") - F.col("w")
    tokens = tokens.where(F.col("w") * F.col("credit") + rest >= F.col("total") * (least_recall - 10**-DIGITS))
    return tokens.select(F.col("recipe").alias("t"), "token").distinct()


def _targets(weighed: DataFrame, neighbours: DataFrame, least_recall: float, exponent: float, exact: bool) -> DataFrame:
    """t, _t, asks and, of equal length, tokens, gains, places: what earns a target credit, and how much.

    The first asks tokens come first by rank: with exact the target's own features, rarest first, else its credited prefix.
    places: twice the number of the feature (rarest first) that a token earns for, and 1 more for a neighbour of it.
    """
    near = neighbours.where("neighbour IS NOT NULL").groupBy("feat").agg(F.collect_list(F.struct(F.col("neighbour").alias("token"), F.pow("sim", F.lit(exponent)).alias("credit"))).alias("near"))
    rows = weighed.join(near, "feat", "left").repartition("recipe")
    rarest = Window.partitionBy("recipe").orderBy(F.desc("w"), "feat")
    before = F.coalesce(F.sum("w").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.select("recipe", "feat", "w", "near", F.sum("w").over(Window.partitionBy("recipe")).alias("_t"), before.alias("before"), F.row_number().over(rarest).alias("n"))
    own = F.array(F.struct(F.col("feat").alias("token"), F.lit(1.0).alias("credit"), (2 * F.col("n")).alias("place")))
    others = F.transform(F.coalesce("near", F.array()), lambda x: F.struct(x["token"].alias("token"), x["credit"].alias("credit"), (2 * F.col("n") + 1).alias("place")))
    rows = rows.select("recipe", "w", "_t", "before", F.explode(F.concat(own, others)).alias("x")).select("recipe", "w", "_t", "before", "x.*")
    gain = F.col("w") * F.col("credit")
    asked = (F.col("place") % 2 == 0) if exact else (gain + F.col("_t") - F.col("before") - F.col("w") >= F.col("_t") * (least_recall - 10**-DIGITS))
    item = F.struct((~asked).alias("later"), "place", (-F.col("credit")).alias("less"), "token", gain.alias("gain"))
    rows = rows.groupBy("recipe").agg(F.first("_t").alias("_t"), F.sort_array(F.collect_list(item)).alias("i"), F.count_if(asked).cast("int").alias("asks"))
    return rows.select(F.col("recipe").alias("t"), "_t", "asks", F.col("i.token").alias("tokens"), F.col("i.gain").alias("gains"), F.col("i.place").alias("places"))


def _sources(sets: DataFrame, weighed: DataFrame, least_precision: float) -> DataFrame:
    """s, _s, asks, feats: a source's features, rarest first, and how many of them are in its prefix (all, without a precision)."""
    if least_precision <= 0:
        own = sets.where("feat IS NOT NULL").groupBy("recipe").agg(F.collect_set("feat").alias("feats"))
        return own.select(F.col("recipe").alias("s"), F.lit(None).cast("double").alias("_s"), F.size("feats").alias("asks"), "feats")
    rarest = Window.partitionBy("recipe").orderBy(F.desc("w"), "feat")
    before = F.coalesce(F.sum("w").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = weighed.select("recipe", "feat", F.row_number().over(rarest).alias("n"), F.sum("w").over(Window.partitionBy("recipe")).alias("_s"), before.alias("before"))
    asked = F.col("_s") - F.col("before") >= F.col("_s") * (least_precision - 10**-DIGITS)
    rows = rows.groupBy("recipe").agg(F.first("_s").alias("_s"), F.count_if(asked).cast("int").alias("asks"), F.sort_array(F.collect_list(F.struct("n", "feat"))).alias("i"))
    return rows.select(F.col("recipe").alias("s"), "_s", "asks", F.col("i.feat").alias("feats"))


def _bits(tokens: F.Column) -> F.Column:
    """64 bits, one of which each token sets: sets with no bit in common have no token in common."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def soft_met(sets: DataFrame, weighed: DataFrame, neighbours: DataFrame, least_recall: float, least_precision: float = 0.0, exponent: float = 2.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """t, s, recall, common, _t, _s: every pair of least_recall or more, with credit for neighbours, and of least_precision without.

    A pair is met at the first asked token of the target that the source has, and nowhere else; the rows that meet bring all that
    recall and precision need, so only pairs that pass come out, none is made distinct or looked up. Most pairs end at a
    cheaper test: a target for which one token is too little needs a second one. Tokens are joined in slices of
    about slice_rows rows, one after the other, so the disk that the join needs does not grow with the tables. Without a
    least_precision _s is null.
    """
    scratch, small, exact = Scratch(weighed.sparkSession, "softmet"), 10**-DIGITS, least_precision > 0
    targets = scratch.stash(_targets(weighed, neighbours, least_recall, exponent, exact))
    sources = scratch.stash(_sources(sets, weighed, least_precision))
    slices = max(1, -(-(targets.agg(F.sum("asks")).first()[0] or 0) // slice_rows))
    found = []
    for k in range(slices):
        own = lambda token: F.pmod(F.xxhash64(token), F.lit(slices)) == k
        t = targets.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.col("asks"))).alias("at", "token")).where(own("token"))
        t = t.where(F.array_position("tokens", F.col("token")) == F.col("at") + 1)
        again = F.size(F.array_remove("tokens", F.col("token"))) < F.size("tokens") - 1
        enough = (F.get("gains", F.col("at")) >= F.col("_t") * (least_recall - small)) | again
        after = F.slice("tokens", F.col("at") + 2, F.size("tokens"))
        t = t.withColumn("enough", enough).withColumn("tbits", _bits(after)).drop("asks")
        s = sources.select("s", "_s", "feats", F.explode(F.slice("feats", F.lit(1), F.col("asks"))).alias("token")).where(own("token"))
        s = s.withColumn("sbits", _bits(F.array_remove("feats", F.col("token"))))
        second = (F.col("tbits").bitwiseAND(F.col("sbits")) != 0) & F.arrays_overlap(after, "feats")
        first = (F.col("at") == 0) | ~F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("at")), "feats")
        met_here = F.when(F.col("t") == F.col("s"), False).when(~F.col("enough") & ~second, False).otherwise(first)  # in this order: the cheapest first
        both = t.join(s, "token").where(met_here)
        found.append(scratch.stash(_earned(both, least_recall, least_precision)))
    scratch.drop(targets, sources)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _earned(both: DataFrame, least_recall: float, least_precision: float) -> DataFrame:
    """t, s, recall, common, _t, _s of the pairs that reach both; a feature earns by the first of its tokens that the source has."""
    items = F.zip_with(F.arrays_zip("places", "gains"), "tokens", lambda x, token: F.struct(x["places"].alias("place"), (-x["gains"]).alias("less"), token.alias("token")))
    hits = F.sort_array(F.filter(items, lambda x: F.array_contains("feats", x["token"])))
    start = F.struct(F.lit(0.0).alias("earned"), F.lit(0.0).alias("common"), F.lit(0).alias("last"))

    def add(a, x):
        again, own = F.shiftright(x["place"], 1) == a["last"], x["place"] % 2 == 0
        return F.struct(F.when(again, a["earned"]).otherwise(a["earned"] - x["less"]).alias("earned"), F.when(own, a["common"] - x["less"]).otherwise(a["common"]).alias("common"), F.shiftright(x["place"], 1).alias("last"))

    ratio = lambda part, whole: F.round(F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(0.0), DIGITS)
    got = F.aggregate(hits, start, add, lambda a: F.struct(ratio(a["earned"], "_t").alias("recall"), a["common"].alias("common"), a["earned"].alias("earned")))
    # of a target with one feature the first token that the source has earns all
    only = F.shiftright(F.array_min("places"), 1) == F.shiftright(F.array_max("places"), 1)
    gain = F.get("gains", F.col("at"))
    single = F.struct(ratio(gain, "_t").alias("recall"), F.when(F.get("places", F.col("at")) % 2 == 0, gain).otherwise(0.0).alias("common"), gain.alias("earned"))
    got = F.when(only, single).otherwise(got)
    fine = lambda x: (x["earned"] > 0) & (x["recall"] >= least_recall)
    if least_precision > 0:
        fine = lambda x: (x["recall"] >= least_recall) & (ratio(x["common"], "_s") >= least_precision)
    out = both.select("t", "s", "_t", "_s", F.inline(F.filter(F.array(got), fine)))  # a generator computes it once
    return out.select("t", "s", "recall", "common", "_t", "_s")


def soft_recall(sets: DataFrame, weighed: DataFrame, neighbours: DataFrame, exponent: float = 2.0, least_recall: float = 0.0, among: DataFrame | None = None) -> DataFrame:
    """t, s, recall of pairs with any credit: a missing feature is credited by its nearest neighbour that the source has, sim ** exponent.

    neighbours: feat, neighbour, sim (at most 1). Only pairs of least_recall or more are returned, and of among if that is given.
    With neither, the source's features spread over the neighbour edges, so that the join of all pairs stays an equi-join.
    """
    if among is None and least_recall <= 0:
        return _soft_of_all(sets, weighed, neighbours, exponent)
    if among is None:
        return soft_met(sets, weighed, neighbours, least_recall, exponent=exponent).select("t", "s", "recall")
    near = neighbours.groupBy("feat").agg(F.collect_list(F.struct("neighbour", F.pow("sim", F.lit(exponent)).alias("credit"))).alias("near"))
    items = weighed.join(near, "feat", "left").groupBy("recipe").agg(F.sort_array(F.collect_list(F.struct("feat", "w", "near"))).alias("_ti"), F.sum("w").alias("_t"))
    feats = sets.groupBy("recipe").agg(F.collect_set("feat").alias("_sf"))
    both = among.select("t", "s").join(items.withColumnRenamed("recipe", "t"), "t").join(feats.withColumnRenamed("recipe", "s"), "s")

    def credit(x):
        found = F.transform(F.filter(x["near"], lambda y: F.array_contains("_sf", y["neighbour"])), lambda y: y["credit"])
        return F.when(F.array_contains("_sf", x["feat"]), 1.0).otherwise(F.coalesce(F.array_max(found), F.lit(0.0)))

    common = F.aggregate("_ti", F.lit(0.0), lambda a, x: a + x["w"] * credit(x))
    out = both.withColumn("_c", common).where("_c > 0").select("t", "s", F.round(F.when(F.col("_t") > 0, F.col("_c") / F.col("_t")).otherwise(0.0), DIGITS).alias("recall"))
    return out.where(F.col("recall") >= least_recall)


def _soft_of_all(sets: DataFrame, weighed: DataFrame, neighbours: DataFrame, exponent: float) -> DataFrame:
    own = sets.select(F.col("recipe").alias("s"), "feat", F.lit(1.0).alias("credit"))
    near = sets.select(F.col("recipe").alias("s"), F.col("feat").alias("neighbour")).join(neighbours, "neighbour")
    near = near.select("s", "feat", F.pow("sim", F.lit(exponent)).alias("credit"))
    credit = own.unionByName(near).groupBy("s", "feat").agg(F.max("credit").alias("credit"))
    t = weighed.select(F.col("recipe").alias("t"), "feat", "w")
    common = t.join(credit, "feat").where("t <> s").groupBy("t", "s").agg(F.sum(F.col("w") * F.col("credit")).alias("common"))
    return ratios(common, totals(weighed), "ingr").select("t", "s", F.col("ingr_recall").alias("recall"))


def costs(pairs: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """pairs with the switch and edit cost, the edit score, the legacy score and whether the zone holds them."""
    miss_i, extra_i = 1 - F.col("ingr_recall"), 1 - F.col("ingr_precision")
    miss_o, extra_o = 1 - F.col("ops_recall"), 1 - F.col("ops_precision")
    gap = 1 - F.col("sim")
    out = pairs.withColumn("switch_cost", F.round(miss_i * config.a_m + extra_i * config.a_f + miss_o * config.b_m + extra_o * config.b_f + HALF, DIGITS))
    out = out.withColumn("edit_cost", F.round(F.col("switch_cost") + gap * config.c + HALF, DIGITS))
    out = out.withColumn("edit_score", F.round(F.exp(-F.col("edit_cost")), DIGITS))
    out = out.withColumn("legacy_score", F.round(F.exp(-(miss_i * config.a + miss_o * config.b + gap * config.c)), DIGITS))
    return out.withColumn("in_zone", F.col("switch_cost").between(config.min_switch_cost, config.max_switch_cost))


def masses(pairs: DataFrame) -> DataFrame:
    """pairs with what is missing and what is superfluous, as shares: miss_ingr, fa_ingr, miss_ops, fa_ops."""
    shares_ = {"miss_ingr": "ingr_recall", "fa_ingr": "ingr_precision", "miss_ops": "ops_recall", "fa_ops": "ops_precision"}
    return pairs.withColumns({name: F.round(1 - F.col(c), DIGITS) for name, c in shares_.items()})


def set_gates(config: RunConfig = RunConfig()) -> dict[str, float]:
    return {"ingr_recall": config.min_ingr_recall, "ingr_precision": config.min_ingr_precision, "ops_recall": config.min_ops_recall, "ops_precision": config.min_ops_precision}


def gate(pairs: DataFrame, config: RunConfig = RunConfig(), sim: bool = True) -> DataFrame:
    if not config.gates:
        return pairs
    for c, least in set_gates(config).items():
        if c in pairs.columns:
            pairs = pairs.where(F.col(c) >= least)
    return pairs.where(F.col("sim") >= config.min_instr_sim) if sim and "sim" in pairs.columns else pairs


def scored(heads: DataFrame, ops: DataFrame, vectors: DataFrame, config: RunConfig = RunConfig(), among: DataFrame | None = None, neighbours: DataFrame | None = None) -> DataFrame:
    """Every pair that passes the gates, with its recalls, precisions, sim and costs.

    heads, ops: recipe, feat (distinct). vectors: recipe, vec (unit length); sim is null without one.
    among: the pairs t, s that a retrieval found; all others are left out. neighbours: feat, neighbour, sim;
    with them a missing head is credited by its nearest neighbour that the source has.
    Ingredient gates come before techniques are joined, and those before the vectors are.
    """
    h = weighted(heads, idf(heads), config.tfidf_heads)
    o = weighted(ops, idf(ops), config.tfidf_ops)
    least = config.min_ingr_recall if config.gates else 0.0
    if neighbours is not None and among is None and least > 0 and config.min_ingr_precision > 0:
        soft = soft_met(heads, h, neighbours, least, config.min_ingr_precision, config.substitution_credit_exp)
        pairs = _shared(soft, "ingr", config.empty_value).withColumn("ingr_recall", F.col("recall")).drop("recall")
        scratch = Scratch(heads.sparkSession, "gated")
        pairs = scratch.stash(gate(pairs, config))
        used = scratch.stash(recipes_of(pairs))
        o, vectors = o.join(used, "recipe", "left_semi"), vectors.join(used, "recipe", "left_semi")
    elif neighbours is not None:
        soft = soft_recall(heads, h, neighbours, config.substitution_credit_exp, least, among)
        pairs = shares(soft, h, "ingr", config.empty_value).withColumn("ingr_recall", F.col("recall")).drop("recall")
    elif among is None and not config.gates:
        pairs = ratios(overlap(h), totals(h), "ingr", config.empty_value)
    elif among is not None and (not config.gates or least <= config.empty_value):
        pairs = shares(among.select("t", "s"), h, "ingr", config.empty_value)
    else:  # few pass: what is looked up next is cut to their recipes
        scratch = Scratch(heads.sparkSession, "gated")
        pairs = scratch.stash(gate(met_shares(h, "ingr", least, config.min_ingr_precision, config.empty_value), config))
        if among is not None:
            pairs = scratch.stash(join_small(among.select("t", "s"), pairs, ["t", "s"]).distinct())
        used = scratch.stash(recipes_of(pairs))
        o, vectors = o.join(used, "recipe", "left_semi"), vectors.join(used, "recipe", "left_semi")
    pairs = gate(shares(gate(pairs, config), o, "ops", config.empty_value), config)
    return gate(costs(with_sim(pairs, vectors), config), config)


def recipes_of(pairs: DataFrame) -> DataFrame:
    """recipe: each that is in a pair."""
    return pairs.select(F.explode(F.array("t", "s")).alias("recipe")).distinct()


def with_sim(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    from fewstep.functions.vectors import dot

    t = vectors.select(F.col("recipe").alias("t"), F.col("vec").alias("_tv"))
    s = vectors.select(F.col("recipe").alias("s"), F.col("vec").alias("_sv"))
    return pairs.join(t, "t", "left").join(s, "s", "left").withColumn("sim", F.round(dot(F.col("_tv"), F.col("_sv")), DIGITS)).drop("_tv", "_sv")
