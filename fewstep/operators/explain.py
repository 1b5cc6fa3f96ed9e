"""Why a source costs what it costs: missing and extra features, swaps, sentences and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.functions.text import fmt_list


def difference(pairs: DataFrame, weighed: DataFrame, sets: DataFrame, of: str = "t", other: str = "s", n: int | None = None) -> DataFrame:
    """t, s, feat, w: the features of one side that the other lacks, heaviest first, n of them per pair."""
    own = pairs.select("t", "s").join(weighed.select(F.col("recipe").alias(of), "feat", "w"), of)
    gone = own.join(sets.select(F.col("recipe").alias(other), "feat"), [other, "feat"], "left_anti")
    if n is not None:
        order = Window.partitionBy("t", "s").orderBy(F.desc("w"), "feat")
        gone = gone.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    return gone.select("t", "s", "feat", "w")


def explained(pairs: DataFrame, heads: DataFrame, ops: DataFrame, neighbours: DataFrame, n: int = 30, exponent: float = 2.0) -> DataFrame:
    """pairs (t, s) with what sets the two apart, as arrays of (feat, w), largest first, n at most: missing_heads, extra_heads,
    missing_ops, extra_ops, and swaps, an array of (feat, neighbour, sim).

    heads, ops: recipe, feat, w. A missing head counts by its residual, w * (1 - credit), where credit is sim ** exponent of the
    nearest of its neighbours (feat, neighbour, sim) that the source has; that one is its swap. Each pair is looked up twice, as a row.
    """
    used = pairs.select(F.explode(F.array("t", "s")).alias("recipe")).distinct()
    heads, ops = heads.join(used, "recipe", "left_semi"), ops.join(used, "recipe", "left_semi")
    near = neighbours.groupBy("feat").agg(F.collect_list(F.struct((-F.col("sim")).alias("less"), "neighbour")).alias("near"))
    own = heads.join(near, "feat", "left").groupBy("recipe").agg(F.collect_list(F.struct("feat", "w", "near")).alias("h"))
    own = own.join(ops.groupBy("recipe").agg(F.collect_list(F.struct("feat", "w")).alias("o")), "recipe", "full")
    t, s = (own.select(F.col("recipe").alias(x), F.col("h").alias(f"_{x}h"), F.col("o").alias(f"_{x}o")) for x in "ts")
    both = pairs.join(t, "t", "left").join(s, "s", "left")
    feats = lambda x: F.coalesce(F.transform(x, lambda e: e["feat"]), F.array())
    for side in ("_th", "_to", "_sh", "_so"):
        both = both.withColumn(side + "f", feats(side))

    def gone(items: str, others: str) -> F.Column:
        return F.filter(items, lambda e: ~F.array_contains(others, e["feat"]))

    def first(items, weight) -> F.Column:
        ranked = F.array_sort(F.transform(items, lambda e: F.struct((-weight(e)).alias("less"), e["feat"].alias("feat"))))
        return F.coalesce(F.transform(F.slice(ranked, 1, n), lambda e: F.struct(e["feat"].alias("feat"), (-e["less"]).alias("w"))), F.array())

    def stand_in(e) -> F.Column:
        """(-sim, neighbour) of the nearest neighbour that the source has."""
        return F.array_min(F.filter(e["near"], lambda x: F.array_contains("_shf", x["neighbour"])))

    plain = lambda e: e["w"]
    residual = lambda e: e["w"] * (1 - F.coalesce(F.pow(-stand_in(e)["less"], F.lit(exponent)), F.lit(0.0)))
    missing = gone("_th", "_shf")
    swapped = F.filter(F.transform(missing, lambda e: F.struct(stand_in(e)["less"].alias("less"), e["feat"].alias("feat"), stand_in(e)["neighbour"].alias("neighbour"))), lambda e: e["neighbour"].isNotNull())
    swapped = F.transform(F.slice(F.array_sort(swapped), 1, n), lambda e: F.struct(e["feat"].alias("feat"), e["neighbour"].alias("neighbour"), (-e["less"]).alias("sim")))
    out = both.withColumn("missing_heads", first(missing, residual)).withColumn("extra_heads", first(gone("_sh", "_thf"), plain))
    out = out.withColumn("missing_ops", first(gone("_to", "_sof"), plain)).withColumn("extra_ops", first(gone("_so", "_tof"), plain))
    return out.withColumn("swaps", F.coalesce(swapped, F.array())).drop(*[f"_{x}{k}{f}" for x in "ts" for k in "ho" for f in ("", "f")])


def swaps(missing: DataFrame, sets: DataFrame, neighbours: DataFrame) -> DataFrame:
    """t, s, feat, neighbour, sim: for a missing feature, the nearest of its neighbours that the source has."""
    near = missing.select("t", "s", "feat").join(neighbours, "feat").join(sets.select(F.col("recipe").alias("s"), F.col("feat").alias("neighbour")), ["s", "neighbour"])
    order = Window.partitionBy("t", "s", "feat").orderBy(F.desc("sim"), "neighbour")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).select("t", "s", "feat", "neighbour", "sim")


def as_list(differences: DataFrame, name: str, token: str = "feat") -> DataFrame:
    """t, s and an array of the features' tokens, heaviest first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col("feat"), F.col(token).cast("string").alias("x")))), lambda e: e["x"])
    return differences.groupBy("t", "s").agg(listed.alias(name))


def sentence(target, source, add, remove, swap=None, add_ops=None, remove_ops=None, switch=None, score=None, n: int = 3) -> F.Column:
    """From source to target: what to add, swap and remove, and what it costs."""
    c = lambda x: F.col(x) if isinstance(x, str) else x

    def piece(lead: str, items) -> F.Column:
        if items is None:
            return F.lit(None).cast("string")
        text = fmt_list(F.coalesce(c(items), F.array().cast("array<string>")), n)
        return F.when(text != "", F.concat(F.lit(lead), text))

    pieces = F.array_compact(F.array(piece("add ", add), piece("swap ", swap), piece("remove/skip ", remove), piece("add op(s): ", add_ops), piece("remove op(s): ", remove_ops)))
    body = F.when(F.size(pieces) > 0, F.array_join(pieces, "; ")).otherwise(F.lit("no major edits"))
    out = F.concat(F.lit("From "), c(source), F.lit(" to "), c(target), F.lit(": "), body)
    if switch is not None:
        figure = lambda x, digits: F.round(c(x) + 1e-9, digits).cast(f"decimal(10,{digits})").cast("string")
        out = F.concat(out, F.lit(" (switch_cost="), figure(switch, 2), F.lit(", edit_score="), figure(score, 3), F.lit(")"))
    return F.concat(out, F.lit("."))


def names(items) -> F.Column:
    """The features of an array of (feat, w), as text."""
    return F.transform(items, lambda e: e["feat"].cast("string"))


def swap_names(items) -> F.Column:
    """"x for y" of an array of (feat, neighbour, sim): the known x stands in for the wanted y."""
    return F.transform(items, lambda e: F.concat(e["neighbour"].cast("string"), F.lit(" for "), e["feat"].cast("string")))


def full_sentence(target, source) -> F.Column:
    """The sentence of a row of explained() with costs: additions, swaps, removals, techniques and what it comes to."""
    return sentence(target, source, names("missing_heads"), names("extra_heads"), swap_names("swaps"), names("missing_ops"), names("extra_ops"), "switch_cost", "edit_score")


def full_prompt(target, source, n: int = 30) -> F.Column:
    """The chat messages, as JSON text, of a row of explained() with costs; no model is called."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    listed = lambda x: F.coalesce(F.nullif(F.array_join(F.slice(x, 1, n), ", "), F.lit("")), F.lit("none"))
    costs = F.concat(F.lit("\nCost: "), F.round(F.col("switch_cost") + 1e-9, 2).cast("decimal(10,2)").cast("string"))
    said = [("Known: ", c(source)), ("\nWanted: ", c(target)), ("\nMissing: ", listed(names("missing_heads"))), ("\nExtra: ", listed(names("extra_heads"))), ("\nSwaps: ", listed(swap_names("swaps")))]
    said += [("\nTechniques to add: ", listed(names("missing_ops"))), ("\nTechniques to drop: ", listed(names("extra_ops")))]
    user = F.concat(*[x for lead, value in said for x in (F.lit(lead), value)], costs)
    system = F.lit("Say in one short paragraph how to get from the known item to the wanted one. Tell the changes only, and use only the names given.")
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


def prompt(target, source, missing, extra, n: int = 30) -> F.Column:
    """The chat messages, as JSON text, that ask for an adaptation; no model is called."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    listed = lambda x: F.coalesce(F.nullif(F.array_join(F.slice(c(x), 1, n), ", "), F.lit("")), F.lit("none"))
    user = F.concat(F.lit("Known: "), c(source), F.lit("\nWanted: "), c(target), F.lit("\nMissing: "), listed(missing), F.lit("\nExtra: "), listed(extra))
    system = F.lit("Say in two sentences how to turn the known item into the wanted one.")
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))
