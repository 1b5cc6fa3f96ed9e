"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words by water-filling its weight under a cap. Whole copies, as many
as the target has source sizes, are certain for all of a source's documents. The words that then lack are
drawn with unequal probabilities: a document's inclusion probability is proportional to the number of
binary digits of its size (mildly in favour of long documents, an empty one has none), with the factor
that makes the expected words right; documents that this would give a probability of 1 or more are certain,
and the factor is that of the rest. Pareto order sampling ranks the documents of a source by their random
odds over their inclusion odds and takes the smallest, up to a fixed size in words.

Nothing is sorted as a whole: the ranks are cut into BINS intervals whose words are added up per source,
the interval that holds the cut into BINS again, and so on LEVELS times. Only the last one is ordered row
by row: of a source with a third of all rows, a part of BINS ** -LEVELS of them.

Nulls: a null text or size counts 0 words; null is a source of its own, after all others; a null id
draws as the empty string. Ties in rank go by id, then size. Equal rows are interchangeable. Empty
tables give empty results. Other columns pass through; the operator's own are named in OWN, and an
input column of such a name is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewstep.plans.storage import Scratch, join_small
from fewstep.sources.tables import table

#: Words are runs of characters other than the six ASCII white-space characters.
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words that all sources share, as a part of the words there are, and the most copies of a source.
SHARE, MAX_COPIES = 1.5, 2
SEED = "mix-1"
BINS, LEVELS = 256, 3
_PLACES = BINS**LEVELS
OWN = ["size", "source_size", "target", "copies", "taken"]


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def draw(doc_id, seed: str = SEED) -> F.Column:
    """A uniform number in (0, 1) that depends on the seed and the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, target, whole (certain copies), rest (words to sample).

    Sources in order of cap over weight: those that reach their cap come first, and what they leave is
    shared by weight among the others, which is where resharing the excess again and again ends.
    The windows run over one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level).withColumn("nth", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("weight") * F.col("level") < F.col("cap"), F.struct("nth", "level"))).over(everything)
    per = per.withColumn("first", first)
    per = per.withColumn("target", F.when(F.col("first").isNull() | (F.col("nth") < F.col("first.nth")), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first.level"))))
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return per.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def chances(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """per (a row for each source) with factor and top: the inclusion probability is factor * digits, and 1 of more than top digits.

    The windows run over the numbers of digits of a source, at most 64.
    """
    by = sizes.withColumn("digits", _digits("size")).where("digits > 0").groupBy("source", "digits").agg(F.sum("size").alias("words"))
    by = by.join(per.select(F.col("source").alias("_source"), "rest"), by["source"].eqNullSafe(F.col("_source"))).drop("_source")
    order = Window.partitionBy("source").orderBy(F.desc("digits"))
    certain = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    weight = F.sum(F.col("digits") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    by = by.withColumn("factor", (F.col("rest") - certain) / weight).where(F.col("factor") * F.col("digits") < 1)
    by = by.groupBy("source").agg(F.max_by(F.struct("factor", "digits"), "digits").alias("best"))
    by = by.select(F.col("source").alias("_source"), "best.factor", F.col("best.digits").alias("top"))
    return per.join(by, per["source"].eqNullSafe(by["_source"]), "left").drop("_source")


def _digits(size: str) -> F.Column:
    return F.when(F.col(size) > 0, F.length(F.bin(size))).otherwise(0)


def _ranked(docs: DataFrame, per: DataFrame, id_col: str, seed: str) -> DataFrame:
    """docs with their source's columns, rank (the Pareto variable mapped to [0, 1]) and its place of BINS ** LEVELS."""
    per = per.withColumnRenamed("source", "_source")
    out = join_small(docs, per, docs["source"].eqNullSafe(per["_source"])).drop("_source")
    u, chance = draw(F.col(id_col), seed), F.col("factor") * _digits("size")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    rank = F.when((F.col("rest") <= 0) | (_digits("size") == 0), 1.0).when(_digits("size") > F.col("top"), 0.0).otherwise(odds / (1 + odds))
    out = out.withColumn("rank", F.coalesce(rank, F.lit(1.0)))
    return out.withColumn("place", F.least(F.floor(F.col("rank") * _PLACES), F.lit(_PLACES - 1)).cast("long"))


def _cuts(ranked: DataFrame, per: DataFrame) -> DataFrame:
    """per with cut (the place that holds a source's cut, or one behind all) and before (the words of the places before it)."""
    cut = per.select(F.col("source").alias("_source"), F.col("rest").alias("_rest"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        size = BINS ** (LEVELS - level)
        inside = join_small(ranked, cut, ranked["source"].eqNullSafe(cut["_source"])).where(F.floor(F.col("place") / (size * BINS)) == F.col("cut"))
        bins = inside.groupBy("source", F.floor(F.col("place") / size).alias("bin")).agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("_rest").alias("rest"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        bins = bins.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("c"))
        cut = bins.select(F.col("source").alias("_source"), F.col("c.rest").alias("_rest"), F.col("c.bin").alias("cut"), F.col("c.before").alias("before"))
    out = per.join(cut.drop("_rest"), per["source"].eqNullSafe(cut["_source"]), "left").drop("_source")
    return out.withColumn("cut", F.coalesce("cut", F.lit(_PLACES)))


def mix(docs: DataFrame, sizes: DataFrame | None = None, id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """docs (with id_col, source, and size or text) plus OWN: how many copies of each the mix takes.

    sizes: id_col, source and size of the same rows, if they are at hand as a narrow table; else they
    are written to one. The documents themselves are joined by broadcast and never shuffled, but for
    the rows of each source's last interval.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    if "size" not in docs.columns or "text" in docs.columns:
        docs = docs.withColumn("size", word_count("text"))
    docs = docs.drop(*[c for c in OWN if c != "size"])
    if sizes is None:
        sizes = scratch.stash(docs.select(id_col, "source", "size"))
    per = scratch.stash(targets(sizes, weights, share, max_copies))
    per = scratch.stash(chances(sizes, per))
    places = scratch.stash(_ranked(sizes, per, id_col, seed).select("source", "size", "place"))
    per = scratch.stash(_cuts(places, per))

    kept = [c for c in docs.columns if c not in OWN]
    ranked = _ranked(docs.withColumnsRenamed({c: f"_own_{c}" for c in kept if c not in (id_col, "source")}), per, id_col, seed)
    clear = ranked.where("place <> cut").withColumn("extra", (F.col("place") < F.col("cut")).cast("long"))
    order = Window.partitionBy("source").orderBy("rank", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = ranked.where("place = cut").withColumn("upto", F.col("before") + F.sum("size").over(order))
    edge = edge.withColumn("extra", (F.col("upto") * 2 - F.col("size") <= F.col("rest") * 2).cast("long")).drop("upto")
    out = clear.unionByName(edge).withColumn("copies", F.col("whole") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[c if c in (id_col, "source") else F.col(f"_own_{c}").alias(c) for c in kept], *OWN)


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as mix() takes it."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    sizes = Scratch(spark, "op1").stash(docs)
    return mix(sizes, sizes).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(2**52)}::DOUBLE AS u
  FROM documents),
per AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level,
         row_number() OVER (ORDER BY cap / weight, place) AS nth
  FROM weighed WINDOW earlier AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firsts AS (
  SELECT *, min(nth) FILTER (WHERE weight * level < cap) OVER () AS f FROM levels),
aimed AS (
  SELECT source, source_size,
         CASE WHEN f IS NULL OR nth < f THEN cap ELSE least(cap, weight * max(level) FILTER (WHERE nth = f) OVER ()) END AS target
  FROM firsts),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aimed),
joined AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest, CASE WHEN s.size > 0 THEN length(bin(s.size)) ELSE 0 END AS digits
  FROM sized s JOIN split p ON s.source IS NOT DISTINCT FROM p.source),
by_digits AS (SELECT source, digits, any_value(rest) AS rest, sum(size)::BIGINT AS words FROM joined WHERE digits > 0 GROUP BY source, digits),
factors AS (
  SELECT source, digits, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(digits * words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS factor
  FROM by_digits),
best AS (SELECT source, max(digits) AS top, arg_max(factor, digits) AS factor FROM factors WHERE factor * digits < 1 GROUP BY source),
odds AS (
  SELECT j.*, b.top, (j.u / (1 - j.u)) / ((b.factor * j.digits) / (1 - b.factor * j.digits)) AS q
  FROM joined j LEFT JOIN best b ON j.source IS NOT DISTINCT FROM b.source),
ranked AS (
  SELECT *, coalesce(CASE WHEN rest <= 0 OR digits = 0 THEN 1.0::DOUBLE WHEN digits > top THEN 0.0::DOUBLE ELSE q / (1 + q) END, 1.0::DOUBLE) AS rank FROM odds),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies, source
FROM (SELECT *, whole + CASE WHEN rest > 0 AND upto * 2 - size <= rest * 2 THEN 1 ELSE 0 END AS copies FROM summed)
"""
