"""Phrases of a dictionary in texts, longest first: each word is part of one phrase at most.

Every position of a text is tried with each length that the dictionary has, as one equi-join on the words. Of a text's matches
those are kept that a reader takes who, from left to right, takes the longest phrase that begins at a word and goes on behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.functions import text as tx
from fewstep.plans.storage import join_small

#: Letters that make up a word, in lower case; all else parts words.
WORD = "[a-z]+"
#: The most lengths (in words) that a dictionary may have: each is a look at every position.
LENGTHS = 64


def words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def dictionary(entries: DataFrame) -> DataFrame:
    """phrase (its words, one blank between them), size, canonical. entries: phrase, canonical; of entries of one phrase the
    smallest canonical form counts, entries without a word or a canonical form are left out."""
    w = words("phrase")
    rows = entries.select(F.array_join(w, " ").alias("phrase"), F.size(w).alias("size"), "canonical").where("size > 0 AND canonical IS NOT NULL")
    return rows.groupBy("phrase", "size").agg(F.min("canonical").alias("canonical"))


def taken(matches) -> F.Column:
    """Of an array of (at, size, canonical) those that a reader from left to right takes, the longest at each place."""
    longest_first = F.array_sort(F.transform(matches, lambda m: F.struct(m["at"].alias("at"), (-m["size"]).alias("less"), m["canonical"].alias("canonical"))))
    kind = "array<struct<at:int,size:int,canonical:string>>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("found"))

    def step(a, m):
        one = F.array(F.struct(m["at"].alias("at"), (-m["less"]).alias("size"), m["canonical"].alias("canonical"))).cast(kind)
        return F.when(m["at"] >= a["end"], F.struct((m["at"] - m["less"]).alias("end"), F.concat(a["found"], one).alias("found"))).otherwise(a)

    return F.aggregate(longest_first, start, step)["found"]


def match(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, found: an array of (at, size, canonical) of each text that has a phrase, in order. known: see dictionary(). Keys are unique.

    The dictionary is broadcast if it is small, else the positions are shuffled by their words.
    """
    sizes = sorted(r["size"] for r in known.select("size").distinct().limit(LENGTHS + 1).collect())
    if len(sizes) > LENGTHS:
        raise ValueError(f"phrases have more than {LENGTHS} different lengths")

    def places(n: int) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.cast("int").alias("at"), F.lit(n).alias("size")))

    w = texts.select(key, words(text).alias("_w"))
    spans = F.flatten(F.array(*[places(n) for n in sizes])) if sizes else F.array().cast("array<struct<at:int,size:int>>")
    fits = F.filter(spans, lambda x: (x["at"] >= 0) & (x["at"] + x["size"] <= F.size("_w")))
    tried = w.select(key, "_w", F.explode(fits).alias("_x")).select(key, F.array_join(F.slice("_w", F.col("_x.at") + 1, F.col("_x.size")), " ").alias("phrase"), F.col("_x.at").alias("at"), F.col("_x.size").alias("size"))
    met = join_small(tried, known.select("phrase", "canonical"), "phrase")
    return met.groupBy(key).agg(F.collect_list(F.struct("at", "size", F.col("canonical").cast("string").alias("canonical"))).alias("_m")).select(key, taken("_m").alias("found"))


def canonical_heads(lines: DataFrame, key: str, line: str, known: DataFrame) -> DataFrame:
    """key, head of ingredient lines: the canonical form of the last phrase of the dictionary in the normalised line, else its
    last word as functions.text.head() takes it; null without a word. Keys are unique."""
    rows = lines.select(key, tx.normalise_ingredient(line).alias("_line"), tx.head(line).alias("_head"))
    found = match(rows, key, "_line", known).select(key, F.element_at("found", -1)["canonical"].alias("_known"))
    return rows.join(found, key, "left").select(key, F.coalesce("_known", "_head").alias("head"))


def techniques_in(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, techniques: the distinct canonical forms of the dictionary's phrases in each text, sorted; an empty array without one."""
    found = match(texts, key, text, known).select(key, F.sort_array(F.array_distinct(F.transform("found", lambda x: x["canonical"]))).alias("techniques"))
    return texts.select(key).join(found, key, "left").select(key, F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"))
